"""Removal of word passages that occur again anywhere, by level-wise doubling of windows.

A window of WINDOW consecutive words is repeated if its word sequence also starts at another
place, in the same text or another. Windows repeated at one length alone are extended to twice
that length (from START, 18; the last doubling stops at WINDOW, 35), until no candidates are left:

1. At the first length only one part of each full window is kept, the one with the smallest hash
   (the leftmost of equals): two equal full windows keep equal parts, so counting those, about one
   in nine places, loses nothing. Parts that occur once die.
2. At each further length the full windows whose kept part lives are candidates; of them, too, one
   part of that length is kept, counted, and dies if it occurs once. Only texts with candidates go
   on, and the loop ends where there are none.
3. At the last length the part is the window itself: those that occur twice or more are the repeated
   windows, and mark their words.

Texts with equal word sequences are found first and form a class, which is worked on once; one of
two rows or more is wholly repeated. Counts combine before every shuffle. A part or class that
has more than a 20,000th of all rows is looked up by broadcast (there are 20,000 such at most), so
a passage in a third of all texts gathers in no task. Sequences and windows are compared by 128-bit
hashes, parts by 64-bit ones.

Defined results: a null text has no words; texts shorter than WINDOW lose nothing; judged is the
input, not what is left. Ids are not keys: every row is served by its text, so rows that share an
id, or have none, are rows like others. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenmill.llm import textkit
from lumenmill.llm.common import discard, join_counted, prepare, stage, table

WINDOW, START = 35, 18
_SALT = np.uint64(0x9FB21C651E98DF25)


def _leftmost_min(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values the place of its smallest, the leftmost of equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best, have = np.arange(len(values), dtype=np.int64), 1
    while have < width:
        step = min(have, width - have)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(values[a] <= values[b], a, b)
        have += step
    return best


def lengths(window: int, start: int) -> list[int]:
    """The lengths of the levels: start, doubled until the window is reached."""
    out = [min(start, -(-window // 2))]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a batch's texts and where each text's begin (n + 1)."""
    data, offsets = textkit.text_buffer(batch.column("text"))
    starts, ends, firsts = textkit.word_bounds(data, offsets)
    return textkit.hash_words(data, starts, ends, lower=False), firsts


def _parts(words: np.ndarray, firsts: np.ndarray, window: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each full window that lies in one text its start and the place of its kept part, and the
    hashes of all parts."""
    parts = textkit.gram_hashes(words, length)
    kept = _leftmost_min(parts, window - length + 1)
    text_end = np.repeat(firsts[1:], np.diff(firsts))[: len(kept)]
    at = np.flatnonzero(np.arange(len(kept)) + window <= text_end)
    return at, kept[at], parts


def _lists(values: np.ndarray, places: np.ndarray, firsts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Sorted places of a batch as a list for each text: their values, and the places in the text."""
    of = np.searchsorted(places, firsts)
    base = np.repeat(firsts[:-1], np.diff(of))
    return textkit.ragged(pa.array(values), of), textkit.ragged(pa.array((places - base).astype(np.int32)), of)


def _first_level(window: int, length: int):
    def run(batches):
        for whole in batches:
            for batch in textkit.blocks(whole, "text"):
                words, firsts = _words(batch)
                _, kept, hashes = _parts(words, firsts, window, length)
                kept = np.unique(kept)
                s1, s2 = textkit.hash_sequence(words, firsts)
                texts = batch.column("text").fill_null("").to_pylist()
                sha = [hashlib.sha256(b" ".join(t.encode().split())).hexdigest() for t in texts]
                part, at = _lists(textkit.signed(hashes[kept]), kept, firsts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("key"), pa.array(np.diff(firsts)), pa.array(textkit.signed(s1)), pa.array(textkit.signed(s2)), pa.array(sha), part, at],
                    ["id", "key", "n_words", "s1", "s2", "sha", "part", "at"],
                )

    return run


def _next_level(window: int, before: int, length: int):
    """From the parts alive at one length to those kept at the next; for the window itself a second
    hash comes beside the first. Rows whose text isn't the class's own (a hash that met) go."""

    def run(batches):
        for whole in batches:
            for batch in textkit.blocks(whole, "text"):
                words, firsts = _words(batch)
                s1, s2 = textkit.hash_sequence(words, firsts)
                own = (textkit.signed(s1) == batch.column("s1").to_numpy()) & (textkit.signed(s2) == batch.column("s2").to_numpy())
                at, kept, _ = _parts(words, firsts, window, before)
                lists = batch.column("at").filter(pa.array(own))
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                alive = np.zeros(len(words) + 1, dtype=bool)
                alive[lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(firsts[:-1][own], sizes)] = True
                at = at[alive[kept]]
                if length == window:
                    hashes, places = textkit.gram_hashes(words, window), at
                    more = textkit.gram_hashes(textkit.mix(words + _SALT), window)[at]
                else:
                    starts, kept, hashes = _parts(words, firsts, window, length)
                    places = np.unique(kept[np.searchsorted(starts, at)])
                    more = np.zeros(len(places), np.uint64)
                part, place = _lists(textkit.signed(hashes[places]), places, firsts)
                second, _ = _lists(textkit.signed(more), places, firsts)
                out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("class", "weight", "s1", "s2", "text")), part, second, place], ["class", "weight", "s1", "s2", "text", "part", "second", "at"])
                yield out.filter(pa.array(own & (np.diff(np.searchsorted(places, firsts)) > 0)))

    return run


def _cut(window: int):
    def run(batches):
        for whole in batches:
            for batch in textkit.blocks(whole, "text"):
                out = []
                for text, at in zip(batch.column("text").to_pylist(), batch.column("at"), strict=True):
                    words = (text or "").encode().split()
                    change = np.zeros(len(words) + 1, dtype=np.int32)
                    at = at.values.to_numpy(zero_copy_only=False)
                    np.add.at(change, at, 1)
                    np.subtract.at(change, at + window, 1)
                    gone = np.cumsum(change)[:-1] > 0
                    kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                    out.append((int(gone.sum()), kept.decode()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("class"), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.large_string()).cast(pa.string())],
                    ["class", "n_removed", "kept_text"],
                )

    return run


def _alive(level: DataFrame, on: list[str], name: str) -> DataFrame:
    """Of a staged level (class, weight, and `on` and at as lists) the places of parts that occur
    twice or more: class, at as a list."""
    zipped = F.expr(f"inline(arrays_zip({', '.join([*on, 'at'])}))")
    counts = level.select("weight", zipped).groupBy(*on).agg(F.sum("weight").alias("twice"), F.count(F.lit(1)).alias("c"))
    counts = stage(counts.filter("twice > 1").drop("twice"), f"substring-{name}-counts")
    total = level.agg(F.coalesce(F.sum(F.size("at")), F.lit(0))).first()[0]
    found = join_counted(level.select("class", zipped), counts, on, total).groupBy("class").agg(F.collect_list("at").alias("at"))
    found = stage(found, f"substring-{name}")
    discard(counts)
    return found


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, start: int = START) -> DataFrame:
    """One row per row of docs: the id, n_words, n_removed, kept_sha256, and kept_text where
    words went (null where the text stays as it is or goes as a whole)."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    schema = "id long, key long, n_words long, s1 long, s2 long, sha string, part array<long>, at array<int>"
    levels = lengths(window, start)
    first = stage(source.mapInArrow(_first_level(window, levels[0]), schema), "substring-first")
    total = first.count()

    same = ["n_words", "s1", "s2"]
    some = first.filter(F.col("n_words") >= window).groupBy(*same)
    classes = some.agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("c"), F.first("part").alias("part"), F.first("at").alias("at"))
    weight = F.least("c", F.lit(2)).cast("long").alias("weight")
    classes = stage(classes.select(F.monotonically_increasing_id().alias("class"), *same, "key", "c", weight, "part", "at"), "substring-classes")

    living = _alive(classes, ["part"], "level-0")
    columns = ["class", "weight", "s1", "s2", "text", "at"]
    keys = stage(living.join(classes.select("class", "weight", "key", "c", "s1", "s2"), "class"), "substring-keys")
    joined = join_counted(source.select("key", "text"), keys, ["key"], total)  # one row for each class of weight one
    copies = joined.filter("weight > 1").select("class", "text").distinct().join(keys.drop("key", "c"), "class")
    now = joined.filter("weight = 1").select(*columns).unionByName(copies.select(*columns))
    schema = "class long, weight long, s1 long, s2 long, text string, part array<long>, second array<long>, at array<int>"
    for i, (before, length) in enumerate(zip(levels[:-1], levels[1:], strict=True), 1):
        level = stage(now.mapInArrow(_next_level(window, before, length), schema), "substring-texts")
        discard(living)
        living = _alive(level, ["part", "second"], f"level-{i}")
        if i > 1:
            discard(last)
        last = level
        now = level.select("class", "weight", "s1", "s2", "text").join(living, "class")
        if living.isEmpty():
            break
    cut = now.filter("weight = 1").select("class", "text", "at").mapInArrow(_cut(window), "class long, n_removed long, kept_text string")
    whole = classes.filter("weight > 1").select("class", F.col("n_words").alias("n_removed"), F.lit(None).cast("string").alias("kept_text"))
    lost = stage(classes.select(*same, "class", "c").join(cut.unionByName(whole), "class").drop("class").withColumnRenamed("n_removed", "gone"), "substring-cut")
    discard(living, last)

    out = join_counted(first.filter(F.col("n_words") >= window), lost, same, total, "left")
    columns = ["id", "n_words", "sha", "gone", "kept_text"]
    out = out.select(*columns).unionByName(first.filter(F.col("n_words") < window).select("id", "n_words", "sha", F.lit(None).cast("long").alias("gone"), F.lit(None).cast("string").alias("kept_text")))
    sha = F.when(F.col("gone").isNull(), F.col("sha")).otherwise(F.sha2(F.coalesce("kept_text", F.lit("")), 256))
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed"), sha.alias("kept_sha256"), "kept_text")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {"op7_substring_dedup": op7_substring_dedup}

ORACLES = {
    "op7_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), p AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS g FROM w, unnest(range(1, len(ws) - 33)) AS r(i)
), twice AS (
  SELECT g FROM p GROUP BY g HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM p SEMI JOIN twice USING (g)
), one AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n FROM one ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
}
