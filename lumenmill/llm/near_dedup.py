"""MinHash near-duplicate detection with SuperMinHash signatures.

Two documents are linked when their sets of distinct 5-word shingles (A-Z lower-cased) have a
Jaccard similarity of 0.75 or more; a group is a connected component of links.

1. One pass over the texts gives each document's set size, a 128-bit fingerprint of its set, and
   a SuperMinHash signature. An element's ranks over the registers form a permutation drawn step
   by step (Fisher-Yates) together with rank-correlated values, so registers have less variance
   than independent ones; a document stops at the first step after which no later value can be
   smaller. Elements of a whole batch take each step together.
2. Documents with equal sets form a class, numbered on its own: ids are no keys. A class goes on by
   one of its texts.
3. Banding: 32 bands of 4 registers. A pair at 0.75 meets in a band but for 5 in a million.
4. Members of a bucket are first compared with one pivot, its smallest class; links are confirmed on
   the full sets. Buckets whose members are by then one component are done. The others are
   compared exactly: in small ones the pairs across components, in larger ones blocks of members,
   in which 0/1 matrix products count the intersections of all full sets; a block sends back at
   most a spanning forest of its links.
5. Components by union-find and star contraction, in the shared folder.

Defined results: null and empty texts and those without words have an empty set and no link; a
text of fewer than five words has one shingle, its whole sequence; rows that share an id, or have
none, are documents like others, and a component whose documents have no id has none either. Other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenmill.llm import textkit
from lumenmill.llm.common import discard, files, join_counted, parts, prepare, stage, table
from lumenmill.llm.graph import components

SHINGLE = 5
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
PERCENT = 75
#: Buckets up to this size are compared pair by pair; larger ones in blocks of BLOCK members.
SMALL_BUCKET, BLOCK = 4, 512
#: Bytes of text whose sets a task holds at once.
BLOCK_BYTES = 1 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, and where each text's begin (n + 1)."""
    starts, ends, firsts = textkit.word_bounds(data, offsets)
    words = textkit.hash_words(data, starts, ends, lower=True)
    grams = textkit.gram_hashes(words, SHINGLE)
    sets, whole = [], None
    for i, (a, b) in enumerate(zip(firsts[:-1], firsts[1:], strict=True)):
        if b - a >= SHINGLE:
            sets.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif b > a:
            whole = textkit.hash_sequence(words, firsts)[0] if whole is None else whole
            sets.append(whole[i : i + 1])
        else:
            sets.append(words[:0])
    return (np.concatenate(sets) if sets else words[:0]), np.cumsum([0, *map(len, sets)])


def super_minhash(flat: np.ndarray, firsts: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Signatures (n, m) of uint64: step number above a 32-bit value. Empty sets stay at the
    largest value."""
    n = len(firsts) - 1
    signature = np.full(n * m, np.iinfo(np.uint64).max, dtype=np.uint64)
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(firsts))
    element, open_docs, swaps = flat, np.unique(doc), []
    for j in range(m):
        z = textkit.mix(element + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & textkit._MASK))
        swap = ((z & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int16) + np.int16(j)
        register = swap.copy()
        for i in range(j - 1, -1, -1):  # what the earlier swaps left at that place
            register[register == swaps[i]] = i
        np.minimum.at(signature, doc * m + register, (z >> np.uint64(32)) | np.uint64(j << 32))
        done = signature.reshape(n, m)[open_docs].max(axis=1) < np.uint64((j + 1) << 32)
        if done.all():
            break
        swaps.append(swap)
        if done.any():
            closed = np.zeros(n, dtype=bool)
            closed[open_docs[done]] = True
            stay = ~closed[doc]
            element, doc, swaps = element[stay], doc[stay], [s[stay] for s in swaps]
            open_docs = open_docs[~done]
    return signature.reshape(n, m)


def band_keys(signature: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(signature), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        keys = textkit.mix(keys * np.uint64(textkit._M) + signature[:, r::ROWS][:, :BANDS])
    return textkit.mix(keys + np.arange(1, BANDS + 1, dtype=np.uint64))


def _sign(batches):
    for whole in batches:
        for batch in textkit.blocks(whole, "text", BLOCK_BYTES):
            data, offsets = textkit.text_buffer(batch.column("text"))
            flat, firsts = shingle_sets(data, offsets)
            sizes = np.diff(firsts)
            prints = []
            for salt in (0, 0x5851F42D4C957F2D):
                sums = np.zeros(len(flat) + 1, dtype=np.uint64)
                np.cumsum(textkit.mix(flat + np.uint64(salt)), out=sums[1:])
                prints.append(textkit.signed(textkit.mix(sums[firsts[1:]] - sums[firsts[:-1]])))
            keys = textkit.signed(band_keys(super_minhash(flat, firsts)))
            keys = textkit.ragged(pa.array(keys.reshape(-1)), np.arange(len(sizes) + 1) * BANDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("key"), pa.array(np.diff(offsets)), pa.array(sizes.astype(np.int64)), pa.array(prints[0]), pa.array(prints[1]), keys],
                ["id", "key", "size", "n", "f1", "f2", "bands"],
            )


def _confirm(batches):
    """Pairs (a, b, ta, tb) to those whose full sets are similar enough."""
    for whole in batches:
        for batch in textkit.blocks(whole, "ta", BLOCK_BYTES):
            fa, ia = shingle_sets(*textkit.text_buffer(batch.column("ta")))
            fb, ib = shingle_sets(*textkit.text_buffer(batch.column("tb")))
            keep = []
            for i in range(batch.num_rows):
                x, y = fa[ia[i] : ia[i + 1]], fb[ib[i] : ib[i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) * 100 >= PERCENT * max(len(x), len(y)) else 0
                keep.append(both > 0 and 100 * both >= PERCENT * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that full sets confirm."""
    left, right = texts.toDF("a", "ta"), texts.toDF("b", "tb")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(_confirm, "a long, b long")


def _open_buckets(buckets: DataFrame, forest: DataFrame, most: int) -> DataFrame:
    """(bucket, class_id, root, c) of buckets of c members that still hold more than one
    component; of buckets with the same members one."""
    grouped = buckets.select("bucket", "class_id").join(forest.toDF("class_id", "root"), "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
    sums = [F.sum(F.xxhash64("class_id", F.lit(i)).cast("decimal(38,0)")) for i in (1, 2)]
    mixed = grouped.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("c"), *[x.alias(f"f{i}") for i, x in enumerate(sums)]).filter("low <> high")
    once = mixed.groupBy("c", "f0", "f1").agg(F.min("bucket").alias("bucket")).select("bucket", "c")
    return stage(grouped.join(once, "bucket"), "near-open", most)


def _in_blocks(opened: DataFrame, texts: DataFrame) -> DataFrame:
    """Members with texts, dealt to every pair of blocks (i, j) of their bucket that holds their
    block; blocks have about BLOCK members."""
    n = F.ceil(F.col("c") / BLOCK).cast("int")
    own = opened.withColumn("own", F.pmod(F.xxhash64("class_id"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    placed = own.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("class_id").alias("id"), "root")
    key = ["bucket", "i", "j"]
    return placed.join(texts.toDF("id", "text"), "id").select(*key, "id", "root", "text").repartition(parts(texts.sparkSession), *key).sortWithinPartitions(*key, "id")


def intersections(flat: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """(n, n): sizes of the intersections of sets i < j. Rare elements are counted pair by pair,
    common ones by products of 0/1 matrices."""
    n = len(firsts) - 1
    out = np.zeros((n, n), dtype=np.float32)
    doc = np.repeat(np.arange(n), np.diff(firsts))
    order = np.argsort(flat, kind="stable")
    values, doc = flat[order], doc[order]
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([at, [len(values)]]))
    rare = 8
    for c in range(2, rare + 1):
        places = at[counts == c]
        if len(places):
            members = doc[places[:, None] + np.arange(c)]
            x, y = np.triu_indices(c, 1)
            out += np.bincount((members[:, x] * n + members[:, y]).ravel(), minlength=n * n).reshape(n, n)
    common = np.flatnonzero(counts > rare)
    for first in range(0, len(common), 4096):
        some = common[first : first + 4096]
        matrix = np.zeros((n, len(some)), dtype=np.float32)
        for column, k in enumerate(some):
            matrix[doc[at[k] : at[k] + counts[k]], column] = 1
        out += np.triu(matrix @ matrix.T, 1)
    return out


def _block_links(batches):
    """Rows sorted by (bucket, i, j): for each of those, links between components, as a forest."""

    def links(rows: list) -> pa.RecordBatch:
        ids, roots = [r[0] for r in rows], [r[1] for r in rows]
        flat, firsts = shingle_sets(*textkit.text_buffer(pa.array([r[2] for r in rows], pa.large_string())))
        size = np.diff(firsts)
        both = intersections(flat, firsts)
        top = {r: r for r in roots}

        def find(x: int) -> int:
            while top[x] != x:
                x = top[x]
            return x

        out: tuple[list, list] = ([], [])
        for i, j in zip(*np.nonzero((both > 0) & (100 * both >= PERCENT * (size[:, None] + size[None, :] - both))), strict=True):
            x, y = find(roots[i]), find(roots[j])
            if x != y:
                top[max(x, y)] = min(x, y)
                out[0].append(ids[i])
                out[1].append(ids[j])
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["a", "b"])

    key, rows = None, []
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("bucket", "i", "j", "id", "root", "text"))
        for bucket, i, j, *row in zip(*columns, strict=True):
            if (bucket, i, j) != key:
                if rows:
                    yield links(rows)
                key, rows = (bucket, i, j), []
            rows.append(row)
    if rows:
        yield links(rows)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_shingles, component_id, kept, class_id (a number of the
    texts with the same set, null without one)."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    signed = stage(source.mapInArrow(_sign, "id long, key long, size long, n long, f1 long, f2 long, bands array<long>"), "near-signatures")
    total, size = signed.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    spark = docs.sparkSession
    by_row, by_band, by_text = files(spark, total), files(spark, total * BANDS), files(spark, total, size)

    same = ["n", "f1", "f2"]
    groups = signed.filter("n > 0").groupBy(*same)
    classes = groups.agg(F.min("id").alias("least"), F.min("key").alias("key"), F.count(F.lit(1)).alias("c"), F.first("bands").alias("bands"))
    classes = stage(classes.select(F.monotonically_increasing_id().alias("class_id"), *same, "least", "key", "c", "bands"), "near-classes", by_row)

    entries = classes.select("class_id", F.explode(F.array_distinct("bands")).alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.min("class_id").alias("pivot")).filter("c > 1")
    shared = stage(shared, "near-shared", by_band)
    buckets = join_counted(entries, shared, ["bucket"], total * BANDS)
    buckets = stage(buckets.select("bucket", "class_id", "pivot"), "near-buckets", by_band)
    candidates = stage(classes.join(buckets.select("class_id").distinct(), "class_id").select("class_id", "key", "c"), "near-candidates", by_row)
    texts = join_counted(source.select("key", "text"), candidates, ["key"], total).select("class_id", "text").distinct()
    texts = stage(texts, "near-texts", by_text)

    pairs = stage(buckets.filter("class_id <> pivot").select(F.col("pivot").alias("a"), F.col("class_id").alias("b")).distinct(), "near-pairs", by_band)
    forest = components(_linked(pairs, texts), by_row)
    opened = _open_buckets(buckets, forest, by_band)
    if not opened.isEmpty():
        few = opened.filter(F.col("c") <= SMALL_BUCKET).select("bucket", "class_id", "root")
        other = few.toDF("bucket", "b", "rb")
        more = few.toDF("bucket", "a", "ra").join(other, "bucket").filter("a < b and ra <> rb").select("a", "b").distinct()
        more = stage(more.join(pairs, ["a", "b"], "left_anti"), "near-pairs", by_band)
        blocks = _in_blocks(opened.filter(F.col("c") > SMALL_BUCKET), texts)
        # the forest stands for the links it was made of
        links = forest.toDF("a", "b").union(_linked(more, texts)).union(blocks.mapInArrow(_block_links, "a long, b long"))
        forest = components(links, by_row)
        discard(more)

    # the smallest id of each component, whatever number its smallest class has
    rooted = classes.select("class_id", *same, "least", "c").join(forest.toDF("class_id", "root"), "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = stage(rooted.join(smallest, "root").select(*same, "c", "class_id", "component_id"), "near-components", by_row)
    columns = ["id", "n", "class_id", "component_id"]
    out = join_counted(signed.filter("n > 0").select("id", *same), found, same, total).select(*columns)
    out = out.unionByName(signed.filter("n = 0").select("id", "n", F.lit(None).cast("long").alias("class_id"), F.col("id").alias("component_id")))
    discard(pairs, texts, buckets, shared, candidates, opened)
    return out.coalesce(by_row).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "class_id")


def op6_superminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op6_superminhash_dedup": op6_superminhash_dedup}

ORACLES = {
    "op6_superminhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)
), edge AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a
), comp AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN n USING (doc_id)
"""
}
