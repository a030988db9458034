"""Language identification by the nearest of several centroids per language.

Texts become TF-IDF vectors of hashed byte 2-, 3- and 4-grams (A-Z lower-cased, other ASCII
non-letters as one space class), normalised. Each language's training vectors are clustered by
spherical k-means into CENTROIDS centroids; a text takes the language of the centroid with the
largest cosine. It is rejected if it has no letter, or if that cosine is below REJECT of the
language's low quantile: that of the cosines of training rows to centroids of the language's
other half of rows. Texts under FULL bytes have fewer grams to match, so their limit is less in
proportion; strings of a few letters, and short runs of digits and letters, can't be told from
words that way and stay.

The classifier is fitted on a sample of about SAMPLE rows of each language, drawn by hash of the
id; that bound is a parameter. Only sparse vectors of the sample reach the driver. Predictions
use whole texts and nothing but the text.

Defined results: text null or without a letter gives ``und``, score 0, rejected; without any
training row all are ``und``; rows of null id or repeated rows are treated like others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenmill.llm import textkit
from lumenmill.llm.common import prepare, remainder, table

DIM_BITS = 15
DIM = 1 << DIM_BITS
SAMPLE = 600
CENTROIDS = 4
#: A text is rejected below this part of its language's QUANTILE of cosines.
REJECT, QUANTILE = 0.5, 0.01
#: Bytes from which the whole limit holds.
FULL = 64
#: Texts whose counts are held at once, and of them those that are counted at once.
ROWS, COUNTED = 128, 16

_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[:128] = 32
_CLASS[65:91] = np.arange(97, 123)
_CLASS[97:123] = np.arange(97, 123)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts (n, DIM) of hashed n-grams of each text."""
    n = len(offsets) - 1
    out = np.zeros((n, DIM), dtype=np.float32)
    if not len(data):
        return out
    at = 0
    while at < n:
        to = min(n, at + COUNTED, max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 20), side="right")) - 1))
        part, ends = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at, first = to, at
        if not len(part):
            continue
        c = _CLASS[part]
        row = np.repeat(np.arange(to - first, dtype=np.int64) * DIM, np.diff(ends))
        left = np.repeat(ends[1:], np.diff(ends)) - np.arange(len(part))  # bytes to the text's end
        key = c.copy()
        total = np.zeros((to - first) * DIM, dtype=np.int64)
        for k in (2, 3, 4):
            key = key[:-1] * np.uint32(257) + c[k - 1 :]
            ok = left[: len(key)] >= k
            slot = (key * np.uint32(2654435761) + np.uint32(k * 40503)) >> np.uint32(32 - DIM_BITS)
            total += np.bincount(row[: len(key)][ok] + slot[ok], minlength=len(total))
        out[first:to] = total.reshape(-1, DIM)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter; texts without an ASCII one are looked at as Unicode."""
    sums = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(_LETTER[data], out=sums[1:])
    found = sums[offsets[1:]] > sums[offsets[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in bytes(data[offsets[i] : offsets[i + 1]]).decode(errors="replace"))
    return found


def _sparse(batches):
    for whole in batches:
        for batch in (b.slice(i, ROWS) for b in textkit.blocks(whole, "text", 1 << 20) for i in range(0, b.num_rows, ROWS)):
            counts = gram_counts(*textkit.text_buffer(batch.column("text")))
            rows, slots = np.nonzero(counts)
            firsts = np.searchsorted(rows, np.arange(len(counts) + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), textkit.ragged(pa.array(slots.astype(np.int16)), firsts), textkit.ragged(pa.array(counts[rows, slots]), firsts)], ["lang", "slots", "counts"]
            )


class Model:
    """Languages, idf, centroids (one row each, with the language's index), limits of cosines."""

    def __init__(self, languages: list[str], idf: np.ndarray, centroids: np.ndarray, owner: np.ndarray, limits: np.ndarray):
        self.languages, self.idf, self.centroids, self.owner, self.limits = languages, idf, centroids, owner, limits

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language index (-1: none), score, rejected."""
        has = _has_letter(data, offsets)
        if not self.languages:
            return np.full(len(has), -1), np.zeros(len(has)), np.ones(len(has), bool)
        scaled = (self.centroids * self.idf).T
        cosines = np.concatenate([self._cosines(data, offsets[i : i + ROWS + 1], scaled) for i in range(0, len(has), ROWS)]) if len(has) else np.zeros((0, len(self.owner)))
        best = cosines.argmax(axis=1)
        score = np.clip(cosines[np.arange(len(best)), best].astype(np.float64), 0, 1)
        lang = self.owner[best]
        rejected = ~has | (score < self.limits[lang] * np.minimum(1, np.diff(offsets) / FULL))
        return np.where(has, lang, -1), np.where(has, score, 0.0), rejected

    def _cosines(self, data: np.ndarray, offsets: np.ndarray, scaled: np.ndarray) -> np.ndarray:
        counts = gram_counts(data[offsets[0] : offsets[-1]], offsets - offsets[0])
        rows, slots = np.nonzero(counts)
        values = np.log1p(counts[rows, slots])
        counts[rows, slots] = values
        size = np.sqrt(np.bincount(rows, (values * self.idf[slots]).astype(np.float64) ** 2, len(counts)))
        return (counts @ scaled) / np.maximum(size, 1e-12)[:, None]


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from far apart first centroids; deterministic."""
    picked = [int((x @ x.mean(axis=0)).argmax())]
    while len(picked) < min(k, len(x)):
        near = (x @ x[picked].T).max(axis=1)
        if near.min() > 1 - 1e-6:
            break
        picked.append(int(near.argmin()))
    centroids = x[picked]
    for _ in range(10):
        own = (x @ centroids.T).argmax(axis=1)
        member = (own == np.arange(len(centroids))[:, None]).astype(np.float32)
        sums = member @ x  # no copy of the rows is made
        centroids = _unit(np.where(member.any(axis=1)[:, None], sums, centroids))
    return centroids


def _fit_language(sparse: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> tuple[np.ndarray, float]:
    """Centroids and limit from the slots and counts of a language's rows, whose vectors are dense
    in the slots that any of them has."""
    seen = np.zeros(DIM, bool)
    for slots, _ in sparse:
        seen[slots] = True
    used = np.flatnonzero(seen)
    place = np.cumsum(seen) - 1
    own = np.zeros((len(sparse), len(used)), np.float32)
    for k, (slots, values) in enumerate(sparse):
        values = np.log1p(values) * idf[slots]
        own[k, place[slots]] = values / max(float(np.linalg.norm(values)), 1e-12)
    if not len(own):
        return np.zeros((0, DIM), np.float32), 0.0
    found, limit = _cluster(own, CENTROIDS), 0.0
    if len(own) > 1:
        share = np.minimum(1, (np.array([values.sum() for _, values in sparse]) / 3 + 2) / FULL)  # a text of n bytes has 3 n - 6 grams
        halves = own[::2], own[1::2]
        cosines = np.concatenate([(y @ _cluster(x, CENTROIDS).T).max(axis=1) for x, y in (halves, halves[::-1])])
        limit = REJECT * max(0.0, float(np.quantile(cosines / np.concatenate([share[1::2], share[::2]]), QUANTILE)))
    centroids = np.zeros((len(found), DIM), np.float32)
    centroids[:, used] = found
    return centroids, limit


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on about `sample` rows of each language, drawn by a hash of the id."""
    rows = train.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.ones(DIM, np.float32), np.zeros((0, DIM), np.float32), np.zeros(0, int), np.zeros(0))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.create_map(*[F.lit(v) for lang in languages for v in (lang, min(1.0, sample / counts[lang]))])
    picked = rows.filter(draw < rate[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    got = picked.mapInArrow(_sparse, "lang string, slots array<short>, counts array<float>").limit(2 * sample * len(languages)).toArrow()
    labels = np.array(got.column("lang").to_pylist(), dtype=object)
    sparse = [(x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)) for x, y in zip(got.column("slots"), got.column("counts"), strict=True)]
    order = np.lexsort((np.array([(x + 1.0) @ y for x, y in sparse]), labels.astype(str)))
    seen = np.zeros(DIM, np.int64)
    for slots, _ in sparse:
        seen[slots] += 1
    idf = (np.log((1 + len(labels)) / (1 + seen)) + 1).astype(np.float32)
    model = Model(languages, idf, np.zeros((0, DIM), np.float32), np.zeros(0, int), np.zeros(len(languages)))
    parts, owner = [], []
    for i, lang in enumerate(languages):  # one at a time: dense vectors of one language are held
        centroids, limit = _fit_language([sparse[k] for k in order if labels[k] == lang and len(sparse[k][0])], idf)
        if len(centroids):
            parts.append(centroids)
            owner += [i] * len(centroids)
        model.limits[i] = limit
    model.centroids, model.owner = (np.concatenate(parts), np.array(owner)) if parts else (model.centroids, model.owner)
    if not parts:
        model.languages = []
    return model


def _predictor(model: Model):
    def run(batches):
        names = pa.array([*model.languages, "und"], pa.string())
        for whole in batches:
            for batch in textkit.blocks(whole, "text", 2 << 20):
                lang, score, rejected = model.predict(*textkit.text_buffer(batch.column("text")))
                lang = names.take(pa.array(np.where(lang < 0, len(model.languages), lang)))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), lang, pa.array(score), pa.array(rejected)], ["id", "held_out", "lang_pred", "score", "rejected"])

    return run


def _keeper(model: Model, text_col: str):
    def run(batches):
        for whole in batches:
            for batch in textkit.blocks(whole, text_col, 2 << 20):
                rejected = model.predict(*textkit.text_buffer(batch.column(text_col)))[2]
                yield batch.filter(pa.array(~rejected))

    return run


def identify(docs: DataFrame, model: Model, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, held_out, lang_pred, score, rejected."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    out = source.mapInArrow(_predictor(model), "id long, held_out boolean, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text the model doesn't reject."""
    return docs.mapInArrow(_keeper(model, text_col), docs.schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    return identify(docs, fit(docs.filter(~held_out)), held_out)


QUERIES = {"op4_language_id": op4_language_id}
