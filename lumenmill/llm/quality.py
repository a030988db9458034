"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

Each whole text becomes STATS statistics (shares of character classes, word and line figures,
repetition). Standardised, they pass through FEATURES random Fourier features, which approximate
a Gaussian kernel; every partition sums its part of the normal equations, the parts are added
row by row on the executors, and the driver solves one system of fixed size. Raw scores of the
labelled rows that the regression did not see are counted in BINS bins and made monotone by
pool-adjacent-violators. All labelled rows are used; what the driver gets has a fixed size.

Defined results: a null or empty text has the statistics of an empty text; rows labelled null
teach nothing; without labels of both kinds every score is the labels' mean (0.5 if none); ids
may be null or repeated (labels are matched by id; a null id matches none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenmill.llm import textkit
from lumenmill.llm.common import parts, prepare, remainder, stage, table

FEATURES = 256
RIDGE = 1.0
BINS = 512
#: Classes of bytes: 0 other ASCII, 1 lower case, 2 upper case, 3 digit, 4 space, 5 newline, 6 beyond ASCII, 7 sentence marks, 8 bars, 9 exclamation and question marks, 10 symbols.
_KIND = np.zeros(256, dtype=np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 6
_KIND[[9, 11, 12, 13, 32]], _KIND[10] = 4, 5
_KIND[[ord(c) for c in ".,;:'-\"()"]] = 7
_KIND[ord("|")] = 8
_KIND[[ord(c) for c in "!?"]] = 9
_KIND[[ord(c) for c in "#$%&*<>=/\\{}[]^_~@+`"]] = 10
_KINDS = 11
STATS = _KINDS + 13


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(n, STATS) statistics of texts."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    kind = _KIND[data]
    counts = np.bincount(np.repeat(np.arange(n) * _KINDS, sizes) + kind, minlength=n * _KINDS).reshape(n, _KINDS) if len(data) else np.zeros((n, _KINDS))
    length = np.maximum(sizes, 1)
    share = counts / length[:, None]
    starts, ends, firsts = textkit.word_bounds(data, offsets)
    words, n_words = textkit.hash_words(data, starts, ends, lower=True), np.diff(firsts)
    many = np.maximum(n_words, 1)

    def per_text(values: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(values) + 1)
        np.cumsum(values, out=sums[1:])
        return (sums[firsts[1:]] - sums[firsts[:-1]]) / many

    def in_words(which: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(which, out=sums[1:])
        return sums[ends] - sums[starts]

    size = (ends - starts).astype(np.float64)
    upper, strange = in_words(kind == 2), in_words((kind >= 8) | (kind == 3))
    mean = per_text(size)
    distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(firsts[:-1], firsts[1:], strict=True)]) / many
    same_next = np.zeros(len(words))
    same_next[:-1] = words[1:] == words[:-1]
    present = np.where(share > 0, share, 1.0)
    more = [
        np.log1p(sizes), np.log1p(n_words), mean, np.sqrt(np.maximum(per_text(size**2) - mean**2, 0)), distinct * np.log1p(n_words), per_text((upper == size) & (size > 1)), per_text(strange > 0),
        per_text(size == 1), per_text(size > 15), per_text(same_next), -(share * np.log(present)).sum(axis=1), counts[:, 5] / many, per_text(in_words(kind == 7) > 0),
    ]
    return np.column_stack([np.log(share + 1e-4), *more])


def _measure(batches):
    for whole in batches:
        for batch in textkit.blocks(whole, "text", 2 << 20):
            x = statistics(*textkit.text_buffer(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("fold"), textkit.ragged(pa.array(x.reshape(-1)), np.arange(len(x) + 1) * STATS)], ["id", "fold", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, STATS))


class Model:
    """Standardisation, features, weights and the calibration's steps."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = rng.normal(size=(STATS, FEATURES)) / np.sqrt(STATS)
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.steps = (np.array([0.0, 1.0]), np.array([0.5, 0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -8, 8) @ self.w + self.b
        return np.column_stack([np.ones(len(x)), np.sqrt(2 / FEATURES) * np.cos(z)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.steps), 0.0, 1.0)


def _normal_parts(model: Model):
    """A partition's sums of z z' and z y, one row for each feature."""

    def run(batches):
        sums = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z = model.features(_matrix(batch.column("x")))
            y = batch.column("y").to_numpy(zero_copy_only=False)
            sums += z.T @ np.column_stack([z, y])
        width = FEATURES + 2
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), textkit.ragged(pa.array(sums.reshape(-1)), np.arange(len(sums) + 1) * width)], ["i", "sums"])

    return run


def _add_rows(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, row in zip(batch.column("i").to_pylist(), batch.column("sums"), strict=True):
            values = row.values.to_numpy(zero_copy_only=False)
            total[i] = total[i] + values if i in total else values.copy()
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["i", "sums"])


def _bins(model: Model):
    def run(batches):
        for batch in batches:
            raw = np.clip(model.raw(_matrix(batch.column("x"))), -0.5, 1.5)
            yield pa.RecordBatch.from_arrays([pa.array(np.floor((raw + 0.5) / 2 * BINS).astype(np.int32)), batch.column("y")], ["bin", "y"])

    return run


def pool(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Isotonic means by pool-adjacent-violators."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def fit(labelled: DataFrame, calibration: Column) -> Model:
    """labelled: x, y (0 or 1) and what the calibration condition names."""
    columns = [F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(STATS)] + [F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(STATS)]
    row = labelled.agg(*columns, F.avg("y").alias("y"), F.count("y").alias("n")).first()
    if not row["n"]:
        return Model(np.zeros(STATS), np.ones(STATS))
    model = Model(np.array(row[:STATS]), np.array(row[STATS : 2 * STATS]))
    model.steps = (np.array([0.0, 1.0]), np.full(2, row["y"]))
    partial = labelled.filter(~calibration).select("x", "y").mapInArrow(_normal_parts(model), "i int, sums array<double>")
    whole = partial.repartition(min(8, parts(labelled.sparkSession)), "i").mapInArrow(_add_rows, "i int, sums array<double>").toArrow()
    sums = np.zeros((FEATURES + 1, FEATURES + 2))
    for i, values in zip(whole.column("i").to_pylist(), whole.column("sums"), strict=True):
        sums[i] = values.values.to_numpy(zero_copy_only=False)
    penalty = RIDGE * np.eye(FEATURES + 1)
    penalty[0, 0] = 1e-9
    model.weights = np.linalg.solve(sums[:, :-1] + penalty, sums[:, -1])
    counted = labelled.filter(calibration).select("x", "y").mapInArrow(_bins(model), "bin int, y double").groupBy("bin").agg(F.sum("y").alias("y"), F.count("y").alias("n"))
    got = sorted((r["bin"], r["y"], r["n"]) for r in counted.collect())
    if got:
        at, y, n = (np.array(v, dtype=float) for v in zip(*got, strict=True))
        smooth = pool((y + 0.5 * row["y"]) / (n + 0.5), n)
        model.steps = ((at + 0.5) * 2 / BINS - 0.5, smooth)
    return model


def _scorer(model: Model):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("fold"), pa.array(model.score(_matrix(batch.column("x"))))], ["id", "fold", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, fold: Column, held_out: int, calibration: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = 0.3) -> DataFrame:
    """One row per row of docs: the id, held_out, score, predicted. Rows of fold `held_out` teach
    nothing; those of `calibration` teach the calibration, the others the regression."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), fold.cast("int").alias("fold"), F.col(text_col).alias("text"))
    measured = stage(source.mapInArrow(_measure, "id long, fold int, x array<double>"), "quality-statistics")
    marks = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y"))
    labelled = stage(measured.filter(F.col("fold") != held_out).join(marks, "id"), "quality-labelled")
    model = fit(labelled, F.col("fold") == calibration)
    scored = measured.mapInArrow(_scorer(model), "id long, fold int, score double")
    return scored.select(F.col("id").alias(id_col), (F.col("fold") == held_out).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder("doc_id", 5), held_out=0, calibration=4)


QUERIES = {"op8_quality": op8_quality}
