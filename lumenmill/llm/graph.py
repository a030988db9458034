"""Connected components: union-find inside each partition, then large-star and small-star."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenmill.llm.common import discard, parts, stage


def _local_union_find(batches):
    """Edges (child, parent) to a star forest of the partition: (child, smallest id)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    stars = [(x, find(x)) for x in list(root)]
    stars = [s for s in stars if s[0] != s[1]]
    for at in range(0, len(stars), 50_000):
        some = stars[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in some], pa.int64()), pa.array([s[1] for s in some], pa.int64())], ["child", "parent"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("parent", "child")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("child"), F.col("m").alias("parent"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.toDF("u", "v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("child"), F.col("m").alias("parent"))
    return moved.union(least.toDF("child", "parent"))


def _is_star_forest(edges: DataFrame) -> bool:
    ends = edges.select(F.col("child").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("parent", F.lit(0), F.lit(1)))
    bad = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)")
    return bad.isEmpty()


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """edges (a, b), long: every node with an edge that is not its component's smallest, as
    (child, parent): parent is the smallest node reachable. Nothing is collected; each round is
    written to the shared folder, into `most` files at most."""
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent"))
    local = pairs.repartition(parts(edges.sparkSession), "parent").mapInArrow(_local_union_find, "child long, parent long")
    now = stage(local.distinct(), "components", most)
    while not _is_star_forest(now):
        then = now
        now = stage(_small_star(_large_star(then)).filter("child <> parent").distinct(), "components", most)
        discard(then)
    return now
