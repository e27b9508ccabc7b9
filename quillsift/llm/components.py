"""Connected components of an edge table by alternating large and small stars; of few edges by one task."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: Edges that one task links by itself, and the types whose order is that of Python's values.
ALONE, PLAIN = 1 << 18, (T.LongType(), T.IntegerType(), T.StringType())


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _alone(edges: DataFrame) -> DataFrame:
    """stars() of edges that one task can hold: every vertex points to a smaller one until it points to the least."""

    def run(batches):
        up, kinds = {}, None

        def least(x):
            while x in up:
                y = up[x]
                if y in up:
                    up[x] = up[y]
                x = y
            return x

        for batch in batches:
            kinds = batch.schema.types
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = least(u), least(v)
                if a != b:
                    up[max(a, b)] = min(a, b)
        if up:
            yield pa.RecordBatch.from_arrays([pa.array(list(up), kinds[0]), pa.array([least(x) for x in up], kinds[1])], ["u", "v"])

    return edges.coalesce(1).mapInArrow(run, edges.schema)


def stars(edges: DataFrame, tag: str = "stars") -> DataFrame:
    """edges (u, v) of an orderable type to one row (u, v) for every vertex u but the least of its component, v being
    that least vertex. Loops, repeats and either direction are allowed; no edges give no rows. Each round is written
    to the shared folder, so a lost executor repeats one round at most. A hub's edges are spread by Spark's skewed join.
    ALONE edges at most need no rounds, each of which costs the driver's memory three plans and their stages."""
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = cut(now, tag)
    was, state = None, _state(now)
    if 0 < state[0] <= ALONE and edges.schema["u"].dataType in PLAIN:
        return cut(_alone(now), tag)
    while state != was and state[0]:
        now = cut(_small(cut(_large(now), tag)), tag)
        was, state = state, _state(now)
    return now
