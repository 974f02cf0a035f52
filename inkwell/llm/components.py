"""Connected components over an edge table of ids: by alternating large-star and small-star rounds, or on the driver where the edges are few."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import materialize


#: Edges, of 16 bytes, that the driver joins by itself; counted before they are gathered.
LOCAL_EDGES = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, comp) for each id that has an edge; comp is the smallest id reachable. Columns of edges: a, b.

    Null ids and loops are ignored, repeated edges count once, an empty table gives an empty result. Each round
    rewrites the id pairs only, and the number of rounds grows with the logarithm of the longest chain; up to LOCAL_EDGES edges are
    joined on the driver, with the same result. Least neighbours are
    aggregated before they are shuffled and joined back, so the edges of a hub need not meet in one task.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    if e.count() <= LOCAL_EDGES:
        found = _joined(e.select("u", "v").toArrow())
        return materialize(e.sparkSession.createDataFrame(found, "doc_id long, comp long"), "components")
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = e.select(F.col("v").alias("u"), F.col("u").alias("far")).join(least, "u").select(F.col("far").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u > v").distinct(), "stars")
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        e = materialize(small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u > v").distinct(), "edges")
    return e.groupBy(F.col("u").alias("doc_id")).agg(F.min("v").alias("comp")).unionByName(e.select(F.col("v").alias("doc_id"), F.col("v").alias("comp")).distinct())


def _joined(edges: pa.Table) -> pa.Table:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    for a, b in zip(*(edges.column(c).to_pylist() for c in ("u", "v"))):
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    ids = list(parent)
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "comp": pa.array(map(root, ids), pa.int64())})
