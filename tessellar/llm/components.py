"""Connected components of a graph of any size, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.llm.workspace import Workspace


#: Rows of a file of the tables between rounds.
ROWS_OF_A_FILE = 100_000


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or smaller) neighbours to the least of itself and its neighbours.

    ``pairs`` is a written table, so the join is one of two plain exchanges and a node
    with very many neighbours is split over tasks.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = pairs.join(least.hint("merge"), "u")
    if large:
        return linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """``u, root`` for each node of ``edges`` (a, b): the least node of its component.

    Every round is written to the shared folder and halves, at least, the longest path;
    the rounds end when the written edges no longer change.
    """
    forest = ws.write(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}_0"
    )
    # no table below has more than twice as many rows: few rows are not written in many files
    files = max(1, -(-forest.count() // ROWS_OF_A_FILE))
    before, at = None, 0
    while True:
        check = forest.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if check == before or not check[0]:
            break
        before = check
        both = ws.write(forest.unionByName(forest.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(files), f"{name}_both")
        large = ws.write(_star(both, large=True).where("u <> v").distinct().coalesce(files), f"{name}_large")
        forest = ws.write(_star(large, large=False).where("u <> v").distinct().coalesce(files), f"{name}_{at + 1}")
        ws.drop(f"{name}_{at}", f"{name}_both", f"{name}_large")
        at += 1
    roots = forest.select("v").distinct().select(F.col("v").alias("u"), F.col("v").alias("root"))
    return forest.select("u", F.col("v").alias("root")).unionByName(roots)
