"""Exact top-k inner products by pivot-table elimination.

With integer vectors, 2 q.c = |q|^2 + |c|^2 - |q - c|^2, and for every pivot p the triangle inequality gives
|q - c| >= | |q - p| - |c - p| |. So the distances of all vectors to a set of pivots, computed once, bound each score
from above by the largest of these differences. A query evaluates the candidates of a block in the order of their
bounds and stops when no bound left reaches its k-th best score.

Candidates are grouped in cells by their nearest pivot and cells are cut into blocks of bounded size; queries are cut
into blocks too. First each query searches its own cell, which gives a k-th score to beat. A cell's range of distances
to each pivot bounds all its candidates at once, and only queries and cells that can still improve are met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.llm.store import Scratch, checkpointed

K = 5
PIVOTS = 32
BLOCK_ROWS = 4096
QUERY_ROWS = 2048
STEP = 256  # candidates evaluated at a time, in bound order


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, v``: floor(256 x) of each component; vectors that are null, empty or hold a null, NaN or infinite
    component, and rows without an id, are left out."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & F.forall(
        "x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return rows.select("id", F.transform("x", lambda c: F.floor(c * 256).cast("long")).alias("v"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Exact squared differences, then a root."""
    out = np.empty((len(x), len(pivots)))
    for k, p in enumerate(pivots):
        d = x - p
        out[:, k] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def _place(shared):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            table = _distances(_matrix(frame["v"]), shared.value)
            yield pd.DataFrame({"id": frame["id"], "v": frame["v"], "d": list(table), "pivot": table.argmin(axis=1)})

    return run


def _search(k: int):
    """Best candidates of one block for one block of queries."""

    def run(_, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found = {"query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(block):
            block = block.sort_values("id", kind="stable")
            ids, x, dx = block["id"].to_numpy(), _matrix(block["v"]), _matrix(block["d"])
            norm = np.einsum("ij,ij->i", x, x)
            for qid, qv, qd, floor in zip(queries["id"], queries["v"], queries["d"], queries["floor"]):
                q = np.asarray(qv, np.float64)
                low = np.abs(dx - np.asarray(qd)).max(axis=1)
                bound = (q @ q + norm - np.maximum(low - 1e-6, 0) ** 2) / 2
                bound[ids == qid] = -np.inf
                order = np.argsort(-bound, kind="stable")
                best_score, best_id = np.zeros(0), np.zeros(0, ids.dtype)
                for lo in range(0, len(order), STEP):
                    part = order[lo:lo + STEP]
                    least = max(floor, best_score[-1] if len(best_score) == k else -np.inf)
                    part = part[(bound[part] > -np.inf) & (bound[part] + 1 >= least)]
                    if not len(part):
                        break
                    score = np.concatenate([best_score, x[part] @ q])
                    who = np.concatenate([best_id, ids[part]])
                    top = np.lexsort((who, -score))[:k]
                    best_score, best_id = score[top], who[top]
                found["query_id"] += [qid] * len(best_id)
                found["vec_id"] += best_id.tolist()
                found["score"] += best_score.astype(np.int64).tolist()
        return pd.DataFrame(found).astype({"score": "int64"})

    return run


def _pivots(rows: DataFrame, count: int) -> np.ndarray:
    """Vectors with the smallest hashes: a sample of fixed size, no matter how many rows there are. Any choice of
    pivots gives the same results."""
    picked = rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(count).toPandas()
    return _matrix(picked["v"])


def _met(queries: DataFrame, blocks: DataFrame, pairs: DataFrame, k: int, id_type: str) -> DataFrame:
    """Results of the given pairs of query and block."""
    left = pairs.join(queries.select("id", "v", "d", "floor"), "id")
    left = left.withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("waiting") / QUERY_ROWS)).cast("int"))
    parts = left.select(F.col("block").alias("cell"), F.col("part").alias("portion")).distinct()
    right = blocks.select(F.col("block").alias("cell"), F.col("id").alias("own"), "v", "d").join(parts, "cell")
    right = right.toDF("cell", "id", "v", "d", "portion")
    return left.groupBy("block", "part").cogroup(right.groupBy("cell", "portion")).applyInPandas(
        _search(k), f"query_id {id_type}, vec_id {id_type}, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; results of many blocks are combined by rank, never in one list."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(df: DataFrame, is_query: F.Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
          pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest integer inner products with the other vectors, all if
    there are fewer, ties to the smaller id.

    ``is_query`` picks the queries by ``id``. Vectors of different lengths are compared within their length. Rows that
    repeat an id with the same vector count once; with another vector the id's best score counts. Columns other than
    the two named are not looked at. Scores are exact while components times dimensions stay below 2**53.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    rows = checkpointed(quantised(df, id_col, vector_col).distinct())
    id_type = dict(rows.dtypes)["id"]
    outs = []
    for size in sorted(r[0] for r in rows.select(F.size("v")).distinct().collect()):
        same = rows.filter(F.size("v") == size)
        shared = spark.sparkContext.broadcast(_pivots(same, pivots))
        placed = scratch.table(same.mapInPandas(_place(shared), f"id {id_type}, v array<long>, d array<double>, pivot int"), "placed")
        counts = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"))
        blocks = placed.join(F.broadcast(counts), "pivot").select(
            "id", "v", "d", "pivot", F.struct("pivot", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / block_rows)).alias("cut")).alias("block"))
        queries = placed.filter(is_query).withColumn("floor", F.lit(float("-inf")))

        names = blocks.select("block").distinct()
        home = queries.select("id", "pivot").join(names.select("block", F.col("block.pivot").alias("pivot")), "pivot")
        waiting = home.groupBy("block").agg(F.count(F.lit(1)).alias("waiting"))
        first = checkpointed(_met(queries, blocks, home.select("id", "block").join(waiting, "block"), k, id_type))
        floors = _best(first, k).groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("c"))
        floors = floors.select(F.col("query_id").alias("id"), F.when(F.col("c") == k, F.col("least").cast("double")).alias("least"))
        queries = checkpointed(queries.drop("floor").join(floors, "id", "left").withColumn(
            "floor", F.coalesce("least", F.lit(float("-inf")))).drop("least"))

        spans = blocks.select("pivot", F.posexplode("d").alias("p", "dist"), F.aggregate("v", F.lit(0).cast("double"), lambda a, x: a + x * x).alias("norm"))
        spans = spans.groupBy("pivot", "p").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.max("norm").alias("norm"))
        cells = _reachable(queries, spans).join(names.select("block", F.col("block.pivot").alias("pivot")), "pivot")
        others = cells.select("id", "block").join(home.select("id", "block"), ["id", "block"], "left_anti")
        waiting = others.groupBy("block").agg(F.count(F.lit(1)).alias("waiting"))
        second = _met(queries, blocks, others.join(waiting, "block"), k, id_type)
        outs.append(_best(first.unionByName(second), k))
    if not outs:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score long")
    out = outs[0]
    for more in outs[1:]:
        out = out.unionByName(more)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _reachable(queries: DataFrame, spans: DataFrame) -> DataFrame:
    """Pairs of query and pivot cell whose bound reaches the query's k-th score. The spans are a table of pivots by
    pivots, of the same size for any input."""
    cells: dict[int, list] = {}
    for r in sorted(spans.collect()):
        cells.setdefault(r.pivot, []).append((r.lo, r.hi, r.norm))
    shared = queries.sparkSession.sparkContext.broadcast(cells)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            d, v = _matrix(frame["d"]), _matrix(frame["v"])
            own = np.einsum("ij,ij->i", v, v)
            for pivot, span in shared.value.items():
                lo, hi, norm = np.array(span).T
                gap = np.maximum(np.maximum(lo - d, d - hi), 0).max(axis=1)
                bound = (own + norm.max() - np.maximum(gap - 1e-6, 0) ** 2) / 2
                hit = bound + 1 >= frame["floor"].to_numpy()
                if hit.any():
                    yield pd.DataFrame({"id": frame["id"][hit], "pivot": pivot})

    id_type = dict(queries.dtypes)["id"]
    return queries.mapInPandas(run, f"id {id_type}, pivot int")
