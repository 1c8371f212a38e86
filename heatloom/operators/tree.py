"""Decision trees for two classes, grown level by level from histograms of binned features."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatloom.operators.small import checked_broadcast

MAX_DEPTH, BINS = 5, 32
# Open nodes of a level sent to the tasks at once; more of them join by shuffle.
MAX_OPEN = 100_000
_SPLITS = "node long, feature int, bin int, threshold double"


@dataclass
class Tree:
    """``nodes`` has a row per node: ``(node, n, pos, feature, bin, threshold)``; the last three are null in a leaf. The root is 1, node i
    has the children 2i (feature at most the threshold) and 2i + 1."""

    nodes: list[dict]
    edges: list[list[float]]
    depth: int

    def table(self, spark) -> DataFrame:
        rows = [tuple(x[c] for c in ("node", "n", "pos", "feature", "bin", "threshold")) for x in self.nodes]
        return spark.createDataFrame(rows, "node long, n long, pos long, feature int, bin int, threshold double")

    def predict(self, rows: DataFrame, features: str = "features") -> DataFrame:
        """Add ``node``, the leaf of each row, ``p``, its share of class 1, and the 0/1 ``prediction`` (1 above a half).

        Rows whose features are null, hold a null or NaN or are of another number than in the fit get nulls.
        """
        spark, names = rows.sparkSession, rows.columns
        at = rows.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), binned(F.col(features), self.edges).alias("_bins"))
        at = at.withColumn("node", F.when(F.col("_bins").isNotNull() & F.lit(bool(self.nodes)), F.lit(1).cast("long")))
        inner = [x for x in self.nodes if x["feature"] is not None]
        for level in range(self.depth):
            part = [x for x in inner if 1 << level <= x["node"] < 2 << level]
            if part:
                at = _descend(at, _splits(spark, part), "left")
        leaf = self.table(spark).filter("feature IS NULL").select(
            F.col("node").alias("_leaf"), (F.col("pos") / F.col("n")).alias("p"), (F.col("pos") * 2 > F.col("n")).cast("int").alias("prediction"))
        out = at.join(checked_broadcast(leaf, MAX_OPEN), F.col("node") == F.col("_leaf"), "left")
        own = [F.col("_row").getField(c).alias(c) for c in names if c not in ("node", "p", "prediction")]
        return out.select(*own, "node", "p", "prediction")


def even_edges(rows: DataFrame, features: str = "features", bins: int = BINS) -> list[list[float]]:
    """Thresholds that cut the range of each feature into ``bins`` equal parts, from one pass; none for a constant feature.

    Rows with null, NaN or infinite features do not count. Only the least and largest value of each feature reach the driver.
    """
    x = F.col(features).cast("array<double>")
    fine = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    ends = rows.filter(fine).select(F.posexplode(x).alias("i", "v")).groupBy("i").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    return [[r["a"] + (r["b"] - r["a"]) * j / bins for j in range(1, bins)] if r["b"] > r["a"] else [] for r in ends.orderBy("i").collect()]


def binned(features: Column, edges: list[list[float]]) -> Column:
    """The number of thresholds below each feature, as an array; null where a feature is missing or NaN."""
    if any(a > b for cuts in edges for a, b in pairwise(cuts)):
        raise ValueError("thresholds must rise")
    x = features.cast("array<double>")
    cuts = F.array(*[F.array(*[F.lit(float(e)) for e in row]).cast("array<double>") for row in edges])
    bins = F.zip_with(x, cuts, lambda v, c: F.size(F.filter(c, lambda e: e < v)))
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v))
    return F.when((F.size(x) == len(edges)) & ~odd, bins)


def _splits(spark, nodes: list[dict]) -> DataFrame:
    found = spark.createDataFrame([(x["node"], x["feature"], x["bin"], x["threshold"]) for x in nodes], _SPLITS)
    return found.select(F.col("node").alias("_at"), F.col("feature").alias("_feature"), F.col("bin").alias("_bin"))


def _descend(at: DataFrame, splits: DataFrame, how: str) -> DataFrame:
    """Rows of divided nodes go on to a child; others stay with a left join and leave with an inner one."""
    kept = [c for c in at.columns if c != "node"]
    right = (F.element_at("_bins", F.col("_feature") + 1) > F.col("_bin")).cast("long")
    joined = at.join(checked_broadcast(splits, MAX_OPEN), F.col("node") == F.col("_at"), how)
    return joined.select(*kept, F.when(F.col("_at").isNotNull(), F.col("node") * 2 + right).otherwise(F.col("node")).alias("node"))


def _entropy(pos: Column, n: Column) -> Column:
    p = pos / n
    return F.when((pos == 0) | (pos == n), 0.0).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))


def best_splits(rows: DataFrame, least: int) -> DataFrame:
    """For each open node ``(node, n, pos, best)``: the split with the largest fall of entropy, null if none falls.

    Gains equal to nine places go to the lower feature, then the lower threshold. The histogram is one grouping of
    (node, feature, bin), added up in the tasks first, and has at most nodes x features x bins rows.
    """
    cells = rows.select("node", "label", F.posexplode("_bins").alias("feature", "bin"))
    cells = cells.groupBy("node", "feature", "bin").agg(F.count(F.lit(1)).alias("c"), F.sum("label").alias("s"))
    whole = Window.partitionBy("node", "feature")
    up = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = cells.select("node", "feature", "bin", F.sum("c").over(up).alias("ln"), F.sum("s").over(up).alias("lp"),
                        F.sum("c").over(whole).alias("n"), F.sum("s").over(whole).alias("pos"))
    n, pos, ln, lp = (F.col(c) for c in ("n", "pos", "ln", "lp"))
    gain = F.round(_entropy(pos, n) - ln / n * _entropy(lp, ln) - (n - ln) / n * _entropy(pos - lp, n - ln), 9)
    split = F.struct(gain.alias("gain"), (-F.col("feature")).alias("feature"), (-F.col("bin")).alias("bin"), "ln", "lp")
    usable = (ln >= least) & (n - ln >= least) & (gain > 0)
    return sums.groupBy("node").agg(F.max("n").alias("n"), F.max("pos").alias("pos"), F.max(F.when(usable, split)).alias("best"))


def fit_tree(rows: DataFrame, edges: list[list[float]], depth: int = MAX_DEPTH, least: int = 1, features: str = "features",
             label: str = "label") -> Tree:
    """Grow a tree on ``features`` (array of numbers) and the 0/1 ``label`` with the thresholds of ``edges``.

    All open nodes of a level are divided in one aggregation; only their splits reach the driver. A node stays a leaf if it is pure,
    if no split leaves ``least`` rows on both sides and lowers the entropy, or at ``depth``. Rows with a null or NaN label or
    feature, or a label other than 0 and 1, take no part; without any row the tree has no nodes.
    """
    spark = rows.sparkSession
    y = F.col(label).cast("double")
    base = rows.select(F.lit(1).cast("long").alias("node"), y.cast("int").alias("label"), binned(F.col(features), edges).alias("_bins"),
                       y.isin(0.0, 1.0).alias("_known"))
    base = base.filter(F.col("_known") & F.col("_bins").isNotNull()).drop("_known").persist()
    nodes: dict[int, dict] = {}

    def leaf(node: int, n: int, pos: int) -> None:
        nodes[node] = {"node": node, "n": n, "pos": pos, "feature": None, "bin": None, "threshold": None}

    try:
        total = base.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")).first()
        if total["n"]:
            leaf(1, total["n"], total["pos"])
        level, at = 0, base
        while nodes and level < depth:
            divided = []
            for r in best_splits(at, least).collect():
                if r["best"] is None:
                    continue
                b, node = r["best"], r["node"]
                nodes[node] |= {"feature": -b["feature"], "bin": -b["bin"], "threshold": edges[-b["feature"]][-b["bin"]]}
                leaf(2 * node, b["ln"], b["lp"])
                leaf(2 * node + 1, r["n"] - b["ln"], r["pos"] - b["lp"])
                divided.append(nodes[node])
            level += 1
            if not divided:
                break
            at = _descend(at, _splits(spark, divided), "inner")
        return Tree([nodes[i] for i in sorted(nodes)], edges, level)
    finally:
        base.unpersist()
