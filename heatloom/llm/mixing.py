"""Mixing of sources to target weights by proportionate-fair (Pfair) scheduling, in SQL functions only.

Each source is cut into blocks of ``block_docs`` documents in a pseudo-random order. A source of weight w is a task
whose i-th block may go out no sooner than floor((i - 1) / w) slots after the start and must go out by ceil(i / w).
Weights are rounded to whole numbers of blocks per period, one at least, so the schedule repeats after a period: it is one
table of as many rows as the period has slots, whatever the size of the corpus. Earliest deadline first over the released
blocks meets all windows of the rounded weights, so after any number of slots every source is less than one block away from
its rounded share. From the share that was asked for it drifts by the rounding; a longer period lowers that.

When a source has no more blocks its slots stay empty and the others go on: nothing is dropped or repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatloom.llm.store import Scratch

BLOCK_DOCS = 64
PERIOD = 200  # slots over which the weights are rounded; each source gets one slot at least
BUCKET_DOCS = 4096

# Order of the documents of a source.
_DIGEST = "md5(cast({} AS string))"


def root_weights(docs: DataFrame, source_col: str = "source") -> DataFrame:
    """Weights in proportion to the square root of each source's number of documents: ``(source, weight)``."""
    name = F.coalesce(F.col(source_col), F.lit("")).alias("source")
    return docs.select(name).groupBy("source").agg(F.sqrt(F.count(F.lit(1))).alias("weight"))


def schedule(weights: DataFrame, period: int = PERIOD) -> DataFrame:
    """One period of the schedule: ``(source, quota, period, turn, slot)``, turn and slot counted from 0.

    ``weights`` (source, weight > 0) names the targets, a list the caller bounds (sources of a mixture). The period's
    slots are filled in order, in one fold over the slots inside one row.
    """
    named = weights.agg(F.sort_array(F.collect_list(F.struct("source", "weight"))).alias("w"), F.sum("weight").alias("total"))
    row = named.select(F.expr(f"transform(w, x -> named_struct('source', x.source, 'q', greatest(1, "
                              f"cast(round(x.weight * {period} / total) AS int))))").alias("t"))
    row = row.withColumn("n", F.expr("aggregate(t, 0, (a, x) -> a + x.q)"))
    # done[k]: blocks of source k sent so far. In slot s source k is released when done * n < (s + 1) * q; its deadline is
    # ceil((done + 1) * n / q).
    fold = row.select("t", "n", F.expr("""
      CASE WHEN n > 0 THEN aggregate(sequence(0, n - 1),
        named_struct('done', transform(t, x -> 0), 'sent', cast(array() AS array<int>)),
        (acc, s) -> aggregate(
          array(array_min(transform(sequence(0, size(t) - 1), k -> CASE
            WHEN acc.done[k] < t[k].q AND cast(acc.done[k] AS bigint) * n < (cast(s AS bigint) + 1) * t[k].q THEN named_struct(
              'd', ((cast(acc.done[k] AS bigint) + 1) * n + t[k].q - 1) div t[k].q, 'k', k) END))),
          acc,
          (old, pick) -> named_struct(
            'done', transform(old.done, (c, k) -> CASE WHEN k = pick.k THEN c + 1 ELSE c END),
            'sent', concat(old.sent, array(pick.k)))),
        acc -> acc.sent) END""").alias("sent"))
    return fold.select("t", "n", F.posexplode("sent").alias("slot", "k")).select(
        F.expr("t[k].source").alias("source"), F.expr("t[k].q").alias("quota"), F.col("n").alias("period"),
        "slot", "k").selectExpr(
        "source", "quota", "period",
        "cast(row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS int) AS turn", "slot")


def _ranked(rows: DataFrame, id_col: str) -> DataFrame:
    """``rows`` with the 0-based position ``_rank`` of each document in its source.

    Documents are spread over buckets by the leading bits of their digest, a bucket holding a few thousand; counts per
    bucket give each bucket's first position. So the largest source is ranked by as many tasks as it needs.
    """
    digest = F.expr(_DIGEST.format(id_col))
    rows = rows.withColumn("_digest", F.coalesce(digest, F.lit("")))
    lead = F.coalesce(F.conv(F.substring("_digest", 1, 8), 16, 10).cast("long"), F.lit(0))
    size = rows.groupBy("_source").agg(F.count(F.lit(1)).alias("_size"))
    size = Scratch(rows.sparkSession).table(size, "sizes")
    parts = F.ceil(F.col("_size") / BUCKET_DOCS)
    rows = rows.join(size, "_source").withColumn("_bucket", F.floor(lead * parts / float(1 << 32)).cast("long"))
    counts = rows.groupBy("_source", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    first = counts.selectExpr("_source", "_bucket", "sum(_n) OVER (PARTITION BY _source ORDER BY _bucket) - _n AS _first")
    return rows.join(first, ["_source", "_bucket"]).selectExpr(
        "*", f"_first + row_number() OVER (PARTITION BY _source, _bucket ORDER BY _digest, `{id_col}`) - 1 AS _rank")


def mix_order(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source",
              block_docs: int = BLOCK_DOCS, period: int = PERIOD) -> DataFrame:
    """For each row: id, source, ``block`` of its source, ``slot`` of the block in the mixture and ``place`` inside
    the block, all counted from 0. Sorting by (slot, place) gives the mixture.

    ``weights`` defaults to ``root_weights``. A null source is the source ''. A source without a positive weight has no
    target: its rows get null slots and go last. Rows without an id and rows that share one come in any order among
    themselves. Columns other than the two named are not read.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(source_col), F.lit("")).alias("_source"))
    weights = root_weights(docs, source_col) if weights is None else weights
    weights = weights.filter("weight > 0")
    plan = Scratch(docs.sparkSession).table(schedule(weights, period).withColumnRenamed("source", "_source"), "slots")
    ranked = _ranked(rows, "_id").selectExpr(
        "_id", "_source", f"cast(_rank div {block_docs} AS bigint) AS block", f"cast(_rank % {block_docs} AS int) AS place")
    quotas = plan.select("_source", "quota", "period").distinct()
    ranked = ranked.join(quotas, "_source", "left").withColumn("turn", F.expr("cast(block % quota AS int)"))
    out = ranked.join(plan.select("_source", "turn", F.col("slot").alias("_slot")), ["_source", "turn"], "left")
    return out.select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), "block",
                      F.expr("(block div quota) * period + _slot").alias("slot"), "place")


def _places(docs: DataFrame, *how) -> DataFrame:
    """``(_id, _at)``: the first slot and place of each id, by ``mix_order``."""
    order = mix_order(docs, *how)
    return order.groupBy(F.col(order.columns[0]).alias("_id")).agg(F.min(F.struct("slot", "place")).alias("_at"))


def with_places(rows: DataFrame, docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id",
                source_col: str = "source", block_docs: int = BLOCK_DOCS, period: int = PERIOD) -> DataFrame:
    """``rows`` (made of ``docs``, same ids) with their ``slot`` and ``place`` in the mixture of ``docs``, sorted by them."""
    order = _places(docs, weights, id_col, source_col, block_docs, period)
    out = rows.join(order, F.col(id_col).eqNullSafe(F.col("_id")), "left")
    out = out.select(*rows.columns, F.col("_at.slot").alias("slot"), F.col("_at.place").alias("place"))
    return out.orderBy(*mixture_order(id_col))


def mixture_order(id_col: str = "doc_id") -> list[Column]:
    return [F.col("slot").asc_nulls_last(), F.col("place").asc_nulls_last(), F.col(id_col)]


def mixed(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source",
          block_docs: int = BLOCK_DOCS, period: int = PERIOD) -> DataFrame:
    """All rows of ``docs``, unchanged, in the order of the mixture (rows that share an id stay together)."""
    names = docs.columns
    order = _places(docs, weights, id_col, source_col, block_docs, period)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(id_col).alias("_key"))
    rows = rows.join(order, F.col("_key").eqNullSafe(F.col("_id")), "left")
    rows = rows.orderBy(F.col("_at.slot").asc_nulls_last(), "_at.place", "_key")
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in names])
