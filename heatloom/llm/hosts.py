"""URL filter by empirical-Bayes host reputation, in SQL functions only.

Labelled pages give each host a count of good and bad outcomes. A host's bad rate is shrunk towards that of its
registered domain, the domain's towards that of its suffix, and the suffix's towards the overall rate, each by a
beta-binomial prior whose strength is estimated from the spread between the groups of that level. A host is blocked
when the lower bound of its posterior rate lies above a limit. Fixed rules on host and path go before the verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatloom.llm.store import Scratch

# The rules of the query, (action, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
LIMIT = 0.5
Z = 1.645
WEAKEST, STRONGEST = 1.0, 1000.0  # bounds of the prior's strength, in pages

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and for a url without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, _UPPER, _LOWER), path


def _named(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    host, path = url_parts(F.col("_url"))
    return rows.select("_id", host.alias("host"), path.alias("path"))


def _levels(rows: DataFrame) -> DataFrame:
    """Registered domain (last two labels, port and user dropped) and suffix (last label) of each host."""
    bare = F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r":[0-9]*$", "")
    rows = rows.withColumn("domain", F.substring_index(bare, ".", -2))
    return rows.withColumn("suffix", F.substring_index("domain", ".", -1))


def _strength(groups: DataFrame) -> DataFrame:
    """One row: pages, bad pages, overall rate and the prior strength by the moments of a beta-binomial.

    Sums of whole numbers and of rates are rounded before use, so their order does not matter.
    """
    sums = groups.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"),
                      F.round(F.sum(F.col("bad") * F.col("bad") / F.col("n")), 6).alias("b2"))
    sums = sums.withColumn("p", (F.coalesce("bad", F.lit(0)) + 1.0) / (F.coalesce("n", F.lit(0)) + 2.0))
    spread = F.col("b2") - 2 * F.col("p") * F.col("bad") + F.col("p") * F.col("p") * F.col("n")
    noise = F.col("p") * (1 - F.col("p"))
    rho = F.try_divide(spread - noise * (F.col("k") - 1), noise * (F.col("n") - F.try_divide("nn", "n") - (F.col("k") - 1)))
    strength = F.when(rho > 0, 1 / rho - 1).otherwise(STRONGEST)
    return sums.select("p", F.round(F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), F.coalesce(strength, F.lit(STRONGEST)))), 6).alias("s"))


def reputations(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url",
                label_id_col: str = "doc_id", bad_col: str = "toxic") -> DataFrame:
    """``host, n, bad, mean, bound`` for every host of ``pages``; hosts without a labelled page have their prior.

    An outcome is bad when ``bad_col`` is 1; null outcomes and labels of unknown pages do not count.
    """
    named = _named(pages, id_col, url_col)
    known = labels.filter(F.col(bad_col).isNotNull()).select(F.col(label_id_col).alias("_id"), (F.col(bad_col) == 1).cast("long").alias("bad"))
    seen = named.select("_id", "host").join(known, "_id").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    hosts = named.select("host").distinct().join(seen, "host", "left").fillna(0, ["n", "bad"])
    hosts = Scratch(pages.sparkSession).table(_levels(hosts), "hosts")
    level = {"host": hosts.filter("n > 0")}
    for name in ("domain", "suffix"):
        level[name] = hosts.filter("n > 0").groupBy(name).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    force = {name: _strength(level[name]).first() for name in level}

    def rate(counts: str, prior: Column, strength: float) -> Column:
        return (F.coalesce(f"bad_{counts}", F.lit(0)) + strength * prior) / (F.coalesce(f"n_{counts}", F.lit(0)) + strength)

    rows = hosts
    for name in ("domain", "suffix"):
        rows = rows.join(level[name].select(name, F.col("n").alias(f"n_{name}"), F.col("bad").alias(f"bad_{name}")), name, "left")
    suffix = rate("suffix", F.lit(force["host"].p), force["suffix"].s)
    domain = rate("domain", suffix, force["domain"].s)
    a = F.col("bad") + force["host"].s * domain
    b = F.col("n") - F.col("bad") + force["host"].s * (1 - domain)
    rows = rows.select("host", "n", "bad", a.alias("a"), b.alias("b"))
    mean = F.col("a") / (F.col("a") + F.col("b"))
    sd = F.sqrt(F.col("a") * F.col("b") / (F.col("a") + F.col("b") + 1)) / (F.col("a") + F.col("b"))
    return rows.select("host", "n", "bad", mean.alias("mean"), (mean - Z * sd).alias("bound"))


def _rule(rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits host and path, as (length, rule, action); null when none fits."""
    fits = [F.when(((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path)),
                   F.struct(F.lit(len(host + path)).alias("size"), F.lit(host + path).alias("rule"), F.lit(action).alias("action")))
            for action, host, path in rules]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,action:string>")


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id",
                url_col: str = "url", limit: float = LIMIT, **columns: str) -> DataFrame:
    """Per row of ``pages``: id, host, path, rule (null: none fits) and verdict.

    Only blocked hosts are joined to the pages, so the host with most pages moves no row unless it is blocked, and
    then adaptive execution splits it. Repeated rows give repeated results; other columns are not returned.
    """
    bad = reputations(pages, labels, id_col, url_col, **columns).filter(F.col("bound") > limit)
    bad = Scratch(pages.sparkSession).table(bad.select("host", F.lit("block").alias("_reputation")), "blocked")
    rows = _named(pages, id_col, url_col).join(bad, "host", "left").withColumn("_rule", _rule(rules))
    return rows.select(F.col("_id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"),
                       F.coalesce("_rule.action", "_reputation", F.lit("allow")).alias("verdict"))
