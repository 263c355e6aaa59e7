"""Point-in-time statements from long XBRL facts: facts(ticker, tag, unit, start, end, val, filed, form).

Facts of instants have no start. Of a period's values the one filed first counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FACT = "start DATE, end DATE, val DOUBLE, filed DATE, form STRING"


def explode_facts(raw: DataFrame, ticker: str = "ticker", facts: str = "facts") -> DataFrame:
    """Long facts from a map of tag to struct of units: map of unit to array of facts."""
    tags = raw.select(ticker, F.explode(facts).alias("tag", "node"))
    units = tags.select(ticker, "tag", F.explode("node.units").alias("unit", "list"))
    return units.select(ticker, "tag", "unit", F.inline("list"))


def kind_of_duration(facts: DataFrame) -> DataFrame:
    """kind: quarter (80 to 100 days), annual (350 to 380), instant (no start) or other."""
    days = F.datediff("end", "start")
    return facts.withColumn("kind", F.when(F.col("start").isNull(), "instant").when(days.between(80, 100), "quarter").when(days.between(350, 380), "annual").otherwise("other"))


def first_filed(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the fact filed first; of equals the one earlier in the tag chain, then the smaller value."""
    rest = [c for c in facts.columns if c not in keys]
    order = [F.col(c) for c in ("filed", "chain", "val") if c in rest]
    g = facts.groupBy(*keys).agg(F.min(F.struct(*order, *[F.col(c) for c in rest if c not in ("filed", "chain", "val")])).alias("_f"))
    return g.select(*keys, *[F.col(f"_f.{c}").alias(c) for c in rest])


def tag_chain(facts: DataFrame, chain: list[str], unit: str = "USD") -> DataFrame:
    """Facts of any tag of a chain, with the tag's place in it."""
    return facts.where((F.col("unit") == unit) & F.col("tag").isin(chain)).withColumn("chain", F.array_position(F.array(*[F.lit(t) for t in chain]), F.col("tag")))


def with_derived_q4(facts: DataFrame, tolerance: int = 10) -> DataFrame:
    """Quarters per ticker with the fourth derived from an annual fact and exactly three quarters inside it, unless a fourth
    was filed no later than the annual fact. A ticker has few annual facts, so the containment join stays narrow."""
    f = kind_of_duration(facts)
    q = first_filed(f.where("kind = 'quarter'").select("ticker", "start", "end", "filed", "val"), ["ticker", "start", "end"])
    a = first_filed(f.where("kind = 'annual'").select("ticker", "start", "end", "filed", "val"), ["ticker", "start", "end"]).select("ticker", F.col("start").alias("a0"), F.col("end").alias("a1"), F.col("filed").alias("afiled"), F.col("val").alias("aval"))
    inside = a.join(q, "ticker").where((F.col("start") >= F.date_sub("a0", tolerance)) & (F.col("end") <= F.date_add("a1", tolerance)))
    is_q4 = F.abs(F.datediff("end", "a1")) <= tolerance
    g = inside.groupBy("ticker", "a0", "a1", "afiled", "aval").agg(F.count_if(~is_q4).alias("n"), F.sum(F.when(~is_q4, F.col("val"))).alias("s"), F.max(F.when(~is_q4, F.col("end"))).alias("q3"), F.min(F.when(is_q4, F.col("filed"))).alias("q4_filed"))
    d = g.where("n = 3 AND (q4_filed IS NULL OR q4_filed > afiled)").select("ticker", F.col("q3").alias("start"), F.col("a1").alias("end"), F.col("afiled").alias("filed"), (F.col("aval") - F.col("s")).alias("val"))
    return first_filed(q.unionByName(d).select("ticker", "end", "filed", "val", "start"), ["ticker", "end"])


def monotone_ends(series: DataFrame) -> DataFrame:
    """Rows in order of filing whose period end is later than all ends before: old periods first filed late go."""
    w = Window.partitionBy("ticker").orderBy("filed", "end", "val").rowsBetween(Window.unboundedPreceding, -1)
    return series.withColumn("_m", F.max("end").over(w)).where(F.col("_m").isNull() | (F.col("end") > F.col("_m"))).drop("_m")


def best_metric(candidates: DataFrame) -> DataFrame:
    """Of candidates (ticker, candidate, end, ...) the one that is alive within 400 days, has most rows since 2019, is longest; the first on a tie."""
    c = candidates.groupBy("ticker", "candidate").agg(F.max("end").alias("last"), F.count_if(F.col("end") >= F.lit("2019-01-01").cast("date")).alias("recent"), F.count("*").alias("n"))
    top = F.max("last").over(Window.partitionBy("ticker"))
    c = c.withColumn("alive", F.datediff(top, "last") <= 400)
    w = Window.partitionBy("ticker").orderBy(F.col("alive").desc(), F.col("recent").desc(), F.col("n").desc(), "candidate")
    return candidates.join(c.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("ticker", "candidate"), ["ticker", "candidate"], "left_semi")


def trailing_sum(quarters: DataFrame, column: str, n: int = 4) -> DataFrame:
    """Sum of the last n quarters, null unless all are known."""
    w = Window.partitionBy("ticker").orderBy("end").rowsBetween(-(n - 1), 0)
    return quarters.withColumn(f"{column}_ttm", F.when(F.count(column).over(w) == n, F.sum(column).over(w)))


def year_to_date_quarters(facts: DataFrame) -> DataFrame:
    """Quarters from year-to-date facts of one fiscal start: differences of neighbours 80 to 100 days apart; the first is itself."""
    w = Window.partitionBy("ticker", "start").orderBy("end")
    f = facts.withColumns({"_v": F.lag("val").over(w), "_e": F.lag("end").over(w)})
    first = F.col("_e").isNull() & F.datediff("end", "start").between(80, 100)
    later = F.datediff("end", "_e").between(80, 100)
    return f.withColumn("q", F.when(first, F.col("val")).when(later, F.col("val") - F.col("_v"))).where("q IS NOT NULL").select("ticker", "end", "filed", F.col("q").alias("val"))


def standardised_surprise(quarters: DataFrame, column: str = "net_income") -> DataFrame:
    """Year-over-year change over the deviation of the eight changes before; the year's gap is 365 +- 45 days."""
    w = Window.partitionBy("ticker").orderBy("end")
    gap = F.datediff("end", F.lag("end", 4).over(w)).between(320, 410)
    q = quarters.withColumn("_d", F.when(gap, F.col(column) - F.lag(column, 4).over(w)))
    before = w.rowsBetween(-8, -1)
    sd = F.when(F.count("_d").over(before) == 8, F.stddev_samp("_d").over(before))
    return q.withColumn("sue", F.when(sd > 0, F.col("_d") / sd)).drop("_d")


def piotroski(statements: DataFrame) -> DataFrame:
    """Eight tests of (current, prior) items in wide columns; null if any is unknown."""
    c, p = (lambda x: F.col(x)), (lambda x: F.col(f"{x}_prior"))
    ratio = lambda a, b: F.try_divide(a, b)
    tests = [c("net_income") > 0, c("cash_flow") > 0, ratio(c("net_income"), c("assets")) > ratio(p("net_income"), p("assets")), c("cash_flow") > c("net_income"), ratio(c("debt"), c("assets")) <= ratio(p("debt"), p("assets")), ratio(c("current_assets"), c("current_liabilities")) > ratio(p("current_assets"), p("current_liabilities")), c("shares") <= p("shares"), ratio(c("revenue"), c("assets")) > ratio(p("revenue"), p("assets"))]
    return statements.withColumn("f_score", sum((t.cast("int") for t in tests), F.lit(0)))
