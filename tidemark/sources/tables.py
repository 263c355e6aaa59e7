"""Tables of a folder and the panels derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formulas import rnd

BAR_COLUMNS = ("ticker", "date", "open", "high", "low", "close", "volume")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def trades(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as trades of a nation's suppliers; the dimensions have a fixed, small number of rows a supplier."""
    sector = table(spark, folder, "nation").join(F.broadcast(table(spark, folder, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    names = table(spark, folder, "supplier").join(F.broadcast(sector), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("ticker"), F.col("r_name").alias("sector"))
    li = table(spark, folder, "lineitem")
    return li.join(names, F.col("l_suppkey") == F.col("s_suppkey")).select("ticker", "sector", F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("q"), "l_orderkey", "l_linenumber", "l_suppkey")


def _bars(t: DataFrame, *keys: str) -> DataFrame:
    """Bars by keys, partially aggregated before the one shuffle."""
    return t.groupBy(*keys).agg(
        rnd(F.min(F.struct("l_orderkey", "l_linenumber", "p"))["p"], 6).alias("open"),
        rnd(F.max("p"), 6).alias("high"),
        rnd(F.min("p"), 6).alias("low"),
        rnd(F.sum(F.col("x").cast("decimal(18,2)")).cast("double") / F.sum("q"), 6).alias("close"),  # prices have cents: an exact sum
        F.sum("q").alias("volume"),
    )


def bars_daily(spark: SparkSession, folder: str) -> DataFrame:
    """ticker, sector, date, open, high, low, close, volume."""
    return _bars(trades(spark, folder), "ticker", "sector", "date")


def bars_weekly(spark: SparkSession, folder: str) -> DataFrame:
    """Bars by supplier and week (from its Monday); ticker is the supplier's key."""
    li = table(spark, folder, "lineitem").select(F.col("l_suppkey").cast("string").alias("ticker"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("q"), "l_orderkey", "l_linenumber")
    return _bars(li, "ticker", "date")


def bars_15m(spark: SparkSession, folder: str) -> DataFrame:
    """Bars of 15 minutes by event type: first and last value by (ts, event_id)."""
    e = table(spark, folder, "events").where(F.col("value").isNotNull())
    start = F.expr("timestamp_seconds(floor(unix_timestamp(cast(ts AS timestamp)) / 900) * 900)")
    key = F.struct("ts", "event_id", "value")
    return e.groupBy(F.col("event_type").alias("ticker"), start.alias("ts")).agg(F.min(key)["value"].alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max(key)["value"].alias("close"), F.count("*").cast("double").alias("volume"))


def facts_quarterly(spark: SparkSession, folder: str) -> DataFrame:
    """ticker, end, filed, revenue, net_income, equity, shares by quarter and nation."""
    who = table(spark, folder, "customer").join(F.broadcast(table(spark, folder, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    shares = who.groupBy(F.col("n_name").alias("ticker")).agg(F.count("*").alias("shares"), rnd(F.sum("c_acctbal"), 2).alias("equity"))
    o = table(spark, folder, "orders").join(who.select("c_custkey", F.col("n_name").alias("ticker"), "n_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    end = F.last_day(F.add_months(F.to_date(F.date_trunc("quarter", "o_orderdate")), 2))
    q = o.groupBy("ticker", "n_nationkey", end.alias("end")).agg(rnd(F.sum("o_totalprice"), 2).alias("revenue"), rnd(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0)) - 0.3 * F.sum("o_totalprice"), 4).alias("net_income"))
    return q.join(F.broadcast(shares), "ticker").select("ticker", "end", F.date_add("end", F.col("n_nationkey") + 30).alias("filed"), "revenue", "net_income", "equity", "shares")


def company_facts(spark: SparkSession, folder: str) -> DataFrame:
    """ticker, end, filed, revenue, net_income, operating_income, operating_cash_flow, capex by quarter and nation.

    Items that no order of the quarter speaks of are null, and every fifth quarter is filed 200 days late. Prices have cents: sums are exact."""
    who = table(spark, folder, "customer").join(F.broadcast(table(spark, folder, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("ticker"), "n_nationkey")
    o = table(spark, folder, "orders").join(who, F.col("o_custkey") == F.col("c_custkey"))
    end = F.last_day(F.add_months(F.to_date(F.date_trunc("quarter", "o_orderdate")), 2))
    total = lambda when: F.sum(F.when(when, F.col("o_totalprice").cast("decimal(18,2)"))).cast("double")
    first = F.left("o_orderpriority", F.lit(1))
    q = o.groupBy("ticker", "n_nationkey", end.alias("end")).agg(total(F.lit(True)).alias("revenue"), total(F.col("o_orderstatus") == "F").alias("_f"), total(first.isin("1", "2")).alias("_u"), total(first == "5").alias("_l"))
    late = F.when((F.year("end") * 4 + F.quarter("end")) % 5 == 0, 200).otherwise(0)
    f = F.coalesce("_f", F.lit(0.0))
    return q.select("ticker", "end", F.date_add("end", F.col("n_nationkey") + 30 + late).alias("filed"), "revenue", (f - F.col("revenue") * 0.3).alias("net_income"), (F.col("_u") * 0.4).alias("operating_income"), (F.col("_f") * 0.25).alias("operating_cash_flow"), (F.col("_l") * 0.1).alias("capex"))


def company_years(spark: SparkSession, folder: str) -> DataFrame:
    """ticker, filed, shares, equity by year and nation, filed in the next January or February; equity may be negative."""
    who = table(spark, folder, "customer").join(F.broadcast(table(spark, folder, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("ticker"), "n_nationkey")
    o = table(spark, folder, "orders").join(who, F.col("o_custkey") == F.col("c_custkey"))
    price = F.col("o_totalprice").cast("decimal(18,2)")
    y = o.groupBy("ticker", "n_nationkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("shares"), F.sum(F.when(F.left("o_orderpriority", F.lit(1)) == "3", price)).cast("double").alias("_m"), F.sum(price).cast("double").alias("_all"))
    return y.select("ticker", F.date_add(F.make_date(F.col("y") + 1, F.lit(1), F.lit(1)), F.col("n_nationkey")).alias("filed"), "shares", (F.coalesce("_m", F.lit(0.0)) * 0.5 - F.col("_all") * 0.09).alias("equity"))


def company_statements(spark: SparkSession, folder: str) -> DataFrame:
    """Items of a nation's fiscal years from sums over its orders by priority and status; those that no order speaks of are null."""
    who = table(spark, folder, "customer").join(F.broadcast(table(spark, folder, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("ticker"))
    o = table(spark, folder, "orders").join(who, F.col("o_custkey") == F.col("c_custkey"))
    price, first = F.col("o_totalprice").cast("decimal(18,2)"), F.left("o_orderpriority", F.lit(1))
    total = lambda when: F.sum(F.when(when, price)).cast("double")
    y = o.groupBy("ticker", F.year("o_orderdate").alias("year")).agg(total(F.lit(True)).alias("revenue"), total(F.col("o_orderstatus") == "F").alias("_f"), *[total(first == str(i)).alias(f"_{i}") for i in range(1, 6)], F.count("*").alias("shares"))
    c = F.col
    return y.select(
        "ticker", "year", "revenue", (c("_f") - c("revenue") * 0.45).alias("net_income"), (c("_f") * 0.25).alias("cash_flow"), (c("_1") * 0.4).alias("operating_income"), (c("_5") * 0.1).alias("capex"),
        (c("_3") + c("_4")).alias("assets"), (c("_5") * 0.5).alias("debt"), c("_1").alias("current_assets"), c("_2").alias("current_liabilities"), (c("_2") * 0.03).alias("interest"), (c("_3") - c("_2") * 0.8).alias("equity"), "shares",
    )


def read_bars(spark: SparkSession, path: str, tickers: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of a Parquet panel; ticker and date predicates reach the scan."""
    bars = spark.read.parquet(path)
    if tickers is not None:
        bars = bars.where(F.col("ticker").isin(tickers))
    if start is not None:
        bars = bars.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        bars = bars.where(F.col("date") <= F.lit(end).cast("date"))
    return bars


def merge_panels(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of two panels on (ticker, date); of a cell that both have, the new one's non-null value wins."""
    keys = ["ticker", "date"]
    both = old.alias("o").join(new.alias("n"), keys, "full_outer")
    return both.select(*keys, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in old.columns if c not in keys])


def missing_tickers(bars: DataFrame, wanted: DataFrame, start: str, grace_days: int = 5) -> DataFrame:
    """Wanted tickers that the panel lacks or whose first bar comes more than grace_days after start."""
    first = bars.where(F.col("close").isNotNull()).groupBy("ticker").agg(F.min("date").alias("first"))
    return wanted.join(first, "ticker", "left").where(F.col("first").isNull() | (F.datediff("first", F.lit(start).cast("date")) > grace_days)).select("ticker", "first")


def coverage(bars: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: tickers wanted, covered and the covered share."""
    have = bars.select("ticker").distinct().withColumn("hit", F.lit(1))
    return wanted.select("ticker").distinct().join(have, "ticker", "left").agg(F.count("*").alias("n_wanted"), F.count("hit").alias("n_covered")).withColumn("share", F.col("n_covered") / F.col("n_wanted"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSONL log; broken lines are skipped."""
    return spark.read.schema(f"{schema}, _corrupt STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).cache().where("_corrupt IS NULL").drop("_corrupt")


def bucket_of(ticker, buckets: int = 64):
    """Stable bucket of a ticker: sha1 modulo the bucket count, by its last eight hex digits."""
    return F.conv(F.right(F.sha1(ticker), F.lit(8)), 16, 10).cast("long") % buckets


def common_stock_symbol(ticker):
    """Symbol with class suffixes written with a dot; null for anything but a common stock's."""
    s = F.upper(F.trim(ticker))
    return F.when(s.rlike(r"^[A-Z]{1,5}(-[A-Z])?$"), F.regexp_replace(s, "-", "."))
