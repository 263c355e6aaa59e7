"""Paper ledgers: identities that must hold, cash, equity curves, signals and slippage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def net_shares(trades: DataFrame) -> DataFrame:
    """account, symbol and bought less sold shares."""
    sign = F.when(F.col("side") == "buy", F.col("qty")).when(F.col("side") == "sell", -F.col("qty")).otherwise(0)
    return trades.groupBy("account", "symbol").agg(F.sum(sign).alias("net"))


def cash_check(accounts: DataFrame, trades: DataFrame, pending: DataFrame) -> DataFrame:
    """account and rule for each broken cash identity; the tolerance grows by 1 a trade.

    accounts: account, cash, initial, deposited, fees, dividends, realized; trades: side, amount, pnl; pending: side, notional."""
    buy, sell = F.col("side") == "buy", F.col("side") == "sell"
    t = trades.groupBy("account").agg(F.count("*").alias("n"), F.sum(F.when(buy, F.col("amount")).otherwise(0.0)).alias("buys"), F.sum(F.when(sell, F.col("amount")).otherwise(0.0)).alias("sells"), F.sum(F.when(sell, F.col("pnl")).otherwise(0.0)).alias("sold_pnl"))
    p = pending.groupBy("account").agg(F.sum(F.when(buy, F.col("notional")).otherwise(0.0)).alias("reserved"))
    a = accounts.join(t, "account", "left").join(p, "account", "left").fillna(0, ["n", "buys", "sells", "sold_pnl", "reserved"])
    tol = F.col("n") + 1.0
    expected = F.col("initial") + F.col("deposited") + F.col("dividends") - F.col("fees") - F.col("buys") + F.col("sells")
    rules = F.array_compact(F.array(F.when(F.col("cash") < 0, "negative_cash"), F.when(F.col("reserved") > F.col("cash") + tol, "over_reserved"), F.when(F.abs(F.col("cash") - expected) > tol, "cash_mismatch"), F.when(F.abs(F.col("realized") - F.col("sold_pnl")) > tol, "realized_mismatch")))
    return a.select("account", F.explode(rules).alias("rule"))


def position_check(trades: DataFrame, positions: DataFrame) -> DataFrame:
    """account, symbol and rule for positions that differ from the trades, are under one share or have no price."""
    both = net_shares(trades).join(positions.select("account", "symbol", F.col("qty").alias("held"), F.col("avg_price")), ["account", "symbol"], "full_outer")
    own = F.col("held").isNotNull()
    rules = F.array_compact(F.array(F.when(F.coalesce("net", F.lit(0)) != F.coalesce("held", F.lit(0)), "share_mismatch"), F.when(own & (F.col("held") < 1), "under_one_share"), F.when(own & (F.coalesce("avg_price", F.lit(0.0)) <= 0), "no_price")))
    return both.select("account", "symbol", F.explode(rules).alias("rule"))


def pending_check(pending: DataFrame, positions: DataFrame, today: str, limit_days: int = 40, other_days: int = 14) -> DataFrame:
    """account, symbol and rule for orders that are malformed, oversold, doubled or stale."""
    held = positions.select("account", "symbol", F.col("qty").alias("held"))
    w = Window.partitionBy("account", "symbol")
    o = pending.join(held, ["account", "symbol"], "left").withColumns({"_buys": F.count_if(F.col("side") == "buy").over(w), "_age": F.datediff(F.lit(today).cast("date"), "placed")})
    limit = F.col("kind") == "limit_entry"
    known = F.col("side").isin("buy", "sell")
    rules = F.array_compact(F.array(F.when(~F.coalesce(known, F.lit(False)), "unknown_side"), F.when((F.col("side") == "buy") & (F.coalesce("notional", F.lit(0.0)) <= 0), "no_reservation"), F.when((F.col("side") == "sell") & (F.col("qty") > F.coalesce("held", F.lit(0))), "oversell"), F.when((F.col("side") == "buy") & (F.col("_buys") > 1), "double_reservation"), F.when(known & (F.col("_age") > F.when(limit, limit_days).otherwise(other_days)), "stale")))
    return o.select("account", "symbol", F.explode(rules).alias("rule")).distinct()


def equity_returns(equity: DataFrame) -> DataFrame:
    """Daily returns of an equity log with the day's deposits taken out."""
    w = Window.partitionBy("account").orderBy("date")
    before = F.lag("equity").over(w)
    paid = F.coalesce("deposited", F.lit(0.0)) - F.coalesce(F.lag("deposited").over(w), F.lit(0.0))
    return equity.withColumn("ret", F.when(before > 0, (F.col("equity") - paid) / before - 1))


def performance(returns: DataFrame, year: int = 252) -> DataFrame:
    """Total return, Sharpe ratio and maximum drawdown of each account."""
    run = F.exp(F.sum(F.log1p("ret")).over(Window.partitionBy("account").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    c = returns.where("ret > -1").withColumn("_c", run)
    top = F.greatest(F.lit(1.0), F.max("_c").over(Window.partitionBy("account").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    c = c.withColumn("_d", F.col("_c") / top - 1)
    return c.groupBy("account").agg(F.count("ret").alias("n"), (F.exp(F.sum(F.log1p("ret"))) - 1).alias("total"), (F.try_divide(F.avg("ret"), F.stddev_samp("ret")) * F.sqrt(F.lit(year))).alias("sharpe"), F.min("_d").alias("max_drawdown"))


def latest_rows(log: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each key: what a log keeps."""
    return log.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(order).desc()))).where(F.col("_rn") <= n).drop("_rn")


def insert_absent(log: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The log and those new rows whose key it doesn't have."""
    return log.unionByName(new.join(log.select(key), key, "left_anti"), allowMissingColumns=True)


def upsert_days(log: DataFrame, new: DataFrame, key: str = "date", size: str = "n") -> DataFrame:
    """One row a day: the one with more entries, of equals the new one."""
    both = log.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.col(size).desc(), F.col("_new").desc())
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def signal_summary(signals: DataFrame, by: list[str]) -> DataFrame:
    """Hit share, expectancy, mean win and loss, profit factor (infinite without losses) and t of evaluated signals."""
    s = signals.where("return_pct IS NOT NULL")
    win, loss = F.when(F.col("return_pct") > 0, F.col("return_pct")), F.when(F.col("return_pct") <= 0, F.col("return_pct"))
    lost = -F.sum(loss)
    pf = F.when(F.coalesce(lost, F.lit(0.0)) == 0, F.when(F.count(win) > 0, float("inf"))).otherwise(F.coalesce(F.sum(win), F.lit(0.0)) / lost)
    return s.groupBy(*by).agg(F.count("*").alias("n"), (F.count(win) / F.count("*")).alias("hit_rate"), F.avg("return_pct").alias("expectancy"), F.avg(win).alias("avg_win"), F.avg(loss).alias("avg_loss"), pf.alias("profit_factor"), (F.try_divide(F.avg("return_pct"), F.stddev_samp("return_pct")) * F.sqrt(F.count("*"))).alias("t"))


def score_buckets(signals: DataFrame, edges: tuple[float, ...] = (0, 60, 70, 80, 101)) -> DataFrame:
    """Signals by half-open score buckets; empty ones keep a row."""
    dim = signals.sparkSession.createDataFrame([(float(a), float(b)) for a, b in zip(edges, edges[1:], strict=False)], "low double, high double")
    low = F.coalesce(*[F.when((F.col("score") >= a) & (F.col("score") < b), F.lit(float(a))) for a, b in zip(edges, edges[1:], strict=False)])
    g = signals.withColumn("low", low).where("low IS NOT NULL AND return_pct IS NOT NULL").groupBy("low").agg(F.count("*").alias("n"), F.avg("return_pct").alias("mean"), F.avg((F.col("return_pct") > 0).cast("double")).alias("hit_rate"))
    return dim.join(g, "low", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def slippage(fills: DataFrame, by: list[str]) -> DataFrame:
    """Slippage in basis points (positive costs) of filled legs: count, median, mean, 90th percentile and maximum.

    The percentile is a measured value, the int(0.9 n)-th in order, or the first: found from counts of distinct values."""
    bp = F.when(F.col("side") == "buy", F.col("fill") / F.col("ref") - 1).otherwise(1 - F.col("fill") / F.col("ref")) * 1e4
    f = fills.where("fill IS NOT NULL AND ref > 0").withColumn("_bp", bp)
    g = f.groupBy(*by).agg(F.count("*").alias("n"), F.median("_bp").alias("median_bp"), F.avg("_bp").alias("mean_bp"), F.max("_bp").alias("max_bp"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy("_bp"))
    ranked = f.groupBy(*by, "_bp").agg(F.count("*").alias("_c")).withColumn("_upto", upto).join(g.select(*by, "n"), by)
    p90 = ranked.where(F.col("_upto") >= F.greatest(F.lit(1), F.floor(F.col("n") * 0.9))).groupBy(*by).agg(F.min("_bp").alias("p90_bp"))
    return g.join(p90, by).select(*by, "n", "median_bp", "mean_bp", "p90_bp", "max_bp")


def round_trips(legs: DataFrame, leg: str = "leg", entry: str = "entry", risk_pct: float = 0.30) -> DataFrame:
    """exit leg, bp and r: the medians of the entry and of each exit leg added, and by a stop's distance in percent; none for legs without fills."""
    first = legs.where(F.col(leg) == entry).agg(F.first("median_bp").alias("_entry"))  # one row
    both = legs.where(F.col(leg) != entry).crossJoin(F.broadcast(first)).withColumn("bp", F.col("median_bp") + F.col("_entry")).where("bp IS NOT NULL")
    return both.select(F.col(leg).alias("exit_leg"), "bp", (F.col("bp") / 1e4 / (risk_pct / 100)).alias("r"))


def concentration(weights: DataFrame) -> DataFrame:
    """Sector weights, Herfindahl index and the largest sector of each portfolio."""
    s = weights.groupBy("account", "sector").agg(F.sum("weight").alias("w"))
    return s.groupBy("account").agg(F.sum(F.col("w") * F.col("w")).alias("hhi"), F.max(F.struct("w", "sector")).alias("t")).select("account", "hhi", F.col("t.sector").alias("top_sector"), F.col("t.w").alias("top_weight"))


def ohlc_violations(bars: DataFrame) -> DataFrame:
    """Counts of broken bar rules per ticker, with a relative tolerance for float noise."""
    tol = F.abs("close") * 1e-9
    return bars.groupBy("ticker").agg(F.count("*").alias("n"), F.count_if(F.col("high") < F.greatest("open", "close") - tol).alias("high_below"), F.count_if(F.col("low") > F.least("open", "close") + tol).alias("low_above"), F.count_if(F.col("high") < F.col("low") - tol).alias("inverted"), F.count_if(F.least("open", "high", "low", "close") <= 0).alias("not_positive"))


def jumps(bars: DataFrame, pct: float = 30.0) -> DataFrame:
    """Bars whose close moved by more than pct percent."""
    w = Window.partitionBy("ticker").orderBy("date")
    return bars.withColumn("change_pct", (F.col("close") / F.lag("close").over(w) - 1) * 100).where(F.abs("change_pct") > pct)
