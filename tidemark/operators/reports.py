"""Data checks, listings, outcomes and report figures over panels and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(bars: DataFrame, least: int = 30, volume_window: int = 20, min_volume: float = 0.0) -> DataFrame:
    """ticker, n (bars with a close), mean_volume of the last volume_window of them and usable."""
    latest = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    known = bars.where("close IS NOT NULL").withColumn("_k", F.row_number().over(latest))
    out = known.groupBy("ticker").agg(F.count("*").alias("n"), F.avg(F.when(F.col("_k") <= volume_window, F.col("volume"))).alias("mean_volume"))
    return out.withColumn("usable", (F.col("n") >= least) & ((F.coalesce("mean_volume", F.lit(0.0)) >= min_volume) if min_volume > 0 else F.lit(True)))


def split_adjustment(bars: DataFrame, splits: DataFrame, around: int = 5, tolerance: float = 0.15) -> DataFrame:
    """ticker, day, ratio, implied (mean close before over after) and adjusted, null where either side has fewer than around bars."""
    both = bars.select("ticker", "date", "close").join(splits, "ticker")
    side = Window.partitionBy("ticker", "day", F.col("date") < F.col("day")).orderBy(F.abs(F.datediff("date", "day")))
    near = both.withColumn("_k", F.row_number().over(side)).where(F.col("_k") <= around)
    early = F.col("date") < F.col("day")
    mean = near.groupBy("ticker", "day", "ratio").agg(F.avg(F.when(early, F.col("close"))).alias("b"), F.avg(F.when(~early, F.col("close"))).alias("a"), F.count_if(early).alias("nb"), F.count_if(~early).alias("na"))
    implied = F.when((F.col("nb") == around) & (F.col("na") == around), F.col("b") / F.col("a"))
    return mean.select("ticker", "day", "ratio", implied.alias("implied")).withColumn("adjusted", F.abs(F.col("implied") - 1) < tolerance)


def risk_metrics(returns: DataFrame, risk_free: float = 0.045, least: int = 60) -> DataFrame:
    """Per ticker of returns (ticker, date, ret, market): beta, var95, var99, cvar95 and vol in percent, sharpe; tickers of fewer rows are left out."""
    known = returns.where("ret IS NOT NULL AND market IS NOT NULL")
    q = known.groupBy("ticker").agg(
        F.count("*").alias("n"),
        (F.covar_samp("ret", "market") / (F.var_pop("market") + 1e-12)).alias("beta"),
        F.percentile("ret", F.lit(0.05)).alias("_q5"),
        F.percentile("ret", F.lit(0.01)).alias("_q1"),
        F.avg("ret").alias("_mean"),
        F.stddev_samp("ret").alias("_sd"),
    ).where(F.col("n") >= least)
    tail = known.join(q.select("ticker", "_q5"), "ticker").where(F.col("ret") <= F.col("_q5")).groupBy("ticker").agg((F.avg("ret") * 100).alias("cvar95"))
    sharpe = F.when(F.col("_sd") > 0, (F.col("_mean") - risk_free / 252) / F.col("_sd") * 252**0.5).otherwise(0.0)
    return q.join(tail, "ticker").select("ticker", "n", "beta", (F.col("_q5") * 100).alias("var95"), (F.col("_q1") * 100).alias("var99"), "cvar95", (F.col("_sd") * 252**0.5 * 100).alias("vol"), sharpe.alias("sharpe"))


def rotation(bars: DataFrame, parts: tuple[tuple[int, float], ...] = ((21, 0.5), (63, 0.3), (126, 0.2)), mean: int = 50, least: int = 21) -> DataFrame:
    """Per ticker: last close, its return in percent over each number of bars, whether it is above its mean, and the momentum: the weighted mean of the returns there are."""
    latest = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    k = bars.where("close IS NOT NULL").withColumn("_k", F.row_number().over(latest)).where(F.col("_k") <= max(mean, *[n for n, _ in parts]))
    at = lambda n: F.max(F.when(F.col("_k") == n, F.col("close")))
    last = k.groupBy("ticker").agg(at(1).alias("last"), F.count("*").alias("_n"), *[at(n).alias(f"_c{n}") for n, _ in parts], F.when(F.count("*") >= mean, F.avg(F.when(F.col("_k") <= mean, F.col("close")))).alias("_mean")).where(F.col("_n") >= least)
    rets = last.select("*", *[((F.col("last") / F.col(f"_c{n}") - 1) * 100).alias(f"r{n}") for n, _ in parts])
    score = sum((F.coalesce(F.col(f"r{n}") * w, F.lit(0.0)) for n, w in parts), F.lit(0.0)) / sum((F.when(F.col(f"r{n}").isNotNull(), w).otherwise(0.0) for n, w in parts), F.lit(0.0))
    return rets.select("ticker", "last", *[f"r{n}" for n, _ in parts], F.coalesce(F.col("last") > F.col("_mean"), F.lit(False)).alias("above_mean"), score.alias("momentum"))


def signal_outcomes(signals: DataFrame, bars: DataFrame, horizon: int = 21) -> DataFrame:
    """signals (ticker, entry_date, entry_price) with the date, price and percent return of the horizon-th close strictly after; null while it is missing."""
    closes = bars.where("close IS NOT NULL").select("ticker", "date", "close", F.lit(0).alias("_s"), F.lit(None).cast("double").alias("entry_price"))
    asks = signals.select("ticker", F.col("entry_date").alias("date"), F.lit(None).cast("double").alias("close"), F.lit(1).alias("_s"), "entry_price")
    w = Window.partitionBy("ticker").orderBy("date", "_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = closes.unionByName(asks).withColumn("_n", F.count("close").over(w))
    price = placed.where("_s = 0").select("ticker", "_n", F.col("date").alias("outcome_date"), F.col("close").alias("outcome_price"))
    out = placed.where("_s = 1").withColumn("_n", F.col("_n") + horizon).join(price, ["ticker", "_n"], "left")
    ret = F.when(F.col("entry_price") > 0, (F.col("outcome_price") / F.col("entry_price") - 1) * 100)
    return out.select("ticker", F.col("date").alias("entry_date"), "entry_price", "outcome_date", "outcome_price", ret.alias("return_pct"))


def listing_spans(snapshots: DataFrame) -> DataFrame:
    """ticker, cik, first_seen, last_seen, snapshots and listing_id of rows (snapshot, ticker, cik)."""
    g = snapshots.groupBy("ticker", "cik").agg(F.min("snapshot").alias("first_seen"), F.max("snapshot").alias("last_seen"), F.count("*").alias("snapshots"))
    return g.withColumn("listing_id", F.concat_ws(":", F.col("cik").cast("string"), "ticker"))


def delistings_by_year(members: DataFrame, last_bars: DataFrame) -> DataFrame:
    """Per year of members (year, asset): those whose last bar is not after the end of the next year; years not over by the panel's end are left out."""
    end = last_bars.agg(F.max("last_bar").alias("_end"))
    horizon = F.make_date(F.col("year") + 1, F.lit(12), F.lit(31))
    own = members.select("year", "asset").distinct().join(last_bars, "asset", "left").join(F.broadcast(end))  # one row
    return own.where(horizon <= F.col("_end")).groupBy("year").agg(F.count_if(F.col("last_bar") <= horizon).alias("delisted"))


def paired_difference(frame: DataFrame, a: str, b: str, by: list[str], bound: float = 2.0) -> DataFrame:
    """n, means and their standard errors, mean difference with its own, the share of periods that b wins, t and a verdict, of periods that have both.

    Differences that are all the same have a t of 999 with their sign, or 0; fewer than two are too few."""
    both = frame.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_d", F.col(b) - F.col(a))
    se = lambda x: F.stddev_samp(x) / F.sqrt(F.count("*"))
    g = both.groupBy(*by).agg(F.count("*").alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.avg("_d").alias("diff"), se("_d").alias("se"), se(a).alias("se_a"), se(b).alias("se_b"), (F.count_if(F.col("_d") > 0) / F.count("*") * 100).alias("wins_pct"))
    g = g.withColumn("t", F.when(F.col("se") > 0, F.col("diff") / F.col("se")).when(F.col("n") >= 2, F.signum("diff") * 999))
    return g.withColumn("verdict", F.when(F.col("n") < 2, "too few").when(F.col("t") >= bound, "better").when(F.col("t") <= -bound, "worse").otherwise("noise"))


def candidates(ranked: DataFrame, score: str, by: list[str], top: int, tie: str = "ticker") -> DataFrame:
    """side and the rows of the best top (buy) and of the last third, one at least (sell), of each group."""
    w = Window.partitionBy(*by)
    r = ranked.withColumns({"rank": F.row_number().over(w.orderBy(F.col(score).desc(), tie)), "_n": F.count("*").over(w)})
    buy, sell = r.where(F.col("rank") <= top).withColumn("side", F.lit("buy")), r.where(F.col("rank") > F.col("_n") - F.greatest(F.floor(F.col("_n") / 3), F.lit(1))).withColumn("side", F.lit("sell"))
    return buy.unionByName(sell).drop("_n")


def publishable(stats: DataFrame, log: DataFrame, growth: float = 1.05) -> DataFrame:
    """horizon, n, last_n: horizons of stats (horizon, n) whose greatest n is positive and growth times the last published one, or never published."""
    now = stats.groupBy("horizon").agg(F.max("n").alias("n")).where("n > 0")
    last = log.groupBy("horizon").agg(F.max("n").alias("last_n"))
    return now.join(last, "horizon", "left").where(F.col("last_n").isNull() | (F.col("n") >= F.col("last_n") * growth))


def coverage_by_analyst(log: DataFrame) -> DataFrame:
    """First and last date, dates and distinct tickers of each slug."""
    return log.where("score IS NOT NULL").groupBy("slug").agg(F.min("date").alias("first_seen"), F.max("date").alias("last_seen"), F.count_distinct("date").alias("days"), F.count_distinct("ticker").alias("tickers"))


def year_on_year(series: DataFrame, by: list[str], order: str, value: str, lag: int = 12) -> DataFrame:
    """Percent change to the lag-th observation before."""
    old = F.lag(value, lag).over(Window.partitionBy(*by).orderBy(order))
    return series.withColumn("yoy", F.when(old != 0, (F.col(value) - old) / F.abs(old) * 100))


def graham(eps: Column, growth_pct: Column, yield_pct: Column, conservative: bool = False) -> Column:
    """Intrinsic value by earnings, growth clipped to -5 to 30 and a bond yield of 1 at least; null without earnings."""
    g = F.greatest(F.lit(-5.0), F.least(F.lit(30.0), F.coalesce(growth_pct, F.lit(7.0))))
    return F.when(eps > 0, eps * (8.5 + (g if conservative else g * 2)) * (4.4 / F.greatest(yield_pct, F.lit(1.0))))


def having_all(frame: DataFrame, key: list[str], kind: str, kinds: int) -> DataFrame:
    """Keys that occur with every one of a number of kinds."""
    return frame.groupBy(*key).agg(F.count_distinct(kind).alias("_k")).where(F.col("_k") == kinds).select(*key)


def _from_last(bars: DataFrame, n: int) -> DataFrame:
    """The last n closes of each ticker with _k, 1 for the last."""
    w = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    return bars.where("close IS NOT NULL").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)


def daily_frames(bars: DataFrame, ts: str = "ts") -> DataFrame:
    """ticker and daily: whether the median number of bars a calendar date is one at most."""
    return bars.groupBy("ticker", F.to_date(ts).alias("_d")).agg(F.count("*").alias("_n")).groupBy("ticker").agg((F.median("_n") <= 1).alias("daily"))


def liquid(bars: DataFrame, days: int, least: float) -> DataFrame:
    """ticker, mean_volume and keeps over the last calendar days before the panel's end; a ticker without bars there is kept."""
    end = bars.agg(F.max("date").alias("_end"))
    own = bars.join(F.broadcast(end))  # one row
    g = own.groupBy("ticker").agg(F.avg(F.when(F.col("date") >= F.date_sub("_end", days), F.col("volume"))).alias("mean_volume"))
    return g.withColumn("keeps", F.coalesce(F.col("mean_volume") >= least, F.lit(True)))


def quintile_curves(returns: DataFrame) -> DataFrame:
    """date, leg, cum: cumulative percent of each quintile of returns (date, quintile, ret in percent), and of long_short, the fifth less
    the first on days that have both; sign and log_grown: of what 1 has grown to, which hold where cum leaves the range of doubles."""
    legs = returns.groupBy("date").agg(F.max(F.when(F.col("quintile") == 5, F.col("ret"))).alias("_5"), F.max(F.when(F.col("quintile") == 1, F.col("ret"))).alias("_1"))
    spread = legs.select("date", F.lit("long_short").alias("leg"), (F.col("_5") - F.col("_1")).alias("ret")).where("ret IS NOT NULL")
    every = returns.select("date", F.concat(F.lit("Q"), F.col("quintile").cast("string")).alias("leg"), "ret").unionByName(spread)
    x, w = 1 + F.col("ret") / 100, Window.partitionBy("leg").orderBy("date")
    # a running product from logarithms; a loss of over 100 percent turns its sign, one of 100 percent ends it
    sign = F.when(F.count_if(x == 0).over(w) > 0, 0).when(F.count_if(x < 0).over(w) % 2 == 1, -1).otherwise(1)
    own = every.withColumns({"sign": sign, "log_grown": F.sum(F.when(x != 0, F.log(F.abs(x)))).over(w)})
    grown = F.col("sign") * F.exp(F.coalesce("log_grown", F.lit(0.0)))
    return own.select("date", "leg", (grown * 100 - 100).alias("cum"), "sign", "log_grown")


def discard_rate(orders: DataFrame, by: list[str]) -> DataFrame:
    """n (orders not filled, filled or short of cash), nofill, cash_short, censored and the percent not filled; null without orders."""
    is_ = lambda *x: F.count_if(F.col("outcome").isin(*x))
    g = orders.groupBy(*by).agg(is_("nofill", "filled", "cash_short").alias("n"), is_("nofill").alias("nofill"), is_("cash_short").alias("cash_short"), is_("censored").alias("censored"))
    return g.withColumn("rate", F.when(F.col("n") > 0, F.col("nofill") / F.col("n") * 100))


def net_expectancy(trades: DataFrame, by: list[str], cost_bp: float) -> DataFrame:
    """Mean r of filled trades after a one-way cost, and the cost in basis points at which it is zero."""
    g = trades.groupBy(*by).agg(F.avg(F.col("r") - F.col("r_cost_per_bp") * cost_bp).alias("net"), F.try_divide(F.avg("r"), F.avg("r_cost_per_bp")).alias("breakeven_bp"))
    return g


def labels(bars: DataFrame, horizon: int = 20, threshold_pct: float = 0.0) -> DataFrame:
    """bars with label: 1 if the return to the horizon-th bar ahead is over the threshold, else 0; null at the end."""
    ahead = (F.lead("close", horizon).over(Window.partitionBy("ticker").orderBy("date")) / F.col("close") - 1) * 100
    return bars.withColumn("label", F.when(ahead.isNotNull(), (ahead > threshold_pct).cast("double")))


def relative_strength(bars: DataFrame, market: DataFrame, spans: tuple[int, ...] = (21, 63, 126)) -> DataFrame:
    """Per ticker and span n: percent return over the last n closes, the market's over its own last n, and their difference."""
    every = F.explode(F.array(*map(F.lit, spans))).alias("span")
    own = _from_last(bars, max(spans)).groupBy("ticker").agg(F.max_by("close", -F.col("_k")).alias("last"), F.count("*").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_k", "close"))).alias("_c"))
    back = own.select("ticker", "last", "_n", "_c", every).withColumn("_k", F.least("span", F.col("_n") - 1)).where("_k > 0")
    mine = back.select("ticker", "span", ((F.col("last") / F.try_element_at("_c", F.col("_k")) - 1) * 100).alias("ret"))
    m = _from_last(market.withColumn("ticker", F.lit("")), max(spans)).agg(F.map_from_entries(F.collect_list(F.struct("_k", "close"))).alias("_m"))
    both = mine.join(F.broadcast(m)).withColumn("market_ret", (F.try_element_at("_m", F.lit(1)) / F.try_element_at("_m", F.col("span")) - 1) * 100)  # one row
    return both.select("ticker", "span", "ret", "market_ret", (F.col("ret") - F.col("market_ret")).alias("strength"))


def momentum_table(bars: DataFrame) -> DataFrame:
    """Per ticker the percent returns over 21, 63, 126 and 252 closes and the mean score of the last three there are; 50 without any."""
    at = lambda n: F.max(F.when(F.col("_k") == n, F.col("close")))
    spans = (21, 63, 126, 252)
    last = _from_last(bars, 252).groupBy("ticker").agg(at(1).alias("_1"), *[at(n).alias(f"_c{n}") for n in spans])
    rets = last.select("ticker", *[((F.col("_1") - F.col(f"_c{n}")) / F.col(f"_c{n}") * 100).alias(f"m{n}") for n in spans])
    # The scores of a return above each bound, and at or below the last one.
    bands = [(30, 90), (15, 75), (5, 65), (0, 55), (-10, 40), (-20, 25)]

    def score(v: Column) -> Column:
        out = F.when(v.isNull(), F.lit(None).cast("int"))
        for bound, points in bands:
            out = out.when(v > bound, points)
        return out.otherwise(10)

    scores = F.filter(F.array(*[score(F.col(f"m{n}")) for n in spans[1:]]), lambda x: x.isNotNull())
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(scores), F.lit(0))
    return rets.withColumn("score", F.coalesce(mean, F.lit(50.0)))


def board(bars: DataFrame, spark: int = 22) -> DataFrame:
    """Per ticker with two closes or more: the last one, its percent change and the last spark closes, oldest first."""
    own = _from_last(bars, spark).groupBy("ticker").agg(F.count("*").alias("_n"), F.array_sort(F.collect_list(F.struct((-F.col("_k")).alias("k"), "close"))).alias("_s")).where("_n > 1")
    s = F.transform("_s", lambda x: x["close"])
    last, before = F.element_at(s, -1), F.element_at(s, -2)
    return own.select("ticker", last.alias("last"), F.when(before != 0, (last - before) / before * 100).otherwise(0.0).alias("change_pct"), s.alias("closes"))


def audit(names: DataFrame, bars: DataFrame) -> DataFrame:
    """Names of a universe that stand in it twice or more (duplicate) or have no close in the panel (dead)."""
    alive = bars.where("close IS NOT NULL").select("ticker").distinct().withColumn("_a", F.lit(True))
    g = names.groupBy("ticker").agg(F.count("*").alias("n")).join(alive, "ticker", "left")
    return g.select("ticker", (F.col("n") > 1).alias("duplicate"), F.col("_a").isNull().alias("dead")).where("duplicate OR dead")


def day_gaps(scores: DataFrame, slugs: int) -> DataFrame:
    """Per date: tickers, and those dropped as they lack some of the slugs."""
    own = scores.groupBy("date", "ticker").agg(F.count_distinct(F.when(F.col("score").isNotNull(), F.col("slug"))).alias("_k"))
    return own.groupBy("date").agg(F.count("*").alias("tickers"), F.count_if(F.col("_k") < slugs).alias("dropped"))
