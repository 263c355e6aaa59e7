"""Trade plans as they could be drawn at each bar, fills at prices that could be had, and entry rules compared on the same setups.

Zones are events with a life: born at a bar, dead at the first later bar that trades through them. Each event finds its end within
one window ahead, and each bar reads the live ones of one window behind, so a plan sees nothing past its own bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formulas import rnd
from ..sources.work import cut
from .indicators import atr, by_time, full, swings, trailing
from .simulate import cooled_down, first_touch, numbered

#: Bars of the windows, points of each structure, thresholds of direction and confidence, bands of the stop's distance in percent.
ZONE_BARS, BIAS_BARS, RANGE_BARS, SIDE, SWEEP_BARS, LEAST_BARS = 80, 60, 60, 5, 3, 60
SWEEP, IN_GAP, NEAR_BLOCK, BREAK, DISCOUNT, PREMIUM, MOST = 20, 15, 10, 10, 5, 8, 30
BIAS, MEDIUM, HIGH = 10, 12, 25
BANDS = ((2.34, "A"), (1.75, "B"), (1.34, "C"))
NEAR, BUFFER, LEAST_GAP, LEAST_MOVE = 0.03, 0.25, 0.03, 1.0


def _born(b: DataFrame) -> DataFrame:
    """The zones and breaks that each bar gives birth to, with the position of the bar that ends (zones) or makes (breaks) them."""
    w = by_time()
    ahead = F.collect_list(F.struct("pos", "low", "high", "close")).over(w.rowsBetween(1, ZONE_BARS - 1))
    h2, l2 = F.lag("high", 2).over(w), F.lag("low", 2).over(w)
    move = (F.lead("close").over(w) / F.col("close") - 1) * 100
    b = b.withColumns({"_ahead": ahead, "_h2": h2, "_l2": l2, "_move": move, "_last": F.when(F.col("swing_low"), F.struct("pos", F.lit("L").alias("side"), F.col("low").alias("price"))).when(F.col("swing_high"), F.struct("pos", F.lit("H").alias("side"), F.col("high").alias("price")))})
    first = lambda test: F.array_min(F.transform(F.filter("_ahead", test), lambda x: x["pos"]))
    zone = lambda kind, top, bottom, end: F.struct("pos", F.lit(kind).alias("kind"), top.alias("top"), bottom.alias("bottom"), end.alias("end"))
    low, high = F.col("low"), F.col("high")
    gap = F.when(F.col("_h2") < low, zone("bull", low, F.col("_h2"), first(lambda x: x["low"] <= F.col("_h2")))).when(F.col("_l2") > high, zone("bear", F.col("_l2"), high, first(lambda x: x["high"] >= F.col("_l2"))))
    block = F.when((F.col("close") < F.col("open")) & (F.col("_move") >= LEAST_MOVE), zone("bull", high, low, first(lambda x: x["low"] <= low))).when((F.col("close") > F.col("open")) & (F.col("_move") <= -LEAST_MOVE), zone("bear", high, low, first(lambda x: x["high"] >= high)))
    before = F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    b = b.withColumns({"_gap": gap, "_block": F.when(F.col("pos") > 0, block), "_before": before})
    broken = lambda s, no: F.struct(F.when(s["side"] == "H", first(lambda x: x["close"] > s["price"])).otherwise(first(lambda x: x["close"] < s["price"])).alias("at"), F.col("pos"), F.lit(no).alias("no"), (s["side"] == "H").alias("bull"), s["pos"].alias("since"))
    both = F.struct("pos", F.lit("H").alias("side"), F.col("high").alias("price"))
    breaks = F.array_compact(F.array(F.when((F.col("swing_high") | F.col("swing_low")) & F.col("_before").isNotNull(), broken(F.col("_before"), 0)), F.when(F.col("swing_high") & F.col("swing_low"), broken(both, 1))))
    return b.withColumn("_breaks", breaks).drop("_ahead", "_h2", "_l2", "_move", "_last", "_before")


def structure_lines(bars: DataFrame) -> DataFrame:
    """bars with pos and, as seen at each: bias (-30 to 30), signals (how many parts spoke), the range's high, low and mid, atr,
    trend_down, the entry zone and first two targets of a long and of a short plan with what the zone is made of.

    Null prices give no zone and no plan. Bars are numbered by date; rows of one ticker and date must be one bar."""
    w = by_time()
    b = _born(swings(atr(numbered(bars)), SIDE))
    t, c = F.col("pos"), F.col("close")
    back = lambda column, a, z: F.collect_list(column).over(w.rowsBetween(-a, -z))
    n60, prior = trailing(RANGE_BARS), w.rowsBetween(-SWEEP_BARS, -1)
    ma = full(50, F.avg("close"), trailing(50))
    known = lambda event, value: F.collect_list(F.when(event, value)).over(w.rowsBetween(-(ZONE_BARS - 1 - SIDE), -SIDE))
    b = b.withColumns({
        "_gaps": back("_gap", ZONE_BARS - 3, 0), "_blocks": back("_block", ZONE_BARS - 2, 1), "_all": F.flatten(back("_breaks", ZONE_BARS - 1 - SIDE, SIDE)), "_ma": ma,
        "range_high": F.max("high").over(n60), "range_low": F.min("low").over(n60), "_ph": F.max("high").over(prior), "_pl": F.min("low").over(prior),
        "_tops": known(F.col("swing_high"), F.col("high")), "_dips": known(F.col("swing_low"), F.col("low")),
    })
    b = b.withColumns({"range_mid": (F.col("range_high") + F.col("range_low")) / 2, "_past": F.lag("_ma", 20).over(w), "_pm": (F.col("_ph") + F.col("_pl")) / 2})
    live = lambda a, test: F.filter(a, lambda z: (z["end"].isNull() | (z["end"] > t)) & test(z))
    wide = lambda z: (z["top"] - z["bottom"]) / c * 100 >= LEAST_GAP
    b = b.withColumns({"_gaps": live("_gaps", wide), "_blocks": live("_blocks", lambda z: z["bottom"].isNotNull())})
    b = b.withColumn("_break", F.array_max(F.filter("_all", lambda x: (x["since"] >= t - (ZONE_BARS - 1 - SIDE)) & (x["at"] <= t))))
    # the bias: each part is points for a long, or against it
    inside = lambda kind: F.exists("_gaps", lambda z: (z["kind"] == kind) & (z["pos"] >= t - (BIAS_BARS - 3)) & c.between(z["bottom"], z["top"]))
    near = lambda kind: F.exists("_blocks", lambda z: (z["kind"] == kind) & (z["pos"] >= t - (BIAS_BARS - 2)) & c.between(z["bottom"] * 0.98, z["top"] * 1.02))
    up = (F.col("low") < F.col("_pl")) & (c > F.col("_pm")) & (c < F.col("_ph"))
    down = (F.col("high") > F.col("_ph")) & (c > F.col("_pl")) & (c < F.col("_pm"))
    place = rnd(F.when(F.col("range_high") > F.col("range_low"), (c - F.col("range_low")) / (F.col("range_high") - F.col("range_low")) * 100).otherwise(50.0), 1)
    pts = lambda test, n: F.when(test, n).otherwise(0)
    parts = [
        F.when(up, SWEEP).when(down, -SWEEP).otherwise(0), pts(inside("bull"), IN_GAP), pts(inside("bear"), -IN_GAP), pts(near("bull"), NEAR_BLOCK), pts(near("bear"), -NEAR_BLOCK),
        F.when(F.col("_break.bull"), BREAK).when(~F.col("_break.bull"), -BREAK).otherwise(0),
        F.when((c <= F.col("range_mid")) & (place < 30), DISCOUNT).when((c > F.col("range_mid")) & (place > 80), -PREMIUM).otherwise(0),
    ]
    b = b.withColumn("_parts", F.array(*parts))
    enough = t >= LEAST_BARS - 1
    total = F.aggregate("_parts", F.lit(0), lambda s, x: s + x)
    b = b.withColumns({"bias": F.when(enough, F.greatest(F.lit(-MOST), F.least(F.lit(MOST), total))).otherwise(0), "signals": F.when(enough, F.size(F.filter("_parts", lambda x: x != 0))).otherwise(0), "trend_down": F.coalesce((c < F.col("_ma")) & (F.col("_ma") <= F.col("_past")), F.lit(False))})
    # the nearest live zone on the right side; the older one of equals
    nearest_long = lambda a: F.array_max(F.transform(F.filter(a, lambda z: (z["kind"] == "bull") & (z["top"] <= c * (1 + NEAR))), lambda z: F.struct(z["top"].alias("edge"), (-z["pos"]).alias("age"), z["bottom"].alias("other"))))
    nearest_short = lambda a: F.array_min(F.transform(F.filter(a, lambda z: (z["kind"] == "bear") & (z["bottom"] >= c * (1 - NEAR))), lambda z: F.struct(z["bottom"].alias("edge"), z["pos"].alias("age"), z["top"].alias("other"))))
    b = b.withColumns({"_lb": nearest_long("_blocks"), "_lg": nearest_long("_gaps"), "_sb": nearest_short("_blocks"), "_sg": nearest_short("_gaps")})
    made = lambda a, g, rest: F.when(F.col(a).isNotNull(), "block").when(F.col(g).isNotNull(), "gap").otherwise(rest)
    b = b.withColumns({
        "long_low": F.coalesce("_lb.other", "_lg.other", "range_low"), "long_high": F.coalesce(F.col("_lb.edge"), F.col("_lg.edge"), F.least("range_mid", "close")), "long_zone": made("_lb", "_lg", "discount"),
        "short_low": F.coalesce(F.col("_sb.edge"), F.col("_sg.edge"), F.greatest("range_mid", "close")), "short_high": F.coalesce("_sb.other", "_sg.other", "range_high"), "short_zone": made("_sb", "_sg", "premium"),
    })
    lref, sref = (F.col("long_low") + F.col("long_high")) / 2, (F.col("short_low") + F.col("short_high")) / 2
    top, dip = F.coalesce(F.array_min(F.filter("_tops", lambda x: x > c)), "range_high"), F.coalesce(F.array_max(F.filter("_dips", lambda x: x < c)), "range_low")
    b = b.withColumns({"long_t1": F.when(top <= lref, F.col("range_high")).otherwise(top), "short_t1": F.when(dip >= sref, F.col("range_low")).otherwise(dip)})
    b = b.withColumns({"long_t2": F.when(F.col("range_high") > F.col("long_t1"), F.col("range_high")).otherwise(F.col("long_t1") + (F.col("long_t1") - lref)), "short_t2": F.when(F.col("range_low") < F.col("short_t1"), F.col("range_low")).otherwise(F.col("short_t1") - (sref - F.col("short_t1")))})
    return b.drop(*[x for x in b.columns if x.startswith("_")], "swing_high", "swing_low")


def grade(distance_pct: Column) -> Column:
    """How well a stop's distance bears costs, A to D."""
    g = F
    for limit, name in BANDS:
        g = g.when(distance_pct > limit, name)
    return g.otherwise("D")


def assemble(lines: DataFrame, min_rr: float = 2.0) -> DataFrame:
    """lines (direction, entry_low, entry_high, stop, target, target2, veto or null) with entry_ref, rr and rr2 (null where they make no
    sense), risk_pct, cost_grade, valid, actionable and reason; lines are rounded to cents at the end, as orders have no finer ones."""
    long = F.col("direction") == "long"
    b = lines.withColumns({"_a": F.least("entry_low", "entry_high"), "_z": F.greatest("entry_low", "entry_high")}).withColumns({"entry_low": F.col("_a"), "entry_high": F.col("_z"), "entry_ref": (F.col("_a") + F.col("_z")) / 2}).drop("_a", "_z")
    ref, stop = F.col("entry_ref"), F.col("stop")
    risk = F.when(long, ref - stop).otherwise(stop - ref)
    gain = lambda x: F.when(long, F.col(x) - ref).otherwise(ref - F.col(x))
    ratio = lambda x: F.when((risk > 0) & (gain(x) > 0), gain(x) / risk)
    order = F.when(long, stop < F.col("entry_low")).otherwise(stop > F.col("entry_high")) & (gain("target") > 0) & (gain("target2") > 0)
    b = b.withColumns({"rr": ratio("target"), "rr2": ratio("target2"), "_ok": F.coalesce(order, F.lit(False)), "risk_pct": F.when(ref > 0, F.abs(ref - stop) / ref * 100).otherwise(0.0)})
    valid = F.col("veto").isNull() & F.col("_ok") & F.coalesce(F.col("rr") >= min_rr, F.lit(False))
    b = b.withColumns({"cost_grade": F.when(ref > 0, grade(F.col("risk_pct"))).otherwise("D"), "valid": valid})
    why = F.coalesce("veto", F.when(~F.col("_ok"), "order").when(~F.col("valid"), "reward").when(~long, "short").when(~F.col("cost_grade").isin("A", "B"), "grade"))
    cents = {x: rnd(F.col(x), 2) for x in ("entry_low", "entry_high", "entry_ref", "stop", "target", "target2", "rr", "rr2", "risk_pct")}
    return b.withColumns({"actionable": F.col("valid") & long & F.col("cost_grade").isin("A", "B"), "reason": why}).withColumns(cents).drop("_ok")


def build_plans(bars: DataFrame, direction: str | None = None, min_rr: float = 2.0, short_filter: bool = True) -> DataFrame:
    """A plan for each bar that has a direction and history: by the sign of the bias where it is strong enough, or the one given.

    Shorts need agreement of MEDIUM or more and, with short_filter, a close under a long mean that doesn't rise; else veto says why
    and the plan isn't valid. A direction given from outside keeps these gates; confidence is what the bias agrees with."""
    if direction not in (None, "long", "short"):
        raise ValueError("direction is long, short or None")
    b = structure_lines(bars).where(F.col("pos") >= LEAST_BARS - 1)
    b = b.withColumn("direction", F.lit(direction) if direction else F.when(F.col("bias") >= BIAS, "long").when(F.col("bias") <= -BIAS, "short")).where("direction IS NOT NULL")
    long = F.col("direction") == "long"
    agrees = F.greatest(F.when(long, F.col("bias")).otherwise(-F.col("bias")), F.lit(0))
    pick = lambda x: F.when(long, F.col(f"long_{x}")).otherwise(F.col(f"short_{x}"))
    weak = F.when(~long & (agrees < MEDIUM), "weak short")
    trend = F.when(~long & ~F.col("trend_down"), "trend") if short_filter else F.lit(None).cast("string")
    lines = b.select(
        F.concat_ws(":", "ticker", F.col("pos").cast("string")).alias("plan_id"), "ticker", "date", F.col("pos").alias("start_pos"), "direction", "bias", "signals",
        F.when(agrees >= HIGH, "high").when(agrees >= MEDIUM, "medium").otherwise("low").alias("confidence"), pick("zone").alias("zone"), pick("low").alias("entry_low"), pick("high").alias("entry_high"),
        F.when(long, F.col("long_low") - BUFFER * F.col("atr")).otherwise(F.col("short_high") + BUFFER * F.col("atr")).alias("stop"), pick("t1").alias("target"), pick("t2").alias("target2"), F.coalesce(weak, trend).alias("veto"),
    )
    return assemble(lines, min_rr)


def placeable(trades: DataFrame, bars: DataFrame, limit: str, own_basis: bool = False) -> DataFrame:
    """trades (first_touch's, with entry_ref) priced as they could be placed: bought at the limit or a better open, stopped at the
    stop or a worse open, sold at the target or a better open. r is in the plan's risk, or with own_basis in that of the price paid;
    no risk left under that price makes a trade a skip. Adds fill_price, exit_price; a timeout's r stays 0 and its exit the fill.

    Two equi-joins by ticker and position."""
    opens = bars.select("ticker", F.col("pos").alias("fill_pos"), F.col("open").alias("_fo"))
    ends = bars.select("ticker", F.col("pos").alias("exit_pos"), F.col("open").alias("_eo"))
    b = trades.join(opens, ["ticker", "fill_pos"], "left").join(ends, ["ticker", "exit_pos"], "left")
    long, stop = F.col("direction") == "long", F.col("stop")
    filled = F.col("fill_pos").isNotNull() & ~F.col("outcome").isin("nofill", "skip")
    b = b.withColumn("fill_price", F.when(filled, F.when(long, F.least("_fo", limit)).otherwise(F.greatest("_fo", limit))))
    base = F.col("fill_price") if own_basis else F.col("entry_ref")
    b = b.withColumn("_risk", F.when(long, base - stop).otherwise(stop - base) if own_basis else F.abs(base - stop))
    done = F.col("outcome").isin("win", "loss")
    b = b.withColumn("outcome", F.when(done & ~F.coalesce(F.col("_risk") > 0, F.lit(False)), "skip").otherwise(F.col("outcome")))
    exit_price = F.when(F.col("outcome") == "loss", F.when(long, F.least("_eo", "stop")).otherwise(F.greatest("_eo", "stop"))).when(F.col("outcome") == "win", F.when(long, F.greatest("_eo", "target")).otherwise(F.least("_eo", "target"))).otherwise(F.col("fill_price"))
    b = b.withColumn("exit_price", exit_price)
    r = F.when(F.col("outcome").isin("win", "loss"), F.when(long, F.col("exit_price") - F.col("fill_price")).otherwise(F.col("fill_price") - F.col("exit_price")) / F.col("_risk")).otherwise(0.0)
    return b.withColumn("r", r).drop("_fo", "_eo", "_risk")


def entry_rules(plans: DataFrame, bars: DataFrame, fill_window: int = 15, hold_window: int = 30, cooldown: int = 3, from_pos: int = 120) -> DataFrame:
    """The same setups under eight ways to enter, a row each: zone (fills at its near edge, counted at its middle: a bound, not a
    rule), middle, near, far and market (the next open), and middle, near and far at prices that could be had (_gap).

    A walk in each ticker picks valid plans by the outcome of zone, so rules are compared on pairs. r is in the plan's risk; of far
    and market in that of their own line, and risk_pct too. Lines without risk or reward are a skip. bars must carry pos."""
    n = F.max("pos").over(Window.partitionBy("ticker"))
    b = bars.withColumn("_n", n)
    opens = b.select("ticker", (F.col("pos") - 1).alias("start_pos"), F.col("open").alias("_next"))
    # A plan is dear to draw and is read by the walk, the setups and every rule; and a filter on it would be pushed into what draws it.
    p = cut(plans).where(F.col("valid") & (F.col("start_pos") >= from_pos)).join(opens, ["ticker", "start_pos"])
    long = F.col("direction") == "long"
    first = first_touch(p.select("plan_id", "ticker", "start_pos", "direction", "entry_low", "entry_high", "stop", "target", "rr"), bars, fill_window, hold_window)
    first = cut(first)  # the walk reads it twice
    setups = p.join(cooled_down(first, cooldown, fill_window, 0).select("plan_id"), "plan_id", "left_semi")
    setups = setups.withColumns({"near": F.when(long, F.col("entry_high")).otherwise(F.col("entry_low")), "far": F.when(long, F.col("entry_low")).otherwise(F.col("entry_high")), "plan_risk": F.when(long, F.col("entry_ref") - F.col("stop")).otherwise(F.col("stop") - F.col("entry_ref"))})
    rule = lambda name, touch, paid, own: F.struct(F.lit(name).alias("rule"), touch.alias("touch"), paid.alias("paid"), F.lit(own).alias("own"))
    open_end = F.when(long, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    ways = F.array(rule("zone", F.col("near"), F.col("entry_ref"), False), rule("middle", F.col("entry_ref"), F.col("entry_ref"), False), rule("near", F.col("near"), F.col("near"), False), rule("far", F.col("far"), F.col("far"), True), rule("market", open_end, F.col("_next"), True))
    s = setups.withColumn("w", F.explode(ways)).select("*", "w.*").drop("w").withColumnsRenamed({"plan_id": "setup", "rr": "plan_rr", "entry_low": "zone_low", "entry_high": "zone_high"})
    risk = F.when(long, F.col("paid") - F.col("stop")).otherwise(F.col("stop") - F.col("paid"))
    gain = F.when(long, F.col("target") - F.col("paid")).otherwise(F.col("paid") - F.col("target"))
    s = s.withColumns({"plan_id": F.concat_ws("/", "setup", "rule"), "_risk": risk, "rr": F.when(F.col("rule").isin("zone", "middle"), F.col("plan_rr")).when(risk > 0, gain / risk), "entry_low": F.col("touch"), "entry_high": F.col("touch")})
    s = s.withColumn("_skip", F.col("own") & ~F.coalesce((risk > 0) & (gain > 0), F.lit(False)))
    keep = ("plan_id", "setup", "rule", "ticker", "date", "start_pos", "direction", "zone", "cost_grade", "actionable", "own", "paid", "entry_ref", "stop", "target", "plan_risk", "_risk", "_skip", "risk_pct")
    got = first_touch(s.select(*keep, "entry_low", "entry_high", "rr"), bars, fill_window, hold_window)
    nothing = F.lit(None).cast("long")
    got = got.withColumns({"outcome": F.when(F.col("_skip"), "skip").otherwise(F.col("outcome")), "r": F.when(F.col("_skip"), 0.0).when(F.col("own"), F.col("r")).otherwise(F.col("r") * F.col("_risk") / F.col("plan_risk")), "fill_pos": F.when(F.col("_skip"), nothing).otherwise(F.col("fill_pos")), "exit_pos": F.when(F.col("_skip"), nothing).otherwise(F.col("exit_pos")), "risk_pct": F.when(F.col("own"), F.when(F.col("paid") > 0, F.col("_risk") / F.col("paid") * 100)).otherwise(F.col("risk_pct"))})
    got = cut(got)  # three of the rules read another's fills
    out = ("setup", "rule", "ticker", "date", "direction", "zone", "cost_grade", "actionable", "outcome", "fill_pos", "exit_pos", "r", "risk_pct")
    gaps = lambda own, names: placeable(got.where(F.col("rule").isin(*names)), bars, "paid", own).withColumn("rule", F.concat("rule", F.lit("_gap")))
    theirs = gaps(True, ["far"]).withColumn("risk_pct", F.when(F.col("outcome").isin("win", "loss"), F.when(long, F.col("fill_price") - F.col("stop")).otherwise(F.col("stop") - F.col("fill_price")) / F.col("fill_price") * 100).when(F.col("outcome") != "skip", F.col("risk_pct")).otherwise(F.when(F.col("fill_price").isNull(), F.col("risk_pct"))))
    return got.select(*out).unionByName(gaps(False, ["middle", "near"]).select(*out)).unionByName(theirs.select(*out))


def net_of_costs(trades: DataFrame, cost_bps: float = 40.0) -> DataFrame:
    """Filled trades with net_r: a round trip's cost in R is what the stop's distance makes of it."""
    return trades.where(~F.col("outcome").isin("nofill", "skip")).withColumn("net_r", F.col("r") - F.try_divide(F.lit(cost_bps / 1e4), F.col("risk_pct") / 100))


def rule_table(trades: DataFrame, by: list[str], cost_bps: float = 40.0) -> DataFrame:
    """Setups, fills, mean R before and after costs and its t by group; skips and those without a fill count as setups only."""
    sizes = trades.groupBy(*by).agg(F.count("*").alias("setups"), F.avg((F.col("direction") == "long").cast("double")).alias("long_share"), F.avg(F.col("actionable").cast("double")).alias("actionable_share"))
    net = net_of_costs(trades, cost_bps).groupBy(*by).agg(F.count("*").alias("filled"), F.avg("r").alias("avg_r"), F.avg("net_r").alias("net_r"), F.sum("net_r").alias("net_sum"), (F.avg("net_r") / (F.nullif(F.stddev_samp("net_r"), F.lit(0.0)) / F.sqrt(F.count("net_r")))).alias("t"))
    return sizes.join(net, by, "left").withColumn("filled", F.coalesce("filled", F.lit(0).cast("long")))
