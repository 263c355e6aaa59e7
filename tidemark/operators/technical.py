"""The nine-part technical score of every bar, its weights by regime, and how well each part has told what came after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formulas import correlation
from .indicators import by_time, full, obv, trailing
from .simulate import adx, macd, rsi

PARTS = ("ma", "rsi", "macd", "bands", "volume", "wave", "stochastic", "adx", "obv")
#: The parts' weights in a regime, in the order of PARTS. Those of neutral are the score's own.
WEIGHTS = {
    "bull": (0.20, 0.07, 0.15, 0.07, 0.09, 0.09, 0.07, 0.20, 0.06),
    "neutral": (0.15, 0.10, 0.13, 0.10, 0.07, 0.08, 0.10, 0.17, 0.10),
    "bear": (0.08, 0.15, 0.10, 0.15, 0.07, 0.05, 0.13, 0.12, 0.15),
}
TINY = 1e-9  # fixed value, in denominators


def _yes(x: Column) -> Column:
    """A comparison with a value that isn't known yet is false."""
    return F.coalesce(x, F.lit(False))


def _ago(x: Column | str, n: int) -> Column:
    return F.lag(x, n).over(by_time())


def _first(*rules: tuple[Column, float], otherwise: float = 50.0) -> Column:
    """The value of the first rule that holds."""
    (cond, value), *rest = rules
    out = F.when(cond, float(value))
    for cond, value in rest:
        out = out.when(cond, float(value))
    return out.otherwise(otherwise)


def _points(*rules: tuple[Column, float]) -> Column:
    """The values of all rules that hold, added."""
    return sum((F.when(_yes(cond), float(value)).otherwise(0.0) for cond, value in rules), F.lit(0.0))


def _score(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def indicators(bars: DataFrame) -> DataFrame:
    """bars with what the parts are made of, in columns that begin with i_."""
    b = adx(macd(rsi(obv(bars).withColumnRenamed("obv", "i_obv")).withColumnRenamed("rsi", "i_rsi")), epsilon=TINY)
    b = b.withColumnsRenamed({"macd": "i_macd", "signal": "i_signal", "histogram": "i_hist", "plus_di": "i_plus", "minus_di": "i_minus", "adx": "i_adx"})
    c, w14, w20 = F.col, trailing(14), trailing(20)
    sd = full(20, F.stddev_samp("close"), w20)
    fast = (c("close") - full(14, F.min("low"), w14)) / (full(14, F.max("high"), w14) - full(14, F.min("low"), w14) + TINY) * 100
    b = b.withColumns({
        **{f"i_ma{n}": full(n, F.avg("close"), trailing(n)) for n in (20, 60, 120)}, "i_width": F.when(sd.isNotNull(), F.greatest(4 * sd, F.lit(TINY))), "i_low": full(20, F.avg("close"), w20) - 2 * sd, "i_fast": fast,
        "i_loud": c("volume") / F.when(full(20, F.avg("volume"), w20).isNotNull(), F.greatest(full(20, F.avg("volume"), w20), F.lit(TINY))), "i_top": full(20, F.max("high"), w20), "i_bottom": full(20, F.min("low"), w20),
        "i_obv_ma": full(20, F.avg("i_obv"), w20), "i_up": _yes(c("i_plus") > c("i_minus")), "i_trend": F.coalesce("i_adx", F.lit(0.0)),
    })
    three = trailing(3)
    b = b.withColumn("i_k", F.when(F.count("i_fast").over(three) >= 3, F.avg("i_fast").over(three)))
    b = b.withColumn("i_d", F.when(F.count("i_k").over(three) >= 3, F.avg("i_k").over(three)))
    narrow = c("i_width") / F.greatest("close", F.lit(TINY))
    return b.withColumn("i_narrow", narrow).withColumn("i_narrow_ma", F.when(F.count("i_narrow").over(w20) >= 20, F.avg("i_narrow").over(w20)))


def parts(bars: DataFrame, plain: bool = False) -> DataFrame:
    """bars with the nine parts, each from 0 to 100; 50 where nothing is known. plain: without what crosses, squeezes and divergences add."""
    b = indicators(bars)
    c, p = F.col, F.col("close")
    up, trend = c("i_up"), c("i_trend")
    strong = trend > 30
    extra = (lambda *rules: F.lit(0.0)) if plain else _points
    away = lambda x: ((p < _ago("close", 19)) & (c(x) > _ago(x, 19)), (p > _ago("close", 19)) & (c(x) < _ago(x, 19)))

    def crossed(sign: int) -> tuple[Column, Column]:
        above = lambda n: (sign * (_ago("i_ma20", n) - _ago("i_ma60", n)) > 0) if n else (sign * (c("i_ma20") - c("i_ma60")) > 0)
        fresh = _yes(above(0) & (sign * (_ago("i_ma20", 4) - _ago("i_ma60", 4)) <= 0)) & (trend > 20)
        lasts = _yes(above(1) & above(2))
        return fresh & lasts, fresh & ~lasts

    ma = _points((p > c("i_ma20"), 20), (p > c("i_ma60"), 20), (p > c("i_ma120"), 20), (c("i_ma20") > c("i_ma60"), 20), (c("i_ma60") > c("i_ma120"), 20))
    (golden, golden_weak), (dead, dead_weak) = crossed(1), crossed(-1)
    ma = ma + extra((golden, 15), (dead, -15), (golden_weak, 5), (dead_weak, -5))

    r = c("i_rsi")
    oversold = F.lit(30.0) if plain else F.when(~up & strong, 35.0).otherwise(30.0)
    overbought = F.lit(70.0) if plain else F.when(up & strong, 65.0).otherwise(70.0)
    moved = r - _ago("i_rsi", 9)
    bull, bear = away("i_rsi")
    strength = _first((r > overbought, 35), ((r > 60) & (r <= overbought), 65), ((r >= oversold) & (r < oversold + 10), 60), (r < oversold, 70))
    strength = strength + extra(((moved > 5) & (r > oversold) & (r < overbought), 20), (moved < -5, -10), (bull, 15), (bear, -15))

    bull, bear = away("i_hist")
    momentum = 50 + _points((c("i_macd") > c("i_signal"), 20), (c("i_hist") > 0, 15), (c("i_hist") > _ago("i_hist", 1), 15), (c("i_hist") <= _ago("i_hist", 1), -10)) + extra((bull, 12), (bear, -12))

    at = (p - c("i_low")) / c("i_width")
    bands = _first((at < 0.2, 30), (at < 0.4, 45), (at <= 0.8, 70), (at <= 0.95, 85), (at > 0.95, 45)) + extra(((c("i_narrow") < c("i_narrow_ma") * 0.7) & up, 10))

    change, loud = p / _ago("close", 5 if plain else 4) - 1, c("i_loud")
    volume = _first(((change > 0) & (loud > 1.2), 80), ((change > 0) & (loud < 0.8), 55), ((change < 0) & (loud > 1.2), 25), ((change < 0) & (loud < 0.8), 45))

    gone = lambda n: (p - _ago("close", n)) / (_ago("close", n) + TINY)
    run = gone(19) * 150 + gone(59) * 80
    wave = 50 + _points((c("i_top") > _ago("i_top", 20), 15), (c("i_bottom") > _ago("i_bottom", 20), 15)) + F.greatest(F.lit(-40.0), F.least(F.lit(40.0), run))
    wave = F.when(run.isNotNull(), _score(wave)).otherwise(50.0)

    k, d = c("i_k"), c("i_d")
    k1, d1 = _ago("i_k", 1), _ago("i_d", 1)
    stochastic = _first((k > 80, 35), (k > 60, 65), (k > 40, 55), (k > 20, 60), (k <= 20, 70)) + extra(((k1 < d1) & (k >= d), 20), ((k1 > d1) & (k < d), -20))

    side = lambda with_it, against: F.when(up, float(with_it)).otherwise(float(against))
    direction = F.when(trend > 40, side(85, 15)).when(trend > 25, side(72, 28)).when(trend > 20, side(58, 42)).otherwise(50.0)

    above, rising = _yes(c("i_obv") > c("i_obv_ma")), _yes(c("i_obv") > _ago("i_obv", 4))
    bull, bear = away("i_obv")
    flow = _first((above & rising, 75), (above, 55), (rising, 40), otherwise=25.0) + _points((bull, 20), (bear, -20))

    made = {"ma": _score(ma), "rsi": _score(strength), "macd": _score(momentum), "bands": _score(bands), "volume": volume, "wave": wave, "stochastic": _score(stochastic), "adx": direction, "obv": _score(flow)}
    out = b.withColumns({f"part_{k}": v for k, v in made.items()})
    return out.drop(*[x for x in out.columns if x.startswith("i_")])


def weighted(regime: str) -> Column:
    return sum((F.col(f"part_{x}") * w for x, w in zip(PARTS, WEIGHTS[regime], strict=True)), F.lit(0.0))


def technical_score(bars: DataFrame, regime: str | None = None) -> DataFrame:
    """bars with the parts, score, and score_regime by the weights of the regime that a column of that name says; unknown ones count as neutral."""
    b = parts(bars).withColumn("score", weighted("neutral"))
    if regime is None:
        return b
    own = F.when(F.col(regime) == "bull", weighted("bull")).when(F.col(regime) == "bear", weighted("bear")).otherwise(weighted("neutral"))
    return b.withColumn("score_regime", own)


def part_ics(bars: DataFrame, horizon: int = 20, skip: int = 20, least: int = 20) -> DataFrame:
    """ticker, part, ic and weight: correlation of each plain part with the return over the next bars, and the weights that these suggest.

    A ticker's first bars are skipped; with too few left, or a part that never moves, ic is 0. Weights are the ics' sizes in
    proportion, at least 3 percent before they are made to sum to 1."""
    ahead = (F.lead("close", horizon).over(by_time()) / F.col("close") - 1) * 100
    b = parts(bars, plain=True).withColumns({"_f": ahead, "_k": F.row_number().over(by_time())}).withColumn("_f", F.when(F.col("_k") > skip, F.col("_f")))
    g = b.groupBy("ticker").agg(F.count("_f").alias("_n"), *[correlation(f"part_{x}", "_f").alias(x) for x in PARTS])
    long = g.select("ticker", F.inline(F.array(*[F.struct(F.lit(x).alias("part"), F.when((F.col("_n") > least) & ~F.isnan(x), F.col(x)).alias("ic")) for x in PARTS]))).withColumn("ic", F.coalesce("ic", F.lit(0.0)))
    w = Window.partitionBy("ticker")  # nine rows
    size = F.greatest(F.abs("ic"), F.lit(0.001))
    share = long.withColumn("_s", F.greatest(size / F.sum(size).over(w), F.lit(0.03)))
    return share.select("ticker", "part", "ic", (F.col("_s") / F.sum("_s").over(w)).alias("weight"))
