"""Channels, divergences, boxes and levels against plain loops over the bars that each bar can see."""

import random
from datetime import date, timedelta
from statistics import mean, median

import pytest

from tidemark.operators import structure

BARS = "ticker string, date date, open double, high double, low double, close double, volume double"
DAY = date(2020, 1, 1)


def frame(spark, series, schema=BARS):
    return spark.createDataFrame([(t, DAY + timedelta(days=i), *x) for t, xs in series.items() for i, x in enumerate(xs)], schema)


def walk(n, seed, plateaus=False):
    rng, out, p = random.Random(seed), [], 100.0
    for _ in range(n):
        p = max(5.0, p + (rng.choice([-1, 0, 0, 1]) if plateaus else rng.gauss(0, 1)))
        out.append((p, p + (0.5 if plateaus else rng.random()), p - (0.5 if plateaus else rng.random()), p, rng.choice([500.0, 1000.0, 3000.0])))
    return out


def swing(v, k, sign):
    return [i for i in range(k, len(v) - k) if all(sign * v[i] > sign * x for x in v[i - k : i] + v[i + 1 : i + k + 1])]


def fit(xs, ys):
    mx, my = mean(xs), mean(ys)
    return sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / sum((x - mx) ** 2 for x in xs)


def one_channel(bars, lookback=80, k=5):
    sub = bars[-lookback:]
    highs, lows, close = [b[1] for b in sub], [b[2] for b in sub], [b[3] for b in sub]
    h, lo = swing(highs, k, 1), swing(lows, k, -1)
    if len(sub) < max(lookback // 2, 3 * k) or len(h) < 2 or len(lo) < 2:
        return None
    m = (fit(h, [highs[i] for i in h]) + fit(lo, [lows[i] for i in lo])) / 2
    end = len(sub) - 1
    up, down = max(highs[i] + m * (end - i) for i in h), min(lows[i] + m * (end - i) for i in lo)
    pos = (close[-1] - down) / (up - down) * 100 if up > down else 50.0
    n = m / (mean(close) + 1e-9) * 100
    return m, up, down, pos, "bullish" if n > 0.05 else "bearish" if n < -0.05 else "sideways", "upper" if pos > 66 else "lower" if pos < 33 else "middle"


def test_channels_of_all_bars(spark):
    series = {"A": walk(150, 1), "B": walk(90, 2), "C": walk(20, 3)}
    got = structure.channel(frame(spark, series)).collect()
    some = 0
    for x in got:
        want = one_channel(series[x.ticker][: (x.date - DAY).days + 1])
        if want is None:
            assert (x.slope, x.upper, x.direction, x.position_pct, x.zone) == (None,) * 5
        else:
            some += 1
            assert (x.slope, x.upper, x.lower, x.position_pct) == pytest.approx(want[:4])
            assert (x.direction, x.zone) == want[4:]
    assert some > 80


def one_divergence(price, osc, lookback=60, k=5):
    sub = [(p, o) for p, o in list(zip(price, osc))[-lookback:] if o is not None]
    out = {"regular_bull": False, "regular_bear": False, "hidden_bull": False, "hidden_bear": False}
    if len(sub) < 2 * k + 3:
        return out
    p, o = [x[0] for x in sub], [x[1] for x in sub]
    low, high = swing(p, k, -1)[-2:], swing(p, k, 1)[-2:]
    if len(low) == 2:
        i, j = low
        out["regular_bull"], out["hidden_bull"] = p[j] < p[i] and o[j] > o[i], p[j] > p[i] and o[j] < o[i]
    if len(high) == 2:
        i, j = high
        out["regular_bear"], out["hidden_bear"] = p[j] > p[i] and o[j] < o[i], p[j] < p[i] and o[j] > o[i]
    return out


@pytest.mark.parametrize(("lookback", "k"), [(60, 5), (25, 2)])
def test_divergences_of_all_bars(spark, lookback, k):
    rng = random.Random(4)
    series = {t: [(b[3], rng.uniform(0, 100) if i > 13 and (t != "B" or rng.random() < 0.8) else None) for i, b in enumerate(walk(140, s))] for t, s in (("A", 5), ("B", 6))}
    got = structure.divergence(frame(spark, series, "ticker string, date date, close double, rsi double"), lookback=lookback, k=k).collect()
    hits = 0
    for x in got:
        seen = series[x.ticker][: (x.date - DAY).days + 1]
        want = one_divergence([a for a, _ in seen], [b for _, b in seen], lookback, k)
        assert {c: x[c] for c in want} == want, (x.ticker, x.date)
        hits += any(want.values())
    assert hits > 20


def test_divergences_by_name(spark):
    def last(price, osc):
        return structure.divergence(frame(spark, {"A": list(zip(map(float, price), map(float, osc)))}, "ticker string, date date, close double, rsi double"), k=1).orderBy("date").collect()[-1]

    x = last([10, 6, 10, 12, 10, 4, 10], [30, 20, 30, 35, 30, 25, 30])
    assert x.regular_bull and not x.regular_bear
    x = last([10, 14, 10, 8, 10, 16, 10], [50, 70, 50, 45, 50, 60, 50])
    assert x.regular_bear and not x.regular_bull


@pytest.mark.parametrize(("volume", "confirmed"), [(5000.0, True), (800.0, False)])
def test_box_is_left_with_or_without_volume(spark, volume, confirmed):
    close = [100.0, 110.0] * 14 + [120.0]
    bars = [(c, c + 0.5, c - 0.5, c, 1000.0) for c in close[:-1]] + [(120.0, 120.5, 119.5, 120.0, volume)]
    x = structure.box_breakout(frame(spark, {"A": bars}), k=1, tolerance_pct=3.0).orderBy("date").collect()[-1]
    assert (x.in_box, x.breakout_up, x.vol_confirmed, x.fakeout) == (True, True, confirmed, not confirmed)
    assert (x.box_high, x.box_low, x.stop) == (110.5, 99.5, 110.5)
    assert x.target == pytest.approx(110.5 + 11 * 1.618)


def test_boxes_of_all_bars(spark):
    series = {"A": walk(120, 7, True), "B": walk(70, 8)}
    for x in structure.box_breakout(frame(spark, series), lookback=40, k=2, tolerance_pct=4.0).collect():
        seen = series[x.ticker][: (x.date - DAY).days + 1]
        sub = seen[-40:]
        res, sup = [sub[i][1] for i in swing([b[1] for b in sub], 2, 1)], [sub[i][2] for i in swing([b[2] for b in sub], 2, -1)]
        if len(sub) < 7 or min(len(res), len(sup)) < 2 or median(res) <= median(sup):
            assert (x.in_box, x.box_high, x.breakout_up, x.vol_confirmed) == (False, None, False, False)
            continue
        high, low = median(res), median(sup)
        inside = all(abs(v - high) / high * 100 <= 4 for v in res[-2:]) and all(abs(v - low) / low * 100 <= 4 for v in sup[-2:])
        assert (x.box_high, x.box_low, x.in_box) == (pytest.approx(high), pytest.approx(low), inside)
        assert (x.breakout_up, x.breakout_down) == (inside and seen[-1][3] > high, inside and not seen[-1][3] > high and seen[-1][3] < low)


def peaks(v, distance, prominence):
    """Peaks by definition: middles of runs above both sides, thinned from the highest, then by prominence."""
    found, i = [], 1
    while i < len(v) - 1:
        j = i
        while j < len(v) - 1 and v[j + 1] == v[i]:
            j += 1
        if j < len(v) - 1 and v[i - 1] < v[i] > v[j + 1]:
            found.append((i + j) // 2)
        i = j + 1
    kept = []
    for p in sorted(found, key=lambda p: (v[p], p), reverse=True):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)

    def base(side, top):
        low = top
        for x in side:
            if x > top:
                break
            low = min(low, x)
        return low

    return sorted(p for p in kept if v[p] - max(base(v[:p][::-1], v[p]), base(v[p + 1 :], v[p])) >= prominence)


@pytest.mark.parametrize("plateaus", [False, True])
def test_levels_match_the_definition(spark, plateaus):
    series = {t: walk(n, s, plateaus) for t, n, s in (("A", 252, 11), ("B", 100, 12), ("C", 400, 13), ("D", 2, 14))}
    got = structure.levels(frame(spark, series)).collect()
    for t, bars in series.items():
        sub = bars[-252:]
        now = sub[-1][3]
        high, low = [b[1] for b in sub], [-b[2] for b in sub]
        raw = sorted([(high[i], "resistance") for i in peaks(high, 5, now * 0.008)[-25:]] + [(-low[i], "support") for i in peaks(low, 5, now * 0.008)[-25:]], key=lambda x: (x[0], x[1] == "support"))
        out = []
        for level, kind in raw:
            if out and abs(level - out[-1][0]) / out[-1][0] < 0.015:
                out[-1] = ((out[-1][0] + level) / 2, out[-1][1], out[-1][2] + 1)
            else:
                out.append((level, kind, 1))
        want = sorted(out, key=lambda c: (abs(c[0] - now), c[0]))[:8]
        mine = sorted((x for x in got if x.ticker == t), key=lambda x: x["rank"])
        assert [(x.kind, x.touches, x.above) for x in mine] == [(k, n, v > now) for v, k, n in want], t
        assert [x.level for x in mine] == pytest.approx([v for v, _, _ in want])
    assert {x.ticker for x in got} == {"A", "B", "C"}
