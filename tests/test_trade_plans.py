"""Plans of every bar against a walk over the bars it can see, geometry, prices that could be had, entry rules on the same setups."""

import math
import random
from datetime import date, timedelta

import pytest

from tidemark.operators import simulate
from tidemark.operators import trade_plans as tp

DAY = date(2020, 1, 1)
BARS = "ticker string, date date, open double, high double, low double, close double, volume double"
LINES = "direction string, entry_low double, entry_high double, stop double, target double, target2 double, veto string"


def walk(n, seed, drift=0.0):
    rng, out, p = random.Random(seed), [], 100.0
    for _ in range(n):
        o = p * (1 + rng.gauss(0, 0.004))
        p = max(5.0, o * (1 + rng.gauss(drift, 0.015)))
        out.append((o, max(o, p) * (1 + rng.random() * 0.008), min(o, p) * (1 - rng.random() * 0.008), p, 1000.0))
    return out


def frame(spark, series):
    return spark.createDataFrame([(t, DAY + timedelta(days=i), *x) for t, xs in series.items() for i, x in enumerate(xs)], BARS)


def zones(sub):
    """(kind of zone, side, place, top, bottom) of the live zones of bars."""
    o, h, low, c = ([x[j] for x in sub] for j in range(4))
    out, n = [], len(sub)
    for i in range(2, n):
        if h[i - 2] < low[i] and (low[i] - h[i - 2]) / c[-1] * 100 >= 0.03 and min(low[i:]) > h[i - 2]:
            out.append(("gap", "bull", i, low[i], h[i - 2]))
        if low[i - 2] > h[i] and (low[i - 2] - h[i]) / c[-1] * 100 >= 0.03 and max(h[i:]) < low[i - 2]:
            out.append(("gap", "bear", i, low[i - 2], h[i]))
    for i in range(1, n - 1):
        move = (c[i + 1] / c[i] - 1) * 100
        if c[i] < o[i] and move >= 1 and min(low[i + 1 :]) > low[i]:
            out.append(("block", "bull", i, h[i], low[i]))
        if c[i] > o[i] and move <= -1 and max(h[i + 1 :]) < h[i]:
            out.append(("block", "bear", i, h[i], low[i]))
    return out


def turns(sub, k=5):
    out = []
    for i in range(k, len(sub) - k):
        sides = sub[i - k : i] + sub[i + 1 : i + k + 1]
        out += [(i, "H", sub[i][1])] if all(sub[i][1] > x[1] for x in sides) else []
        out += [(i, "L", sub[i][2])] if all(sub[i][2] < x[2] for x in sides) else []
    return out


def bias(bars):
    c, parts = bars[-1][3], []
    top, dip = max(x[1] for x in bars[-4:-1]), min(x[2] for x in bars[-4:-1])
    mid = (top + dip) / 2
    parts.append(20 if bars[-1][2] < dip and mid < c < top else -20 if bars[-1][1] > top and dip < c < mid else 0)
    live = zones(bars[-60:])
    for sort, points, a, z in (("gap", 15, 1, 1), ("block", 10, 0.98, 1.02)):
        for side, sign in (("bull", 1), ("bear", -1)):
            parts.append(sign * points if any(s == sort and d == side and b * a <= c <= t * z for s, d, _, t, b in live) else 0)
    sub, events = bars[-80:], []
    sw = turns(sub)
    for no, ((_, side, price), (at, *_)) in enumerate(zip(sw, sw[1:])):
        done = [i for i in range(at + 1, len(sub)) if (sub[i][3] > price if side == "H" else sub[i][3] < price)]
        events += [(done[0], no, 10 if side == "H" else -10)] if done else []
    parts.append(max(events)[2] if events else 0)
    h, low = max(x[1] for x in bars[-60:]), min(x[2] for x in bars[-60:])
    place = round((c - low) / (h - low) * 100, 1)
    parts.append(5 if c <= (h + low) / 2 and place < 30 else -8 if c > (h + low) / 2 and place > 80 else 0)
    return max(-30, min(30, sum(parts))), sum(x != 0 for x in parts)


def one_plan(bars):
    """direction, zone, low, high, stop, both targets and the veto, or None without a direction."""
    b, signals = bias(bars)
    if len(bars) < 60 or abs(b) < 10:
        return None
    c, live = bars[-1][3], zones(bars[-80:])
    h, low = max(x[1] for x in bars[-60:]), min(x[2] for x in bars[-60:])
    mid, long = (h + low) / 2, b > 0
    tr = [max(x[1] - x[2], abs(x[1] - p[3]), abs(x[2] - p[3])) for p, x in zip(bars[-15:], bars[-14:])]
    buffer = sum(tr) / 14 * 0.25
    fit = [z for z in live if (z[1] == "bull" and z[3] <= c * 1.03 if long else z[1] == "bear" and z[4] >= c * 0.97)]
    name, lo, hi = ("discount", low, min(mid, c)) if long else ("premium", max(mid, c), h)
    for sort in ("gap", "block"):
        some = [z for z in fit if z[0] == sort]
        if some:
            best = max(some, key=lambda z: (z[3], -z[2])) if long else min(some, key=lambda z: (z[4], z[2]))
            name, lo, hi = sort, best[4], best[3]
    prices, ref = [p for _, s, p in turns(bars[-80:]) if s == ("H" if long else "L")], (lo + hi) / 2
    sign, edge = (1, h) if long else (-1, low)
    beyond = [p for p in prices if sign * p > sign * c]
    t1 = min(beyond, key=lambda p: sign * p) if beyond else edge
    t1 = edge if sign * t1 <= sign * ref else t1
    t2 = edge if sign * edge > sign * t1 else t1 + (t1 - ref)
    ma = lambda z: sum(x[3] for x in bars[len(bars) - z - 50 : len(bars) - z]) / 50
    veto = None
    if not long:
        veto = "weak short" if -b < 12 else "trend" if len(bars) < 70 or not (c < ma(0) <= ma(20)) else None
    return "long" if long else "short", b, signals, name, lo, hi, lo - buffer if long else hi + buffer, t1, t2, veto


def test_plans_of_every_bar_see_nothing_later(spark):
    series = {"A": walk(230, 1, 0.001), "B": walk(200, 2, -0.002), "C": walk(59, 3), "D": walk(160, 4, 0.0005)}
    got = {(r.ticker, r.start_pos): r for r in tp.build_plans(frame(spark, series)).collect()}
    shorts = 0
    for t, xs in series.items():
        for i in range(len(xs)):
            want, r = one_plan(xs[: i + 1]) if i >= 59 else None, got.pop((t, i), None)
            assert (want is None) == (r is None), (t, i)
            if want is None:
                continue
            assert (r.direction, r.bias, r.signals, r.zone, r.veto) == (*want[:4], want[9]), (t, i)
            assert [r.entry_low, r.entry_high, r.stop, r.target, r.target2] == pytest.approx([min(want[4:6]), max(want[4:6]), *want[6:9]], abs=0.00501)
            shorts += r.direction == "short"
    assert not got and shorts > 20


def test_geometry_grades_and_reasons(spark):
    rows = [
        ("long", 98.0, 100.0, 96.0, 106.0, 110.0, None), ("short", 100.0, 102.0, 104.0, 94.0, 90.0, None), ("long", 98.0, 100.0, 96.0, 102.0, 110.0, None), ("long", 98.0, 100.0, 98.5, 106.0, 110.0, None),
        ("long", 98.0, 100.0, 97.5, 103.0, 110.0, None), ("long", 100.0, 98.0, 97.9, 106.0, 110.0, None), ("short", 100.0, 102.0, 104.0, 94.0, 90.0, "trend"), ("long", None, 100.0, 96.0, 106.0, 110.0, None),
    ]
    got = tp.assemble(spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], f"{LINES}, i int")).orderBy("i").collect()
    assert [(r.valid, r.actionable, r.cost_grade, r.reason) for r in got[:7]] == [
        (True, True, "A", None), (True, False, "A", "short"), (False, False, "A", "reward"), (False, False, "D", "order"), (True, False, "C", "grade"), (True, False, "D", "grade"), (False, False, "A", "trend"),
    ]
    assert (got[0].entry_ref, got[0].rr, got[0].rr2) == (99.0, 2.33, 3.67) and (got[5].entry_low, got[5].entry_high) == (98.0, 100.0)
    with pytest.raises(ValueError, match="direction"):
        tp.build_plans(frame(spark, {"A": walk(5, 1)}), "up")
    assert tp.build_plans(frame(spark, {"A": walk(5, 1)}).limit(0)).count() == 0


def outcome(xs, start, long, edge, stop, target, fill=15, hold=30):
    fills = [j for j in range(start + 1, min(start + 1 + fill, len(xs))) if (xs[j][2] <= edge if long else xs[j][1] >= edge)]
    if not fills:
        return "nofill", None, None
    for k in range(fills[0], min(fills[0] + hold, len(xs))):
        if xs[k][2] <= stop if long else xs[k][1] >= stop:
            return "loss", fills[0], k
        if xs[k][1] >= target if long else xs[k][2] <= target:
            return "win", fills[0], k
    return "timeout", fills[0], None


def test_entry_rules_on_the_setups_of_one_walk(spark):
    series = {"A": walk(420, 11, 0.001), "B": walk(400, 12, -0.001), "D": walk(300, 14)}
    bars = frame(spark, series)
    plans = tp.build_plans(bars)
    valid = {(r.ticker, r.start_pos): r for r in plans.where("valid").collect()}
    got = {(r.setup, r.rule): r for r in tp.entry_rules(plans, simulate.numbered(bars)).collect()}
    seen = set()
    for t, xs in series.items():
        i = 120
        while i < len(xs) - 1:
            p = valid.get((t, i))
            if p is None:
                i += 1
                continue
            long = p.direction == "long"
            sign = 1 if long else -1
            near, far = (p.entry_high, p.entry_low) if long else (p.entry_low, p.entry_high)
            risk = sign * (p.entry_ref - p.stop)
            lines = {"zone": (near, p.entry_ref), "middle": (p.entry_ref, p.entry_ref), "near": (near, near), "far": (far, far), "market": (sign * math.inf, xs[i + 1][0])}
            for rule, (edge, paid) in lines.items():
                own, mine = rule in ("far", "market"), sign * (paid - p.stop)
                o, f, e = outcome(xs, i, long, edge, p.stop, p.target)
                if own and not (mine > 0 and sign * (p.target - paid) > 0):
                    o, f, e = "skip", None, None
                base = mine if own else risk
                r = {"loss": -mine / base if mine else 0.0, "win": p.rr if rule == "zone" or rule == "middle" else sign * (p.target - paid) / base if base else 0.0}.get(o, 0.0)
                g = got[p.plan_id, rule]
                assert (g.outcome, g.fill_pos, g.exit_pos) == (o, f, e) and g.r == pytest.approx(r), (p.plan_id, rule)
                seen.add((p.plan_id, rule))
                if rule in ("middle", "near", "far"):
                    g, r = got[p.plan_id, f"{rule}_gap"], 0.0
                    if o in ("win", "loss"):
                        price = min(xs[f][0], paid) if long else max(xs[f][0], paid)
                        base = sign * (price - p.stop) if own else risk
                        worse, better = (min, max) if long else (max, min)
                        end = worse(xs[e][0], p.stop) if o == "loss" else better(xs[e][0], p.target)
                        o, r = (o, sign * (end - price) / base) if base > 0 else ("skip", 0.0)
                    assert g.outcome == o and g.r == pytest.approx(r), (p.plan_id, rule)
                    seen.add((p.plan_id, f"{rule}_gap"))
            o, f, e = outcome(xs, i, long, near, p.stop, p.target)
            i = max(i + 1, (e if e is not None else f if f is not None else i + 15) + 3)
    assert seen == set(got) and len(seen) > 100
    table = {r.rule: r for r in tp.rule_table(spark.createDataFrame([x for x in got.values()]), ["rule"], 40.0).collect()}
    taken = [x for (_, rule), x in got.items() if rule == "near" and x.outcome not in ("nofill", "skip")]
    assert table["near"].setups == len(seen) / 8 and table["near"].filled == len(taken)
    assert table["near"].net_r == pytest.approx(sum(x.r - 0.004 / (x.risk_pct / 100) for x in taken) / len(taken))
