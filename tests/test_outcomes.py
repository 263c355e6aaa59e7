"""Outcomes that come in bit by bit: written once, never changed, filled in when bars are late."""

from datetime import date, datetime, timedelta

import pytest

from tidemark.streaming.outcomes import Outcomes, fresh_outcomes, resolved_signals

START = datetime(2026, 8, 6, 13, 30)
BARS, DONE = "ticker string, ts timestamp, close double", "ticker string, asof timestamp, horizon int, ret double"


def bars(spark, n, ticker="AAPL", first=100.0, step=1.0):
    return spark.createDataFrame([(ticker, START + timedelta(minutes=15 * i), first + step * i) for i in range(n)], BARS)


def records(spark, *tickers):
    return spark.createDataFrame([(t, START) for t in tickers], "ticker string, asof timestamp")


def found(df):
    return {(x.ticker, x.horizon): x.ret for x in df.collect()}


def test_only_what_is_due_is_resolved(spark):
    got = fresh_outcomes(records(spark, "AAPL", "GONE"), bars(spark, 30), spark.createDataFrame([], DONE))
    assert found(got) == {("AAPL", 26): pytest.approx(26.0)}


def test_what_is_resolved_is_left(spark):
    done = spark.createDataFrame([("AAPL", START, 26, 99.0)], DONE)
    assert found(fresh_outcomes(records(spark, "AAPL"), bars(spark, 30), done)) == {}


def test_a_stream_fills_in_late_names_once(spark, tmp_path):
    source, home = f"file://{tmp_path}/source", f"file://{tmp_path}/home"
    store = Outcomes(spark, home, records(spark, "AAPL", "MSFT"))
    bars(spark, 30).write.mode("append").parquet(source)
    stream = spark.readStream.schema(BARS).parquet(source)
    store.take(stream)
    assert found(store.done()) == {("AAPL", 26): pytest.approx(26.0)}
    bars(spark, 30, "MSFT", 200.0, -2.0).write.mode("append").parquet(source)
    store.take(stream)
    assert found(store.done()) == {("AAPL", 26): pytest.approx(26.0), ("MSFT", 26): pytest.approx(-26.0)}
    before = sorted(store.done().collect())
    store.merge(bars(spark, 30, "MSFT", 200.0, -2.0), 1)  # a batch that is tried again
    assert sorted(store.done().collect()) == before
    store.take(stream)
    assert sorted(store.done().collect()) == before


SIGNAL = "symbol string, entry_date date, entry_price double, return_pct double, outcome_date date"


def signal(spark, n, ret=None, day=None, entry=date(2026, 7, 1)):
    closes = spark.createDataFrame([("AAA", date(2026, 7, 1) + timedelta(days=i), 100.0 + i) for i in range(n)], "ticker string, date date, close double")
    return resolved_signals(spark.createDataFrame([("AAA", entry, 100.0, ret, day)], SIGNAL), closes).first()


def test_a_signal_is_resolved_at_its_bar(spark):
    a, b = signal(spark, 30), signal(spark, 90)
    assert a == b
    assert (a.return_pct, a.outcome_date) == (pytest.approx(21.0), date(2026, 7, 22))


def test_a_signal_waits_for_its_bar(spark):
    assert signal(spark, 16)[3:] == (None, None)
    assert signal(spark, 21)[3:] == (None, None)


def test_a_signal_is_never_resolved_again(spark):
    assert signal(spark, 90, -3.0, date(2026, 7, 30))[3:] == (-3.0, date(2026, 7, 30))


def test_a_signal_before_the_first_bar_counts_from_it(spark):
    assert signal(spark, 30, entry=date(2026, 6, 1)).return_pct == pytest.approx(20.0)
