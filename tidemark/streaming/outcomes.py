"""Outcomes of recorded scores and signals, resolved bit by bit as bars come in; what is resolved never changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import asof

DONE = "ticker string, asof timestamp, horizon int, ret double"
HORIZONS = (26, 78)


def fresh_outcomes(records: DataFrame, bars: DataFrame, done: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """ticker, asof, horizon, ret in percent of those records (ticker, asof) and horizons that done doesn't have and whose time has come.

    A return runs from the last bar at or before asof to the horizon-th bar after it; without that bar there is none yet, and
    the record is looked at again next time. Done is told by ticker, so that names whose bars were late are filled in later.
    Only bars from the oldest open record on could matter, and only those of its tickers are read into the window."""
    h = records.select("ticker", "asof").distinct().withColumn("horizon", F.explode(F.array(*[F.lit(x) for x in horizons])))
    open_ = h.join(done.select("ticker", "asof", "horizon"), ["ticker", "asof", "horizon"], "left_anti")
    w = Window.partitionBy("ticker").orderBy("ts")
    ahead = bars.join(open_.select("ticker").distinct(), "ticker", "left_semi").select("ticker", "ts", "close", F.map_from_arrays(F.array(*[F.lit(x) for x in horizons]), F.array(*[F.lead("close", x).over(w) for x in horizons])).alias("ahead"))
    base = asof(open_, ahead, "ticker", "asof", "ts", ["close", "ahead"])
    ret = (F.element_at("ahead", F.col("horizon")) / F.col("close") - 1) * 100
    return base.where("close > 0").select("ticker", "asof", "horizon", ret.alias("ret")).where("ret IS NOT NULL")


class Outcomes:
    """Records, bars and outcomes under one folder; each batch of a stream of bars is merged once, whatever is tried again.

    A batch writes its bars and its outcomes into folders of its own number, over what a failed try left there, and reads the
    outcomes of lower numbers only: a repeated batch gives the same rows."""

    def __init__(self, spark: SparkSession, home: str, records: DataFrame, horizons: tuple[int, ...] = HORIZONS):
        self.spark, self.home, self.records, self.horizons = spark, home, records, horizons

    def done(self, before: int | None = None) -> DataFrame:
        try:
            out = self.spark.read.schema(f"{DONE}, batch long").option("basePath", f"{self.home}/outcomes").parquet(f"{self.home}/outcomes")
            out.head(0)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], DONE)
        return (out if before is None else out.where(F.col("batch") < before)).drop("batch")

    def merge(self, batch: DataFrame, number: int) -> None:
        batch.select("ticker", "ts", "close").write.mode("overwrite").parquet(f"{self.home}/bars/batch={number}")
        bars = self.spark.read.schema("ticker string, ts timestamp, close double, batch long").parquet(f"{self.home}/bars").where(F.col("batch") <= number)
        fresh = fresh_outcomes(self.records, bars.drop("batch"), self.done(number), self.horizons)
        fresh.write.mode("overwrite").parquet(f"{self.home}/outcomes/batch={number}")

    def take(self, bars: DataFrame) -> None:
        """Takes in what a stream of bars (ticker, ts, close) has ready."""
        q = bars.writeStream.foreachBatch(self.merge).option("checkpointLocation", f"{self.home}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()


def resolved_signals(signals: DataFrame, bars: DataFrame, n: int = 21) -> DataFrame:
    """signals (symbol, entry_date, entry_price, return_pct, outcome_date) with the open ones resolved at the n-th bar after the entry date.

    The bar's number decides, not the day this runs: more bars don't change the answer, and fewer leave a signal open.
    A signal with a return is left as it is."""
    w = Window.partitionBy("ticker").orderBy("date")
    numbered = bars.where("close IS NOT NULL").withColumn("_pos", F.row_number().over(w))
    at = asof(signals, numbered.select("ticker", F.col("date").alias("_on"), "_pos").withColumnRenamed("ticker", "symbol"), "symbol", "entry_date", "_on", ["_pos"]).drop("_on_seen")
    end = numbered.select(F.col("ticker").alias("symbol"), F.col("_pos").alias("_end"), F.col("date").alias("_day"), F.col("close").alias("_close"))
    both = at.withColumn("_end", F.coalesce("_pos", F.lit(0)) + n).join(end, ["symbol", "_end"], "left")
    due = F.col("return_pct").isNull() & F.col("_close").isNotNull() & (F.col("entry_price") > 0)
    made = {"return_pct": F.when(due, (F.col("_close") / F.col("entry_price") - 1) * 100).otherwise(F.col("return_pct")), "outcome_date": F.when(due, F.col("_day")).otherwise(F.col("outcome_date"))}
    return both.select(*[made.get(c, F.col(c)).alias(c) for c in signals.columns])
