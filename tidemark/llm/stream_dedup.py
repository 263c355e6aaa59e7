"""Operator 11, exact dedup: a stateful stream whose keyed state, on disk and without expiry, remembers every text ever seen.

Two streams run one after the other, each over what is ready and then no more. The first reads whole texts and lands narrow
rows: doc_id, digest of the normalised text, and the content locator (file and row in it). The second keeps a state under the
digest, in RocksDB under the shared work folder: rows seen, and the greatest (doc_id, locator), which is the row that stays.
There is no watermark, so nothing expires; a later run with the same home folder takes in new files only, and a text that
was seen years ago is still a hit. Both streams are exactly-once from their checkpoints, so a lost executor or a new driver
goes on where the last batch ended.

A digest that more than one row has is a hit, and hits are checked by their full bytes: the least and the greatest text
under a digest are the same if and only if all its texts are the one at the locator. They are aggregated over all rows, so
that a task hands on at most one text for each digest, however many copies it read; a join that leaves out digests of one
row would send every text through the shuffle, copies too. Where they differ, the rows are told apart by whole texts.

A digest's size is known from the state, so a hot one is dealt out: rows over a 2000th of all are at most 2000 digests,
which are broadcast with their number of parts, and each part is joined by itself.

Defined cases: a null text counts as empty, and all empty texts are one group; a null doc_id is less than any other; of rows
with equal text and doc_id the one with the greatest locator stays; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, column, cut, spread_join, work_dir

FILES_A_BATCH = 1000  # so that a lost batch costs a bounded piece of work
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition sets aside some MB of disk
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",  # how soon the stores of a stream that has ended are closed
}
SESSION = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.files.maxPartitionBytes")


def normal(text: Column) -> Column:
    """The text with A-Z in lower case; null is empty. Of ASCII alone, lower() does the same and is faster."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _digests(docs: DataFrame, digest: Callable[[Column], Column], *more: Column) -> DataFrame:
    return docs.select(column(docs, "doc_id").alias("doc_id"), digest(normal(column(docs, "text"))).alias("digest"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), *more)


def _stream_session(spark: SparkSession) -> SparkSession:
    """A session beside the caller's, whose settings stay as they are."""
    own = spark.newSession()
    for k in SESSION:
        if (v := spark.conf.get(k, None)) is not None:
            own.conf.set(k, v)
    for k, v in ROCKSDB.items():
        own.conf.set(k, v)
    return own


def _run(query) -> None:
    q = query.trigger(availableNow=True).start()
    q.awaitTermination()


def ingest(spark: SparkSession, path: str, home: str, digest: Callable[[Column], Column] = sha256, files_a_batch: int = FILES_A_BATCH) -> None:
    """Takes in the Parquet files of a folder (or one file) that home hasn't seen yet."""
    own = _stream_session(spark)
    path = path.rstrip("/")
    schema = own.read.parquet(path).schema
    # Files of any age count: the source's default forgets those over a week older than the newest.
    reader = own.readStream.option("maxFilesPerTrigger", files_a_batch).option("maxFileAge", "36500d")
    rows = _digests(reader.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]"), digest)  # as a pattern, since a plain path would have to be a folder
    _run(rows.writeStream.format("parquet").option("path", f"{home}/landed").option("checkpointLocation", f"{home}/landing"))
    seen = reader.schema(rows.schema).parquet(f"{home}/landed").groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "file", "row")).alias("keep"))
    _run(seen.writeStream.outputMode("update").format("noop").option("checkpointLocation", f"{home}/state"))


def landed(spark: SparkSession, home: str, id_type: T.DataType) -> DataFrame:
    """doc_id, digest, file, row of every row taken in."""
    return spark.read.schema(T.StructType().add("doc_id", id_type).add("digest", "binary").add("file", "string").add("row", "long")).parquet(f"{home}/landed")


def groups(spark: SparkSession, home: str, rows: DataFrame) -> DataFrame:
    """The state as a table: digest, n, keep_id, keep_file, keep_row. rows: those landed."""
    kind = f"digest binary, n long, keep_id {rows.schema['doc_id'].dataType.simpleString()}, keep_file string, keep_row long"
    if rows.isEmpty():  # no batch has made a state yet
        return spark.createDataFrame([], kind)
    own = _stream_session(spark)
    state = own.read.format("statestore").load(f"{home}/state")
    n, keep = (F.col("value")[x.name] for x in state.schema["value"].dataType.fields)
    path = f"{work_dir(spark)}/groups"
    state.select(F.col("key")["digest"].alias("digest"), n.alias("n"), keep["doc_id"].alias("keep_id"), keep["file"].alias("keep_file"), keep["row"].alias("keep_row")).write.parquet(path)
    return spark.read.schema(kind).parquet(path)


def verdicts(spark: SparkSession, path: str, home: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest of every row taken in, hits checked by their full bytes."""
    docs = spark.read.parquet(path)
    rows = landed(spark, home, docs.schema["doc_id"].dataType)
    known = groups(spark, home, rows)
    total = known.agg(F.sum("n")).first()[0] or 0
    out = spread_join(rows, known, "digest", "n", total, spread=F.xxhash64("file", "row"))
    texts = _digests(docs, digest, normal(column(docs, "text")).alias("text"))
    differ = cut(texts.groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high")).where("low != high").select("digest"), "differ")
    columns = ["doc_id", "keep_id", F.col("n").alias("group_size"), ((F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))).alias("kept"), "digest"]
    if differ.isEmpty():
        return out.select(*columns)
    # Digests that stand for several texts: these are told apart by their bytes.
    apart = texts.join(differ, "digest", "left_semi")
    kinds = apart.groupBy("digest", "text").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "file", "row")).alias("keep"))
    kinds = kinds.select("digest", "text", "n", F.col("keep.doc_id").alias("keep_id"), F.col("keep.file").alias("keep_file"), F.col("keep.row").alias("keep_row"))
    return out.join(differ, "digest", "left_anti").select(*columns).unionByName(apart.join(kinds, ["digest", "text"]).select(*columns))


def dedup_files(spark: SparkSession, path: str, home: str | None = None, digest: Callable[[Column], Column] = sha256, files_a_batch: int = FILES_A_BATCH) -> DataFrame:
    """Takes in the files under path and gives the verdict on every row. home: the folder that remembers; a fresh one if None."""
    home = home or f"{work_dir(spark)}/dedup"
    ingest(spark, path, home, digest, files_a_batch)
    return verdicts(spark, path, home, digest)


def dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The same for any DataFrame with doc_id and text, which is written first, as a locator needs files."""
    spark = docs.sparkSession
    path = f"{work_dir(spark)}/content"
    docs.select(column(docs, "doc_id"), column(docs, "text")).write.parquet(path)
    return dedup_files(spark, path, digest=digest)
