"""Helpers shared by the corpus operators: work folders, lineage cuts, text columns and word hashing."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the word contracts define it: space and tab to carriage return.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Words after folding A-Z: digits, a-z and everything outside ASCII.
FOLDED_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: bytes.translate table that folds A-Z and turns every separator of FOLDED_WORD into a space.
FOLD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidemark-")


def work_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which the whole cluster shares; where that is unset, one of our own in local mode and an error elsewhere."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = _own_folder()
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


_recorded: list[list[str]] = []
SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def recorded(made: list[str]):
    """Notes the folders that cut() makes meanwhile in made, so that release() can delete them once all that reads them is done."""
    _recorded.append(made)
    try:
        yield
    finally:
        _recorded.pop()


def drop(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that cut() made; of the store that it lies in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession, made: list[str], *read_by: DataFrame) -> None:
    """Deletes the folders of made and forgets them, but for those that some DataFrame still reads."""
    used = {f.rsplit("/", 2)[0].split("tidemark-")[-1] for df in read_by if made for f in df.inputFiles()}
    for folder in [f for f in made if f.split("tidemark-")[-1] not in used]:
        drop(spark, folder)
        made.remove(folder)


@contextlib.contextmanager
def _shuffles_deleted(spark: SparkSession):
    """Meanwhile Spark deletes a query's shuffle files when it ends; else they stay until the driver collects its garbage."""
    before = spark.conf.get(SHUFFLES)
    spark.conf.set(SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES, before)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, so that lost executors only cost the stage at hand; the shuffles of the write are deleted once it is done."""
    folder = work_dir(df.sparkSession)
    for made in _recorded:
        made.append(folder)
    path = f"{folder}/{name}"
    with _shuffles_deleted(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, however often body's lambdas read it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def fold(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column, pattern: str) -> Column:
    """All matches of pattern in a text; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern.replace("\\", "\\")), F.lit(0))


def column(docs: DataFrame, name: str) -> Column:
    """A column by its whole name, dots and backquotes included."""
    return docs["`" + name.replace("`", "``") + "`"]


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns alone; columns of other names can't clash with those made on the way."""
    return docs.select(*[column(docs, n) for n in names])


HOT_PARTS = 2000


def spread_join(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: Column) -> DataFrame:
    """rows joined with groups, one row a key, by key; a key with more than a 2000th of all rows is joined in parts.

    size: groups' column with a key's number of rows; their sum is total at most, so that hot keys number 2000 at most, and
    these alone are broadcast. spread: a long of rows that deals a hot key's rows over its parts."""
    most = max(1, total // HOT_PARTS)
    parts = F.ceil(F.col(size) / F.lit(most)).cast("int")
    hot = F.broadcast(groups.where(F.col(size) > most).select(key, parts.alias("_parts")))
    dealt = rows.join(hot, key, "left").withColumn("_part", F.coalesce(F.pmod(spread, F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    each = groups.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.join(each, [key, "_part"]).drop("_part")


class WordHashes(dict):
    """64-bit hashes of words by bytes; forgets all it knows at a bounded size, as the hash can be made anew."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def hash_words(words: list[bytes], known: WordHashes):
    """uint64 array with the hash of each word."""
    import numpy as np

    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


#: Odd 64-bit constants that mix a window's words by their place in it.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def finalize(x):
    """Spreads the bits of uint64 values, in place where it can."""
    import numpy as np

    x = x ^ (x >> np.uint64(29))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def window_hashes(h, width: int):
    """Hashes of all runs of width consecutive words; a shorter, non-empty text is one run."""
    import numpy as np

    if not len(h):
        return h
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out *= np.uint64(MIX[0])
            out += h[k : k + n]
        return finalize(out)
