"""Operator 13, vector code compression: product codes by k-means over vector parts that stay where their entry's owner is.

A vector is cut into equal consecutive parts; each part position has a codebook of 16 entries, and a vector's code is the
index of the nearest entry for each position. All components are integers, floor(4096 x), so that results don't hang on order.

Training keeps the parts resident. The owner of (position, entry, salt) holds the parts that the entry has now and whose salt,
by hash of vec_id and vector, it is; owners are dealt so that the salts of one entry lie in all partitions, whatever share of the rows
it has, and a partition's parts have the bound MEMBERS_A_TASK. In a round each owner sums its resident parts, the sums of
128 entries meet in one small shuffle and give the new codebooks, and each owner assigns its parts anew. Those that keep their
entry stay in the partition; those that change it, and only those, go through the next shuffle to their new owners. The
last assignment is encode(), one scan that can code any table of vectors with the codebooks found.

The resident parts are an RDD of arrays, persisted to memory and disk for one round; a lost executor's are computed anew
from the rows and the shuffles, with the same result, as places hang on vec_id and vector alone.

Defined cases: rows whose vector is null, empty or holds null or non-finite components are dropped, as are those whose length
can't be cut into parts or isn't the most common length (of these the least). Of fewer than 16 rows each begins an entry. Null
vec_ids come last and repeated ones by vector; equal rows count each. An entry without parts stays as it is; equal distances
go to the lower index. An empty table gives no rows. Components too large for 64-bit sums are counted in unbounded integers, and an
error that a long can't hold is null. Extra columns pass through encode().
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, spread_join

MEMBERS_A_TASK = 400_000
CELLS = 1 << 22  # differences taken at once


def usable(vector: Column, parts: int) -> Column:
    """Whether a vector has only finite components and can be cut into parts."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & (F.size(vector) % parts == 0) & fine, F.lit(False))


def whole(rows, scale: int, wide: bool):
    """floor(scale x) of an array of doubles; wide: as Python's integers."""
    import numpy as np

    if not wide:
        return np.floor(rows * scale).astype(np.int64)
    return np.array([[_floor(x, scale) for x in row] for row in rows.tolist()], dtype=object).reshape(rows.shape)


def _floor(x: float, scale: int) -> int:
    top, bottom = x.as_integer_ratio()
    return top * scale // bottom


def nearest(x, entries):
    """Index and squared distance of the nearest entry for each row; the lower index of equals."""
    import numpy as np

    at = np.zeros(len(x), dtype=np.int64)
    off = np.zeros(len(x), dtype=x.dtype)
    block = max(1, CELLS // entries.size)
    for lo in range(0, len(x), block):
        d = ((x[lo : lo + block, None, :] - entries[None]) ** 2).sum(axis=2)
        at[lo : lo + block] = best = d.argmin(axis=1)
        off[lo : lo + block] = d[np.arange(len(best)), best]
    return at, off


class Codebooks:
    """entries[position] is an array (entry, component)."""

    def __init__(self, entries: list, scale: int, wide: bool):
        self.entries, self.scale, self.wide = entries, scale, wide

    @property
    def length(self) -> int:
        return sum(e.shape[1] for e in self.entries)

    def sha256(self) -> str:
        """Of all components as decimal integers, by position, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(int(x)) for e in self.entries for x in e.reshape(-1)).encode()).hexdigest()


def _shape(rows: DataFrame) -> tuple[int, int, bool]:
    """Number of rows of the most common length, that length, and whether sums and distances need more than 64 bits."""
    by = rows.groupBy(F.size("_v").alias("length")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("_v", lambda x: F.abs(x)))).alias("most"))
    got = by.orderBy(F.col("n").desc(), "length").limit(1).collect()  # one row
    return (got[0]["n"], got[0]["length"], got[0]["most"]) if got else (0, 0, 0.0)


def _dealt(batches: Iterator, books: Codebooks, partitions: int) -> Iterator:
    """(partition, parts) blocks of a table's rows under the first codebooks; a block holds columns position, entry, salt and components."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        salt = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64) % partitions
        v = whole(np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(len(salt), -1), books.scale, books.wide)
        blocks: list = []
        for pos, (part, entries) in enumerate(zip(np.split(v, len(books.entries), axis=1), books.entries, strict=True)):
            entry, _ = nearest(part, entries)
            blocks.append(Members.of(pos, entry, salt, part))
        out = [(to, b.packed()) for to, b in Members.joined(blocks).by_owner(partitions)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], type=pa.int32()), pa.array([x[1] for x in out], type=pa.binary())], names=["to", "block"])


class Members:
    """Parts with their position, entry and salt, as arrays of one length."""

    __slots__ = ("entry", "parts", "pos", "salt")

    def __init__(self, pos, entry, salt, parts):
        self.pos, self.entry, self.salt, self.parts = pos, entry, salt, parts

    @staticmethod
    def of(pos: int, entry, salt, parts) -> Members:
        import numpy as np

        return Members(np.full(len(entry), pos, dtype=np.int32), entry.astype(np.int32), salt.astype(np.int64), parts)

    @staticmethod
    def joined(blocks: list[Members]) -> Members:
        import numpy as np

        return Members(*[np.concatenate([getattr(b, k) for b in blocks]) for k in ("pos", "entry", "salt", "parts")])

    def __len__(self) -> int:
        return len(self.pos)

    def where(self, keep) -> Members:
        return Members(self.pos[keep], self.entry[keep], self.salt[keep], self.parts[keep])

    def by_owner(self, partitions: int) -> Iterator[tuple[int, Members]]:
        """Blocks by the partition of the owner of (position, entry, salt): one entry's salts lie in all partitions."""
        import numpy as np

        to = (self.pos.astype(np.int64) * 16 + self.entry + self.salt) % partitions
        order = np.argsort(to, kind="stable")
        edges = np.flatnonzero(np.diff(to[order])) + 1
        for at in np.split(order, edges):
            if len(at):
                yield int(to[at[0]]), self.where(at)

    def packed(self) -> bytes:
        import pickle

        return pickle.dumps((self.pos, self.entry, self.salt, self.parts), protocol=5)

    @staticmethod
    def unpacked(block: bytes) -> Members:
        import pickle

        return Members(*pickle.loads(block))

    def sums(self) -> dict:
        """(position, entry) -> components' sums as Python's integers, and the count."""
        import numpy as np

        key = self.pos.astype(np.int64) * 16 + self.entry
        order = np.argsort(key, kind="stable")
        at = np.split(order, np.flatnonzero(np.diff(key[order])) + 1)
        return {(int(self.pos[i[0]]), int(self.entry[i[0]])): ([int(s) for s in self.parts[i].sum(axis=0)], len(i)) for i in at if len(i)}


def _partition_sums(blocks: Iterator) -> Iterator:
    """Sums of all resident blocks, at most 128 rows a task."""
    total: dict = {}
    for _, block in blocks:
        for k, x in Members.unpacked(block).sums().items():
            total[k] = _added(total[k], x) if k in total else x
    yield from total.items()


def _added(a: tuple, b: tuple) -> tuple:
    return [x + y for x, y in zip(a[0], b[0], strict=True)], a[1] + b[1]


def _assigned(blocks: Iterator, entries: list, partitions: int) -> Iterator:
    """(stays, partition, block): what keeps its entry under the new entries, then what goes to another owner."""
    import numpy as np

    for home, packed in blocks:
        m = Members.unpacked(packed)
        entry = m.entry.copy()
        for pos, e in enumerate(entries):
            mine = np.flatnonzero(m.pos == pos)
            if len(mine):
                entry[mine] = nearest(m.parts[mine], e)[0]
        moved = entry != m.entry
        if not moved.all():
            yield True, home, (m.where(~moved) if moved.any() else m).packed()
        if moved.any():
            m.entry = entry
            for to, b in m.where(moved).by_owner(partitions):
                yield False, to, b.packed()


def _same_key(x: int) -> int:
    return x


def train(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, members_a_task: int = MEMBERS_A_TASK) -> Codebooks | None:
    """Codebooks of rows (_id, _v: doubles); None without rows."""
    import numpy as np

    if entries > 16:
        raise ValueError("a code has one hex digit for an entry: 16 at most")
    n, length, most = _shape(rows)
    if not n:
        return None
    reach = most * scale + 1
    wide = 4 * reach * reach * (length // parts) >= 2.0**62 or reach * n >= 2.0**62
    rows = rows.where(F.size("_v") == length)
    first = rows.orderBy(F.col("_id").asc_nulls_last(), "_v").limit(entries).collect()  # 16 rows at most
    start = whole(np.array([x["_v"] for x in first], dtype=np.float64), scale, wide)
    books = Codebooks(np.split(start, parts, axis=1), scale, wide)
    partitions = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n * parts // members_a_task))
    dealt = rows.select(F.shiftrightunsigned(F.xxhash64("_id", "_v"), 1).alias("salt"), "_v").mapInArrow(functools.partial(_dealt, books=books, partitions=partitions), "to int, block binary")
    # mapInArrow hands a block from each batch to each owner; the first shuffle brings every part to its owner.
    resident = dealt.rdd.map(lambda x: (x[0], bytes(x[1]))).partitionBy(partitions, _same_key)
    held = []
    for last in [False] * (rounds - 1) + [True]:
        sums = dict(resident.mapPartitions(_partition_sums).reduceByKey(_added, min(partitions, parts * entries)).collect())  # one row for each entry
        now = [e.copy() for e in books.entries]
        for (pos, entry), (total, count) in sums.items():
            now[pos][entry] = [t // count for t in total]
        books = Codebooks(now, scale, wide)
        while len(held) > 1:
            held.pop(0).unpersist()  # what came after it has been made
        if last:
            break
        assigned = resident.mapPartitions(functools.partial(_assigned, entries=now, partitions=partitions), preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
        held.append(assigned)
        stay = assigned.mapPartitions(lambda xs: ((x[1], x[2]) for x in xs if x[0]), preservesPartitioning=True)
        moved = assigned.mapPartitions(lambda xs: ((x[1], x[2]) for x in xs if not x[0])).partitionBy(partitions, _same_key)
        resident = stay.union(moved)  # of one partitioner, so that stayers stay where they are
    for x in held:
        x.unpersist()
    return books


def _coded(batches: Iterator, books: Codebooks) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        v = whole(np.asarray(batch.column(0).flatten(), dtype=np.float64).reshape(len(batch), -1), books.scale, books.wide)
        codes, error = [], np.zeros(len(v), dtype=v.dtype)
        for part, entries in zip(np.split(v, len(books.entries), axis=1), books.entries, strict=True):
            entry, off = nearest(part, entries)
            codes.append(entry)
            error = error + off
        text = ["".join(f"{c:02x}" for c in row) for row in np.stack(codes, axis=1).tolist()]
        held = [int(x) if int(x) < 1 << 63 else None for x in error.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(text, type=pa.string()), pa.array(held, type=pa.int64()), batch.column(1)], names=["code", "error", "_row"])


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """code, error and the struct _row of rows (_v, _row) whose length is that of the codebooks."""
    row = rows.schema["_row"].dataType.simpleString()
    return rows.where(F.size("_v") == books.length).select("_v", "_row").mapInArrow(functools.partial(_coded, books=books), f"code string, error long, _row {row}")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vec_id, code (two hex digits a part), error (squared distances summed), label, label_error (error over equal labels, nulls together), codebooks_sha256."""
    v = column(vectors, vector_col)
    own = vectors.where(usable(v.cast("array<double>"), parts))
    label = column(own, label_col) if label_col in own.columns else F.lit(None).cast("string")
    rows = own.select(column(own, id_col).alias("_id"), column(own, vector_col).cast("array<double>").alias("_v"), F.struct(column(own, id_col).alias("vec_id"), label.alias("label")).alias("_row"))
    books = train(rows.select("_id", "_v"), parts, entries, rounds, scale)
    if books is None:
        coded = rows.select(F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), "_row").where(F.lit(False))
    else:
        coded = encode(rows, books)
    coded = coded.select("_row.vec_id", "code", "error", "_row.label", F.coalesce(F.concat(F.lit("="), F.col("_row.label").cast("string")), F.lit("")).alias("_key"))
    errors = coded.groupBy("_key").agg(F.expr("try_cast(sum(cast(error AS decimal(20,0))) AS long)").alias("label_error"), F.count("*").alias("_n"))
    total = errors.agg(F.sum("_n")).first()[0] or 0
    out = spread_join(coded, errors, "_key", "_n", total, spread=F.xxhash64("vec_id", "code"))
    return out.select("vec_id", "code", "error", "label", "label_error", F.lit(books.sha256() if books else "").alias("codebooks_sha256"))
