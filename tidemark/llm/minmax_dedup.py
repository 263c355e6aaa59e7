"""Operator 7, MinHash near-dedup by min-max hashing.

A document's set is its distinct word shingles. One multiply-add per permutation gives both the least and the greatest value,
so PERMUTATIONS evaluations make twice as many signature values; they are banded in BANDS bands of ROWS values. Texts with
the same words in the same order are one class from the start, so exact copies cost one row. Classes that share a band
bucket are candidates, and every link is confirmed on the full sets:

1. Each class is confirmed against one hub, the least class of its buckets; links become components.
2. Classes of buckets that still hold several components are banded anew, more sharply (SHARP_ROWS values a band), and the
   new buckets chain them into families. In a family all classes outside its largest component are compared on the full
   sets with all its other components, in blocks of BLOCK classes by an inverted index: the exact rest.

A pair within one component needs no check, and compared pairs never become rows, so k near copies cost about k rows, and
yet no link between candidates is lost. A pair with similarity 0.8 shares no bucket in less than one of 10**6 cases.

Defined cases: null or empty texts and texts of white space have an empty set and are linked with nothing; fewer words than
the width make one shingle; ties keep the least doc_id; rows with a null doc_id take part, and a component of theirs alone
has a null id; repeated rows get a row each, but of them `dedup` leaves one; an empty table gives no rows; other columns pass
through `dedup`.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, column, cut, finalize, hash_words, window_hashes
from .components import connected_components

ROWS, BANDS = 5, 36
SHARP_ROWS, SHARP_BANDS = 8, 128
PERMUTATIONS = ROWS * BANDS // 2
BLOCK = 256
BROADCAST_KEYS = 500_000  # rows of 24 bytes


@functools.cache
def _permutations(n: int):
    import numpy as np

    rng = np.random.default_rng(20240607 + n)
    a = rng.integers(0, 1 << 64, size=n, dtype=np.uint64) | np.uint64(1)
    return a[:, None], rng.integers(0, 1 << 64, size=n, dtype=np.uint64)[:, None]


def shingles(text: bytes | None, width: int, known: WordHashes):
    """(hash of the word sequence or None, sorted distinct shingle hashes)."""
    import numpy as np

    import xxhash

    words = (text or b"").lower().split()  # bytes: folds A-Z and splits at ASCII white space only
    if not words:
        return None, np.zeros(0, dtype=np.uint64)
    return xxhash.xxh3_128_digest(b" ".join(words)), np.unique(window_hashes(hash_words(words, known), width))


def bands(values, rows: int = ROWS, n: int = BANDS):
    """n hashes of a set's min-max signature, each of rows values."""
    import numpy as np

    a, b = _permutations(rows * n // 2)
    low, high = None, None
    with np.errstate(over="ignore"):
        for i in range(0, len(values), 4096):
            x = a * values[None, i : i + 4096] + b
            mn, mx = x.min(axis=1), x.max(axis=1)
            low, high = (mn, mx) if low is None else (np.minimum(low, mn), np.maximum(high, mx))
        # neighbours in a band come from different permutations as far as may be
        table = np.concatenate([low, high]).reshape(rows, n)
        h = np.arange(n, dtype=np.uint64)
        for row in table:
            h = finalize(h * np.uint64(0x9E3779B97F4A7C15) + row)
    return h.view(np.int64)


_KNOWN = WordHashes()


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, _h (hash of the text), n (set size), key (class; null without words) and sig (band hashes)."""

    def apply(batches):
        import pyarrow as pa

        for batch in batches:
            n, keys, sigs = [], [], []
            for text in batch.column(2).to_pylist():
                key, values = shingles(text, width, _KNOWN)
                n.append(len(values))
                keys.append(key)
                sigs.append(bands(values) if len(values) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, type=pa.int64()), pa.array(keys, type=pa.binary()), pa.array(sigs, type=pa.list_(pa.int64()))], names=["doc_id", "_h", "n", "key", "sig"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("_h"), docs["text"].cast("binary").alias("text")).mapInArrow(apply, "doc_id long, _h long, n long, key binary, sig array<long>")


def candidate_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """key and set (sorted hashes as bytes) of the wanted classes, made from the text of one document of each."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), F.xxhash64(docs["text"]).alias("_h"))
    few = wanted.count() <= BROADCAST_KEYS
    want = F.broadcast(wanted) if few else wanted
    found = texts.join(want, (texts["_h"] == want["h"]) & texts["doc_id"].eqNullSafe(want["d"])).select("key", F.col("text").cast("binary").alias("text"))

    def apply(batches):
        import pyarrow as pa

        for batch in batches:
            made = [shingles(t, width, _KNOWN) for t in batch.column(1).to_pylist()]
            mine = [i for i, (k, m) in enumerate(zip(batch.column(0).to_pylist(), made, strict=True)) if m[0] == k]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(mine, type=pa.int32())), pa.array([made[i][1].tobytes() for i in mine], type=pa.binary())], names=["key", "set"])

    return found.mapInArrow(apply, "key binary, set binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with ok: whether 100 * intersection >= percent * union on the full sets."""
    left = pairs.join(sets.select(F.col("key").alias("a"), F.col("set").alias("sa")), "a")
    both = left.join(sets.select(F.col("key").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb")

    def apply(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                z = np.sort(np.concatenate([p, q]), kind="stable")  # two runs: a merge
                same = int((z[1:] == z[:-1]).sum())
                ok.append(100 * same >= percent * (len(z) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, type=pa.bool_())], names=["a", "b", "ok"])

    return cut(both.mapInArrow(apply, "a binary, b binary, ok boolean"), "confirmed")


def _near(n: str, m: str, percent: int):
    """Sets of these sizes can be similar enough."""
    return (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)


def link_classes(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, comp) over classes from members (h, key, n): the rows of buckets that hold two classes or more."""
    hubs = members.groupBy("h").agg(F.min(F.struct("key", "n")).alias("hub"))
    first = members.join(hubs, "h").select("key", "n", F.col("hub.key").alias("hub"), F.col("hub.n").alias("m")).where((F.col("key") != F.col("hub")) & _near("n", "m", percent))
    tried = confirm(first.groupBy(F.col("key").alias("a")).agg(F.min("hub").alias("b")), sets, percent)
    links = tried.where("ok").select("a", "b")
    comps = connected_components(links)

    got = members.join(comps, members["key"] == comps["node"], "left").select("h", "key", F.coalesce("comp", "key").alias("comp"))
    several = got.groupBy("h").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 != c1").select("h")
    mixed = cut(got.join(several, "h").select("key", "comp").distinct(), "mixed")
    if mixed.isEmpty():
        return comps
    more = link_families(mixed.join(sets, "key"), percent)
    if more.isEmpty():
        return comps
    # links between components: what they join takes the least label
    joined = connected_components(more).select(F.col("node").alias("_c"), F.col("comp").alias("_to"))
    everyone = comps.unionByName(mixed.select(F.col("key").alias("node"), "comp")).distinct()
    return everyone.join(joined, F.col("comp") == F.col("_c"), "left").select("node", F.coalesce("_to", "comp").alias("comp"))


def link_families(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): components of members (key, comp, set) that a confirmed link joins."""

    def sharper(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sigs = [bands(np.frombuffer(x.as_buffer(), np.uint64), SHARP_ROWS, SHARP_BANDS) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sigs, type=pa.list_(pa.int64()))], names=["key", "comp", "sig"])

    held = cut(members.select("key", "comp", "set"), "held")
    rows = cut(held.mapInArrow(sharper, "key binary, comp binary, sig array<long>"), "sharp").select("key", "comp", F.explode("sig").alias("h"))
    hubs = rows.groupBy("h").agg(F.min("key").alias("hub"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 != c1").select("h", "hub")
    # A key's hubs, at most SHARP_BANDS, are linked through the least of them: near copies share their hubs, so that distinct
    # links number about one a key, not one a key and band.
    seen = rows.join(hubs, "h").groupBy("key").agg(F.collect_set("hub").alias("hubs"))
    links = seen.select(F.explode(F.array_union("hubs", F.array("key"))).alias("a"), F.array_min("hubs").alias("b")).distinct()
    families = connected_components(links)
    own = cut(held.join(families.select(F.col("node").alias("key"), F.col("comp").alias("fam")), "key").select("fam", "key", "comp"), "families")
    sizes = own.groupBy("fam", "comp").agg(F.count("*").alias("n")).groupBy("fam").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp"))["comp"].alias("main"), F.max("n").alias("most")).where("most < n")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    mine = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    full = own.join(sizes, "fam").withColumns({"nb": blocks(F.col("n")), "nu": blocks(F.col("n") - F.col("most"))}).join(held.select("key", "set"), "key")
    every = F.sequence(F.lit(0), F.col("nb") - 1), F.sequence(F.lit(0), F.col("nu") - 1)
    rest = full.where("comp != main").select("fam", mine(F.col("nu")).alias("u"), F.explode(every[0]).alias("i"), "comp", "set", F.lit(True).alias("asks"))
    all_ = full.select("fam", F.explode(every[1]).alias("u"), mine(F.col("nb")).alias("i"), "comp", "set", F.lit(False).alias("asks"))

    def compare(group):
        import numpy as np
        import pyarrow as pa

        asks = np.array(group.column("asks").to_pylist())
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("set").combine_chunks()]
        names, comp = np.unique(np.array([x.hex() for x in group.column("comp").to_pylist()]), return_inverse=True)
        there, found = np.flatnonzero(~asks), set()
        if len(there):
            n = np.array([len(sets[i]) for i in there])
            values, owner = np.concatenate([sets[i] for i in there]), np.repeat(np.arange(len(there)), n)
            order = np.argsort(values, kind="stable")
            values, owner, there_comp = values[order], owner[order], comp[there]
            for q in np.flatnonzero(asks):
                low, high = np.searchsorted(values, sets[q]), np.searchsorted(values, sets[q], side="right")
                runs = high - low
                at = np.repeat(low - (np.cumsum(runs) - runs), runs) + np.arange(int(runs.sum()))
                same = np.bincount(owner[at], minlength=len(there))
                near = (100 * same >= percent * (n + len(sets[q]) - same)) & (there_comp != comp[q])
                found.update((int(comp[q]), int(c)) for c in np.unique(there_comp[near]))
        return pa.table({"a": pa.array([bytes.fromhex(names[x]) for x, _ in found], pa.binary()), "b": pa.array([bytes.fromhex(names[y]) for _, y in found], pa.binary())})

    return cut(rest.unionByName(all_).groupBy("fam", "u", "i").applyInArrow(compare, "a binary, b binary").distinct(), "joined")


def placed_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """A row per document: doc_id, _h, n_shingles, component_id, kept and stays: it has the one doc_id and text hash that stand for its component."""
    signed = cut(signatures(docs, width), "signatures")
    classes = cut(signed.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_h")).alias("r"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    rows = classes.select(F.explode("sig").alias("h"), "key", "n")
    shared = rows.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    members = cut(rows.join(shared, "h"), "members")
    wanted = members.select("key").distinct().join(classes, "key").select("key", F.col("r.doc_id").alias("d"), F.col("r._h").alias("h"))
    sets = cut(candidate_sets(docs, cut(wanted, "wanted"), width).groupBy("key").agg(F.first("set").alias("set")), "sets")
    comps = link_classes(members, sets, percent)
    placed = classes.join(comps, classes["key"] == comps["node"], "left").select("key", "r", F.coalesce("comp", "key").alias("comp"))
    least = placed.groupBy("comp").agg(F.min("r").alias("least"))
    of = placed.join(least, "comp").select("key", F.col("least.doc_id").alias("component_id"), F.col("least._h").alias("_g"))
    out = signed.select("doc_id", "_h", "n", "key").join(of, "key", "left")
    alone = F.col("key").isNull()
    kept = alone | F.col("doc_id").eqNullSafe(F.col("component_id"))
    stays = alone | (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("_h") == F.col("_g")))
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "_h", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), stays.alias("stays"))


def components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """A row per document: doc_id, _h, n_shingles, component_id and kept."""
    return placed_rows(docs, width, percent).drop("stays")


def dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: that of its least doc_id, for equal ones of the least text hash, any one of rows that
    repeat both. Rows without words stay, but for such repeated ones."""
    rows = placed_rows(docs, width, percent).groupBy(F.col("doc_id").alias("_tm_id"), F.col("_h").alias("_tm_g"))
    marks = cut(rows.agg(F.bool_or("stays").alias("_tm_stays"), F.count("*").alias("_tm_n")).where("NOT _tm_stays OR _tm_n > 1"), "marks")
    keyed = docs.withColumn("_tm_h", F.xxhash64("text"))
    same = (F.col("_tm_h") == F.col("_tm_g")) & F.col("doc_id").eqNullSafe(F.col("_tm_id"))
    left = keyed.join(marks, same, "left_anti").select(*[column(keyed, c) for c in docs.columns])
    repeated = marks.where("_tm_stays")
    n = repeated.count()
    if not n:
        return left
    several = keyed.join(F.broadcast(repeated) if n <= BROADCAST_KEYS else repeated, same, "left_semi")
    one = several.groupBy("doc_id", "_tm_h").agg(F.first(F.struct(*[column(keyed, c) for c in docs.columns])).alias("_tm_row"))
    return left.unionByName(one.select(*[F.col("_tm_row").getField(c).alias(c) for c in docs.columns]))
