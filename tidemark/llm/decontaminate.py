"""Operator 3, benchmark decontamination: broadcast hash set of benchmark n-grams against all token windows.

Benchmark items are cut into windows of `width` folded words. A bit array of the window hashes, whose size follows their
number up to a fixed bound, travels to every task as a scalar subquery and screens each document's windows inside the
row; the windows that pass carry their words into a hash join on the words themselves, so every hit is verified and a
false positive of the screen costs one probe. The window set is broadcast while its row count is within a bound that is
checked; past it the same join shuffles. DataFrame expressions only.

Defined cases: a null or empty text has no words and no hits; an item without words is no window, one with fewer words
than width is a single window of its own length; repeated documents get a row each, repeated items count by distinct
item_id; an empty benchmark hits nothing; other columns are not read (or pass through in `clean`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FOLDED_WORD, column, cut, fold, let, pick, words_of

BROADCAST_WINDOWS = 2_000_000  # rows of about 100 bytes
MOST_BITS = 26  # 8 MB of screen at most


def run_keys(words: Column, width: int) -> Column:
    """64-bit hashes of all runs of width words, from hashes of runs of powers of two."""

    def paired(k: Column, shift: int, other: Column) -> Column:
        left = F.slice(k, 1, F.greatest(F.size(other) - shift, F.lit(0)))
        return F.zip_with(left, F.slice(other, shift + 1, F.greatest(F.size(other), F.lit(1))), lambda a, b: F.xxhash64(a, b))

    def grow(step: int, done: int, left: int):
        """k holds runs of step words and of those joined so far (done words, or none)."""

        def body(k: Column) -> Column:
            one, acc = k["one"], k["acc"]
            now, n = (acc, done)
            if left & 1:
                now, n = (one, step) if not done else (paired(acc, done, one), done + step)
            if left == 1:
                return now
            twice = paired(one, step, one)
            return let(F.struct(twice.alias("one"), now.alias("acc")), grow(2 * step, n, left >> 1))

        return body

    first = F.transform(words, lambda w: F.xxhash64(w))
    return let(F.struct(first.alias("one"), F.array().cast("array<bigint>").alias("acc")), grow(1, 0, width))


def benchmark_windows(benchmark: DataFrame, width: int = 10) -> DataFrame:
    """item_id, len, w (the window's words joined by a space) and k (its hash), distinct."""
    words = pick(benchmark, "item_id", "text").select("item_id", words_of(fold(F.col("text")), FOLDED_WORD).alias("ws"))
    parts = []
    for n in range(1, width + 1):
        here = words.where(F.size("ws") >= width if n == width else F.size("ws") == n)
        at = F.sequence(F.lit(1), F.size("ws") - F.lit(n - 1))
        runs = F.arrays_zip(_joined(F.col("ws"), at, n).alias("w"), run_keys(F.col("ws"), n).alias("k"))
        parts.append(here.select("item_id", F.lit(n).alias("len"), F.inline(runs).alias("w", "k")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def _joined(words: Column, at: Column, n: int) -> Column:
    return F.transform(at, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


def screen(windows: DataFrame, bits: int) -> DataFrame:
    """One row, one array of longs: bit h of it says that some window has hash h, modulo its length."""
    slots = F.col("k").bitwiseAND((1 << bits) - 1)
    mine = windows.select(F.shiftright(slots, 6).alias("at"), F.expr("shiftleft(1L, cast(k & 63 as int))").alias("b")).groupBy("at").agg(F.bit_or("b").alias("b"))
    full = windows.sparkSession.range(1 << bits - 6).withColumnRenamed("id", "at").join(mine, "at", "left")
    return full.agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("b", F.lit(0).cast("long")).alias("b")))).alias("r")).select(F.col("r.b").alias("screen"))


def scan(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> tuple[DataFrame, DataFrame]:
    """(hits, items): hits has _row, _key, doc_id, n_words and pos, len, w of every hit, and one row without them for each
    document; items has w and item_id."""
    windows = cut(benchmark_windows(benchmark, width), "windows")
    distinct = windows.select("len", "w", "k").distinct()
    lens = sorted((r["len"], r["n"]) for r in distinct.groupBy("len").agg(F.count("*").alias("n")).collect())
    n = sum(x for _, x in lens)
    keyed = pick(docs, "doc_id", "text").select("doc_id", F.monotonically_increasing_id().alias("_row"), F.xxhash64("doc_id", "text").alias("_key"), words_of(fold(F.col("text")), FOLDED_WORD).alias("_ws"))
    none = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("len"), F.lit(None).cast("string").alias("w")))
    if n:
        bits = min(MOST_BITS, max(16, (16 * n).bit_length()))
        bitmap = cut(screen(distinct, bits), "screen").scalar()

        def passed(words: Column, length: int) -> Column:
            def seen(k: Column) -> Column:
                word = F.get(F.col("_screen"), F.shiftright(k.bitwiseAND((1 << bits) - 1), 6).cast("int"))
                return F.shiftrightunsigned(word, 0).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(63).cast("int"))) != 0

            places = F.filter(F.transform(run_keys(words, length), lambda k, i: F.when(seen(k), i)), lambda i: i.isNotNull())
            return F.transform(places, lambda i: F.struct(i.alias("pos"), F.lit(length).alias("len"), F.array_join(F.slice(words, i + 1, F.lit(length)), " ").alias("w")))

        keyed = keyed.withColumn("_screen", bitmap)
        found = F.concat(none, *[passed(F.col("_ws"), length) for length, _ in lens])
    else:
        found = none
    rows = keyed.select("_row", "_key", "doc_id", F.size("_ws").cast("long").alias("n_words"), F.inline(found).alias("pos", "len", "w"))
    known = distinct.select("w", F.lit(True).alias("_hit"))
    known = F.broadcast(known) if n <= BROADCAST_WINDOWS else known
    hits = rows.join(known, "w", "left").where("pos < 0 OR _hit").drop("_hit")
    return cut(hits, "hits"), windows.select("w", "item_id").distinct()


def spans(starts: Column) -> Column:
    """Merged [from, to) word ranges of an ascending array of (pos, len)."""
    empty = F.array().cast("array<struct<a:int,b:int>>")

    def add(done: Column, x: Column) -> Column:
        last, end = F.get(done, F.size(done) - 1), x["pos"] + x["len"]
        new = F.array(F.struct(x["pos"].alias("a"), end.alias("b")))
        longer = F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], end).alias("b")))
        return F.when((F.size(done) > 0) & (x["pos"] <= last["b"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), longer)).otherwise(F.concat(done, new))

    return F.aggregate(starts, empty, add)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_spans (word ranges)."""
    hits, items = scan(docs, benchmark, width)
    covered = hits.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(F.when(F.col("pos") >= 0, F.struct("pos", "len")))).alias("s"))
    of = hits.where("pos >= 0").select("_row", "w").distinct().join(items, "w").select("_row", F.col("item_id").cast("string").alias("i")).distinct().groupBy("_row").agg(F.array_sort(F.collect_list("i")).alias("i"))
    out = covered.withColumn("hit_spans", spans(F.col("s"))).join(of, "_row", "left")
    ids = F.coalesce("i", F.array().cast("array<string>"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"), "hit_spans")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, drop_share: float = 0.5) -> DataFrame:
    """docs without the hit words (and the separators after them); a document that they make up drop_share of goes whole."""
    hits, _ = scan(docs, benchmark, width)
    found = hits.where("pos >= 0").groupBy("_key", "doc_id").agg(F.max("n_words").alias("_n"), F.array_sort(F.collect_set(F.struct("pos", "len"))).alias("_s")).withColumn("_s", spans(F.col("_s"))).withColumnRenamed("doc_id", "_id")
    share = F.aggregate("_s", F.lit(0), lambda n, x: n + x["b"] - x["a"]) / F.col("_n")
    names = docs.columns
    rest = [c for c in names if c not in ("doc_id", "text")]
    flat = docs.select("doc_id", "text", F.struct(*[column(docs, c).alias(c) for c in rest]).alias("_rest") if rest else F.lit(None).alias("_rest"), F.xxhash64("doc_id", "text").alias("_k"))
    both = flat.join(found, (F.col("_k") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left").where(F.col("_s").isNull() | (share < drop_share))
    either = FOLDED_WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")

    def rebuilt(parts: Column) -> Column:
        # what stays lies between the end of a span and the start of the next
        starts = F.concat(F.array(F.lit(0)), F.transform("_s", lambda x: x["b"]))
        left = F.zip_with(starts, F.transform("_s", lambda x: x["a"]), lambda a, b: F.array_join(F.slice(parts["tails"], a + 1, F.coalesce(b, F.size(parts["tails"])) - a), ""))
        return F.concat(parts["head"], F.array_join(left, ""))

    def cut_up(x: Column) -> Column:
        tails = F.zip_with(x["ws"], F.slice(x["gaps"], 2, F.size(x["gaps"])), lambda w, gap: F.concat(w, F.coalesce(gap, F.lit(""))))
        return let(F.struct(F.get(x["gaps"], F.lit(0)).alias("head"), tails.alias("tails")), rebuilt)

    text = F.when(F.col("_s").isNull(), F.col("text")).otherwise(let(F.struct(words_of(F.col("text"), either).alias("ws"), F.split("text", either, -1).alias("gaps")), cut_up))
    made = {"doc_id": F.col("doc_id"), "text": text}
    if "n_chars" in rest:
        made["n_chars"] = F.when(F.col("_s").isNull(), F.col("_rest")["n_chars"]).otherwise(F.length(text).cast("long"))
    return both.select(*[made.get(c, F.col("_rest")[c] if c in rest else F.col(c)).alias(c) for c in names])
