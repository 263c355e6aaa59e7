"""Operator 2, quality rules: a ledger of rule failures as bits.

Every rule is evaluated once for a document; the ledger holds the measurements and one long whose bit i says that rule i
failed. A policy is a versioned set of rules that reject, written as a mask, so any policy or ablation is bit arithmetic
on the ledger and never reads a text again. All of it is DataFrame expressions inside one scan: no shuffle, no Python.

Defined cases: a null or empty text has no words and measures 0, and fails min_words; ties and repeated rows are judged
alike, row by row; an empty table gives an empty ledger; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORD, let, pick, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Rule name to the measurement columns' test of failure; the place in this list is the rule's bit, so only append.
RULES: list[tuple[str, str]] = [
    ("min_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbol_share", "10 * n_symbols > n_words AND n_words > 0"),
    ("dup_line_share", "n_lines > 0 AND 100 * n_dup_lines > 30 * n_lines"),
    ("mean_word_short", "n_words > 0 AND word_chars < 2 * n_words"),
    ("mean_word_long", "word_chars > 20 * n_words"),
    ("shouting", "n_upper > 0 AND 100 * n_upper > 70 * (n_upper + n_lower) AND n_words > 0"),
    ("exclaiming", "n_words > 0 AND 2 * n_bangs > n_words"),
]
BIT = {name: i for i, (name, _) in enumerate(RULES)}


def mask(*rules: str) -> int:
    """The bits of the named rules."""
    return sum(1 << BIT[r] for r in rules)


#: Policies by version; a version never changes once it is published.
POLICIES: dict[str, int] = {
    "base-v1": mask("min_words", "repeated_windows"),
    "web-v1": mask("min_words", "repeated_windows", "symbol_share", "mean_word_short", "mean_word_long", "shouting", "exclaiming"),
    "web-v2": mask(*BIT),
}


def duplicated(keys: Column) -> Column:
    """How many elements of an array of longs equal an earlier one."""
    return F.size(keys) - F.size(F.array_distinct(keys))


def covered(keys: Column, width: int) -> Column:
    """Positions that lie in a window found twice or more; keys holds a window's key at its start. n log n in the window count."""

    def spread(starts: Column) -> Column:
        # starts ascend: each window adds its width, less what it shares with the next
        gaps = F.zip_with(starts, F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(width)), F.lit(width)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)

    def repeated(by_key: Column) -> Column:
        n = F.size(by_key)
        after = F.zip_with(by_key, F.slice(by_key, 2, n), lambda a, b: F.coalesce(a["k"] == b["k"], F.lit(False)))  # equals the next
        before = F.concat(F.array(F.lit(False)), F.slice(after, 1, F.greatest(n - 1, F.lit(0))))
        both = F.zip_with(by_key, F.zip_with(after, before, lambda a, b: a | b), lambda x, y: F.when(y, x["i"]))
        return let(F.sort_array(F.filter(both, lambda x: x.isNotNull())), spread)

    counted = F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), let(F.array_sort(counted), repeated)).otherwise(F.lit(0).cast("long"))


def window_keys(words: Column, width: int) -> Column:
    """128 bits would be needed for proof; 64 bits tell a text's few thousand windows apart but for one text in 10**11.

    Keys of all runs of width (a power of two) words, from pairwise hashes of runs half as long."""

    def paired(step: int):
        return lambda k: F.zip_with(F.slice(k, 1, F.greatest(F.size(k) - step, F.lit(0))), F.slice(k, step + 1, F.greatest(F.size(k), F.lit(1))), lambda a, b: F.xxhash64(a, b))

    keys = F.transform(words, lambda w: F.xxhash64(w))
    step = 1
    while step < width:
        keys = let(keys, paired(step))
        step *= 2
    return keys


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements that rules read, each from one pass over the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = pick(docs, "doc_id", "text").withColumn("_m", let(words_of(text, SPACE_WORD), _measures))
    return base.select("doc_id", "_m.*")


def _measures(words: Column) -> Column:
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.regexp_replace(text, SPACE_WORD.replace("^", ""), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(F.transform(lines, lambda x: F.struct(F.xxhash64(x), F.xxhash64(F.lit(1), x))), duplicated).cast("long").alias("n_dup_lines"),
        let(window_keys(words, WINDOW), lambda k: covered(k, WINDOW)).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        (F.length(text) - F.length(F.translate(text, "abcdefghijklmnopqrstuvwxyz", ""))).cast("long").alias("n_lower"),
        (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long").alias("n_bangs"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and failed: the bitmask of failed rules."""
    bits = F.lit(0).cast("long")
    for name, test in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(test), F.lit(1 << BIT[name])).otherwise(F.lit(0)).cast("long"))
    return measure(docs).withColumn("failed", bits)


def apply_policy(ledgered: DataFrame, policy: str | int) -> DataFrame:
    """Adds base_failed and kept under a policy; the base rules always reject."""
    bits = POLICIES[policy] if isinstance(policy, str) else policy
    base = F.col("failed").bitwiseAND(POLICIES["base-v1"]) != 0
    return ledgered.withColumns({"base_failed": base, "kept": ~base & (F.col("failed").bitwiseAND(bits) == 0)})


def ablation(ledgered: DataFrame, policy: str | int) -> DataFrame:
    """For each rule of a policy: documents it fails, those that it alone rejects, and those kept without it."""
    bits = POLICIES[policy] if isinstance(policy, str) else policy
    used = [name for name, _ in RULES if bits >> BIT[name] & 1]
    hit = F.col("failed").bitwiseAND(bits)
    parts = [F.struct(F.lit(r).alias("rule"), F.count_if(hit.bitwiseAND(mask(r)) != 0).alias("fails"), F.count_if(hit == mask(r)).alias("alone"), F.count_if(hit.bitwiseAND(~mask(r)) == 0).alias("kept_without")) for r in used]
    return ledgered.agg(F.array(*parts).alias("r")).select(F.inline("r"))


def exact_masks(ledgered: DataFrame) -> DataFrame:
    """Documents by failure mask, from which any further policy's counts follow without the documents."""
    return ledgered.groupBy("failed").agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"))
