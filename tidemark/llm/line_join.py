"""Operator 6, line dedup: an exact set-similarity self-join of lines that removes later matches.

A line's tokens are its distinct runs of `width` words (fewer words: the whole line). A line is removed if some earlier line,
by doc_id and place in the text, has a Jaccard similarity of `percent` or more to it; what counts is the input, not what is
left. Lines without words stay.

1. Tokens are ordered by the length of their first word in bytes, long ones first, as they are rarer; then by that word's hash,
   then by their own: a total order, which keeps the prefix filter exact, and needs no count of words.
2. A line gives its prefix, the n - ceil(n * percent) + 1 first tokens of that order, with all tokens that share the last one's
   first word. Repeated runs make n an upper bound, which only lengthens the prefix; if repeats leave fewer distinct tokens
   than the prefix must have, all tokens are sent. So the other tokens of a line are never hashed.
3. Lines with equal words are one class, held by its first line; aggregation combines them before the shuffle.
4. Only tokens that two classes or more have go on. Within a token each class is paired with the first one. Classes that
   have no earlier match yet are paired with the other earlier classes of their tokens, a token's group being of GROUP
   classes at most. The full sets are read for these classes alone; pairs pass the length filter and the parity filter and
   then the Jaccard test.
5. In larger groups the classes still open are paired with those of their length, as long as these are GROUP * BY_LENGTH at most.
6. Classes of still larger groups are joined by counts of all their tokens, and those made of frequent tokens as kinds, in blocks.

DataFrame expressions only. Tokens are compared by 64-bit hashes. Defined cases: null and empty texts have no lines with words
and stay as they are; a null doc_id comes after all others; of equal lines in rows of one doc_id the smaller text hash is
earlier; fully repeated rows count as one and get equal results; an empty table gives no rows; extra columns pass through
`dedup_lines`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, cut, let, pick, recorded, release, spread_join

PLACE_BITS = 24  # of a word's place in its line, below length and word hash in a long; longer lines send all tokens
SLACK = 16  # tokens after the prefix's end that may share its last first word, before all tokens are sent instead
BROADCAST_ROWS = 300_000
BROADCAST_TOKENS = 1_000_000  # rows of 8 bytes
GROUP = 256
BLOCK = 256
BY_LENGTH = 4  # groups of one length class may be so many times larger: their pairs are filtered by numbers at hand, which costs less than a row for each token
LONG = 48  # tokens from which on 128 bits are compared
LAST = (1 << 63) - 1


def line_words(line: Column) -> Column:
    for c in "\t\x0b\x0c\r":
        line = F.replace(line, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(line, " ", -1), "")


def _run(ws: Column, at: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(ws, at + k if k else at) for k in range(width)])


def _rank(w: Column) -> Column:
    """Shortness and part of the hash of a word above PLACE_BITS zero bits: long words are rare, and no pass over the texts counts them. Beyond 63 bytes lengths wrap, in an order as total."""
    short = F.lit(63) - F.octet_length(w)
    return F.shiftleft(short.cast("long"), 57).bitwiseOR(F.xxhash64(w).bitwiseAND(((1 << 57) - 1) ^ ((1 << PLACE_BITS) - 1)))


def prefix_size(n: Column, percent: int) -> Column:
    return (n - F.ceil(n * percent / F.lit(100.0) - F.lit(1e-9)) + F.lit(1)).cast("int")


def with_prefix(lines: DataFrame, width: int, percent: int) -> DataFrame:
    """lines with prefix instead of their words ws: the token hashes that hold a line's prefix; null for fewer words than width.

    A column at a time, as Spark compiles sorting and slicing of columns but not of what a lambda holds."""
    n, ws = F.size("ws") - (width - 1), F.col("ws")
    p, rank = prefix_size(n, percent), lambda k: F.shiftright(k, PLACE_BITS)
    keyed = lines.withColumn("keys", F.when(n >= 1, F.sort_array(F.transform(F.slice(ws, 1, n), lambda w, i: _rank(w).bitwiseOR(i)))))
    last, more = F.get("keys", p - 1), F.slice("keys", 1, p + SLACK)
    tied = F.filter(more, lambda k: rank(k) <= rank(last))
    # all tokens of the last rank are there if some key after them is, or all keys are
    tied = F.when((rank(F.get(more, F.size(more) - 1)) > rank(last)) | (F.size(more) == n), tied)
    head = F.when(rank(F.get("keys", p)) == rank(last), tied).otherwise(F.slice("keys", 1, p))
    headed = keyed.withColumn("keys", F.when((n >= 1) & (n < 1 << PLACE_BITS), head))
    some = F.transform("keys", lambda k: _run(ws, k.bitwiseAND((1 << PLACE_BITS) - 1).cast("int"), width))
    every = F.transform(F.slice(ws, 1, n), lambda _, i: _run(ws, i, width))
    made = headed.withColumn("keys", F.array_distinct(some))
    return made.withColumn("prefix", F.when(n >= 1, F.coalesce(F.when(F.size("keys") >= p, F.col("keys")), F.array_distinct(every)))).drop("ws", "keys")


def with_tokens(lines: DataFrame, width: int) -> DataFrame:
    """lines with tokens instead of their words ws: all distinct token hashes, made of the words' hashes; one token for fewer words than width."""
    hashed = lines.withColumn("ws", F.transform("ws", lambda w: F.xxhash64(w)))
    n, ws = F.size("ws") - (width - 1), F.col("ws")
    runs = F.transform(F.slice(ws, 1, n), lambda _, i: _run(ws, i, width))
    return hashed.withColumn("tokens", F.when(n >= 1, F.array_distinct(runs)).otherwise(F.array(F.xxhash64(F.lit(0), ws)))).drop("ws")


def parities(tokens: Column) -> Column:
    """64 bits: how many of the tokens fall to each, modulo 2. Two sets' bits differ in no more places than the sets differ in tokens."""
    one = F.lit(1).cast("long")
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda bits, t: bits.bitwiseXOR(F.call_function("shiftleft", one, t.bitwiseAND(63).cast("int"))))


def half_parities(tokens: Column) -> Column:
    """parities of the tokens whose seventh bit is set, null for fewer than LONG tokens: with them 128 bits are compared, as half as many tokens fall to each."""
    half = lambda t: F.call_function("shiftleft", F.shiftright(t, 6).bitwiseAND(1), t.bitwiseAND(63).cast("int"))
    return F.when(F.size(tokens) >= LONG, F.aggregate(tokens, F.lit(0).cast("long"), lambda bits, t: bits.bitwiseXOR(half(t))))


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, tag (text hash; rows with a null doc_id stand after all others) and text."""
    own = pick(docs, "doc_id", "text")
    tag = F.xxhash64("text").bitwiseAND((1 << 30) - 1) + F.when(F.col("doc_id").isNull(), F.lit(1 << 30)).otherwise(F.lit(0))
    return own.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), tag.alias("tag"), F.coalesce("text", F.lit("")).alias("text"))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, tag, no and line, for every line."""
    return _named(docs).select("doc_id", "tag", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))


def prefixes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of each line with words: doc_id, place (tag and line number), the hashes k1, k2 of its words and its prefix. A text's first line has a row in any case, without words k1 is null."""
    some = lines_of(docs).where((F.btrim("line", F.lit(" \t\x0b\x0c\r")) != "") | (F.col("no") == 0))  # a test of words would split each line twice
    rated = some.select("doc_id", (F.shiftleft("tag", 32) + F.col("no")).alias("place"), line_words(F.col("line")).alias("ws"))
    k1 = F.when(F.size("ws") > 0, F.xxhash64("ws"))
    return with_prefix(rated.select("doc_id", "place", k1.alias("k1"), F.xxhash64(F.lit(1), "ws").alias("k2"), "ws"), width, percent)


def _sets(docs: DataFrame, lines: DataFrame, width: int, repeats: bool) -> DataFrame:
    """doc_id, place, n, bits, half and tokens of the given lines (doc_id, place), read from the texts again. repeats: whether some rows of docs repeat a doc_id and a text."""
    wanted = cut(lines.groupBy(F.col("doc_id").alias("d"), F.shiftright("place", 32).alias("t")).agg(F.collect_set(F.col("place").bitwiseAND((1 << 32) - 1).cast("int")).alias("nos")), "wanted")
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    both = _named(docs).join(F.broadcast(wanted) if few else wanted, (F.col("doc_id") == F.col("d")) & (F.col("tag") == F.col("t")))
    own = let(F.split("text", "\n", -1), lambda ls: F.transform("nos", lambda no: F.struct(no.alias("no"), F.get(ls, no).alias("line"))))
    found = both.select("doc_id", "tag", F.inline(own)).select("doc_id", (F.shiftleft("tag", 32) + F.col("no")).alias("place"), line_words(F.col("line")).alias("ws"))
    rated = with_tokens(found, width).select("doc_id", "place", F.size("tokens").alias("n"), parities(F.col("tokens")).alias("bits"), half_parities(F.col("tokens")).alias("half"), "tokens")
    return rated.dropDuplicates(["doc_id", "place"]) if repeats else rated  # repeated rows give the same line twice


def _close(x: Column, y: Column, percent: int) -> Column:
    return F.size(F.array_intersect(x, y)) * (100 + percent) >= (F.size(x) + F.size(y)) * percent


def _sized(n: Column, m: Column, percent: int) -> Column:
    return (n * 100 >= m * percent) & (m * 100 >= n * percent)


def _filters(percent: int) -> Column:
    """Length and parity filters of a pair of n and m tokens, with bits, half and others, other_half: of similar ones no more than a share of both is in one alone."""
    n, m, either = F.col("n"), F.col("m"), F.col("bits").bitwiseXOR(F.col("others"))
    half = F.col("half").bitwiseXOR(F.col("other_half"))
    apart = F.coalesce(F.bit_count(half) + F.bit_count(half.bitwiseXOR(either)), F.bit_count(either))
    return _sized(n, m, percent) & (apart * (100 + percent) <= (n + m) * (100 - percent))


def _other(x: str = "") -> list[Column]:
    """The columns of a row (of x) under the names that a pair gives its earlier line."""
    return [F.col(f"{x}{c}").alias(to) for c, to in (("doc_id", "d"), ("place", "p"), ("n", "m"), ("bits", "others"), ("half", "other_half"))]


def _earlier(other_doc: Column, other_place: Column) -> Column:
    return (other_doc < F.col("doc_id")) | ((other_doc == F.col("doc_id")) & (other_place < F.col("place")))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """doc_id and place of those of pairs (doc_id, place, d, p and what _filters reads) whose full token sets are similar enough."""
    one = cut(pairs.where(_filters(percent)).select("doc_id", "place", "d", "p").distinct(), "pairs")
    lines = one.select("doc_id", "place").union(one.select("d", "p")).distinct()
    few = one.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    some = sets.select("doc_id", "place", "tokens").join(F.broadcast(lines) if few else lines, ["doc_id", "place"], "left_semi")
    both = one.join(some.withColumnRenamed("tokens", "x"), ["doc_id", "place"]).join(some.select(F.col("doc_id").alias("d"), F.col("place").alias("p"), F.col("tokens").alias("y")), ["d", "p"])
    return cut(both.where(_close(F.col("x"), F.col("y"), percent)).select("doc_id", "place").distinct(), "verified")


def _small(rows: DataFrame) -> DataFrame:
    """rows, broadcast if they are few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def _by_count(lines: DataFrame, percent: int, name: str) -> DataFrame:
    """lines (doc_id, place, n, tokens) with cs, those of their tokens that others of these lines have too with counts, rarest first, and k, how many of these are in the prefix of all n tokens in that order; lines without any go."""
    named = cut(lines.select("doc_id", "place", "n", F.explode("tokens").alias("t")), name)
    counts = cut(named.groupBy("t").agg(F.count("*").alias("c")).where("c > 1"), "counts")
    few = counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    both = named.join(F.broadcast(counts), "t") if few else spread_join(named, counts, "t", "c", named.count(), F.xxhash64("doc_id", "place"))
    held = both.groupBy("doc_id", "place", "n").agg(F.sort_array(F.collect_list(F.struct("c", "t"))).alias("cs"))
    k = prefix_size(F.col("n"), percent) - (F.col("n") - F.size("cs"))
    return cut(held.withColumn("k", k).where("k > 0"), "held")


def _in_prefix(held: DataFrame) -> DataFrame:
    return held.select("doc_id", "place", F.inline(F.slice("cs", 1, F.col("k"))))


def alike_kinds(kinds: DataFrame, percent: int) -> DataFrame:
    """h and the first line (d, p) of kinds similar to those that ask, by the tokens f alone: a kind (h, doc_id, place, n, f, asks) stands for all lines of n tokens with these frequent ones and doc_id, place for the first of them. Large groups of kinds are compared in blocks of them."""
    own = kinds.where(F.col("asks") & (F.size("f") * (100 + percent) >= 2 * F.col("n") * percent)).select("h", F.col("doc_id").alias("d"), F.col("place").alias("p"))
    held = _by_count(kinds.select("doc_id", "place", "n", F.col("f").alias("tokens")), percent, "kind_tokens")
    own_bits = kinds.withColumn("bits", parities(F.col("f")))
    dealt = cut(_in_prefix(held).join(own_bits, ["doc_id", "place"]).withColumn("nb", F.ceil(F.col("c") / BLOCK).cast("int")).drop("c"), "dealt")
    b = F.pmod(F.xxhash64("doc_id", "place"), "nb").cast("int").alias("b")
    blocks = dealt.groupBy("t", b).agg(F.collect_list(F.struct("h", "doc_id", "place", "n", "bits", F.size("f").alias("m"), "f")).alias("block"))
    asks = dealt.where("asks").select("t", "h", "n", "bits", "f", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"))
    tasks = int(kinds.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows, much work for each

    def alike(x: Column) -> Column:
        rest = (F.size("f") + x["m"]) * (100 + percent) - (F.col("n") + x["n"]) * 2 * percent  # tokens that may be in one alone, by 100 + percent
        fits = (x["h"] != F.col("h")) & (F.bit_count(x["bits"].bitwiseXOR(F.col("bits"))) * (100 + percent) <= rest)
        return F.when(fits, F.size(F.array_intersect("f", x["f"])) * (100 + percent) >= (F.col("n") + x["n"]) * percent).otherwise(F.lit(False))

    first = F.array_min(F.transform(F.filter("block", alike), lambda x: F.struct(x["doc_id"].alias("d"), x["place"].alias("p"))))
    other = asks.repartition(tasks, "t", "b").join(blocks, ["t", "b"]).select("h", first.alias("l")).where("l IS NOT NULL").select("h", "l.d", "l.p")
    return own.unionByName(other).groupBy("h").agg(F.min(F.struct("d", "p")).alias("l")).select("h", "l.d", "l.p")


def by_length(large: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """large's rows (doc_id, place, t, n, bits, half) twice, in the groups of their token and length class g and of the class below, with their own class k, whether they are open (not in near) and the group's size c; groups without open lines go.

    A class is wider than the length filter, so similar lines are of one class or of neighbours, and meet in the group of the lower one."""
    k = F.floor(F.log(F.col("n")) / F.log(F.lit(104.0 / percent))).cast("int")
    asks = _small(near.select("doc_id", "place", F.lit(True).alias("near")))
    own = cut(large.drop("c").withColumn("k", k).join(asks, ["doc_id", "place"], "left").withColumn("open", F.col("near").isNull()).drop("near"), "classed")
    twice = own.withColumn("g", F.col("k")).unionByName(own.withColumn("g", F.col("k") - 1))
    sizes = cut(twice.groupBy("t", "g").agg(F.count("*").alias("c"), F.max("open").alias("asked"), F.min("k").alias("least")).where("asked AND c > 1 AND least = g").drop("asked", "least"), "sizes")
    few = sizes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return cut(twice.join(F.broadcast(sizes) if few else sizes, ["t", "g"]), "by_length")


def frequent_matches(large: DataFrame, near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """doc_id and place of those lines of large (doc_id, place) not in near that are similar to an earlier one of them, by the order of counts among these lines."""
    lines = sets.join(_small(large), ["doc_id", "place"], "left_semi")
    held = _by_count(lines, percent, "named")
    placed = cut(_in_prefix(held).where(F.col("c") <= GROUP).join(sets.drop("tokens"), ["doc_id", "place"]), "rarer")
    other = placed.select("t", *_other())
    found = verified(placed.join(near, ["doc_id", "place"], "left_anti").join(other, "t").where(_earlier(F.col("d"), F.col("p"))), sets, percent)
    open_ = held.join(near, ["doc_id", "place"], "left_anti").join(found, ["doc_id", "place"], "left_anti").select("doc_id", "place", F.lit(True).alias("open"))
    f = F.sort_array(F.transform(F.filter("cs", lambda x: x["c"] > GROUP), lambda x: x["t"]))
    most = held.where(F.get("cs", F.col("k") - 1)["c"] > GROUP).select("doc_id", "place", "n", f.alias("f")).withColumn("h", F.xxhash64("n", "f"))
    most = cut(most.join(open_, ["doc_id", "place"], "left"), "most")
    total = most.count()
    if not total:
        return found
    kinds = most.groupBy("h").agg(F.min(F.struct("doc_id", "place")).alias("l"), F.first("n").alias("n"), F.first("f").alias("f"), F.count("*").alias("c"), F.count("open").alias("asking"))
    kinds = cut(kinds.select("h", "l.*", "n", "f", "c", (F.col("asking") > 0).alias("asks")), "kinds")
    firsts = cut(alike_kinds(kinds.drop("c"), percent), "firsts").join(kinds.select("h", "c"), "h")
    both = spread_join(most.where("open").select("doc_id", "place", "h"), firsts, "h", "c", total, F.xxhash64("doc_id", "place"))
    return found.unionByName(both.where(_earlier(F.col("d"), F.col("p"))).select("doc_id", "place"))


def _placed(docs: DataFrame, tokens: DataFrame, width: int, repeats: bool) -> tuple[DataFrame, DataFrame]:
    """Tokens (doc_id, place, t) of two classes or more, with their count c, the class's size n, bits and half; and the classes' full sets."""
    shared = cut(tokens.groupBy("t").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    n_shared = shared.count()
    members = cut(tokens.join(F.broadcast(shared) if n_shared <= BROADCAST_TOKENS else shared, "t"), "members")
    sets = cut(_sets(docs, members.select("doc_id", "place").distinct(), width, repeats), "sets")
    placed = cut(members.join(sets.drop("tokens"), ["doc_id", "place"]), "placed")
    return placed, sets


def matched(docs: DataFrame, firsts: DataFrame, width: int, percent: int, repeats: bool) -> DataFrame:
    """doc_id and place of those classes (doc_id, place, prefix) that an earlier one is similar to."""
    tokens = firsts.where("prefix IS NOT NULL").select("doc_id", "place", F.explode("prefix").alias("t"))
    passing: list[str] = []  # tables that placed is made of, deleted when it has been written
    with recorded(passing):
        placed, sets = _placed(docs, tokens, width, repeats)
    release(docs.sparkSession, passing, placed, sets)
    head = placed.groupBy("t").agg(F.min(F.struct("doc_id", "place", "n", "bits", "half")).alias("f")).select("t", *_other("f."))
    linked = placed.join(head, "t").where(_earlier(F.col("d"), F.col("p")))
    near = verified(linked, sets, percent)
    open_ = placed.join(_small(near), ["doc_id", "place"], "left_anti")
    small = F.col("c").between(3, GROUP)
    other = placed.where(small).select("t", *_other())
    pairs = open_.where(small).join(other, "t").where(_earlier(F.col("d"), F.col("p"))).drop("t", "c")
    large = placed.where(F.col("c") > GROUP)
    if large.isEmpty():
        return near.unionByName(verified(pairs, sets, percent)).distinct()
    dealt = by_length(large, near, percent)
    few = F.col("c") <= GROUP * BY_LENGTH
    other = dealt.where(few).select("t", "g", F.col("k").alias("j"), *_other())
    met = dealt.where(few & F.col("open")).join(other, ["t", "g"]).where(_earlier(F.col("d"), F.col("p")) & ((F.col("k") == F.col("g")) | (F.col("j") == F.col("g"))))
    near = near.unionByName(verified(pairs.unionByName(met.select(pairs.columns)), sets, percent))
    larger = cut(dealt.where(~few).select("doc_id", "place").distinct(), "larger")
    if not larger.isEmpty():
        near = near.unionByName(frequent_matches(larger, near, sets, percent))
    return near.distinct()


def _no() -> Column:
    return F.col("place").bitwiseAND((1 << 32) - 1).cast("int")


def ledger(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, tag, n (lines with words) and kept: the numbers of those that stay, ascending; a row for each two values of docs."""
    lines = cut(prefixes(docs, width, percent), "lines")
    firsts = cut(lines.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "place", "prefix")).alias("l")).select("l.*"), "classes")
    of = F.col("doc_id"), F.shiftright("place", 32).alias("tag")
    repeats = not lines.where(_no() == 0).groupBy(*of).agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    kept = firsts.select("doc_id", "place").join(matched(docs, firsts, width, percent, repeats), ["doc_id", "place"], "left_anti")
    stay = kept.groupBy(*of).agg(F.array_sort(F.collect_list(_no())).alias("kept"))
    copies = F.count_if(_no() == 0)  # rows that repeat a doc_id and a text give every line again
    sizes = lines.groupBy(*of).agg((F.count("k1") / copies).cast("long").alias("n"))
    return sizes.join(stay, ["doc_id", "tag"], "left").select("doc_id", "tag", "n", F.coalesce("kept", F.array().cast("array<int>")).alias("kept"))


def _with_ledger(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """docs with _tm_n and _tm_kept of their texts, and _tm_null for a null doc_id."""
    kept = ledger(docs, width, percent).select(F.col("doc_id").alias("_tm_d"), F.col("tag").alias("_tm_t"), F.col("n").alias("_tm_n"), F.col("kept").alias("_tm_kept"))
    doc_id, text = column(docs, "doc_id"), column(docs, "text")
    tag = F.xxhash64(text).bitwiseAND((1 << 30) - 1) + F.when(doc_id.isNull(), F.lit(1 << 30)).otherwise(F.lit(0))
    keyed = docs.withColumns({"_tm_id": F.coalesce(doc_id.cast("long"), F.lit(LAST)), "_tm_tag": tag})
    return keyed.join(kept, (F.col("_tm_id") == F.col("_tm_d")) & (F.col("_tm_tag") == F.col("_tm_t")), "left")


def line_counts(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """A row per document: doc_id, n_lines (with words), n_removed and kept_lines (their numbers, from 0)."""
    both = _with_ledger(pick(docs, "doc_id", "text"), width, percent)
    return both.select("doc_id", F.col("_tm_n").alias("n_lines"), (F.col("_tm_n") - F.size("_tm_kept")).alias("n_removed"), F.col("_tm_kept").alias("kept_lines"))


def dedup_lines(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with later matches taken out of their texts; a text that only had such lines goes as a row."""
    both, text = _with_ledger(docs, width, percent), column(docs, "text")
    kept, fewer = F.col("_tm_kept"), F.size("_tm_kept") < F.col("_tm_n")
    blank = lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) == 0

    def rebuilt(lines: Column) -> Column:
        blanks = F.filter(F.transform(lines, lambda x, i: F.when(blank(x), i)), lambda i: i.isNotNull())
        return F.array_join(F.transform(F.array_sort(F.array_union(kept, blanks)), lambda i: F.get(lines, i)), "\n")

    left = F.when(fewer, let(F.split(text, "\n", -1), rebuilt)).otherwise(text)
    made = {"text": left} | ({"n_chars": F.when(fewer, F.length(left).cast("long")).otherwise(column(docs, "n_chars"))} if "n_chars" in docs.columns else {})
    return both.where((F.size("_tm_kept") > 0) | (F.col("_tm_n") == 0)).select(*[made.get(c, column(docs, c)).alias(c) for c in docs.columns])
