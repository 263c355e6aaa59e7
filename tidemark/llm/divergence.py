"""Operator 12, source divergence audit: how far the sources of a language differ in their words, by hash-consed segment trees.

Terms are runs of letters (A-Z folded) and of anything outside ASCII. A language keeps the terms that at least 30 of its
documents have. A group is a (lang, source); its share of a term is the integer p = 1 + floor(10^9 (count + 5) / (N + 5 V)),
N the group's occurrences of kept terms and V their number. Two sources differ by the sum of |p - q| over all kept terms, and a
source's own terms are those whose p is greater than the language's.

The kept terms of a language are dealt by hash into 2^k blocks of about BLOCK terms, the subtrees below the top of its segment
tree. A block's leaves are the groups' counts in term order. Its trees are built for all groups at once, level by level, and
equal pairs of children make one node, so that equal count subtrees are shared by groups and by places. A group's tree is then
walked along with those of others from the root down; pairs of nodes that are met again (the same two sources, the same two
nodes) are merged with the number of times they stand for, so that each is priced once, and equal nodes of groups with equal N
cost nothing and go. Prices of blocks add up to those of the sources.

Spark deals out the blocks and, for languages of many sources, tiles of TILE by TILE sources of a block; a task holds one
tile of one block. Documents are counted in one scan, summed within each task before the shuffle. All arithmetic is in integers.

Defined cases: null text, lang or source is ''. A source without terms has p of count 0 and N = 0; where V is 0 all values are
0. Ties of value go by the item's UTF-8 bytes. Repeated rows count each. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, cut

LEAST_DOCS = 30
BLOCK = 2048  # terms of a block, about
TILE = 64  # sources of a tile's side, about
PIECE = 1 << 22  # bytes of text that are counted at a time, which bounds what counting holds, whatever the texts
COUNTS = "lang string, source string, term string, n long, docs long"
#: bytes.translate table that folds A-Z and turns all of ASCII but letters into a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


def _counted(batches: Iterator) -> Iterator:
    """Occurrences and documents of each term by (lang, source), and a row without a term for each group, anew for each slice of PIECE bytes of text; nothing is held from one slice to the next."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < len(ends):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + PIECE, side="right")))
            lang, source, text = (batch.column(c).slice(at, stop - at).cast(pa.string()) for c in ("lang", "source", "text"))
            at = stop
            offsets = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset : text.offset + len(text) + 1]
            data = text.buffers()[2]
            letters = (data[int(offsets[0]) : int(offsets[-1])].to_pybytes() if data else b"").translate(LETTERS)
            lists = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(text), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(letters)))
            words, doc = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
            real = pc.not_equal(pc.binary_length(words), 0)
            words, doc = words.filter(real).dictionary_encode(), doc[real.to_numpy(zero_copy_only=False)].astype(np.int64)
            langs, sources = lang.dictionary_encode(), source.dictionary_encode()
            group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            known = max(1, len(words.dictionary))
            key, times = np.unique(doc * known + words.indices.to_numpy(), return_counts=True)  # a document's terms
            key, of = np.unique(group[key // known] * known + key % known, return_inverse=True)
            n, docs = np.bincount(of, weights=times, minlength=len(key)).astype(np.int64), np.bincount(of, minlength=len(key))
            groups = np.unique(group)
            owner = np.concatenate([groups, key // known])
            zero = np.zeros(len(groups), dtype=np.int64)
            out = pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(owner // len(sources.dictionary))), sources.dictionary.take(pa.array(owner % len(sources.dictionary))), pa.concat_arrays([pa.nulls(len(groups), pa.string()), words.dictionary.take(pa.array(key % known))]), pa.array(np.concatenate([zero, n])), pa.array(np.concatenate([zero, docs]).astype(np.int64))],
                names=["lang", "source", "term", "n", "docs"],
            )
            for k in range(0, len(out), 50_000):
                yield out.slice(k, 50_000)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n and docs (documents that have it); term is null in one row of each group."""
    text = docs.select(*[F.coalesce(column(docs, c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return text.mapInArrow(_counted, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 v)), exact."""
    wide = "decimal(38,0)"
    return F.lit(1).cast("long") + F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * (n.cast("decimal(20,0)") + F.lit(5).cast("decimal(1,0)")), (total.cast("decimal(20,0)") + F.lit(5).cast("decimal(1,0)") * v.cast("decimal(12,0)")).cast(wide)).cast("long")


def shares(n: list[int], total: int, v: int) -> list[int]:
    return [1 + 1_000_000_000 * (x + 5) // (total + 5 * v) for x in n]


class Trees:
    """Hash-consed segment trees over rows of counts, one row a group; equal subtrees of one height are one node."""

    def __init__(self, counts, width: int):
        """counts: an array (groups, 2^k); places from width on are padding, which costs nothing."""
        import numpy as np

        self.values, ids = np.unique(counts, return_inverse=True)
        ids = ids.reshape(counts.shape)
        self.pad = len(self.values)
        ids[:, width:] = self.pad
        self.levels = []  # from the leaves' parents up: the children of each node
        known = self.pad + 1
        self.sizes = [known]
        while ids.shape[1] > 1:
            both, at = np.unique(ids[:, ::2].astype(np.int64) * known + ids[:, 1::2], return_inverse=True)
            self.levels.append((both // known, both % known))
            ids, known = at.reshape(ids.shape[0], -1), len(both)
            self.sizes.append(known)
        self.roots = ids[:, 0]

    def price(self, one: int, others, p, same) -> list[int]:
        """For each of others (rows) the sum of |p - q| over the leaves. p: (groups, values) prices; same: whether two groups' prices agree."""
        import numpy as np

        who = np.arange(len(others))
        x, y, times = np.full(len(others), self.roots[one]), self.roots[others], np.ones(len(others), dtype=np.int64)
        alike = same[one, others]
        for (left, right), known in zip(reversed(self.levels), reversed(self.sizes[:-1]), strict=True):
            go = ~(alike[who] & (x == y))
            who, x, y, times = who[go], x[go], y[go], times[go]
            key = (np.concatenate([who, who]) * known + np.concatenate([left[x], right[x]])) * known + np.concatenate([left[y], right[y]])
            key, at = np.unique(key, return_inverse=True)
            times = np.bincount(at, weights=np.concatenate([times, times]), minlength=len(key)).astype(np.int64)
            who, x, y = key // (known * known), key // known % known, key % known
        real = x != self.pad
        who, x, y, times = who[real], x[real], y[real], times[real]
        out = np.zeros(len(others), dtype=np.int64)
        np.add.at(out, who, times * np.abs(p[one, x] - p[np.asarray(others)[who], y]))
        return out.tolist()


def _tile_prices(key, rows):
    """Prices of one tile of one block: every pair of sources that meets here and nowhere else."""
    import numpy as np
    import pyarrow as pa

    low, high = key[2].as_py(), key[3].as_py()
    rows = rows.sort_by("source")
    names, total, tile = rows.column("source").to_pylist(), rows.column("total").to_numpy(), rows.column("tile").to_numpy()
    width, v = rows.column("width")[0].as_py(), rows.column("v")[0].as_py()
    places = 1
    while places < width:
        places *= 2
    counts = np.zeros((len(names), places), dtype=np.int64)
    for i, (ids, ns) in enumerate(zip(rows.column("ids"), rows.column("ns"), strict=True)):
        if ids.is_valid:
            counts[i, ids.values.to_numpy()] = ns.values.to_numpy()
    trees = Trees(counts, width)
    values = trees.values.tolist()
    p = np.array([shares(values, t, v) if v else [0] * len(values) for t in total.tolist()], dtype=np.int64)
    same = np.equal.outer(total, total)
    mine = np.flatnonzero(tile == low)
    theirs = mine if low == high else np.flatnonzero(tile == high)
    a, b, f = [], [], []
    for k, i in enumerate(mine.tolist()):
        others = theirs[k + 1 :] if low == high else theirs
        if len(others):
            a += [names[i]] * len(others)
            b += [names[j] for j in others.tolist()]
            f += trees.price(i, others, p, same)
    return pa.table({"lang": pa.array([key[0].as_py()] * len(a), type=pa.string()), "a": pa.array(a, type=pa.string()), "b": pa.array(b, type=pa.string()), "f": pa.array(f, type=pa.int64())})


def _ranked(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    return df.withColumn("rank", F.row_number().over(w))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = 50, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    counts = cut(term_counts(docs), "counts")
    vocabulary = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("all_total"))
    groups = counts.where("term IS NULL").select("lang", "source")
    langs = groups.groupBy("lang").agg(F.count("*").alias("n_sources")).join(sizes, "lang", "left")
    langs = langs.select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("all_total", F.lit(0)).alias("all_total"), F.expr(f"cast(ceil(n_sources / {tile}) AS int)").alias("tiles"), F.expr(f"cast(pow(2, ceil(log2(greatest(coalesce(v, 1) / {block}, 1)))) AS int)").alias("blocks"))
    langs = cut(langs, "langs")
    # A kept term's place: its block by hash, and its number within the block.
    at = vocabulary.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    kept = cut(at.withColumn("id", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1).drop("blocks", "tiles"), "kept")
    leaves = cut(counts.where("term IS NOT NULL").drop("docs").join(kept, ["lang", "term"]), "leaves")
    totals = leaves.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    known = groups.join(totals, ["lang", "source"], "left").join(langs, "lang")
    known = cut(known.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "v", "all_total", "blocks", "tiles", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("tile")), "groups")
    rows = known.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sparse = leaves.groupBy("lang", "source", "block").agg(F.collect_list(F.struct("id", "n")).alias("x"))  # a block's terms at most
    widths = kept.groupBy("lang", "block").agg(F.count("*").cast("int").alias("width"))
    rows = rows.join(sparse, ["lang", "source", "block"], "left").join(widths, ["lang", "block"], "left")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiles = rows.select("lang", "block", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "source", "total", "v", F.coalesce("width", F.lit(0)).alias("width"), F.col("x.id").alias("ids"), F.col("x.n").alias("ns"))
    priced = tiles.groupBy("lang", "block", "low", "high").applyInArrow(_tile_prices, "lang string, a string, b string, f long")
    pairs = cut(priced.groupBy("lang", "a", "b").agg(F.sum("f").alias("value")), "pairs")
    both = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    pair = _ranked(both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value"))
    f = share(F.col("n"), F.col("total"), F.col("v")) - share(F.col("all_n"), F.col("all_total"), F.col("v"))
    own = leaves.where("n > 0").join(known.select("lang", "source", "total"), ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), f.alias("value")).where("value > 0")
    return pair.unionByName(_ranked(own).where(F.col("rank") <= top))
