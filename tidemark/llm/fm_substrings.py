"""Operator 5, substring dedup: a compressed FM-index per shard, searched backwards for streamed fragments.

A window is `width` consecutive words. Shards are cut by content, not by document, so that a window is looked for in one
shard only, however many there are: each window is dealt out by its minimiser, the least hash of its GRAM-word runs, and
consecutive windows with one minimiser travel as a fragment.

1. Every document gives its fragments as (minimiser, hash of the fragment, doc_id, place). Minimisers that only one
   document has are done: their windows are unique. Aggregation and a join find the others; no words move yet.
2. Equal fragments are one from here on, with their least doc_id; one document of each sends its words.
3. Each shard concatenates its fragments, orders their suffixes to 16 words by prefix doubling, and keeps the transform in a
   wavelet matrix of packed bits with block ranks. All windows of the shard's fragments are searched backwards together;
   the steps taken while an interval still holds two suffixes are the matching statistics, and intervals at full width
   yield the least doc_id of their suffixes' documents.
   A minimiser whose distinct fragments hold over HOT_WORDS words, such as a phrase with ever other words around it, has no
   shard: its fragments are recut, in the documents that have some, to single windows, which an aggregation compares by their hashes, however many there are.
4. Windows found in a smaller doc_id go back to their documents, which drop the words they cover.

Words are compared by 64-bit hashes. Defined cases: a null or empty text has no words; fewer words than the width make no
window; rows with a null doc_id neither remove nor lose words; rows with equal doc_ids don't affect one another, and repeated
rows get a row each; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, cut, finalize, hash_words, window_hashes

GRAM = 4
DEPTH = 16  # words to which suffixes are ordered; no pattern may be longer
SHARD_WORDS = 1 << 19  # words of one index; a task builds as many as its fragments need
HOT_WORDS = 1 << 17  # words of a minimiser's distinct fragments that a shard takes; so a shard has a bound
MOST_WINDOWS = 64  # of a fragment, so that a long says which of them are found
BROADCAST_ROWS, BROADCAST_ITEMS = 300_000, 6_000_000  # of 16 bytes an item at most
TAG = (1 << 24) - 1  # bits of a text's hash that tell rows of one doc_id apart

_KNOWN = WordHashes()


def fragments(h, width: int):
    """(minimiser, start, length in words) of a text's word hashes: runs of windows whose minimisers are equal, MOST_WINDOWS at most."""
    import numpy as np

    n = len(h) - width + 1
    if n <= 0:
        return None
    gram = min(GRAM, width)
    g = window_hashes(h, gram)
    best, span = g, 1
    want = width - gram + 1
    while span * 2 <= want:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < want:
        best = np.minimum(best[: span - want], best[want - span :])
    new = np.concatenate([[True], best[1:] != best[:-1]])
    begin = np.flatnonzero(new)
    new[(np.arange(n) - np.repeat(begin, np.diff(begin, append=n))) % MOST_WINDOWS == 0] = True
    first = np.flatnonzero(new)
    return best[first], first, np.diff(first, append=n) + width - 1


def minimisers(h, start, width: int):
    """Minimisers of the windows that begin at start."""
    import numpy as np

    gram = min(GRAM, width)
    g = window_hashes(h, gram)
    return np.minimum.reduce([g[start + k] for k in range(width - gram + 1)])


def fragment_hashes(h, start, length):
    """Hashes of the fragments' word sequences, from sums of words times powers of a constant."""
    import numpy as np

    with np.errstate(over="ignore"):
        p = np.full(len(h) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64)
        p[0] = 1
        p = np.cumprod(p)
        inverse = np.full(len(h) + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), dtype=np.uint64)
        inverse[0] = 1
        inverse = np.cumprod(inverse)
        s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(finalize(h.copy()) * p[:-1])])
        return finalize((s[start + length] - s[start]) * inverse[start] + length.astype(np.uint64))


class WaveletMatrix:
    """Rank of any symbol over a sequence, from one packed bit row with block counts for each bit of the alphabet."""

    def __init__(self, symbols, bits: int):
        import numpy as np

        self.bits, self.rows, self.n = bits, [], len(symbols)
        s = symbols
        for level in range(bits - 1, -1, -1):
            b = (s >> level & 1).astype(bool)
            packed = np.zeros((-(-(len(b) + 1) // 64)) * 8, dtype=np.uint8)
            raw = np.packbits(b, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view("<u8")
            ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
            zeros = int(len(b) - b.sum())
            self.rows.append((words, ranks, zeros))
            s = np.concatenate([s[~b], s[b]])
        every = np.arange(int(symbols.max(initial=0)) + 1)
        self.begin = self.place(every, np.zeros_like(every))  # where a symbol's run begins; the same for every rank of it

    def rank(self, symbol, i):
        """How often symbol[k], one of the sequence, stands before place i[k]; vectorised."""
        return self.place(symbol, i) - self.begin[symbol]

    def place(self, symbol, i):
        """Where place i[k] comes to lie below all bits of symbol[k]."""
        import numpy as np

        for (words, ranks, zeros), level in zip(self.rows, range(self.bits - 1, -1, -1), strict=True):
            one = (symbol >> level & 1).astype(bool)
            for_i = ranks[i >> 6] + np.bitwise_count(words[i >> 6] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where(one, zeros + for_i, i - for_i)
        return i


class FMIndex:
    """Backward search over concatenated fragments; suffixes are ordered to DEPTH words."""

    def __init__(self, text):
        """text: symbols from 1; 0 ends a fragment."""
        import numpy as np

        n = len(text)
        rank, step = text.astype(np.int64), 1
        while step < DEPTH:
            after = np.concatenate([rank[step:] + 1, np.zeros(min(step, n), dtype=np.int64)])[:n]
            key = rank * (n + int(rank.max(initial=0)) + 2) + after
            order = np.argsort(key)
            s = key[order]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], (s[1:] != s[:-1]).astype(np.int64)]))
            step *= 2
        self.order = order
        counts = np.bincount(text)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.wavelet = WaveletMatrix(text[order - 1], max(1, int(len(counts) - 1).bit_length()))

    def matching(self, text, ends, width: int):
        """(length, low, high) for patterns of width symbols that end at ends (inclusive): how far back an interval of two suffixes or more holds, and the last interval."""
        import numpy as np

        s = text[ends]
        low, high, length = self.before[s].copy(), self.before[s + 1].copy(), np.ones(len(ends), dtype=np.int64)
        live = np.flatnonzero(high - low > 1)
        length[high - low <= 1] = 0
        for k in range(1, width):
            s = text[ends[live] - k]
            both = self.wavelet.rank(np.concatenate([s, s]), np.concatenate([low[live], high[live]]))
            lo, hi = self.before[s] + both[: len(live)], self.before[s] + both[len(live) :]
            good = hi - lo > 1
            live = live[good]
            low[live], high[live] = lo[good], hi[good]
            length[live] = k + 1
            if not len(live):
                break
        return length, low, high


def search(rows: list[tuple], width: int):
    """For fragments (words as uint64 array, least doc_id) the least doc_id of each window: (offsets, values)."""
    import numpy as np

    lens = np.array([len(w) for w, _ in rows])
    words, text = np.unique(np.concatenate([w for w, _ in rows]), return_inverse=True)
    ends = np.cumsum(lens + 1)
    full = np.zeros(int(ends[-1]), dtype=np.int64)
    place = np.arange(len(text)) + np.repeat(np.arange(len(rows)), lens)
    full[place] = text + 1
    owner = np.repeat(np.array([d for _, d in rows], dtype=np.int64), lens + 1)
    index = FMIndex(full)
    windows = lens - width + 1
    first = np.cumsum(windows) - windows
    at = np.repeat(ends - lens - 1, windows) + np.arange(int(windows.sum())) - np.repeat(first, windows)
    length, low, high = index.matching(full, at + width - 1, width)
    found = np.flatnonzero(length >= width)
    out = np.repeat(np.array([d for _, d in rows], dtype=np.int64), windows)
    if len(found):
        lows, inverse = np.unique(low[found], return_inverse=True)
        highs = np.zeros(len(lows), dtype=np.int64)
        highs[inverse] = high[found]
        docs = owner[index.order]
        bounds = np.stack([lows, highs], axis=1).ravel()
        docs = np.append(docs, np.iinfo(np.int64).max)
        out[found] = np.minimum.reduceat(docs, bounds)[::2][inverse]
    return np.append(first, len(out)), out


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("binary").alias("text"), F.xxhash64(docs["text"]).bitwiseAND(TAG).alias("tag"))


def shared_fragments(docs: DataFrame, width: int) -> DataFrame:
    """mini, frag, doc_id, place (start, length and tag packed) of fragments whose minimiser two doc_ids or more have."""

    def apply(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            out = [[], [], [], []]
            for doc_id, text, tag in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                h = hash_words((text or b"").split(), _KNOWN)
                got = fragments(h, width)
                if got is None:
                    continue
                mini, start, length = got
                out[0].append(mini.view(np.int64) >> np.int64(16))  # 48 bits are enough to deal out; equality is judged later
                out[1].append(fragment_hashes(h, start, length).view(np.int64))
                out[2].append(np.full(len(start), doc_id, dtype=np.int64))
                out[3].append((start << 32 | length << 24 | tag).astype(np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["mini", "frag", "doc_id", "place"])

    rows = cut(_rows(docs).where("doc_id IS NOT NULL").mapInArrow(apply, "mini long, frag long, doc_id long, place long"), "fragments")
    # Written, so that the join below has plain shuffles on both sides, whose hot partitions can be split.
    several = cut(rows.groupBy("mini").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")).where("d0 < d1").select("mini"), "several")
    return cut(rows.join(several, "mini"), "shared")


def hot_minimisers(one: DataFrame) -> list[int]:
    """Minimisers of distinct fragments (mini, frag, at) with over HOT_WORDS words: as many as the corpus has words by HOT_WORDS at most."""
    words = F.sum(F.shiftright("at.place", 24).bitwiseAND(255))
    return [r["mini"] for r in one.groupBy("mini").agg(words.alias("w")).where(F.col("w") > HOT_WORDS).select("mini").collect()]


def holders(docs: DataFrame, fragments: DataFrame) -> DataFrame:
    """doc_id, text and tag of the documents that have some of the fragments (doc_id, place); no others need to be cut again."""
    have = cut(fragments.select(F.col("doc_id").alias("d"), F.col("place").bitwiseAND(TAG).alias("t")).distinct(), "holders")
    few = have.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return _rows(docs).join(F.broadcast(have) if few else have, (F.col("doc_id") == F.col("d")) & (F.col("tag") == F.col("t")), "left_semi")


def single_windows(rows: DataFrame, hot: list[int], width: int) -> DataFrame:
    """mini, frag, doc_id and place like shared_fragments, of the hot minimisers' windows in rows (doc_id, text, tag), each a fragment of its own."""
    import numpy as np

    known = rows.sparkSession.sparkContext.broadcast(np.sort(np.array(hot, dtype=np.int64)))

    def apply(batches):
        import pyarrow as pa

        for b in batches:
            out = [[], [], [], []]
            for doc_id, text, tag in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                h = hash_words((text or b"").split(), _KNOWN)
                got = fragments(h, width)
                if got is None:
                    continue
                mini, start, length = got
                mini = mini.view(np.int64) >> np.int64(16)
                windows = length - width + 1
                mine = np.flatnonzero(np.repeat(np.isin(mini, known.value), windows))  # windows follow one another over the fragments
                out[0].append(np.repeat(mini, windows)[mine])
                out[1].append(window_hashes(h, width)[mine].view(np.int64))
                out[2].append(np.full(len(mine), doc_id, dtype=np.int64))
                out[3].append((mine << 32 | width << 24 | tag).astype(np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["mini", "frag", "doc_id", "place"])

    return cut(rows.mapInArrow(apply, "mini long, frag long, doc_id long, place long"), "single")


def _with_list(docs: DataFrame, lists: DataFrame, how: str, column: str) -> DataFrame:
    """docs joined with lists (d, t, column) by doc_id and tag; broadcast while rows and items of the lists are within bounds."""
    n, items = lists.agg(F.count("*"), F.sum(F.size(column))).first()
    few = n <= BROADCAST_ROWS and (items or 0) <= BROADCAST_ITEMS
    return _rows(docs).join(F.broadcast(lists) if few else lists, (F.col("doc_id") == F.col("d")) & (F.col("tag") == F.col("t")), how)


def earliest(docs: DataFrame, one: DataFrame, width: int) -> DataFrame:
    """mini, frag and least: the least doc_id of each of the windows of fragments (mini, frag, at), by backward search in their shards."""
    lists = cut(one.groupBy(F.col("at.doc_id").alias("d"), F.col("at.place").bitwiseAND(TAG).alias("t")).agg(F.collect_list(F.shiftright("at.place", 24)).alias("want")), "wanted")

    def send(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                h = hash_words(text.split(), _KNOWN)
                # another text of this doc_id and tag has other fragments; what doesn't fit in this one is left out
                place = want.values.to_numpy()
                start, length = place >> 8, place & 255
                fits = start + length <= len(h)
                start, length = start[fits], length[fits]
                if not len(start):
                    continue
                mini, frag = minimisers(h, start, width), fragment_hashes(h, start, length)
                at = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
                for o, v in zip(out, (mini.view(np.int64) >> np.int64(16), frag.view(np.int64), np.full(len(start), doc_id, dtype=np.int64), h[at], length), strict=True):
                    o.append(v)
            if out[0]:
                ends = np.cumsum(np.concatenate(out[4])) * 8
                words = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(np.concatenate(out[3]))])
                yield pa.RecordBatch.from_arrays([*[pa.array(np.concatenate(x)) for x in out[:3]], words], names=["mini", "frag", "least", "words"])

    sent = _with_list(docs, lists, "inner", "want").select("doc_id", "text", "want").mapInArrow(send, "mini long, frag long, least long, words binary")

    def look(batches):
        import numpy as np
        import pyarrow as pa

        held: list[tuple] = []
        size, last = 0, None

        def done():
            offsets, found = search([(w, d) for _, _, d, w in held], width)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found))], names=["mini", "frag", "least"])

        for b in batches:
            for mini, frag, least, words in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                if size >= SHARD_WORDS and mini != last:
                    yield done()
                    held, size = [], 0
                held.append((mini, frag, least, np.frombuffer(words, np.uint64)))
                size, last = size + len(words) // 8, mini
        if held:
            yield done()

    return sent.repartition(F.col("mini")).sortWithinPartitions("mini", "frag").mapInArrow(look, "mini long, frag long, least array<long>")


KINDS = {"doc_id": "long", "n_words": "long", "n_removed": "long", "kept": "string", "kept_sha256": "string", "intervals": "array<array<int>>"}


def dedup_substrings(docs: DataFrame, width: int = 13, outputs: tuple[str, ...] = ("doc_id", "n_words", "n_removed", "kept", "intervals")) -> DataFrame:
    """A row per document: words, words removed, and the kept words joined by a space, their sha256, or the intervals [from, to) removed."""
    if not 1 <= width <= DEPTH:
        raise ValueError(f"width must be from 1 to {DEPTH}")
    shared = shared_fragments(docs, width)
    one = cut(shared.groupBy("mini", "frag").agg(F.min(F.struct("doc_id", "place")).alias("at")), "distinct")
    hot = hot_minimisers(one)
    if hot:
        spread = F.broadcast(docs.sparkSession.createDataFrame([(m,) for m in hot], "mini long"))
        single = single_windows(holders(docs, shared.join(spread, "mini")), hot, width)
        shared, one = shared.join(spread, "mini", "left_anti").unionByName(single), one.join(spread, "mini", "left_anti")
    found = earliest(docs, one, width)
    if hot:
        found = found.unionByName(single.groupBy("mini", "frag").agg(F.array(F.min("doc_id")).alias("least")))
    found = cut(found, "earliest")
    # bit i of the mask: window i of the fragment starts in a smaller doc_id
    mask = F.aggregate(F.transform("least", lambda m, i: F.when(m < F.col("doc_id"), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    hits = shared.join(found, ["mini", "frag"]).select(F.col("doc_id").alias("d"), F.col("place").bitwiseAND(TAG).alias("t"), F.shiftright("place", 32).cast("int").alias("s"), mask.alias("m")).where("m != 0")
    lists = cut(hits.groupBy("d", "t").agg(F.collect_set(F.struct("s", "m")).alias("w")), "hits")

    def apply(batches):
        import numpy as np
        import pyarrow as pa

        types = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string(), "kept_sha256": pa.string(), "intervals": pa.list_(pa.list_(pa.int32()))}
        for b in batches:
            made: dict = {c: [] for c in outputs}
            for doc_id, text, hit in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                words, n, spans = (text or b"").split(), 0, ()
                total = len(words)
                if hit.is_valid:
                    edge = np.zeros(total + 1, dtype=np.int32)
                    start, found = (hit.values.field(i).to_numpy() for i in (0, 1))
                    which, bit = np.nonzero(found.view(np.uint64)[:, None] >> np.arange(MOST_WINDOWS, dtype=np.uint64) & np.uint64(1))
                    s = np.unique(start[which].astype(np.int64) + bit)
                    edge[s] += 1
                    edge[s + width] -= 1
                    gone = np.cumsum(edge[:-1]) > 0
                    n = int(gone.sum())
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    spans = turn.reshape(-1, 2).tolist()
                    words = [words[i] for i in np.flatnonzero(~gone)]
                kept = b" ".join(words)
                for c, v in (("doc_id", doc_id), ("n_words", total), ("n_removed", n), ("intervals", spans)):
                    if c in made:
                        made[c].append(v)
                if "kept" in made:
                    made["kept"].append(kept.decode("utf-8", "replace"))
                if "kept_sha256" in made:
                    made["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(made[c], type=types[c]) for c in outputs], names=list(outputs))

    return _with_list(docs, lists, "left", "w").select("doc_id", "text", "w").mapInArrow(apply, ", ".join(f"{c} {KINDS[c]}" for c in outputs))
