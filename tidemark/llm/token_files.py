"""Operator 4, token-id output: static range asymmetric numeral coding of token ids in independent interleaved blocks.

Documents are dealt out by ranges of doc_id and sorted; each range becomes a file. A file's rows are groups of blocks of
whole documents. A group holds the frequency table that its blocks share, quantised to 2**SCALE; a block holds the final
states of its lanes, one word stream, a checkpoint every CHECKPOINT steps (states and place in the stream,
so that decoding can begin there) and a crc32 of its ids. Blocks decode independently, in parallel and vectorised over
lanes; a block whose ids don't match its crc32 raises. Files are written by Spark's Parquet writer, so they can be in any
store, and a lost task is simply redone.

Defined cases: a null text is encoded as an empty one, which is the end id alone; a null doc_id sorts first; documents with
equal doc_ids keep a row each (ordered by the text's hash, then the text); an empty table makes files without blocks; other columns aren't read. The
text of an added token, such as an end marker, is that token where added is set, which is the library's default and what the
query asks for; else it is encoded like any other text.
"""

from __future__ import annotations

import re
import string
import zlib
from array import array

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, work_dir

SCALE = 20  # a table's frequencies add up to 2**SCALE
LANES = 4096
BLOCK_TOKENS = 1 << 20
GROUP_TOKENS = 1 << 22  # tokens held by a task until their table is made
CHECKPOINT = 128  # steps of LANES ids
END_ID = 0
PUNCTUATION = string.punctuation
WIDE = re.compile(r" \s")
LOW = 1 << 31
BLOCK = "n_tokens:bigint,doc_ids:array<bigint>,doc_tokens:array<int>,states:binary,words:binary,marks:binary,crc32:bigint"
FORMAT = f"file int, part int, first_token long, n_tokens long, table_ids binary, table_freqs binary, blocks array<struct<{BLOCK}>>"


def quantise(counts, scale: int = SCALE):
    """Frequencies of at least 1 for every id that occurs, adding up to 2**scale; deterministic."""
    import numpy as np

    total, size = int(counts.sum()), 1 << scale
    if len(counts) > size:
        raise ValueError("more ids than slots")
    f = np.maximum(1, counts.astype(np.float64) * size // total).astype(np.int64)
    over = int(f.sum()) - size
    order = np.argsort(-f, kind="stable")
    while over > 0:  # many rare ids were raised to 1: take it from the frequent ones in proportion
        room = f[order] - 1
        take = np.minimum(room, np.maximum(1, room * over // max(1, int(room.sum()))))
        reach = np.searchsorted(np.cumsum(take), over, side="right")
        take[reach + 1 :] = 0
        if reach < len(take):
            take[reach] = over - int(take[:reach].sum())
        f[order] -= take
        over = int(f.sum()) - size
    f[order[0]] -= over
    return f


def encode_block(symbols, freqs, starts, lanes: int = LANES, every: int = CHECKPOINT):
    """(states, words, marks) for symbols, which index freqs. marks: per checkpoint its step, word offset and lane states."""
    import numpy as np

    n, steps = len(symbols), -(-len(symbols) // lanes)
    x = np.full(min(lanes, max(n, 1)), LOW, dtype=np.uint64)
    lane_f, lane_c = freqs[symbols], starts[symbols]
    chunks, marks, scale, top = [], [], np.uint64(SCALE), np.uint64(63 - SCALE)
    for t in range(steps - 1, -1, -1):
        f, c = lane_f[t * lanes : (t + 1) * lanes], lane_c[t * lanes : (t + 1) * lanes]
        y = x[: len(f)]
        full = y >= (f << top)
        if full.any():
            chunks.append((y[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            y[full] >>= np.uint64(32)
        q = y // f
        y[:] = (q << scale) + (y - q * f) + c
        if t and t % every == 0:
            marks.append((t, sum(map(len, chunks)), x.copy()))
    words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, "<u4")
    packed = b"".join(np.array([t, len(words) - behind], "<u8").tobytes() + s.astype("<u8").tobytes() for t, behind, s in reversed(marks))
    return x.astype("<u8").tobytes(), words.tobytes(), packed


def decode_steps(states, words, n: int, freqs, starts, symbol_of, lanes: int = LANES, at: int = 0, until: int | None = None, offset: int = 0):
    """Symbols of steps at to until (exclusive), from the lane states and word offset that hold at step at."""
    import numpy as np

    steps = -(-n // lanes)
    until = steps if until is None else min(until, steps)
    x, out = states.astype(np.uint64), np.empty(min(until * lanes, n) - at * lanes, dtype=np.int64)
    mask, scale, low = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(LOW)
    for t in range(at, until):
        y = x[: min(lanes, n - t * lanes)]
        slot = y & mask
        s = symbol_of[slot.astype(np.int64)]
        y[:] = freqs[s] * (y >> scale) + slot - starts[s]
        need = y < low
        k = int(need.sum())
        if k:
            y[need] = (y[need] << np.uint64(32)) | words[offset : offset + k]
            offset += k
        out[(t - at) * lanes : (t - at) * lanes + len(y)] = s
    return out


class Table:
    """A group's shared table: ids that occur, their frequencies, starts and slots."""

    def __init__(self, ids, freqs):
        import numpy as np

        self.ids, self.freqs = ids, freqs.astype(np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(freqs)[:-1]]).astype(np.uint64)
        self.symbol_of = np.repeat(np.arange(len(ids), dtype=np.int32), freqs.astype(np.int64))


def decode_ids(row: dict, table: Table, part: int | None = None):
    """ids of a block; part: only those from that checkpoint to the next (0: from the start)."""
    import numpy as np

    n, states, words = row["n_tokens"], np.frombuffer(row["states"], "<u8"), np.frombuffer(row["words"], "<u4")
    if part is None:
        ids = table.ids[decode_steps(states, words, n, table.freqs, table.starts, table.symbol_of)].astype("<u4")
        if zlib.crc32(ids.tobytes()) != row["crc32"]:
            raise ValueError(f"block of documents {row['doc_ids'][:1]}: checksum of the ids doesn't match")
        return ids
    size = 8 * (2 + len(states))
    marks = [np.frombuffer(row["marks"][i : i + size], "<u8") for i in range(0, len(row["marks"]), size)]
    at, offset, states = (0, 0, states) if part == 0 else (int(marks[part - 1][0]), int(marks[part - 1][1]), marks[part - 1][2:])
    until = int(marks[part][0]) if part < len(marks) else None
    return table.ids[decode_steps(states, words, n, table.freqs, table.starts, table.symbol_of, at=at, until=until, offset=offset)].astype("<u4")


class Chunks(dict):
    """ids of text chunks as bytes, by the chunk without its leading space. A chunk begins at a space before a non-space, where
    the pre-tokenizer always cuts, so chunks can be encoded apart; each is encoded by the library once while it is remembered.

    The pre-tokenizer also parts letters, the punctuation after them and a line feed before letters. A chunk of these alone, in
    ASCII and without an apostrophe, is encoded by parts, so that a word is remembered whatever follows it."""

    def __init__(self, path: str, added: bool = False, most: int = 600_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.merged = self.tokenizer.model.tokenize
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.most, self.old, self.starts, self.marks = most, {}, {}, {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def letters(self, pretoken: str) -> bytes:
        """One pre-token of ASCII letters, a space before them written as the byte-level alphabet does: the model's merges alone."""
        return array("I", [t.id for t in self.merged(pretoken)]).tobytes()

    def _kept(self, known: dict, key: str, make) -> bytes:
        if key not in known:
            if len(known) >= self.most // 4:
                known.clear()
            known[key] = make(key)
        return known[key]

    def _parts(self, chunk: str) -> bytes | None:
        out = []
        for i, line in enumerate(chunk.split("\n")):
            stem = line.rstrip(PUNCTUATION)
            if not stem.isalpha():
                return None
            if i:
                out.append(self._kept(self.marks, "\n", self.whole))
                out.append(self._kept(self.starts, stem, self.letters))
            else:
                out.append(self[stem] if len(stem) < len(chunk) else self.letters("\u0120" + stem))
            if len(stem) < len(line):
                out.append(self._kept(self.marks, line[len(stem) :], self.whole))
        return b"".join(out)

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.most:  # two generations: what is in use moves on, the rest is forgotten
            self.old = dict(self)
            self.clear()
        ids = self.old.get(chunk)
        if ids is None and chunk.isascii() and "'" not in chunk:
            ids = self._parts(chunk)
        if ids is None:
            ids = self.whole(" " + chunk)
        if len(chunk) < 256:  # so that the memory has a bound
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(t in text for t in self.added):
            return self.whole(text)
        if text[-1] == " " or WIDE.search(text):
            return self.whole(text)  # runs of spaces: their cut depends on what follows
        first, *rest = text.split(" ")
        return self.whole(first) + b"".join(map(self.__getitem__, rest))


_CHUNKS: dict[tuple[str, bool], Chunks] = {}


def chunks_for(path: str, added: bool = False) -> Chunks:
    """One for each worker process, tokenizer file and reading of added tokens."""
    if (path, added) not in _CHUNKS:
        _CHUNKS[path, added] = Chunks(path, added)
    return _CHUNKS[path, added]


def write_tokens(docs: DataFrame, tokenizer_path: str, out: str, added: bool = False) -> None:
    """Encodes all documents and writes the files under out, in ascending doc_id order."""

    def encode(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        chunks, file, end = chunks_for(tokenizer_path, added), TaskContext.get().partitionId(), np.array([END_ID], "<u4").tobytes()
        ids, raw, held, part, first = [], [], 0, 0, 0
        one = pa.struct([("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int32())), ("states", pa.binary()), ("words", pa.binary()), ("marks", pa.binary()), ("crc32", pa.int64())])
        schema = pa.schema([("file", pa.int32()), ("part", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("table_ids", pa.binary()), ("table_freqs", pa.binary()), ("blocks", pa.list_(one))])

        def flush():
            nonlocal ids, raw, held, part, first
            if not ids:
                return
            tokens = np.frombuffer(b"".join(raw), "<u4")
            counts = np.bincount(tokens)
            known = np.flatnonzero(counts)
            table = Table(known.astype("<u4"), quantise(counts[known]))
            index = np.zeros(len(counts), dtype=np.int64)
            index[known] = np.arange(len(known))
            ends = np.cumsum([len(x) // 4 for x in raw])
            blocks, at, d = [], 0, 0
            while d < len(ids):
                e = max(d + 1, int(np.searchsorted(ends, at + BLOCK_TOKENS, side="right")))
                mine = tokens[at : ends[e - 1]]
                states, words, marks = encode_block(index[mine], table.freqs, table.starts)
                blocks.append({"n_tokens": len(mine), "doc_ids": ids[d:e], "doc_tokens": np.diff(ends[d:e], prepend=at).tolist(), "states": states, "words": words, "marks": marks, "crc32": zlib.crc32(mine.tobytes())})
                at, d = int(ends[e - 1]), e
            row = {"file": file, "part": part, "first_token": first, "n_tokens": len(tokens), "table_ids": table.ids.tobytes(), "table_freqs": table.freqs.astype("<u4").tobytes(), "blocks": blocks}
            part, first, ids, raw, held = part + 1, first + len(tokens), [], [], 0
            yield pa.RecordBatch.from_pylist([row], schema=schema)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = chunks.encode(text or "") + end
                ids.append(doc_id)
                raw.append(got)
                held += len(got) // 4
                if held >= GROUP_TOKENS:
                    yield from flush()
        yield from flush()

    # The text's hash parts rows that share a doc_id, or have none, so that many of them don't have to be one task and one file.
    place = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    ordered = pick(docs, "doc_id", "text").repartitionByRange(*place[:2]).sortWithinPartitions(*place)
    ordered.mapInArrow(encode, FORMAT).write.parquet(out)


def read_tokens(spark: SparkSession, path: str, outputs: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids")) -> DataFrame:
    """A row per document from the files: doc_id, start, n_tokens, ids (array of int) or ids_crc32, as asked for."""
    blocks = spark.read.schema(FORMAT).parquet(path)
    # A file's tokens before it: one number a file, so the driver holds as many as there are files.
    sizes = {r["file"]: r["n"] for r in blocks.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect()}
    offsets, run = {}, 0
    for f in sorted(sizes):
        offsets[f], run = run, run + sizes[f]
    kinds = {"doc_id": "long", "start": "long", "n_tokens": "long", "ids": "array<int>", "ids_crc32": "long"}

    def decode(batches):
        import numpy as np
        import pyarrow as pa

        types = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_crc32": pa.int64()}
        for b in batches:
            for group in b.to_pylist():
                table = Table(np.frombuffer(group["table_ids"], "<u4"), np.frombuffer(group["table_freqs"], "<u4"))
                first = offsets[group["file"]] + group["first_token"]
                for block in group["blocks"]:
                    ids = decode_ids(block, table)
                    n = np.array(block["doc_tokens"], dtype=np.int64)
                    begin = np.cumsum(n) - n
                    made = {"doc_id": block["doc_ids"], "start": begin + first, "n_tokens": n}
                    first += len(ids)
                    if "ids_crc32" in outputs:
                        made["ids_crc32"] = [zlib.crc32(ids[a : a + k].tobytes()) for a, k in zip(begin, n, strict=True)]
                    if "ids" in outputs:
                        made["ids"] = pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([x if isinstance(x := made[c], pa.Array) else pa.array(x, type=types[c]) for c in outputs], names=list(outputs))

    return blocks.mapInArrow(decode, ", ".join(f"{c} {kinds[c]}" for c in outputs))


def tokenize_to_files(docs: DataFrame, tokenizer_path: str, out: str | None = None, outputs: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids_crc32"), added: bool = False) -> DataFrame:
    """Writes the files (to the shared folder unless out says where) and reads them back."""
    out = out or f"{work_dir(docs.sparkSession)}/tokens"
    write_tokens(docs, tokenizer_path, out, added)
    return read_tokens(docs.sparkSession, out, outputs)
