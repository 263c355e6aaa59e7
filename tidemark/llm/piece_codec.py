"""Operator 9, SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

No piece holds a space mark after another character, so a text falls apart into segments of space marks and what follows
them, which encode alone. For a segment an Aho-Corasick automaton over the pieces gives the longest piece at each place.
The encoder takes the longest piece that fits the one before: two neighbours fit if merging their characters anew, best
score first, gives just these two. Where none fits it steps back, and a bitfield remembers places from which the rest
can't be encoded. Characters outside the vocabulary become byte pieces and end a run.

Defined cases: a null or empty text is the end id alone; a text that holds the space mark itself decodes to a space, as
with the library; repeated rows get a row each; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

MARK = "\u2581"


class PieceEncoder:
    """Encodes segments with the pieces of a merge-type model; the library is used to read the model file only."""

    def __init__(self, model_path: str, most_pairs: int = 300_000):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.end = sp.eos_id()
        self.id, self.score, self.raw, byte = {}, {}, {}, {}
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte[int(p[3:-1], 16)] = i
                self.raw[i] = bytes([int(p[3:-1], 16)])
            elif sp.is_control(i) or sp.is_unknown(i):
                self.raw[i] = b""
            else:
                self.id[p], self.score[p], self.raw[i] = i, sp.get_score(i), p.replace(MARK, " ").encode()
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece goes on after a space mark: texts can't be cut into segments")
        self.byte = [byte[b] for b in range(256)]
        self.chars = frozenset(p for p in self.id if len(p) == 1)
        self.longest = ahocorasick.Automaton()
        for p in self.id:
            self.longest.add_word(p, p)
        self.longest.make_automaton()
        self.fits: dict = {}
        self.most_pairs = most_pairs
        self.shorter: dict[str, str | None] = {}

    def merged(self, s: str) -> list[str]:
        """Merging by definition: the best-scored neighbours first, of equals the leftmost."""
        parts, score = list(s), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                x = score.get(parts[i] + parts[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def next_shorter(self, piece: str) -> str | None:
        """The longest piece that is a proper prefix."""
        got = self.shorter.get(piece, self)
        if got is self:
            got = self.shorter[piece] = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.id), None)
        return got

    def compatible(self, a: str, b: str) -> bool:
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) >= self.most_pairs:
                self.fits.clear()
            got = self.fits[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return got

    def run(self, s: str) -> list[str]:
        """Pieces of a string of known characters."""
        longest: list = [None] * len(s)
        for end, p in self.longest.iter(s):
            at = end - len(p) + 1
            if longest[at] is None or len(p) > len(longest[at]):
                longest[at] = p
        n, pos, dead, out, piece = len(s), 0, 0, [], longest[0]
        while pos < n:
            while True:
                end = pos + len(piece)
                if not dead >> end & 1 and self.compatible(out[-1] if out else "", piece):
                    out.append(piece)
                    pos = end
                    piece = longest[pos] if pos < n else None
                    break
                piece = self.next_shorter(piece)
                if piece is None:
                    if not out:
                        return self.merged(s)  # no chain of fitting neighbours: by definition then
                    dead |= 1 << pos
                    piece = out.pop()
                    pos -= len(piece)
        return out

    def segment(self, s: str) -> list[int]:
        """ids of a segment."""
        if self.chars.issuperset(s):
            return [self.id[p] for p in self.run(s)]
        out: list[int] = []
        for known, run in _runs(s, self.chars):
            out += [self.id[p] for p in self.run(run)] if known else [self.byte[b] for b in run.encode()]
        return out


def _runs(s: str, chars: frozenset) -> list[tuple[bool, str]]:
    out: list[list] = []
    for c in s:
        known = c in chars
        if out and out[-1][0] == known:
            out[-1][1] += c
        else:
            out.append([known, c])
    return [(a, b) for a, b in out]


class Segments(dict):
    """Of a segment without its first mark: ids as bytes, ids in decimals with a space after each, and the decoded bytes."""

    def __init__(self, model_path: str, most: int = 250_000):
        super().__init__()
        self.encoder, self.most, self.old = PieceEncoder(model_path), most, {}

    def __missing__(self, rest: str) -> tuple[bytes, bytes, bytes]:
        if len(self) >= self.most:  # two generations: what is in use moves on, the rest is forgotten
            self.old = dict(self)
            self.clear()
        got = self.old.get(rest)
        if got is None:
            import array

            ids = self.encoder.segment(MARK + rest)
            got = array.array("i", ids).tobytes(), "".join([f"{i} " for i in ids]).encode(), b"".join([self.encoder.raw[i] for i in ids])
        self[rest] = got
        return got

    def encode(self, text: str) -> list[tuple[bytes, bytes, bytes]]:
        if not text:
            return []
        if "  " in text or MARK in text or text[0] == " ":
            return [self[x[1:]] for x in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]
        return list(map(self.__getitem__, text.split(" ")))


_SEGMENTS: dict[str, Segments] = {}


def segments_for(model_path: str) -> Segments:
    """One for each worker process and model file."""
    if model_path not in _SEGMENTS:
        _SEGMENTS[model_path] = Segments(model_path)
    return _SEGMENTS[model_path]


KINDS = {"doc_id": "long", "n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_decode(docs: DataFrame, model_path: str, outputs: tuple[str, ...] = ("doc_id", "n_tokens", "ids", "decoded")) -> DataFrame:
    """Of each document the ids with an end id, and the text that they decode to; digests of both in place of them if asked for."""

    def apply(batches):
        import numpy as np
        import pyarrow as pa

        known = segments_for(model_path)
        end = known.encoder.end
        types = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
        for b in batches:
            made: dict = {c: [] for c in outputs}
            if "doc_id" in made:
                made["doc_id"] = b.column(0)
            for text in b.column(1).to_pylist():
                got = known.encode(text or "")
                decimals = b"".join([x[1] for x in got]) + str(end).encode()
                if "n_tokens" in made:
                    made["n_tokens"].append(decimals.count(b" ") + 1)
                if "ids" in made:
                    made["ids"].append(np.append(np.frombuffer(b"".join([x[0] for x in got]), np.int32), np.int32(end)))
                if "ids_sha256" in made:
                    made["ids_sha256"].append(hashlib.sha256(decimals).hexdigest())
                if "decoded" in made or "decoded_sha256" in made:
                    raw = b"".join([x[2] for x in got])[1:]  # without the space that encoding puts before a text
                    if "decoded" in made:
                        made["decoded"].append(raw.decode("utf-8", "replace"))
                    if "decoded_sha256" in made:
                        made["decoded_sha256"].append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([x if isinstance(x := made[c], pa.Array) else pa.array(x, type=types[c]) for c in outputs], names=list(outputs))

    return pick(docs, "doc_id", "text").mapInArrow(apply, ", ".join(f"{c} {KINDS[c]}" for c in outputs))


def decode_ids(frame: DataFrame, model_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """frame with the text that its column of ids decodes to, as the library's decode gives it; null ids give null."""
    names = frame.columns

    def apply(batches):
        import pyarrow as pa
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for b in batches:
            made = [None if x is None else sp.decode(x) for x in b.column(names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, type=pa.string())], names=[*names, text])

    return frame.mapInArrow(apply, frame.withColumn(text, F.lit("")).schema)
