"""Operator 1, license scans: a positional rare-token index of licence templates.

The corpus' document frequencies of the licence words give their IDF, and words are numbered by falling IDF. The index maps a
word to its postings (template, place), where a template is posted under the RARE words of highest IDF in its mandatory key
phrase. A file's words of the index are looked up from the highest IDF down. The rarest word of a template proposes starts, its
place in the file less that in the template; the postings of the next ones are intersected with them by relative position. A
template of which all postings agree has its whole key phrase verified at the starts that are left. The verified start is
scored by the IDF-weighted share of the template's words that stand at their relative places; a template of MATCH or more adds
its label.

Every occurrence of a key phrase holds all words that its template is posted under, so no place is missed.

Defined cases: a null or empty text has no words, no labels and score 0; ties in IDF go to the word first in alphabetical order;
repeated rows and a null doc_id get a row each; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD_TABLE, pick

MATCH = 0.85
RARE = 3  # words of a key phrase that its template is posted under

#: Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Fixed values: (label, template, key phrase within it), words folded.
TEMPLATES = [
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "free of charge to any person obtaining a copy"),
    ("mit", "released under the mit license", "mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
    ("cc0", "creative commons zero public domain dedication", "creative commons zero"),
]


def _templates() -> list[tuple[str, list[str], list[str], bool]]:
    return [(label, phrase.split(), phrase.split(), True) for phrase, label in BASE.items()] + [(label, t.split(), k.split(), False) for label, t, k in TEMPLATES]


def document_frequencies(docs: DataFrame) -> tuple[dict[str, int], int]:
    """In how many documents each licence word stands, and the number of documents. As many rows as there are licence words reach the driver."""
    vocabulary = sorted({w for _, t, k, _ in _templates() for w in t + k})
    known = frozenset(w.encode() for w in vocabulary)

    def count(batches):
        import pyarrow as pa

        n, found = 0, dict.fromkeys(known, 0)
        for b in batches:
            for text in b.column(0).to_pylist():
                n += 1
                for w in known.intersection((text or b"").translate(FOLD_TABLE).split()):
                    found[w] += 1
        yield pa.RecordBatch.from_pydict({"w": [None, *[w.decode() for w in found]], "n": pa.array([n, *found.values()], type=pa.int64())}, schema=pa.schema([("w", pa.string()), ("n", pa.int64())]))

    got = pick(docs, "text").select(F.col("text").cast("binary")).mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    by = {r["w"]: r["n"] for r in got}
    return {w: by.get(w, 0) for w in vocabulary}, by.get(None, 0)


class Index:
    """Postings by word; word numbers from 1 up by falling IDF, 0 for words of no licence."""

    def __init__(self, frequency: dict[str, int], n_docs: int):
        import numpy as np

        order = sorted(frequency, key=lambda w: (frequency[w], w))
        self.number = {w.encode(): i for i, w in enumerate(order, 1)}
        self.idf = np.array([0.0, *[math.log((1 + n_docs) / (1 + frequency[w])) + 1e-9 for w in order]])
        self.templates, self.postings = [], {}
        for label, words, key, base in _templates():
            at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
            ids = np.array([self.number[w.encode()] for w in words], dtype=np.int32)
            rare = sorted((int(ids[at + i]), i) for i in range(len(key)))[:RARE]
            for word, place in rare:
                self.postings.setdefault(word, []).append((len(self.templates), place))
            self.templates.append((label, base, ids, at, ids[at : at + len(key)], len(rare)))
        self.posted, self.rarest = np.zeros(len(self.idf), dtype=bool), np.zeros(len(self.idf), dtype=bool)
        self.posted[list(self.postings)] = True
        self.rarest[[int(key.min()) for *_, key, _ in self.templates]] = True

    def proposed(self, ids) -> dict:
        """Starts, by template, on which all its postings agree; a start is that of the key phrase in the file's word numbers."""
        import numpy as np

        if not self.rarest[ids].any():  # no template has all its postings
            return {}
        at = np.flatnonzero(self.posted[ids])
        own, starts, agreed = ids[at], {}, {}
        for word in np.unique(own).tolist():
            places = at[own == word]
            for t, place in self.postings[word]:
                begin = places - place
                starts[t] = np.intersect1d(starts[t], begin, assume_unique=True) if t in starts else begin
                agreed[t] = agreed.get(t, 0) + 1
        return {t: begin[(begin >= 0) & (begin + len(self.templates[t][4]) <= len(ids))] for t, begin in starts.items() if agreed[t] == self.templates[t][5] and len(begin)}

    def scan(self, words: list[bytes]) -> tuple[int, int | None, int | None, set[str], set[str], float]:
        """(n_base, first, last, base labels, all labels, score) of a text's words."""
        from itertools import repeat

        import numpy as np

        ids = np.fromiter(map(self.number.get, words, repeat(0)), dtype=np.int32, count=len(words))
        starts, base, labels, best = [], set(), set(), 0.0
        for t, begin in self.proposed(ids).items():
            label, is_base, template, at, key, _ = self.templates[t]
            begin = begin[(ids[begin[:, None] + np.arange(len(key))] == key).all(axis=1)]
            if not len(begin):
                continue
            around = (begin - at)[:, None] + np.arange(len(template))
            inside = (around >= 0) & (around < len(ids))
            agree = (ids[np.where(inside, around, 0)] == template) & inside
            weight = self.idf[template]
            score = float((agree * weight).sum(axis=1).max() / weight.sum())
            best = max(best, min(1.0, score))
            if is_base:
                starts.append(begin)
                base.add(label)
                labels.add(label)
            elif score >= MATCH:
                labels.add(label)
        places = np.concatenate(starts) if starts else ()
        return len(places), int(min(places)) if len(places) else None, int(max(places)) if len(places) else None, base, labels, best


FIELDS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licences(docs: DataFrame) -> DataFrame:
    """A row per document: FIELDS. first_word and last_word are places of base phrases; score is the best template's."""
    frequency, n_docs = document_frequencies(docs)

    def scan(batches):
        import pyarrow as pa

        index = Index(frequency, n_docs)
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])
        for b in batches:
            made = []
            for text in b.column(1).to_pylist():
                words = (text or b"").translate(FOLD_TABLE).split()
                n, first, last, base, labels, score = index.scan(words)
                made.append((len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score))
            columns = list(zip(*made, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, type=schema.field(i + 1).type) for i, c in enumerate(columns)]], schema=schema)

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(scan, FIELDS)
