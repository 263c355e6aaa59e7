"""Operators 11 to 13 against brute force, with nulls, repeats, ties, long texts, odd columns and empty tables."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction
from math import floor

import pytest
from pyspark.sql import functions as F

from tidemark.llm import divergence, stream_dedup, vector_codes
from tidemark.llm.common import spread_join

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def copies(seed=1):
    rng = random.Random(seed)
    texts = ["Some text", "sOME tEXT", "ÄÖ same", "äö same", "ÄÖ SAME", "", None, "x" * 200_000, "X" * 200_000, "İ", "K"]
    rows = [(i * 3 % 101, rng.choice(texts)) for i in range(90)]
    rows += [(None, "only null id"), (None, "Some text"), (500, "tied"), (500, "TIED"), (501, "alone")]
    return rows


def weak(text):
    """A digest of four bits: most texts collide."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 1))


def check_verdicts(rows, got):
    by = {}
    for doc_id, text in rows:
        by.setdefault((text or "").translate(FOLD), []).append(doc_id)
    expected = Counter()
    for ids in by.values():
        keep = max((i for i in ids if i is not None), default=None)
        expected.update((i, keep, len(ids)) for i in ids)
    assert Counter((x.doc_id, x.keep_id, x.group_size) for x in got) == expected
    assert sum(x.kept for x in got) == len(by)
    assert all(x.doc_id == x.keep_id for x in got if x.kept)


@pytest.mark.parametrize("digest", [stream_dedup.sha256, weak])
def test_copies_match_brute_force(spark, digest):
    rows = copies()
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, digest string, `a.b` int").repartition(3)
    got = stream_dedup.dedup(docs, digest).collect()
    check_verdicts(rows, got)
    if digest is stream_dedup.sha256:
        text = {d: (t or "").translate(FOLD) for d, t in rows if d is not None}
        assert all(bytes(x.digest) == hashlib.sha256(text[x.doc_id].encode()).digest() for x in got if x.doc_id is not None)


def test_copies_are_remembered_over_runs(spark, tmp_path):
    rows, home, path = copies(2), f"file://{tmp_path}/home", f"file://{tmp_path}/docs"
    for part in (rows[:40], rows[40:41], rows[41:]):
        spark.createDataFrame(part, "doc_id long, text string").repartition(2).write.mode("append").parquet(path)
        got = stream_dedup.dedup_files(spark, path, home, files_a_batch=1).collect()
    check_verdicts(rows, got)


def test_copies_of_an_empty_table(spark):
    assert stream_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_spread_join_deals_hot_keys(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 300)).alias("key"), "id")
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = spread_join(rows, groups, "key", "n", 5000, spread=F.xxhash64("id"))
    assert got.count() == 5000
    assert got.where("key = 'hot' AND top = 3999").count() == 4000


def audit(rows, least, top=50):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        terms = sorted(t for t in df if df[t] >= least)
        count = {s: Counter(t for d in mine if d[1] == s for t in d[2] if t in set(terms)) for s in {d[1] for d in mine}}
        whole = sum(count.values(), Counter())
        p = lambda c: {t: 1 + floor(Fraction(10**9 * (c[t] + 5), sum(c.values()) + 5 * len(terms))) for t in terms}
        ps, q = {s: p(c) for s, c in count.items()}, p(whole)
        for s in count:
            pairs = sorted((-sum(abs(ps[s][t] - ps[o][t]) for t in terms), o.encode()) for o in count if o != s)
            own = sorted((q[t] - ps[s][t], t.encode()) for t in terms if count[s][t] and ps[s][t] > q[t])[:top]
            out += [(lang, s, part, item.decode(), -v, i + 1) for part, xs in (("pair", pairs), ("term", own)) for i, (v, item) in enumerate(xs)]
    return sorted(out)


@pytest.mark.parametrize(("block", "tile"), [(2048, 64), (8, 3)])
def test_audit_matches_brute_force(spark, block, tile):
    rng = random.Random(3)
    words = ["Tea", "tea", "Ünder", "ünder", "x1y", "don't", "the", "of", "日本"] + [rng.choice("abcdef") + rng.choice("ghijkl") + rng.choice("mno") for _ in range(60)]
    rows = [(rng.choice(["en", "de", None]), rng.choice([f"s{i}" for i in range(9)] + [None]), " ".join(rng.choices(words, k=rng.randint(0, 30)))) for _ in range(400)]
    rows += [("en", "empty", None), ("en", "empty too", " 12 "), ("en", "empty", ""), ("xx", "a", "no kept terms"), ("xx", "b", None), ("yy", "lonely", "words"), ("en", "s1", "tea " * 60_000)]
    rows += [("en", "twin a", "the tea of")] * 20 + [("en", "twin b", "the tea of")] * 20
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "lang string, source string, text string, term int, `a.b` string").repartition(5)
    got = sorted(tuple(x) for x in divergence.divergence(docs, least_docs=5, top=7, block=block, tile=tile).collect())
    assert got == audit(rows, 5, 7)
    assert [x[4] for x in got if x[:4] == ("en", "twin a", "pair", "twin b")] == [0]


def test_audit_of_an_empty_table(spark):
    assert divergence.divergence(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


@pytest.mark.parametrize("kind", ["string", "large_string"])
def test_counts_are_handed_on_piece_by_piece(monkeypatch, kind):
    import pyarrow as pa

    rng, taken = random.Random(8), []
    texts = ["", " ", "Ünder ünder\n日本\t日本", "x1y", "tea " * 3000, "12"] + [" ".join("".join(rng.choices("abcdeÄß", k=3)) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = [(rng.choice(["en", "", "d\u00e9"]), rng.choice(["a", "b", ""]), t) for t in texts]
    rows += [("en", "no words", "1 2 3"), ("en", "no words", "")]

    def batches():
        for at in range(0, len(rows), 50):
            taken.append(at)
            cols = zip(*[("x", "cut off", "before"), *rows[at : at + 50]], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=getattr(pa, kind)()) for c in cols], names=["lang", "source", "text"]).slice(1)

    monkeypatch.setattr(divergence, "PIECE", 1000, raising=False)
    counted = divergence._counted(batches())
    first = next(counted)
    assert len(taken) == 1 and sum(first.column("n").to_pylist()) < sum(len(t.split()) for t in texts[:50])
    n, docs = Counter(), Counter()
    for b in [first, *counted]:
        for lang, source, term, k, d in zip(*b.to_pydict().values(), strict=True):
            n[lang, source, term] += k
            docs[lang, source, term] += d
    words = [(r[:2], re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r[2].translate(FOLD))) for r in rows]
    assert +n == Counter((*g, t) for g, ts in words for t in ts)
    assert +docs == Counter((*g, t) for g, ts in words for t in set(ts))
    assert {k[:2] for k in n if k[2] is None} == {r[:2] for r in rows}


def test_equal_subtrees_are_one_node():
    import numpy as np

    counts = np.array([[1, 2, 0, 0, 1, 2, 0, 0], [1, 2, 0, 0, 0, 0, 0, 0], [1, 2, 0, 0, 1, 2, 0, 0]], dtype=np.int64)
    trees = divergence.Trees(counts, 8)
    assert trees.sizes == [4, 2, 2, 2]  # three counts and the padding; [1 2] and [0 0]; two halves; two roots
    assert trees.roots[0] == trees.roots[2]


def codes(rows, parts=8, k=16, rounds=6):
    """The same by plain loops over whole vectors; rows of (id, vector, label)."""
    bad = lambda v: not v or len(v) % parts or any(x is None or x != x or x in (float("inf"), float("-inf")) for x in v)
    rows = [r for r in rows if not bad(r[1])]
    length = min(Counter(len(r[1]) for r in rows).items(), key=lambda x: (-x[1], x[0]))[0]
    rows = [(i, [floor(Fraction(x) * 4096) for x in v], label, v) for i, v, label in rows if len(v) == length]
    w = length // parts
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:k]
    books = [[r[1][p * w : p * w + w] for r in first] for p in range(parts)]
    near = lambda book, x: min((sum((a - b) ** 2 for a, b in zip(e, x)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            at = {}
            for r in rows:
                x = r[1][p * w : p * w + w]
                at.setdefault(near(book, x)[1], []).append(x)
            books[p] = [[sum(c) // len(c) for c in zip(*at[j])] if j in at else e for j, e in enumerate(book)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, of = [], Counter()
    for i, v, label, _ in rows:
        got = [near(b, v[p * w : p * w + w]) for p, b in enumerate(books)]
        out.append((i, "".join(f"{j:02x}" for _, j in got), sum(d for d, _ in got), label))
        of[label] += out[-1][2]
    return Counter((i, c, e, of[label], sha) for i, c, e, label in out)


def result(df):
    return Counter((x.vec_id, x.code, x.error, x.label_error, x.codebooks_sha256) for x in df.collect())


@pytest.mark.parametrize("scale", [1.0, 1e15])
def test_codes_match_brute_force(spark, scale):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    rows = [(i * 7 % 1009, [scale * (x + rng.gauss(0, 0.1)) for x in rng.choice(centres)], rng.choice([None, 0, 1, 2])) for i in range(700)]
    rows += [(2000 + i, centres[0], 1) for i in range(300)] + [(5000, centres[1], 1)] * 3  # a hot vector, repeated rows
    rows += [(-5, None, 1), (-4, [1.0, None] * 8, 1), (-3, [float("nan")] * 16, 1), (-2, [float("inf")] * 16, 1), (-1, [], 1), (-6, [1.0] * 9, 1), (-7, [1.0] * 8, 1), (None, centres[2], 0), (None, centres[3], 0)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, code int, `a.b` int").repartition(5)
    got = result(vector_codes.compress(df))
    want = codes(rows)
    if scale > 1:  # errors over a long are null
        want = Counter({(i, c, None if e >= 1 << 63 else e, None, s): 0 for i, c, e, _, s in want})
        assert {x[:2] + x[4:] for x in got} == {x[:2] + x[4:] for x in want}
    else:
        assert got == want


def test_codes_stay_with_their_owners(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(i % 3, 1) for _ in range(16)], i % 4) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    few = spark.createDataFrame(rows, "_id long, _v array<double>, x int").select("_id", "_v")
    assert vector_codes.train(few, members_a_task=100).sha256() == vector_codes.train(few, members_a_task=10_000).sha256()
    assert len(result(vector_codes.compress(df))) == 600


def test_codes_of_few_or_no_rows(spark):
    rows = [(i, [float(i)] * 8, None) for i in range(3)]
    assert result(vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string"))) == codes(rows)
    assert vector_codes.compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label string")).collect() == []


def test_intermediate_tables_are_deleted_but_for_what_is_read(spark):
    import os

    from tidemark.llm.common import cut, recorded, release

    made, inner = [], []
    with recorded(made):
        a = cut(spark.range(3), "a")
        with recorded(inner):
            b = cut(spark.range(4), "b")
    outside = cut(spark.range(5), "c")
    at = lambda f: f.removeprefix("file://")
    assert len(made) == 2 and len(inner) == 1
    release(spark, made, a.where("id > 0"))
    assert len(made) == 1 and a.count() == 3 and not os.path.exists(at(inner[0]))
    release(spark, inner)  # what is gone already is no matter
    release(spark, made)
    assert made == inner == [] and outside.count() == 5
    assert b is not None
