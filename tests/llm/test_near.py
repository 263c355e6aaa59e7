"""Near-dedup and line dedup against brute force, on groups of near copies whose members aren't all alike."""

import random
import re

import pytest

from tidemark.llm import line_join, minmax_dedup

SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def shingle_set(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def expected(rows, width, percent):
    sets = [shingle_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                same = len(sets[i] & sets[j])
                if 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                    a, b = sorted((find(i), find(j)))
                    parent[b] = a
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return {(d, len(sets[i]), min(groups[find(i)])) for i, (d, _) in enumerate(rows)}


def near_copies(n, words=60, seed=1):
    r = random.Random(seed)
    base = [f"w{r.randrange(500)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8])):
            w[r.randrange(words)] = f"x{r.randrange(100000)}"
        out.append((i * 3 + 1, " ".join(w)))
    return out


@pytest.fixture(scope="module")
def rows():
    edge = [(900, None), (901, ""), (902, " \t\n"), (903, "a b"), (904, "A  B"), (905, "a b c"), (906, "é É"), (907, "é É"), (908, "x " * 3000)]
    return near_copies(300) + edge


def test_components_match_brute_force(spark, rows):
    docs = spark.createDataFrame([(d, t, "h") for d, t in rows], "doc_id long, text string, key string").repartition(3)
    got = minmax_dedup.components(docs, 4, 80).collect()
    assert {(x.doc_id, x.n_shingles, x.component_id) for x in got} == expected(rows, 4, 80)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_dedup_keeps_one_of_each_and_the_columns(spark, rows):
    docs = spark.createDataFrame([(d, t, "h") for d, t in rows], "doc_id long, text string, sig string")
    got = minmax_dedup.dedup(docs, 4, 80)
    assert got.columns == docs.columns
    assert {x.doc_id for x in got.collect()} == {c for _, _, c in expected(rows, 4, 80)}


def test_pipeline_leaves_one_row_of_each_group(spark, sf):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a)] * 4 + [(2, a), (None, a)]  # repeated rows hold the least doc_id
    rows += [(None, b)] * 5 + [(None, b + " tail")] * 2  # no doc_id at all
    rows += [(7, c), (7, c + " tail"), (8, c)]  # one doc_id, two near texts
    rows += [(9, d), (9, "alone here")]  # one doc_id, two texts apart
    rows += [(None, None)] * 3 + [(5, "")] * 2 + [(6, "")]
    docs = spark.createDataFrame([(i, t, f"s{n}") for n, (i, t) in enumerate(rows)], "doc_id long, text string, source string").repartition(5)
    got = corpus_pipeline.near_copies(spark, docs, sf)
    assert got.columns == docs.columns
    got = got.collect()
    assert sorted((x.doc_id or 0, (x.text or "")[:2]) for x in got) == [(0, ""), (0, "b0"), (1, "a0"), (5, ""), (6, ""), (7, "c0"), (9, "al"), (9, "d0")]
    assert all(rows[int(x.source[1:])] == (x.doc_id, x.text) for x in got)  # whole rows, not mixtures
    lines = corpus_pipeline.lines(spark, docs.where("text IS NOT NULL AND text != ''"), sf)
    assert corpus_pipeline.near_copies(spark, lines, sf).where("doc_id = 1").count() == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minmax_dedup.components(docs, 5, 80).count() == 0
    assert line_join.line_counts(docs).count() == 0


def kept_lines(rows, width, percent):
    lines = []
    for d, t in sorted(rows, key=lambda r: r[0]):
        for no, line in enumerate((t or "").split("\n")):
            w = [x for x in SPACE.split(line.encode()) if x]
            if w:
                lines.append((d, no, frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])))
    out = {d: [] for d, _ in rows}
    for i, (d, no, s) in enumerate(lines):
        hit = any(100 * len(s & o) >= percent * (len(s) + len(o) - len(s & o)) for _, _, o in lines[:i])
        if not hit:
            out[d].append(no)
    return out


def test_lines_match_brute_force(spark):
    near = [t for _, t in near_copies(60, words=30, seed=2)]
    rows = [(i, "\n".join([near[i], "same line here", f"own {i}", "", near[(i * 7) % 60]])) for i in range(60)] + [(70, None), (71, ""), (72, "\n \n"), (73, "a b c d e f g h i"), (74, "a b c d e f g h")]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_chars int, kept string").repartition(3)
    want = kept_lines(rows, 5, 80)
    got = {x.doc_id: x for x in line_join.line_counts(docs, 5, 80).collect()}
    assert {d: x.kept_lines for d, x in got.items()} == want
    texts = {x.doc_id: x.text for x in line_join.dedup_lines(docs, 5, 80).collect()}
    assert texts[70] is None and texts[71] == "" and texts[72] == "\n \n"
    assert texts[3].split("\n")[:1] == ([rows[3][1].split("\n")[0]] if 0 in want[3] else texts[3].split("\n")[:1])
