"""Line dedup, the empirical Bayes step and the pipeline against brute force, with nulls, repeats, long texts and odd columns."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import line_join, quality_classifier

DOCS = "doc_id long, text string"


def gone_lines(rows, width=5, percent=80):
    """Places of lines similar to an earlier one, by comparing all."""
    lines = []
    for i, (doc_id, text) in enumerate(rows):
        for no, line in enumerate((text or "").split("\n")):
            ws = line.replace("\t", " ").split()
            if ws:
                lines.append(((doc_id is None, doc_id or 0, i, no), {tuple(ws[k : k + width]) for k in range(max(1, len(ws) - width + 1))}))
    lines.sort(key=lambda x: x[0])
    return {(place[2], place[3]) for n, (place, s) in enumerate(lines) if any(100 * len(s & t) >= percent * len(s | t) for _, t in lines[:n])}


def corpus(seed=4):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz")
    line = lambda n: [word() for _ in range(n)]
    base = [line(rng.randint(8, 60)) for _ in range(12)]
    rows = []
    for d in range(60):
        out = []
        for _ in range(rng.randint(0, 6)):
            ws = list(rng.choice(base)) if rng.random() < 0.6 else line(rng.randint(1, 40))
            for _ in range(rng.choice((0, 0, 1, 2))):
                ws[rng.choice((0, -1, rng.randrange(len(ws))))] = word()
            out.append(" ".join(ws) if rng.random() < 0.9 else " ".join(ws * 3))
        rows.append((d * 7 - 30, "\n".join(out)))
    rows += [(None, "only here in a null row today\n" + rows[3][1]), ((1 << 63) - 1, "the greatest doc id there is\n" + " ".join(base[0])), (900, None), (901, ""), (902, " \t\n "), (903, "a a a a a a\na a a a a"), (904, " ".join(line(3000)))]
    return rows


@pytest.mark.parametrize("group", [256, 4])
def test_lines_match_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(line_join, "GROUP", group)  # at 4 most groups go through families
    rows = corpus()
    gone = gone_lines(rows)
    got = {x.doc_id: x for x in line_join.line_counts(spark.createDataFrame(rows, DOCS)).collect()}
    for i, (doc_id, text) in enumerate(rows):
        has = [no for no, line in enumerate((text or "").split("\n")) if line.strip()]
        assert got[doc_id].n_lines == len(has)
        assert got[doc_id].kept_lines == [no for no in has if (i, no) not in gone], doc_id
    assert len(gone) > 40


def test_lines_of_repeated_rows_and_odd_columns(spark):
    text = "one line that has more than five words\nanother one that has as many words"
    rows = [(1, text, 5, "x"), (1, text, 5, "y"), (2, text, 5, "z"), (3, None, 0, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, `a.b` string")
    assert sorted((x.doc_id, x.n_lines, x.n_removed) for x in line_join.line_counts(docs).collect()) == [(1, 2, 0), (1, 2, 0), (2, 2, 2), (3, 0, 0)]
    left = line_join.dedup_lines(docs)
    assert left.columns == docs.columns and sorted(x["a.b"] for x in left.collect()) == ["n", "x", "y"]
    assert line_join.line_counts(docs.limit(0)).count() == 0


def test_shrinkage_matches_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, f"h{i % 3}" if i % 7 else None, f"p{i % 2}" if i % 5 else None, rng.gauss(-1 if i % 3 else 2, 2)) for i in range(200)]
    got = {x._key: x for x in quality_classifier.shrink(spark.createDataFrame(rows, "_key long, host string, path string, evidence double")).collect()}
    p = {k: 1 / (1 + math.exp(-max(-30, min(30, e)))) for k, _, _, e in rows}
    mean = sum(p.values()) / len(p)

    def groups(key):
        out = {}
        for r in rows:
            out.setdefault(key(r), []).append(p[r[0]])
        return out

    def strength(g):
        n, k = sum(map(len, g)), len(g)
        noise = sum(sum(x * x for x in v) - sum(v) ** 2 / len(v) for v in g) / (n - k)
        between = (sum(len(v) * (sum(v) / len(v) - mean) ** 2 for v in g) - (k - 1) * noise) / (n - sum(len(v) ** 2 for v in g) / n)
        return min(1e4, max(1.0, noise / between)) if between > 1e-9 else 1e4

    hosts, paths = groups(lambda r: r[1]), groups(lambda r: (r[1], r[2]))
    a, b = strength(list(hosts.values())), strength(list(paths.values()))
    for k, h, q, e in rows:
        host = (sum(hosts[h]) - p[k] + mean * a) / (len(hosts[h]) - 1 + a)
        path = (sum(paths[h, q]) - p[k] + host * b) / (len(paths[h, q]) - 1 + b)
        assert math.isclose(got[k].path_rate, path, rel_tol=1e-9)
        assert math.isclose(got[k].posterior, 1 / (1 + math.exp(-(e + math.log(path / (1 - path))))), rel_tol=1e-9)


def test_classifier_without_labels_and_with_odd_columns(spark):
    docs = spark.createDataFrame([(1, "a text", "s", "x"), (None, None, None, "y"), (2, "", "s", None)], "doc_id long, text string, source string, `a.b` string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality_classifier.classify(docs, labels).collect()
    assert len(out) == 3 and {round(x.posterior, 6) for x in out} == {0.5}
    assert quality_classifier.accept(docs, labels, reject=0.6).columns == docs.columns
    assert quality_classifier.accept(docs, labels, reject=0.6).count() == 3


def test_pipeline_keeps_what_its_stages_keep(spark, sf):
    import corpus_pipeline as pipe

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = pipe.run(spark, sf).collect()
    ids = [x.doc_id for x in out]
    assert len(set(ids)) == len(ids) and set(ids) <= {x.doc_id for x in docs.select("doc_id").collect()}
    kept = {x.doc_id for x in pipe.quality(spark, docs, sf).select("doc_id").collect()}
    assert set(ids) <= kept and len(ids) > 0.3 * docs.count()
    assert all(x.n_tokens == len(x.ids) for x in out)


def test_a_written_table_leaves_no_shuffle_files(spark):
    import time
    from pathlib import Path

    from tidemark.llm.common import SHUFFLES, cut

    dirs = [Path(str(d)) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in dirs for f in d.rglob("shuffle_*.data")}
    before, was = files(), spark.conf.get(SHUFFLES)
    out = cut(spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).agg(F.count("*").alias("c")), "counts")
    for _ in range(20):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(SHUFFLES) == was and out.count() == 5000


def test_groups_of_two_tokens_are_not_compared_with_one_another(spark, monkeypatch):
    monkeypatch.setattr(line_join, "GROUP", 4)
    rng, seen = random.Random(9), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    one, two = [word() + "x" * 40 for _ in range(5)], [word() + "y" * 40 for _ in range(5)]
    texts = [" ".join([*p, *[word() for _ in range(30)]]) for p in (one, two) for _ in range(20)]
    rows = list(enumerate([*texts, " ".join([*one, *two, *[word() for _ in range(30)]]), texts[3] + " more", texts[30] + " more"]))
    write = line_join.cut
    monkeypatch.setattr(line_join, "cut", lambda df, name="cut": seen.append((name, write(df, name))) or seen[-1][1])
    got = {x.doc_id: x.kept_lines for x in line_join.line_counts(spark.createDataFrame(rows, DOCS)).collect()}
    assert {i for i, kept in got.items() if not kept} == {i for i, _ in gone_lines(rows)} == {41, 42}
    held = {name: df for name, df in seen}["named"]
    sizes = [x["count"] for x in held.groupBy("t").count().collect()]
    assert sizes and max(sizes) <= 22  # a line with both phrases doesn't make one family of all 43


def test_lines_with_a_common_passage_are_not_paired_with_one_another(spark, monkeypatch):
    monkeypatch.setattr(line_join, "GROUP", 4)
    monkeypatch.setattr(line_join, "BLOCK", 4)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    passage = [word() + "x" * 40 for _ in range(8)]
    rows = list(enumerate(" ".join([*passage, *[word() for _ in range(20)]]) for _ in range(240)))
    rows += [(1000 + i, rows[7 * i + 3][1] + " more") for i in range(5)]
    seen, write = [], line_join.cut
    monkeypatch.setattr(line_join, "cut", lambda df, name="cut": seen.append((name, write(df, name))) or seen[-1][1])
    got = {x.doc_id: x.kept_lines for x in line_join.line_counts(spark.createDataFrame(rows, DOCS)).collect()}
    assert {i for i, kept in got.items() if not kept} == {1000, 1001, 1002, 1003, 1004}
    made = dict(seen)
    assert 10 <= made["held"].count() <= 20  # of the lines with the passage, those that another one has rarer tokens of too
    assert "dealt" not in made and made["pairs"].count() <= 50


def test_lines_made_of_common_tokens_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(line_join, "GROUP", 4)
    monkeypatch.setattr(line_join, "BLOCK", 4)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    parts = [[word() for _ in range(9)] for _ in range(7)]
    mixed = [[w for p in rng.sample(parts, rng.randint(2, 4)) for w in p] for _ in range(60)]
    rows = list(enumerate(" ".join([*ws[rng.choice((0, 0, 1, 3)) :], *[word() for _ in range(rng.choice((0, 1, 2, 4, 6, 8)))]]) for ws in mixed for _ in range(3)))
    gone, seen, write = {rows[i][0] for i, _ in gone_lines(rows)}, [], line_join.cut
    monkeypatch.setattr(line_join, "cut", lambda df, name="cut": seen.append((name, write(df, name))) or seen[-1][1])
    got = {x.doc_id: x.kept_lines for x in line_join.line_counts(spark.createDataFrame(rows, DOCS)).collect()}
    assert {i for i, kept in got.items() if not kept} == gone and 30 < len(gone) < 150
    made = dict(seen)
    assert 1 < made["kinds"].count() < made["most"].count() and made["firsts"].count()


def test_lines_with_a_common_passage_are_parted_by_length(spark, monkeypatch):
    monkeypatch.setattr(line_join, "GROUP", 4)
    rng, seen = random.Random(5), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    passage = [word() + "x" * 40 for _ in range(6)]
    texts = [" ".join([*passage, *[word() for _ in range(round(20 * 1.1**i))]]) for i in range(24) for _ in range(2)]
    others = [f"{word()} {t}" if i % 2 else f"{t} {' '.join(word() for _ in range(len(t.split()) // 10))}" for i, t in enumerate(texts[::5])]
    rows, write = list(enumerate([*texts, *others])), line_join.cut
    monkeypatch.setattr(line_join, "cut", lambda df, name="cut": seen.append((name, write(df, name))) or seen[-1][1])
    got = {x.doc_id: x.kept_lines for x in line_join.line_counts(spark.createDataFrame(rows, DOCS)).collect()}
    assert {i for i, kept in got.items() if not kept} == {i for i, _ in gone_lines(rows)} == set(range(len(texts), len(rows)))
    made = dict(seen)
    assert "named" not in made  # no row for each token of these lines
    assert made["pairs"].count() <= 2 * len(others)  # of long lines too, pairs that share the passage alone end at the filters
