"""Token files, pieces, windows and scans against the libraries and brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import decontaminate, fm_substrings, histogram_sort, licence_scan, piece_codec, quality_classifier, rule_ledger, token_files

P = pytest.importorskip("public_tokenizers")
TEXTS = [None, "", " ", "a", "a  b\n\n c", "don't stop, it's. 'tis 12,5 <|endoftext|> é!!", "ñandú\t你好 😀\x00x", "  lead and trail  ", "▁ mark ▁▁x", "word " * 400, "x" * 5000, "same same", "same same"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "h", 7, "m") for i, t in enumerate(TEXTS)] + [(None, "no id", "h", 7, "m")]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, size int, shard string").repartition(3)


def test_token_files_round_trip(spark, docs):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    got = {r.doc_id: r for r in token_files.tokenize_to_files(docs, path, outputs=("doc_id", "start", "n_tokens", "ids", "ids_crc32")).collect()}
    start = len(t.encode("no id", add_special_tokens=False).ids) + 1  # the null doc_id comes first
    for i, text in enumerate(TEXTS):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids, got[i].ids_crc32) == (start, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_query_follows_the_library_on_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    from tidemark.llm import queries

    t, texts = Tokenizer.from_file(P.path("byte_bpe_50k.json")), [*TEXTS, "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y.", "<|endoftext |> plain"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, start = {r.doc_id: r for r in queries.op4_token_files(spark, str(tmp_path)).collect()}, 0
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_rows_without_a_doc_id_are_dealt_over_files(spark, tmp_path):
    texts = [f"text {i} of many" for i in range(4000)]
    docs = spark.createDataFrame([(None, x) for x in texts] + [(7, "last")], "doc_id long, text string")
    out, joins_small_ones = f"{tmp_path}/tokens", "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(joins_small_ones, "false")
    try:
        got = token_files.tokenize_to_files(docs, P.path("byte_bpe_50k.json"), out, ("doc_id", "start", "n_tokens", "ids")).orderBy("start").collect()
    finally:
        spark.conf.unset(joins_small_ones)
    assert spark.read.parquet(out).select("file").distinct().count() > 1
    assert len(got) == 4001 and got[-1].doc_id == 7 and got[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert sorted(t.decode(r.ids[:-1]) for r in got) == sorted([*texts, "last"])


@pytest.mark.parametrize("n", [1, 4096, 4097, 700_000])
def test_blocks_decode_whole_and_from_checkpoints(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 50_000) - 1
    counts = np.bincount(ids)
    known = np.flatnonzero(counts)
    index = np.zeros(len(counts), dtype=np.int64)
    index[known] = np.arange(len(known))
    table = token_files.Table(known.astype("<u4"), token_files.quantise(counts[known]))
    states, words, marks = token_files.encode_block(index[ids], table.freqs, table.starts)
    row = {"n_tokens": n, "states": states, "words": words, "marks": marks, "crc32": zlib.crc32(ids.astype("<u4").tobytes()), "doc_ids": [1]}
    assert (token_files.decode_ids(row, table) == ids).all()
    parts = len(marks) // (8 * (2 + len(states) // 8)) + 1
    assert (np.concatenate([token_files.decode_ids(row, table, i) for i in range(parts)]) == ids).all()
    with pytest.raises(ValueError, match="checksum"):
        token_files.decode_ids(row | {"crc32": row["crc32"] ^ 1}, table)


def test_pieces_equal_the_library(docs):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in piece_codec.encode_decode(docs, path, tuple(piece_codec.KINDS)).collect()}
    for i, text in enumerate(TEXTS):
        ids = [*sp.encode(text or ""), 2]
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and got[i].decoded == sp.decode(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    again = piece_codec.decode_ids(piece_codec.encode_decode(docs, path, ("doc_id", "ids")), path)
    assert {r.doc_id: r.text for r in again.collect()}[5] == TEXTS[5]


def test_pieces_fuzz():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp, known, r = sentencepiece.SentencePieceProcessor(model_file=path), piece_codec.segments_for(path), random.Random(5)
    alphabet = "aeiou tshrn  \n.,-==__**##12你​\U0001f600é"
    for _ in range(2000):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(30)))
        assert np.frombuffer(b"".join(x[0] for x in known.encode(text)), np.int32).tolist() == sp.encode(text)


def test_substrings_match_brute_force(spark):
    r = random.Random(3)
    shared = [f"s{i}" for i in range(40)]
    rows = []
    for i in range(120):
        w = [f"w{r.randrange(30)}" for _ in range(r.randrange(60))]
        if i % 3 == 0:
            at = r.randrange(len(w) + 1)
            w[at:at] = shared[r.randrange(10) : r.randrange(20, 41)]
        rows.append((i, " ".join(w)))
    rows += [(200, "go " * 300), (201, "go " * 90), (202, None), (203, ""), (204, rows[5][1]), (205, rows[5][1])]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, place int").repartition(4)
    got = {x.doc_id: x for x in fm_substrings.dedup_substrings(docs, 13).collect()}
    first: dict = {}
    words = {d: (t or "").split() for d, t in rows}
    for d in sorted(words):
        for i in range(len(words[d]) - 12):
            first.setdefault(tuple(words[d][i : i + 13]), d)
    for d, w in words.items():
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        assert (got[d].n_words, got[d].n_removed) == (len(w), len(gone))
        assert got[d].kept == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_a_hot_phrase_has_no_shard_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(fm_substrings, "HOT_WORDS", 500)
    from tidemark.llm.common import WordHashes, hash_words, window_hashes

    r, rows, seen = random.Random(6), [], []
    hashed = lambda t: window_hashes(hash_words(t.encode().split(), WordHashes()), 4)[0]
    phrase = min((f"sold as is {i}" for i in range(500)), key=hashed)  # a low hash, so that it is the minimiser of its windows
    for i in range(300):  # one phrase in ever other surroundings, some of them shared
        w = [f"v{r.randrange(10**6)}" for _ in range(9)] + phrase.split() + [f"v{r.randrange(10**6)}" for _ in range(12)]
        rows.append((i, " ".join(rows[r.randrange(i)][1].split()[:20] + w[20:] if i % 4 == 3 else w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    search = fm_substrings.hot_minimisers
    monkeypatch.setattr(fm_substrings, "hot_minimisers", lambda one: seen.extend(search(one)) or search(one))
    got = {x.doc_id: x for x in fm_substrings.dedup_substrings(docs, 13).collect()}
    assert seen
    first: dict = {}
    for d, t in rows:
        w = t.split()
        gone = {j for i in range(len(w) - 12) if first.setdefault(tuple(w[i : i + 13]), d) < d for j in range(i, i + 13)}
        assert (got[d].n_removed, got[d].kept) == (len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))


def test_null_ids_neither_remove_nor_lose(spark):
    t = " ".join(f"z{i}" for i in range(20))
    docs = spark.createDataFrame([(None, t), (5, t), (None, t)], "doc_id long, text string")
    assert [x.n_removed for x in fm_substrings.dedup_substrings(docs).collect()] == [0, 0, 0]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def folded(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def test_licences(spark):
    rows = [(0, "Licensed under the Apache License, Version 2.0."), (1, "MIT license mit LICENSE"), (2, "gnu general public"), (3, None), (4, "CC-BY CC BY"), (5, "plain")]
    got = {x.doc_id: x for x in licence_scan.scan_licences(spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, labels string")).collect()}
    for d, t in rows:
        w = folded(t)
        at = sorted(i for p in licence_scan.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert (got[d].n_words, got[d].n_base, got[d].first_word, got[d].last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
    assert "apache-2.0" in got[0].labels and got[1].base_labels == "mit" and got[3].labels == "" and 0 <= got[5].score <= 1


def test_licences_against_brute_force(spark):
    draw = random.Random(3)
    phrases = [*licence_scan.BASE, *[t for _, t, _ in licence_scan.TEMPLATES], *[k for _, _, k in licence_scan.TEMPLATES]]
    vocabulary = sorted({w for p in phrases for w in p.split()})
    rows = [(i, " ".join(" ".join(draw.choice(phrases).split()[draw.randint(0, 2) :]) if draw.random() < 0.4 else draw.choice([*vocabulary, "other"]) for _ in range(draw.randint(0, 30)))) for i in range(150)]
    rows += [rows[0], (None, rows[1][1]), (200, "the of " * 40_000 + "cc by " * 3000 + "apache license version 2 0"), (201, None), (202, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts = [folded(t) for _, t in rows]
    idf = {w: math.log((1 + len(texts)) / (1 + sum(w in x for x in map(set, texts)))) + 1e-9 for w in vocabulary}

    def brute(w):
        n_base, labels, base, best = [], set(), set(), 0.0
        for label, template, key, is_base in [(v, k, k, True) for k, v in licence_scan.BASE.items()] + [(*t, False) for t in licence_scan.TEMPLATES]:
            t, k = template.split(), key.split()
            at = next(i for i in range(len(t)) if t[i : i + len(k)] == k)
            for i in range(len(w) - len(k) + 1):
                if w[i] == k[0] and w[i : i + len(k)] == k:
                    score = sum(idf[x] for j, x in enumerate(t) if 0 <= i - at + j < len(w) and w[i - at + j] == x) / sum(idf[x] for x in t)
                    best = max(best, min(1.0, score))
                    if is_base:
                        n_base.append(i)
                        base.add(label)
                    if is_base or score >= licence_scan.MATCH:
                        labels.add(label)
        return (len(w), len(n_base), min(n_base, default=None), max(n_base, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(best, 9))

    got = [(r.doc_id, (*r[1:7], round(r.score, 9))) for r in licence_scan.scan_licences(docs).collect()]
    want = [(d, brute(w)) for (d, _), w in zip(rows, texts, strict=True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_decontamination_of_short_items_and_cleaning(spark):
    bench = spark.createDataFrame([(1, "One two three"), (2, " ".join(f"q{i}" for i in range(14))), (3, None), (4, "..."), (1, "one two three")], "item_id long, text string")
    body = " ".join(f"q{i}" for i in range(2, 13))
    rows = [(0, f"start {body} end one, TWO three!"), (1, "one two"), (2, None), (3, ""), (4, f"start {body} end one, TWO three!"), (5, "Clean text, kept. As it is")]
    docs = spark.createDataFrame([(d, t, 3, "x") for d, t in rows], "doc_id long, text string, n_chars int, w string").repartition(2)
    got = {x.doc_id: x for x in decontaminate.contamination(docs, bench).collect()}
    assert (got[0].n_words, got[0].n_hit, got[0].n_items, got[0].contaminated) == (16, 14, 2, True)
    assert got[0].items_sha256 == hashlib.sha256(b"1,2").hexdigest() and got[4].n_hit == 14
    assert (got[1].n_hit, got[2].n_words, got[3].contaminated) == (0, 0, False)
    cleaned = {x.doc_id: x for x in decontaminate.clean(docs, bench, drop_share=0.9).collect()}
    assert cleaned[0].text == "start end " and cleaned[5].text == rows[5][1] and cleaned[2].text is None and cleaned[0].w == "x"
    assert 0 not in {x.doc_id for x in decontaminate.clean(docs, bench).collect()}


def test_rules(docs):
    got = {x.doc_id: x for x in rule_ledger.apply_policy(rule_ledger.ledger(docs), "web-v1").collect()}
    for i, text in enumerate(TEXTS):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        c = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        n = len({k + j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(8)})
        assert (got[i].n_words, got[i].n_repeat_words, got[i].base_failed) == (len(w), n, len(w) < 20 or 100 * n > 30 * len(w))
    table = {r.rule: r for r in rule_ledger.ablation(rule_ledger.ledger(docs), "base-v1").collect()}
    assert table["min_words"].fails == sum(x.n_words < 20 for x in got.values())


def test_shards(docs):
    got = histogram_sort.histogram_sort(docs, 3).collect()
    assert len(got) == len(TEXTS) + 1
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    for r in got:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))


def test_shards_split_a_hot_text_and_balance(spark):
    rows = [(i, "hot " * 20 if i % 3 == 0 else f"t{i} " * 20) for i in range(3000)]
    got = histogram_sort.histogram_sort(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    sizes = collections.Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert len(sizes) == 8 and max(sizes.values()) < 1.03 * sum(sizes.values()) / 8


@pytest.mark.parametrize("ids", ["far", "null", "equal", "extreme"])
def test_shards_split_a_hot_text_whatever_its_ids(spark, ids):
    of = {"far": lambda i: 10**15 if i == 0 else i, "null": lambda i: None, "equal": lambda i: 7, "extreme": lambda i: (-(2**63), 2**63 - 1)[i % 2] if i < 6 else i}[ids]
    rows = [(of(i) if i % 3 == 0 else i, "hot " * 20 if i % 3 == 0 else f"t{i} " * 20) for i in range(3000)]
    got = histogram_sort.histogram_sort(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 8).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(rows)
    sizes = collections.Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert len(sizes) == 8 and max(sizes.values()) < 1.03 * sum(sizes.values()) / 8
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    hot = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.text == "hot " * 20]
    assert hot == sorted(hot, key=lambda d: (d is not None, d or 0))


def test_classifier_on_held_out_rows(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 4 != 0"), labels.where("doc_id % 4 = 0")
    got = quality_classifier.classify(docs, train).join(test, "doc_id").collect()
    good = [r.kept for r in got if r.quality == 1 and r.toxic == 0]
    assert sum(good) >= 0.8 * len(good)
    whole = quality_classifier.classify(docs, labels).join(labels, "doc_id").collect()
    right = [r.kept == (r.quality == 1 and r.toxic == 0) for r in whole]
    assert sum(right) >= 0.9 * len(right)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fm_substrings.dedup_substrings(docs).count() == 0
    assert histogram_sort.histogram_sort(docs).count() == 0
    assert rule_ledger.ledger(docs).count() == 0
    assert licence_scan.scan_licences(docs).count() == 0
    assert token_files.tokenize_to_files(docs, P.path("byte_bpe_50k.json")).count() == 0
    assert quality_classifier.accept(docs, labels).count() == 0
    assert decontaminate.contamination(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_cleaning_and_shards_keep_columns_of_any_name(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"before {passage} after and then some more words follow here", 5, "x", 9, "s", 3), (2, None, 6, "y", 8, "t", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, `_rest` string, size int, shard string, slot int")
    bench = spark.createDataFrame([("i", passage)], "item_id string, text string")
    got = sorted(decontaminate.clean(docs, bench, drop_share=0.9).collect(), key=lambda x: x.doc_id)
    assert got[0].asDict() == dict(zip(docs.columns, rows[0])) | {"text": "before after and then some more words follow here"}
    assert got[1].asDict() == dict(zip(docs.columns, rows[1]))
    out = histogram_sort.histogram_sort(docs, 2)
    assert out.columns == ["doc_id", "text", "a.b", "_rest", "input_size", "input_shard", "input_slot", "size", "text_crc32", "shard", "slot"]
    assert {(x.doc_id, x["a.b"], x.input_size, x.input_shard, x.input_slot, x.size) for x in out.collect()} == {(1, 5, 9, "s", 3, len(rows[0][1]) + 1), (2, 6, 8, "t", 4, 1)}


def test_only_holders_of_hot_minimisers_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(fm_substrings, "HOT_WORDS", 40)
    r, read = random.Random(8), []
    text = lambda n: " ".join(f"v{r.randrange(10**6)}" for _ in range(n))
    passage = text(60)
    rows = [(i, f"{text(30)} {passage}" if i % 20 == 0 else text(80)) for i in range(200)]
    cut_again = fm_substrings.single_windows
    monkeypatch.setattr(fm_substrings, "hot_minimisers", lambda one: [x.mini for x in one.select("mini").distinct().collect()])
    monkeypatch.setattr(fm_substrings, "single_windows", lambda docs, hot, width: read.append(docs.count()) or cut_again(docs, hot, width))
    got = {x.doc_id: x.n_removed for x in fm_substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), 13).collect()}
    assert read == [10]
    assert got == {i: 60 if i % 20 == 0 and i else 0 for i in range(200)}


def test_ranks_of_a_wavelet_matrix():
    import numpy as np

    r = np.random.default_rng(3)
    text = r.integers(0, 37, 500)
    matrix = fm_substrings.WaveletMatrix(text, 6)
    s, i = text[r.integers(0, 500, 300)], r.integers(0, 501, 300)
    assert matrix.rank(s, i).tolist() == [int((text[:k] == c).sum()) for c, k in zip(s, i, strict=True)]
    assert matrix.begin.tolist() == matrix.place(np.arange(len(matrix.begin)), np.zeros(len(matrix.begin), dtype=np.int64)).tolist()
