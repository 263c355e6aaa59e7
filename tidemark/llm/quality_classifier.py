"""Operator 8, quality classifier: hierarchical empirical Bayes over documents, paths and hosts.

A document's own evidence is the log odds of a hashed naive Bayes model plus a few shape features, trained here by logistic
regression on labelled rows. Expected bad counts of sites come from grouped aggregation: a host's rate is shrunk toward the
global rate, a path's toward its host's, each with a prior strength fitted by moments: the spread within groups over the
spread between them. A document's prior is its path's shrunk rate without the document itself, so that its own evidence counts
once; its posterior is the evidence at that prior. Sparse sites so lean on the prior above. The documents have no url: the host
is their source, and the finest site below it is the source's part in one language.

Training reads at most TRAIN_ROWS labelled documents, chosen by a hash of doc_id: a documented bound. Their features, at most
2**BITS numbers a document, reach the driver as Arrow columns and stay arrays of 4 bytes a feature; so do a few sums for the
priors. Everything else, the scores and the sites' counts, covers all rows and stays distributed; site tables join back by
key, a hot host being one row of its side.

Defined cases: a null or empty text has only its shape as evidence; null hosts and paths form groups of their own; labels
that repeat count each time; without labels, or of one class only, the evidence is 0 and the prior global; equal posteriors get
equal verdicts; repeated rows get a row each; a null doc_id is classified but never a training row; an empty table gives no
rows; other columns pass through `accept` untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD_TABLE, column, cut

BITS = 18
TRAIN_ROWS = 20_000
REJECT = 0.5  # posterior of being bad, from which a document goes
EPOCHS = 8
LEAST_SHARE = 0.0025  # of the labelled documents that a bucket's words must be in, for the bucket to have a weight
PREFIXES = (4, 5)
SHAPES = 8


def features(text: bytes):
    """(buckets of the text's distinct folded words and of their first PREFIXES bytes, shape values), in the text's length."""
    import zlib

    words = text.translate(FOLD_TABLE).split()
    own = set(words)
    n = max(1, len(words))
    raw = max(1, len(text))
    upper = sum(text.count(b) for b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") if raw else 0
    symbols = sum(text.count(b) for b in b"#*$%&|<>")
    shape = [1.0 - len(own) / n, upper / raw, symbols / n, text.count(b"!") / n, len(text) / n / 10, 1.0 if n < 20 else 0.0, text.count(b"\n") / n, math.log1p(n) / 10]
    # Inflected forms share their stem, so a prefix tells of words that the labels don't show.
    stems = {w[:n] + b"-" for n in PREFIXES for w in own if len(w) > n}
    return [zlib.crc32(w) & ((1 << BITS) - 1) for w in (*own, *stems)], shape


class Model:
    """Word weights and shape weights; the score is log odds of bad without the training prior."""

    def __init__(self, words, shapes, bias: float):
        self.words, self.shapes, self.bias = words, shapes, bias

    def score(self, text: bytes) -> float:
        import numpy as np

        at, shape = features(text)
        return float(self.words[at].sum() + np.dot(self.shapes, shape) + self.bias)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Logistic regression by AdaGrad on a bounded sample of labelled rows; bad: low quality or toxic."""
    import numpy as np
    import pyarrow as pa

    marked = labels.select(F.col("doc_id").alias("_id"), (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad")).where(F.col("_id").isNotNull())
    some = marked.orderBy(F.xxhash64("_id"), "_id", "bad").limit(TRAIN_ROWS)
    sample = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).join(F.broadcast(some), F.col("doc_id") == F.col("_id"))

    def lean(batches):
        import pyarrow as pa

        for b in batches:
            got = [features(x) for x in b.column(1).to_pylist()]
            own = pa.array([np.unique(np.array(g[0], dtype=np.int32)) for g in got], type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), own, pa.array([g[1] for g in got], type=pa.list_(pa.float64()))], names=["doc_id", "bad", "w", "s"])

    got = sample.select("doc_id", "text", "bad").mapInArrow(lean, "doc_id long, bad boolean, w array<int>, s array<double>").toArrow()
    order = np.lexsort((got.column("bad").to_numpy(), got.column("doc_id").to_numpy())) if len(got) else []
    y = got.column("bad").to_numpy().astype(np.float64)
    words, shapes = np.zeros(1 << BITS), np.zeros(SHAPES)
    if not len(got) or not 0 < y.sum() < len(y):
        return Model(words, shapes, 0.0)
    own = np.concatenate([c.flatten().to_numpy() for c in got.column("s").chunks]).reshape(-1, SHAPES)
    seen = np.zeros(1 << BITS, dtype=np.int64)
    for c in got.column("w").chunks:
        seen += np.bincount(c.flatten().to_numpy(), minlength=1 << BITS)
    frequent = seen >= max(1, LEAST_SHARE * len(y))
    ends, kept = [np.zeros(1, np.int64)], []
    for c in got.column("w").chunks:  # a chunk's features at a time, so that the whole is held once
        at = c.flatten().to_numpy()
        stays = np.concatenate([[0], np.cumsum(frequent[at], dtype=np.int64)])
        ends.append(ends[-1][-1] + stays[c.offsets.to_numpy()[1:] - c.offsets.to_numpy()[0]])
        kept.append(at[frequent[at]])
    del got
    pa.default_memory_pool().release_unused()
    ends, kept = np.concatenate(ends), np.concatenate(kept)
    data = [(kept[ends[i] : ends[i + 1]], own[i], y[i]) for i in order]
    gw, gs, bias, gb = np.full(1 << BITS, 1e-2), np.full(SHAPES, 1e-2), 0.0, 1e-2
    rng = np.random.default_rng(8)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(data)):
            at, s, good = data[i]
            z = words[at].sum() + shapes @ s + bias
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - good
            if abs(g) < 1e-3:
                continue
            gw[at] += g * g
            words[at] -= 0.1 * g / np.sqrt(gw[at])
            gs += (g * s) ** 2
            shapes -= 0.1 * g * s / np.sqrt(gs)
            gb += g * g
            bias -= 0.1 * g / math.sqrt(gb)
    return Model(words.astype(np.float32), shapes, bias - math.log(y.sum() / (len(y) - y.sum())))


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, host, path and evidence (log odds of bad without a prior), for every row."""
    weights, shapes, bias = docs.sparkSession.sparkContext.broadcast(model.words), model.shapes, model.bias  # 1 MB by the model's size

    def apply(batches):
        import pyarrow as pa

        m = Model(weights.value, shapes, bias)
        for b in batches:
            scores = pa.array([m.score(x) for x in b.column(1).to_pylist()], type=pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), scores], names=["_key", "host", "path", "evidence"])

    host = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    own = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("_key"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), host.cast("string").alias("host"), lang.cast("string").alias("path"))
    return own.mapInArrow(apply, "_key struct<doc_id:bigint,h:bigint>, host string, path string, evidence double")


def strength(groups: DataFrame, mean: float) -> float:
    """Prior strength by moments, from groups' sums b of p, q of p squared and counts n: variance within groups over variance between them."""
    n, b, q = (F.col(c) for c in ("n", "b", "q"))
    total, within, spread, squares, count = groups.agg(F.sum(n), F.sum(q - b * b / n), F.sum(n * F.pow(b / n - mean, 2)), F.sum(n.cast("double") * n), F.count("*")).first()
    if not count or count < 2 or total <= count:
        return 100.0
    noise = max(0.0, within / (total - count))
    between = (spread - (count - 1) * noise) / (total - squares / total)
    return min(1e4, max(1.0, noise / between)) if between > 1e-9 else 1e4


def posteriors(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """_key, host, path, evidence, host_rate, path_rate (the shrunk prior) and posterior of being bad, for every row of docs."""
    return shrink(cut(evidence(docs, model or fit(docs, labels)), "evidence"))


def shrink(scored: DataFrame) -> DataFrame:
    """Rows with a host, a path and an evidence get host_rate, path_rate and posterior: the empirical Bayes step."""
    capped = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("evidence")))
    scored = scored.withColumn("_e", capped).withColumn("_p", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_e"))))
    paths = cut(scored.groupBy("host", "path").agg(F.sum("_p").alias("b"), F.sum(F.col("_p") * F.col("_p")).alias("q"), F.count("*").alias("n")), "paths")
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in "bqn"])
    b, n = hosts.agg(F.sum("b"), F.sum("n")).first()
    mean = (b / n) if n else 0.5
    s_host, s_path = strength(hosts, mean), strength(paths, mean)
    sites = paths.join(hosts.select(F.col("host").alias("_g"), F.col("b").alias("_hb"), F.col("n").alias("_hn")), F.col("host").eqNullSafe(F.col("_g"))).select(F.col("host").alias("_h"), F.col("path").alias("_q"), F.col("b").alias("_pb"), F.col("n").alias("_pn"), "_hb", "_hn")
    both = scored.join(sites, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_q")))
    # the row's own share is taken out of either level
    host_rate = (F.col("_hb") - F.col("_p") + mean * s_host) / (F.col("_hn") - 1 + s_host)
    rated = both.withColumn("host_rate", host_rate).withColumn("path_rate", (F.col("_pb") - F.col("_p") + F.col("host_rate") * s_path) / (F.col("_pn") - 1 + s_path))
    safe = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col("path_rate")))
    posterior = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("_e") + F.log(safe / (F.lit(1.0) - safe)))))
    return rated.select("_key", "host", "path", "evidence", "host_rate", "path_rate", posterior.alias("posterior"))


def classify(docs: DataFrame, labels: DataFrame, reject: float = REJECT, model: Model | None = None) -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, posterior and kept, a row per document."""
    out = posteriors(docs, labels, model)
    return out.select(F.col("_key.doc_id").alias("doc_id"), "evidence", "host_rate", "path_rate", "posterior", (F.col("posterior") < reject).alias("kept"))


def accept(docs: DataFrame, labels: DataFrame, reject: float = REJECT, model: Model | None = None) -> DataFrame:
    """The rows of docs that the classifier keeps, with their own columns."""
    out = posteriors(docs, labels, model).where(F.col("posterior") >= reject).select(F.col("_key.doc_id").alias("_tm_id"), F.col("_key.h").alias("_tm_g")).distinct()
    keyed = docs.withColumns({"_tm_h": F.xxhash64("text")})
    return keyed.join(out, (F.col("_tm_h") == F.col("_tm_g")) & F.col("doc_id").eqNullSafe(F.col("_tm_id")), "left_anti").select(*[column(docs, c) for c in docs.columns])
