"""Toxicity by multiple-instance learning: sentences are scored, a noisy-or makes them a document's score.

Only documents have labels. A sentence's logit is a bias plus the weights of its words (hashed words and their first
four to six letters, of which training keeps those that lean clearly to label 1); P(document) = 1 - product of
(1 - P(sentence)). The likelihood of the document labels is climbed by Adam over a bounded sample of labelled rows
(`TRAIN_DOCS`, those with the smallest hashes), so offending sentences are located without sentence labels. All documents
are scored whole.

Executors read the texts that are trained on: they count in how many documents of each label a feature is, and then
reduce every document to the features that lean to label 1, sentence by sentence. The driver gets these, not texts.

Defined cases: null or empty text counts as one sentence without words; sentences end at . ! ? and line breaks; words
are runs of letters in lower case; texts of any length are scored whole; of several labels for one doc_id the largest
counts, rows without one are not used; of several texts for one doc_id the smallest is trained on, each is scored; with no
labels at all every weight is 0; repeated rows are each scored; an empty table gives an empty result; `score` keeps
further columns, but for those named score and offending, which it replaces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Numbered, Scratch, blocks, small_batches, table

TRAIN_DOCS = 6000
BUCKETS = 1 << 18
STEPS, RATE, PENALTY = 120, 0.1, 1e-4
LEAST_DOCS, LEAST_Z = 3, 4.5  # of a feature: training documents that have it, standard errors above the base rate of label 1
THRESHOLD = 0.3
BLOCK_BYTES = 2 << 20
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
ENDS = ".!?\n"


def _buckets(words: list[str]) -> np.ndarray:
    """Four feature buckets of each word: itself and its first 4, 5 and 6 letters."""
    crc = zlib.crc32
    return np.array([[crc(w.encode()), crc(b"4" + w[:4].encode()), crc(b"5" + w[:5].encode()), crc(b"6" + w[:6].encode())] for w in words], np.int64).reshape(-1, 4) % BUCKETS


def _laid_out(texts: list[str | None]):
    """Distinct words, then of every word in the block its number and sentence, and of every sentence its document."""
    index = Numbered({e: i for i, e in enumerate(ENDS)})
    ids = [np.fromiter(map(index.__getitem__, TOKEN.findall((t or "").lower())), np.int64) for t in texts]
    sizes = np.array([len(x) + 1 for x in ids], np.int64)
    flat = np.zeros(int(sizes.sum()), np.int64)  # an end mark stands behind every document
    ends = np.cumsum(sizes)
    if len(texts):
        inside = np.ones(len(flat), bool)
        inside[ends - 1] = False
        flat[inside] = np.concatenate(ids)
    mark = flat < len(ENDS)
    sentence = np.cumsum(mark) - mark
    doc = np.repeat(np.arange(len(texts)), sizes)[mark]
    return list(index)[len(ENDS) :], (flat[~mark] - len(ENDS)).astype(np.int32), sentence[~mark].astype(np.int32), doc


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def sentences(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Probability and document of every sentence."""
        words, word, sentence, doc = _laid_out(texts)
        value = self.weights[_buckets(words)].sum(axis=1, dtype=np.float64)
        z = self.bias + np.bincount(sentence, value[word] if len(word) else None, minlength=len(doc))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40))), doc

    def documents(self, p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        return -np.expm1(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))


def counted(texts: list[str | None], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, and how many of the documents, and of those with label 1, have each."""
    words, word, sentence, doc = _laid_out(texts)
    features, of = _buckets(words), doc[sentence]
    pairs = np.unique(of * np.int64(len(words) + 1) + word)
    held = np.unique((pairs // (len(words) + 1))[:, None] * BUCKETS + features[pairs % (len(words) + 1)])
    found, place = np.unique(held % BUCKETS, return_inverse=True)
    return found, np.bincount(place), np.bincount(place, toxic[held // BUCKETS]).astype(np.int64)


def leaning(count: np.ndarray, toxic: np.ndarray, rate: float, least: int = LEAST_DOCS, least_z: float = LEAST_Z) -> np.ndarray:
    """Whether features have documents of label 1 well beyond the base rate."""
    rate = np.clip(rate, 1e-6, 1 - 1e-6)
    return (count >= least) & (toxic - count * rate >= least_z * np.sqrt(count * rate * (1 - rate)))


def reduced(texts: list[str | None], used: np.ndarray) -> list[dict[tuple[int, ...], int]]:
    """Of each document its sentences, as the used features they have (with repeats), and how many are alike."""
    words, word, sentence, doc = _laid_out(texts)
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    of_word = place[_buckets(words)]
    at, which = np.nonzero(of_word[word] >= 0)
    at_sentence, feature = sentence[at], of_word[word[at], which]
    out: list[dict[tuple[int, ...], int]] = [{} for _ in texts]
    plain = np.bincount(doc, minlength=len(texts))
    cuts = np.flatnonzero(np.diff(at_sentence, prepend=-1, append=len(doc)))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        d, key = int(doc[at_sentence[lo]]), tuple(sorted(feature[lo:hi].tolist()))
        out[d][key] = out[d].get(key, 0) + 1
        plain[d] -= 1
    for d, n in enumerate(plain.tolist()):
        if n:
            out[d][()] = n
    return out


def fit(docs: list[dict[tuple[int, ...], int]], labels: np.ndarray, used: np.ndarray, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> Model:
    """Maximum likelihood of document labels under the noisy-or. docs: what `reduced` gives for the features `used`."""
    if not docs:
        return Model(np.zeros(BUCKETS), -5.0)
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    alike = np.array([n for d in docs for n in d.values()], np.float64)
    keys = [k for d in docs for k in d]
    sentence = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    feature = np.array([f for k in keys for f in k], np.int64)
    n, k, y = len(docs), len(used), labels.astype(np.float64)
    w, b = np.zeros(k), -5.0
    m, v, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    for step in range(1, steps + 1):
        z = b + np.bincount(sentence, w[feature], minlength=len(keys))
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        log_none = np.bincount(doc, alike * np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n)
        whole = np.maximum(-np.expm1(log_none), 1e-9)
        up = alike * p * np.where(y == 1, np.exp(log_none) / whole, -1.0)[doc]
        g = np.bincount(feature, up[sentence], minlength=k) / n - penalty * w
        gb = up.sum() / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w += rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b += rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[used] = w
    return Model(weights, b)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> Model:
    """Fit on at most `limit` labelled documents that aren't held out. What comes to the driver is bounded: a row for each
    feature that leans to label 1 (of BUCKETS at most), and each document's sentences with such features, alike ones once."""
    scratch = Scratch(docs.sparkSession)
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    texts = scratch.write(texts, "trained")
    n, rate = texts.agg(F.count(F.lit(1)), F.avg("toxic")).first()
    column = lambda block, name: block.column(block.schema.get_field_index(name))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            found = counted(column(block, "text").to_pylist(), column(block, "toxic").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["feature", "n", "toxic"])

    held = small_batches(texts).mapInArrow(counts, "feature long, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    held = held.where(F.col("n") >= LEAST_DOCS).toPandas().sort_values("feature") if n else None
    used = held["feature"].to_numpy()[leaning(held["n"].to_numpy(), held["toxic"].to_numpy(), rate)] if n else np.zeros(0, np.int64)

    def sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            found = reduced(column(block, "text").to_pylist(), used)
            lists = [pa.array([list(map(list, d)) for d in found], pa.list_(pa.list_(pa.int32()))), pa.array([list(d.values()) for d in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([column(block, "doc_id"), column(block, "toxic"), *lists], ["doc_id", "toxic", "features", "alike"])

    rows = small_batches(texts.select(F.col("doc_id").cast("long"), "toxic", "text")).mapInArrow(sentences, "doc_id long, toxic int, features array<array<int>>, alike array<long>")
    rows = sorted(rows.collect(), key=lambda r: r.doc_id)
    scratch.drop("trained")
    docs_ = [dict(sorted((tuple(f), a) for f, a in zip(r.features, r.alike, strict=True))) for r in rows]
    return fit(docs_, np.array([r.toxic for r in rows]), used)


def offending(text: str, p: np.ndarray, threshold: float) -> list[dict]:
    """Start, end (code points) and probability of the sentences at the threshold or above."""
    found, start, k = [], 0, 0
    for end in (*(m.start() for m in re.finditer(r"[.!?\n]", text)), len(text)):
        if p[k] >= threshold:
            found.append({"start": start, "end": end, "score": float(p[k])})
        start, k = end + 1, k + 1
    return found


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with score and offending, the sentences that make it (none below the threshold)."""
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    added = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("offending", spans)])
    docs = docs.drop(*added.names)
    schema = T.StructType([*docs.schema.fields, *added.fields])
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for block in blocks(batches, "text", BLOCK_BYTES):
            texts = block.column(block.schema.get_field_index("text")).to_pylist()
            p, doc = own.sentences(texts)
            scores = own.documents(p, doc, len(texts))
            cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
            located = [offending(t or "", p[cuts[i] : cuts[i + 1]], threshold) if scores[i] >= threshold else [] for i, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(scores), pa.array(located, arrow)], [*block.schema.names, *added.names])

    return small_batches(docs).mapInArrow(run, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending"
    )
