"""Quality classifier on supervised subword embeddings.

A document is a bag of hashed features: its words, pairs of neighbouring words (a word and itself again is one
feature, whatever the word), and the character n-grams of its words with their edges marked. Each feature has a learned vector; the mean of a document's vectors goes through a
softmax. Vectors and softmax are trained together by stochastic gradient descent in numpy.

Training reads at most ``max_rows`` labelled documents with whole texts, the first in the order of a hash of their id, so its
cost doesn't grow with the corpus. Everything else covers all rows: scoring is one narrow pass. As the mean and the
layer before the softmax are linear, the trained model is folded into one number per feature first; a document's score
needs no vectors.

Defined cases: a null text is scored as the empty text, which has one feature of its own; labels that contradict each
other count as 0; labels without a document, null labels and null ids are not used; without labels of both kinds
every score is the share of label 1 (0.5 without labels); other columns of the input never enter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from threatlake.llm.common import PLACE, U64, expand, mixed, prefix_hash, span_hash, text_blocks, text_of, word_spans

BUCKETS = 1 << 16
WIDTH = 8
GRAMS = (2, 3)
AGAIN = PLACE[21]
MAX_ROWS, EPOCHS, BATCH, RATE = 4000, 12, 16, 0.5
THRESHOLD = 0.3


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature of each occurrence, text of each occurrence)."""
    starts, ends, firsts = word_spans(data, offsets)
    texts = np.arange(len(offsets) - 1)
    owner = np.repeat(texts, np.diff(firsts))
    prefix = prefix_hash(data)
    with np.errstate(over="ignore"):
        words = span_hash(prefix, starts, ends)
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        pairs = mixed(words[pair] * PLACE[0] + words[pair + 1] * PLACE[1])
        pairs[words[pair] == words[pair + 1]] = AGAIN
        found, whose = [words, pairs, mixed(PLACE[20] + np.zeros(len(texts), np.uint64))], [owner, owner[pair], texts]
        size = ends - starts
        for n in GRAMS:
            count = np.maximum(size - n + 1, 0)
            at = expand(starts, count)
            last = np.repeat(ends, count) == at + n
            head = np.repeat(starts, count) == at
            place = head.astype(np.uint64) * PLACE[10] + last.astype(np.uint64) * PLACE[11] + PLACE[n]
            found.append(mixed(span_hash(prefix, at, at + n) + place))
            whose.append(np.repeat(owner, count))
    return (np.concatenate(found) & U64(BUCKETS - 1)).astype(np.int32), np.concatenate(whose)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document as its distinct features and their shares."""
    for batch in batches:
        for first, data, offsets in text_blocks(batch.column("text")):
            feature, whose = features(data, offsets)
            n = len(offsets) - 1
            ids, shares = [], []
            order = np.argsort(whose, kind="stable")
            cuts = np.searchsorted(whose[order], np.arange(n + 1))
            for a, b in zip(cuts[:-1], cuts[1:]):
                count = np.bincount(feature[order[a:b]], minlength=BUCKETS)
                some = np.flatnonzero(count)
                ids.append(some.astype(np.uint16).tobytes())
                shares.append((count[some] / (b - a)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, n), batch.column("label").slice(first, n), pa.array(ids, pa.binary()), pa.array(shares, pa.binary())],
                ["doc_id", "label", "ids", "shares"],
            )


def descend(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Train vectors and softmax; returns (number per feature, bias): the logit of label 1 is the bias plus the mean of the numbers."""
    rng = np.random.Generator(np.random.PCG64(seed))
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
    target = np.eye(2, dtype=np.float32)[labels]
    steps, done = EPOCHS * -(-len(bags) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = np.stack([bags[i][1] @ vectors[bags[i][0]] for i in some])
            z = hidden @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            off = p - target[some]
            back = off @ layer.T
            layer -= rate * hidden.T @ off / len(some)
            bias -= rate * off.mean(0)
            for i, g in zip(some, back):
                ids, share = bags[i]
                vectors[ids] -= (rate * SPREAD * share)[:, None] * g
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float64), float(bias[1] - bias[0])


#: A step on the vectors counts this much more, as each feature has a small share of its document.
SPREAD = 20.0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float]:
    """Fit on the labelled documents outside the held-out fold, ``max_rows`` of them at most."""
    spark = docs.sparkSession
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold_of(F.col("doc_id")) != 0))
    chosen = chosen.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")  # max_rows rows of two numbers
    bags = texts.mapInArrow(_bags, "doc_id long, label int, ids binary, shares binary")
    rows = sorted(bags.toLocalIterator(), key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[2]))
    y = np.array([r[1] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return np.zeros(BUCKETS), float(np.log(share / (1 - share)))
    return descend([(np.frombuffer(r[2], np.uint16).astype(np.int64), np.frombuffer(r[3], np.float32)) for r in rows], y)


def _score(batches: Iterator[pa.RecordBatch], model, names: list[str]) -> Iterator[pa.RecordBatch]:
    numbers, bias = model.value
    for batch in batches:
        scores = np.zeros(batch.num_rows)
        for first, data, offsets in text_blocks(batch.column(batch.num_columns - 1)):
            feature, whose = features(data, offsets)
            n = len(offsets) - 1
            total = np.bincount(whose, numbers[feature], n) / np.bincount(whose, minlength=n)
            scores[first : first + n] = 1 / (1 + np.exp(-np.clip(total + bias, -700, 700)))
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) - 1], pa.array(scores)], names)


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str], name: str = "score") -> DataFrame:
    """Columns ``keep`` of ``docs`` and the score (0 to 1). The model has a fixed size: BUCKETS numbers."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep)
    rows = kept if keep[-1:] == ["text"] else docs.select(*keep, text_of().alias("_text"))
    return rows.mapInArrow(partial(_score, model=held, names=[*keep, name]), T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())]))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted 1, with their columns."""
    keep = [*(c for c in docs.columns if c != "text"), "text"]
    return score(docs, train(docs, labels), keep, "_quality_score").where(F.col("_quality_score") >= THRESHOLD).select(*docs.columns)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    scored = score(docs, train(docs, labels), ["doc_id"])
    held_out = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
