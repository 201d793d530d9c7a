"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features describe its characters and words (shares of upper case,
digits, symbols and so on, word lengths, repeated words and lines), together with those of the line before
and the line after; a transition matrix ties neighbouring labels. Forward-backward gives each line's
probability of being good; a document's score is their mean, weighted by the lines' lengths. A prediction is
1 where the score reaches the threshold.

The field is fitted on a bounded sample of labelled rows (max_docs, in the order of a hash of the
identifier): lines take their document's label. Nothing but the text enters a score.

Null and empty texts are one empty line and get a score like any other. Lines and texts are taken whole.
Repeated rows get equal scores; rows with a null identifier are scored, but never learnt from. Without
labels of both kinds every score is 0.5. Extra columns are kept by score(); one named like the score is
replaced by it. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from corvane.llm.bpe_replay import blocks
from corvane.llm.common import Words, mix64, packed, unpacked, word_bytes

THRESHOLD, MAX_DOCS, ROUNDS, FOLDS = 0.3, 3000, 250, 5
SPACED = word_bytes([(0, 9), (14, 32), (33, 256)])

#: Kinds of bytes whose share of a line is a feature (fixed values).
KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t",
    "stop": b".",
    "comma": b",;:",
    "shout": b"!?",
    "bar": b"|",
    "mark": b"*#$%&@^~",
    "bracket": b"<>{}[]()\\/=+_",
    "quote": b"\"'`-",
    "high": bytes(range(128, 256)),
}
TABLES = np.array([np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for v in KINDS.values()])
OWN = len(KINDS) + 11


@dataclass
class Lines:
    x: np.ndarray  # a row of features for each line, with its neighbours'
    weight: np.ndarray  # length in bytes
    first: np.ndarray  # document n has the lines first[n] to first[n + 1]


def lines_of(column: pa.Array) -> Lines:
    w = Words(column, SPACED)
    raw, offsets = w.raw, w.offsets
    breaks = np.flatnonzero(raw == 10)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    end = np.sort(np.concatenate([breaks, offsets[1:]]))
    first = np.concatenate([[0], np.cumsum(1 + np.diff(np.searchsorted(breaks, offsets)))])
    n, size = len(start), end - start
    length = np.maximum(size, 1)
    own = np.zeros((n, OWN))
    for k, table in enumerate(TABLES):
        total = np.concatenate([[0], np.cumsum(table[raw], dtype=np.int32)])
        own[:, k] = (total[end] - total[start]) / length
    at = np.searchsorted(w.begin, start)
    to = np.searchsorted(w.begin, end)
    words = to - at
    some = np.maximum(words, 1)
    line_of_word = np.repeat(np.arange(n), words)
    again = np.zeros(len(w.hash), bool)
    if len(again):
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (line_of_word[1:] == line_of_word[:-1])
    per = lambda mask: np.bincount(line_of_word, weights=mask, minlength=n)
    distinct = np.unique(mix64(w.hash ^ (line_of_word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)[1]
    letters = w.end - w.begin
    odd_end = TABLES[[6, 8]].any(axis=0)[raw[w.end - 1]] if len(letters) else np.zeros(0)
    key = np.zeros(n, np.uint64)
    np.add.at(key, line_of_word, mix64(w.hash + (np.arange(len(w.hash)) - np.repeat(at, words)).astype(np.uint64)))
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    _, group, count = np.unique(mix64(key ^ doc.astype(np.uint64)), return_inverse=True, return_counts=True)
    own[:, len(KINDS) :] = np.stack(
        [
            np.log1p(size) / 8,
            np.log1p(words) / 5,
            np.minimum(per(letters) / some, 40) / 10,
            per(again) / some,
            np.bincount(line_of_word[distinct], minlength=n) / some,
            per(odd_end) / some,
            per(letters == 1) / some,
            per(letters > 14) / some,
            (count[group] > 1) & (words > 0),
            size == 0,
            np.log1p(np.diff(first))[doc] / 5,
        ],
        axis=1,
    )
    edge = np.zeros((n, 2))
    edge[first[:-1], 0] = edge[first[1:] - 1, 1] = 1
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[edge[:, 0] == 1] = after[edge[:, 1] == 1] = 0
    return Lines(np.concatenate([own, before, after, edge], axis=1), length.astype(float), first)


def chains(first: np.ndarray) -> list[np.ndarray]:
    """By step: the lines at that place of their documents, longest documents first."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    live = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
    return [begin[:k] + t for t, k in enumerate(live)]


def forward_backward(good: np.ndarray, trans: np.ndarray, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """P(line is good), and the expected transitions by line (from the line before it); good: log-odds."""
    n = len(good)
    g = np.clip(good, -30, 30)
    emit = np.stack([np.exp(-np.maximum(g, 0)), np.exp(np.minimum(g, 0))], axis=1)
    m = np.exp(trans)
    ahead, back, pair = np.empty((n, 2)), np.ones((n, 2)), np.zeros((n, 2, 2))
    for t, at in enumerate(steps):
        a = emit[at] if t == 0 else (ahead[steps[t - 1][: len(at)]] @ m) * emit[at]
        ahead[at] = a / a.sum(axis=1, keepdims=True)
    for t in range(len(steps) - 1, 0, -1):
        at, was = steps[t], steps[t - 1][: len(steps[t])]
        b = emit[at] * back[at]
        p = ahead[was][:, :, None] * m * b[:, None, :]
        pair[at] = p / p.sum(axis=(1, 2), keepdims=True)
        b = b @ m.T
        back[was] = b / b.sum(axis=1, keepdims=True)
    p = ahead * back
    return p[:, 1] / p.sum(axis=1), pair


@dataclass
class Field:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    trans: np.ndarray

    def score(self, column: pa.Array) -> np.ndarray:
        if not len(column):
            return np.zeros(0)
        lines = lines_of(column)
        p, _ = forward_backward(((lines.x - self.mean) / self.scale) @ self.weight + self.bias, self.trans, chains(lines.first))
        return np.add.reduceat(p * lines.weight, lines.first[:-1]) / np.add.reduceat(lines.weight, lines.first[:-1])


def train(texts: list[str | None], labels: list[int], rounds: int = ROUNDS) -> Field:
    """Maximum conditional likelihood of the line labels, each document with the same weight, by Adam."""
    width = 3 * OWN + 2
    field = Field(np.zeros(width), np.ones(width), np.zeros(width), 0.0, np.zeros((2, 2)))
    if len(set(labels)) < 2:
        return field
    lines = lines_of(pa.array(texts, pa.string()))
    size = np.diff(lines.first)
    y = np.repeat(np.array(labels, float), size)
    share = np.repeat(1 / size, size) / len(size)
    field.mean, field.scale = lines.x.mean(axis=0), lines.x.std(axis=0) + 1e-3
    x, steps = (lines.x - field.mean) / field.scale, chains(lines.first)
    follows = np.ones(len(y), bool)
    follows[lines.first[:-1]] = False
    kept = np.zeros((len(y), 2, 2))
    kept[np.flatnonzero(follows), y[follows].astype(int), y[follows].astype(int)] = 1
    theta = np.zeros(width + 5)
    m = v = np.zeros_like(theta)
    for k in range(1, rounds + 1):
        p, pair = forward_backward(x @ theta[:width] + theta[width], theta[width + 1 :].reshape(2, 2), steps)
        err = (y - p) * share
        grad = np.concatenate([x.T @ err - 1e-4 * theta[:width], [err.sum()], ((kept - pair) * share[:, None, None]).sum(axis=0).ravel() - 1e-3 * theta[width + 1 :]])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    field.weight, field.bias, field.trans = theta[:width], float(theta[width]), theta[width + 1 :].reshape(2, 2)
    return field


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, *, max_docs: int = MAX_DOCS, rounds: int = ROUNDS) -> Field:
    """Fit on at most max_docs labelled rows that are not held out."""
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).select("doc_id", "quality")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).dropDuplicates(["doc_id"])
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(max_docs).collect()
    return train([r["text"] for r in rows], [r["quality"] for r in rows], rounds)


def score(docs: DataFrame, field: Field, *, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """docs with the score, which replaces a column of that name; no shuffle."""
    rows = packed(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(field.score(b.column("text")), pa.float64())], names=["row", "text", score_col])

    scored = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(score_col, DoubleType())]))
    return unpacked(scored, docs.columns, text_col, own=(score_col,))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    field = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, field, score_col="score")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
