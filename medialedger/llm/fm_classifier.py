"""Quality scores by a factorisation machine over hashed words, structure statistics and the text's length.

Pairwise interactions have low rank and are summed in linear time: half of the squared sums minus the summed squares.
The machine is fitted on the driver from the sparse features of a bounded sample of labelled texts; scoring runs in the
tasks over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialedger.llm.quality_rules import count_features
from medialedger.llm.wordscan import scan_words, slices

WORDS = 1 << 12
STATS = 10
_ROWS = 256


def features(column: pa.Array) -> np.ndarray:
    """(texts, WORDS + STATS) of float32: hashed word weights of unit length per text, then bounded statistics."""
    words = scan_words(column, fold=True)
    n = len(column)
    cells = words.row * WORDS + (words.hash >> np.uint64(52)).astype(np.int64)
    x = np.zeros((n, WORDS + STATS), dtype=np.float32)
    weights = np.log1p(np.bincount(cells, minlength=n * WORDS).reshape(n, WORDS).astype(np.float32))
    x[:, :WORDS] = weights / np.maximum(np.sqrt((weights**2).sum(axis=1, keepdims=True)), 1e-6)
    c = count_features(column)
    per_word, per_char = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    stats = [
        c["n_symbols"] / per_word, c["n_marks"] / per_word, c["n_upper"] / per_char, c["n_repeat_words"] / per_word,
        c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["word_chars"] / per_word / 8, np.log1p(c["n_words"]) / 6,
        np.log1p(c["word_chars"]) / 8, c["n_lines"] / per_word * 5, c["n_words"] < 50,
    ]
    x[:, WORDS:] = np.clip(np.column_stack(stats), 0, 2)
    return x


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        sums = x @ self.factors
        return self.bias + x @ self.linear + 0.5 * ((sums**2).sum(axis=1) - (x**2) @ (self.factors**2).sum(axis=1))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(np.float64), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rank: int = 8, epochs: int = 30, batch: int = 256, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Adam on the logistic loss. Without examples, or with one class alone, only the bias tells what was seen."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    share = (y.sum() + 1) / (len(y) + 2)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(d, np.float32), rng.normal(0, 0.02, (d, rank)).astype(np.float32))
    if len(y) == 0 or len(np.unique(y)) < 2:
        return Machine(m.bias, m.linear, 0 * m.factors)
    moments = [np.zeros((2, *p.shape), np.float32) for p in (m.linear, m.factors)] + [np.zeros(2)]
    step = 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            step += 1
            xb = x[rows]
            g = ((m.scores(xb) - y[rows]) / len(rows)).astype(np.float32)
            sums = xb @ m.factors
            grads = [
                xb.T @ g + decay * m.linear,
                xb.T @ (g[:, None] * sums) - m.factors * ((xb**2).T @ g)[:, None] + decay * m.factors,
                float(g.sum()),
            ]
            moves = []
            for grad, mom in zip(grads, moments, strict=True):
                mom[0] = 0.9 * mom[0] + 0.1 * grad
                mom[1] = 0.99 * mom[1] + 0.01 * np.square(grad)
                moves.append(rate * (mom[0] / (1 - 0.9**step)) / (np.sqrt(mom[1] / (1 - 0.99**step)) + 1e-8))
            m.linear -= moves[0]
            m.factors -= moves[1]
            m.bias -= float(moves[2])
    return m


def held_out(doc_id) -> F.Column:
    """Rows that no label is learned from: the CRC-32 of the id as text leaves no rest by five."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, **options) -> Machine:
    """Fit on at most ``max_rows`` labelled documents outside the held-out fold, chosen by a hash of their ids.

    The chosen ids (a bounded table) are broadcast; only the sparse features of their texts reach the driver.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").alias("quality"))
    chosen = known.where(~held_out("doc_id")).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), "text", 1 << 20):
                for at in range(0, len(part), _ROWS):
                    piece = part.slice(at, _ROWS)
                    x = features(piece.column("text"))
                    row, cell = np.nonzero(x)
                    cuts = np.searchsorted(row, np.arange(1, len(piece)))
                    cells = [c.astype(np.uint16).tobytes() for c in np.split(cell, cuts)]
                    values = [v.tobytes() for v in np.split(x[row, cell], cuts)]
                    columns = [piece.column("doc_id"), piece.column("quality").cast(pa.int32()), pa.array(cells, pa.binary()), pa.array(values, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "quality", "cells", "values"])

    found = rows.mapInArrow(sparse, "doc_id bigint, quality int, cells binary, values binary")
    # Of several texts with one id always the same one is taken.
    sample = found.groupBy("doc_id").agg(F.min(F.struct("quality", "cells", "values")).alias("r")).select("doc_id", "r.*").collect()
    sample.sort(key=lambda r: r["doc_id"])
    x = np.zeros((len(sample), WORDS + STATS), dtype=np.float32)
    for i, r in enumerate(sample):
        x[i, np.frombuffer(r["cells"], np.uint16)] = np.frombuffer(r["values"], np.float32)
    return fit(x, np.array([r["quality"] for r in sample], dtype=np.float32), **options)


def score(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text).

    Null and empty texts have no words and are scored by their statistics; rows that repeat get equal scores, a null id is
    not held out, extra columns are ignored, an empty table gives no rows.
    """

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            for at in range(0, len(part), _ROWS):
                piece = part.slice(at, _ROWS)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(machine.scores(features(piece.column("text"))))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    rated = rows.mapInArrow(rate, "doc_id bigint, score double")
    return rated.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
