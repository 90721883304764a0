"""Quality rules with risk-controlled cutoffs.

Every document gets counts of its words, symbols, repeated lines and repeated word windows, and from them a level: how
strict the rules must be before one of them rejects it. Labelled documents show, for each stratum (language), how many
good ones each level would reject; exact binomial tests in fixed order, from lax to strict, with the error rate divided
by the number of strata, select the strictest level whose false rejection rate is certified.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialedger.llm.store import discard, materialize, small
from medialedger.llm.wordscan import _BYTE, IS_WORD, bytes_hash, distinct_rows, mix, scan_words, slices, windows

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines")
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[np.frombuffer(b"!?@^_~=+/\\{}[]", dtype=np.uint8)] = True
_U = np.uint64
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
#: Lines are hashed together in runs of this many bytes at most.
_RUN = 1 << 20


def _line_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each line. Lines are taken in runs of bounded size, and one that is longer than a run in steps of that size, so
    that memory stays bounded in texts and lines of any length; a line's hash depends on its bytes alone."""
    out = np.zeros(len(starts), dtype=np.uint64)
    for i in np.flatnonzero(ends - starts > _RUN):
        for at in range(int(starts[i]), int(ends[i]), _RUN):
            part = _BYTE[data[at : min(int(ends[i]), at + _RUN)]]
            out[i : i + 1] = mix(out[i : i + 1] * _U(31) + bytes_hash(part, np.array([0]), np.array([len(part)])))
    short = np.flatnonzero(ends - starts <= _RUN)
    at = 0
    while at < len(short):
        begin = int(starts[short[at]])
        stop = max(at + 1, int(np.searchsorted(ends[short], begin + _RUN, "right")))
        lines = short[at:stop]
        part = _BYTE[data[begin : int(ends[lines[-1]])]]
        out[lines] = bytes_hash(part, starts[lines] - begin, ends[lines] - begin)
        at = stop
    return out


def _lines(data: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word, those of them that equal an earlier line of their row) of each row."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    rows = np.searchsorted(offsets, starts, "right") - 1
    keep = starts < len(data)
    # A row's last line may be empty and start where the next row does; an empty line has no word in any case.
    starts, rows = starts[keep], rows[keep]
    ends = np.append(starts[1:], len(data))
    ends = np.where(data[ends - 1] == 10, ends - 1, ends)
    ends = np.maximum(ends, starts)
    full = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends, rows = starts[full], ends[full], rows[full]
    n = len(offsets) - 1
    again = ~distinct_rows(rows, _line_hashes(data, starts, ends))[0]
    return np.bincount(rows, minlength=n), np.bincount(rows[again], minlength=n)


def count_features(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of ``COUNTS`` for each text of a column (null: none).

    n_dup_lines are the newline-split lines with a word that equal an earlier line, n_repeat_words the words in windows
    of three words that occur twice or more in the text, n_upper the letters A-Z, n_marks other marks, n_lines the lines
    with a word.
    """
    words = scan_words(column)
    data, offsets, n = words.data, words.offsets, len(column)
    inside, points = IS_WORD[data], (data & 0xC0) != 0x80
    per_row = lambda mask: np.array([np.count_nonzero(mask[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], dtype=np.int64)
    at, hashes = windows(words, 3)
    _, again = distinct_rows(words.row[at], hashes)
    step = np.zeros(len(words.hash) + 3, dtype=np.int64)
    np.add.at(step, at[again], 1)
    np.add.at(step, at[again] + 3, -1)
    repeated = np.cumsum(step[: len(words.hash)]) > 0
    n_lines, n_dup = _lines(data, offsets, words.start)
    return {
        "n_words": words.per_row, "word_chars": per_row(inside & points), "n_symbols": per_row(_SYMBOL[data]),
        "n_dup_lines": n_dup, "n_repeat_words": np.bincount(words.row[repeated], minlength=n),
        "n_upper": per_row(_UPPER[data]), "n_marks": per_row(_MARK[data]), "n_lines": n_lines,
    }


def base_failed(c: dict[str, np.ndarray], min_words: int = 50, max_repeat_percent: int = 50) -> np.ndarray:
    return (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > max_repeat_percent * c["n_words"])


#: For each rule its cutoffs from lax to strict; a level is a place in these lists, the same for all rules.
RULES = {
    "symbols per word": [2.0, 1.0, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1, 0.06, 0.03],
    "other marks per word": [2.0, 1.0, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1, 0.06, 0.03],
    "capital share of characters": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2],
    "share of repeated words": [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "share of repeated lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15],
    "characters per word": [60.0, 50.0, 40.0, 35.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0],
}
LEVELS = 10


def levels(c: dict[str, np.ndarray]) -> np.ndarray:
    """The first level at which a rule rejects each text; ``LEVELS`` if none does."""
    words, chars, lines = (np.maximum(c[x], 1) for x in ("n_words", "word_chars", "n_lines"))
    rates = [c["n_symbols"] / words, c["n_marks"] / words, c["n_upper"] / chars, c["n_repeat_words"] / words, c["n_dup_lines"] / lines, c["word_chars"] / words]
    out = np.full(len(words), LEVELS)
    for rate, cutoffs in zip(rates, RULES.values(), strict=True):
        over = rate[:, None] > np.array(cutoffs)[None, :]
        out = np.minimum(out, np.where(over.any(axis=1), over.argmax(axis=1), LEVELS))
    return out


def binomial_cdf(r: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= r), exactly up to rounding."""
    terms = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p) for i in range(r + 1)]
    top = max(terms)
    return min(1.0, exp(top) * sum(exp(t - top) for t in terms))


@dataclass(frozen=True)
class Cutoffs:
    """The certified level of each stratum; a stratum that no label was seen in has none and rejects nothing."""

    by_lang: dict[str | None, int]

    def of(self, langs: list[str | None]) -> np.ndarray:
        return np.array([self.by_lang.get(x, -1) for x in langs], dtype=np.int64)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the counts, base_failed and level of every row of ``docs`` (doc_id, text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            c = count_features(part.column("text"))
            columns = [part.column("doc_id"), part.column("lang"), *(pa.array(c[x]) for x in COUNTS)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(base_failed(c)), pa.array(levels(c))], names=["doc_id", "lang", *COUNTS, "base_failed", "level"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("lang").cast("string"))
    return rows.mapInArrow(count, f"doc_id bigint, lang string, {', '.join(f'{c} bigint' for c in COUNTS)}, base_failed boolean, level bigint")


def fit(rows: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05) -> Cutoffs:
    """Cutoffs under which, with probability 1 - ``error`` for all strata at once, at most ``risk`` of the good documents
    of each stratum that pass the base rules are rejected.

    Strata are all languages, rows without one being a stratum of their own. For each, levels are tested from lax to
    strict: level j is certified if P(Binomial(n, risk) <= rejected at j) <= error / strata; the first failure ends it.
    Fixed order needs no correction within a stratum. Of the certified levels the one that rejects most of the labelled bad
    documents is taken, the laxest of these if there are several. A stratum with too few labels certifies nothing and
    rejects nothing. A document with both labels counts as good. A labelled id is one draw in its language however many rows
    have it, at the strictest judgement of them: draws that repeat would make the bound look surer than it is. The driver
    gets one row of counts for each language, label and level.
    """
    marks = labels.where("quality IN (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").alias("quality"))
    held = rows.where("NOT base_failed").join(marks, "doc_id").groupBy("doc_id", "lang", "quality").agg(F.min("level").alias("level"))
    at: dict[str | None, np.ndarray] = {}
    for r in held.groupBy("lang", "quality", "level").agg(F.count("*").alias("n")).collect():
        at.setdefault(r["lang"], np.zeros((2, LEVELS + 1), dtype=np.int64))[r["quality"], r["level"]] += r["n"]
    out: dict[str | None, int] = {}
    for stratum, seen in at.items():
        n, out[stratum], most = int(seen[1].sum()), -1, 0
        for j, (bad, good) in enumerate(np.cumsum(seen[:, :LEVELS], axis=1).T if n else []):
            if binomial_cdf(int(good), n, risk) > error / len(at):
                break
            if bad > most:
                out[stratum], most = j, bad
    return Cutoffs(out)


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """The counts, base_failed, stratum's cutoff_level and kept of every row of ``docs`` (doc_id, text, lang).

    Null and empty texts have no words and fail the base rules; rows without a language are a stratum of their own; rows that
    repeat are judged alike; without labels nothing but the base rules rejects; an empty table gives no rows.
    """
    rows = materialize(features(docs), "quality-features")
    cutoffs = docs.sparkSession.createDataFrame(list(fit(rows, labels, risk, error).by_lang.items()), "stratum string, cutoff bigint")
    rows = rows.join(small(cutoffs), F.col("lang").eqNullSafe(F.col("stratum")), "left").drop("stratum")
    rows = rows.withColumn("cutoff_level", F.coalesce("cutoff", F.lit(-1).cast("bigint"))).drop("cutoff")
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("level") > F.col("cutoff_level")))


def keep(docs: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns as they are; needs doc_id, text and lang."""
    rows = materialize(features(docs), "quality-features")
    cutoffs = fit(rows, labels, risk, error)
    discard(rows)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            c = count_features(part.column("text"))
            langs = [None if x is None else str(x) for x in part.column("lang").to_pylist()]  # as the strata are named
            yield part.filter(pa.array(~base_failed(c) & (levels(c) > cutoffs.of(langs))))

    return docs.mapInArrow(pick, docs.schema)
