"""Removal of word windows that occur again: Rabin-Karp hashes of every window of k words, counted in Spark.

Two jobs: ``repeated_spans`` counts every window and merges repeated ones into maximal intervals; ``remove_spans`` cuts
the intervals out of the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialedger.llm.ledger import Chunk, distinct_places, recurring
from medialedger.llm.store import has_member, materialize, member_bits
from medialedger.llm.wordscan import scan_words, slices, windows

_KEYED = "doc_id bigint, text string, text_key binary"
_SPANS = "doc_id bigint, n_words bigint, n_removed bigint, text_key binary, spans array<int>"


def _text_key(column: pa.Array) -> list[bytes]:
    """SHA-256 of each whole text (null as empty): equal texts lose the same words."""
    return [hashlib.sha256((x or "").encode()).digest() for x in column.to_pylist()]


def repeated_spans(docs: DataFrame, window: int = 35) -> DataFrame:
    """For each row of ``docs`` (doc_id, text) the word intervals [start, end) that repeated windows cover.

    A window counts as repeated if its word sequence starts anywhere else, in the same text too. Words are runs of
    characters other than space and U+0009 to U+000D, unchanged. Null and empty texts have no words; repeated rows are
    copies of each other and lose all windows; extra columns are ignored; an empty table gives no rows.
    Returns doc_id, n_words, n_removed, text_key (SHA-256 of the text), spans (flat start, end pairs in rising order).
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
        for part in slices(batches, "text"):
            words = scan_words(part.column("text"))
            at, hashes = windows(words, window)
            side = windows(words, window, "side")[1]
            hashes = hashes + side  # each alone has 61 bits
            first, again = distinct_places(hashes)
            side = side[first]
            payload = pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(words.per_row), pa.array(_text_key(part.column("text")), pa.binary())],
                names=["doc_id", "n_words", "text_key"],
            )
            yield Chunk(hashes[first], side, at[first], payload, known=at[again])

    def finish(payload: pa.RecordBatch, places: np.ndarray, _: np.ndarray) -> pa.RecordBatch:
        sizes = payload.column("n_words").to_numpy()
        first = np.concatenate([[0], np.cumsum(sizes)])
        n = int(first[-1])
        hit = np.zeros(n + 1, dtype=np.int64)
        hit[places] = 1
        cover = np.cumsum(hit[:n] - np.concatenate([np.zeros(min(window, n), np.int64), hit[: max(0, n - window)]])) > 0
        edge = cover.copy()
        inner = first[(first > 0) & (first < n)]
        edge[1:] &= ~cover[:-1]
        edge[inner] = cover[inner]
        stop = cover.copy()
        stop[:-1] &= ~cover[1:]
        stop[inner - 1] = cover[inner - 1]
        starts, ends = np.flatnonzero(edge), np.flatnonzero(stop) + 1
        row = np.searchsorted(first, starts, "right") - 1
        flat = np.column_stack([starts - first[row], ends - first[row]]).astype(np.int32).ravel()
        per_row = np.bincount(row, weights=ends - starts, minlength=len(sizes)).astype(np.int64) if n else np.zeros(len(sizes), np.int64)
        cuts = np.concatenate([[0], np.cumsum(2 * np.bincount(row, minlength=len(sizes)))]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                payload.column("doc_id"), pa.array(sizes), pa.array(per_row), payload.column("text_key"),
                pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat)),
            ],
            names=["doc_id", "n_words", "n_removed", "text_key", "spans"],
        )

    return recurring(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), chunks, finish, _SPANS)


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the words of ``spans`` (of ``repeated_spans``) cut out; one row for each row of ``docs``.

    Returns doc_id, n_words, n_removed, kept_text: the kept words joined by one space (empty if none is left).
    Spans belong to texts, not to ids, so ids may repeat or be null.
    """

    def keyed(bits: np.ndarray, wanted: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            keys = _text_key(part.column("text"))
            member = has_member(bits, np.array([int.from_bytes(k[:7], "big") for k in keys], dtype=np.int64))
            columns = [part.column("doc_id"), part.column("text"), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "text_key"]).filter(pa.array(member == wanted))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = scan_words(part.column("text"))
            first, sizes = words.first, words.per_row
            out = part.column("spans")
            offsets = out.offsets.to_numpy()
            flat = out.values.to_numpy()
            n = len(words.hash)
            step = np.zeros(n + 1, dtype=np.int64)
            for row in np.flatnonzero(np.diff(offsets)):
                mine = flat[offsets[row] : offsets[row + 1]] + first[row]
                np.add.at(step, mine[::2], 1)
                np.add.at(step, mine[1::2], -1)
            kept = np.cumsum(step[:n]) == 0
            data = np.append(words.data, np.uint8(32))
            # Every kept word with the byte after it turned into a space; a text's last word goes without.
            lengths = (words.end - words.start + 1)[kept]
            begin = np.cumsum(lengths) - lengths
            pick = np.repeat(words.start[kept] - begin, lengths) + np.arange(lengths.sum())
            joined = data[np.minimum(pick, len(words.data))]
            joined[begin + lengths - 1] = 32
            rows = words.row[kept]
            size = np.bincount(rows, weights=lengths, minlength=len(part)).astype(np.int64) if len(rows) else np.zeros(len(part), np.int64)
            ends = np.cumsum(size)
            starts = ends - size
            texts = [joined[a : max(a, b - 1)].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
            removed = sizes - np.bincount(rows, minlength=len(part))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes), pa.array(removed), pa.array(texts, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )

    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    cuts = materialize(spans.filter(F.col("n_removed") > 0).select("text_key", "spans").dropDuplicates(["text_key"]), "spans")
    # Only texts that may lose words are shuffled to meet their spans; the filter has a fixed size and lets some others pass.
    bits = member_bits(cuts, F.conv(F.hex(F.substring("text_key", 1, 7)), 16, 10).cast("bigint"))
    none = F.array().cast("array<int>")
    whole = texts.mapInArrow(partial(keyed, bits, False), _KEYED).select("doc_id", "text", none.alias("spans"))
    met = texts.mapInArrow(partial(keyed, bits, True), _KEYED).join(cuts, "text_key", "left")
    rows = whole.unionByName(met.select("doc_id", "text", F.coalesce("spans", none).alias("spans")))
    return rows.mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """``docs`` without the words that repeated windows of ``window`` words cover; see the two steps for the cases."""
    return remove_spans(docs, repeated_spans(docs, window))
