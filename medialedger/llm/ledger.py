"""Which hashes occur again anywhere in the corpus, counted by a Spark shuffle of packed postings.

Documents are read in chunks of a few megabytes. A chunk sends one posting (eight bytes of hash, place, count) for each
distinct hash, packed by bucket, so that a hash that every document holds costs one posting per chunk and not one per
document. The buckets are shuffled, each is sorted by itself, and the places of hashes that occur again go back to their
chunk, where ``finish`` turns them into rows. Tasks hold one chunk or one bucket at a time.

The bucket comes from a second hash, so two different grams only meet if 64 bits and the bucket agree. There are 32 buckets
for each shuffle partition (1024 at least) and a task holds one bucket whole, about 10 bytes for each posting: 10**13 windows
(some 100 TB of text) in buckets of 64 MB need 50,000 shuffle partitions. With that many buckets some 85 bits tell two
windows apart, so of the 5 * 10**25 pairs about one unequal pair is expected to meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from medialedger.llm.store import shuffle_partitions
from medialedger.llm.wordscan import give_back, mix

_POSTINGS = "bucket int, chunk bigint, hashes binary, places binary, counts binary, payload binary"
_ARROW = pa.schema(
    [("bucket", pa.int32()), ("chunk", pa.int64())]
    + [(c, pa.binary()) for c in ("hashes", "places", "counts", "payload")]
)
_NONE = np.zeros(0, dtype=np.uint32)


@dataclass
class Chunk:
    """One chunk: its distinct hashes, the place each goes back to, how often it occurs here, and what ``finish`` needs."""

    hashes: np.ndarray
    side: np.ndarray
    places: np.ndarray
    payload: pa.RecordBatch
    counts: np.ndarray | None = None
    known: np.ndarray = field(default_factory=lambda: _NONE)


def distinct_places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the first of each distinct hash in rising order, all places of hashes that occur twice or more)."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    again = np.zeros(len(hashes), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    first = np.ones(len(hashes), dtype=bool)
    first[order[1:][same]] = False
    return np.flatnonzero(first), np.flatnonzero(again)


def pack_batch(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(payload: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(payload).read_next_batch()


def _binary(rows: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """rows (n, width) of bytes, cut at bounds."""
    data = np.ascontiguousarray(rows)
    width = rows.shape[1] if rows.ndim == 2 else rows.itemsize
    offsets = (bounds * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _send(chunk: Chunk, number: int, n_buckets: int) -> Iterator[pa.RecordBatch]:
    bucket = (chunk.side % np.uint64(n_buckets)).astype(np.uint16 if n_buckets <= 1 << 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    owner = bucket[order]
    if len(owner):
        cuts = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1, [len(owner)]])
        heads = owner[cuts[:-1]].astype(np.int32)
        places = chunk.places[order].astype(np.uint32)
        steps = places.copy()
        steps[1:] -= places[:-1]
        steps[cuts[:-1]] = places[cuts[:-1]]
        # Places rise within a bucket, so their steps mostly need two bytes.
        steps = steps.astype(np.uint16) if steps.max(initial=0) < 1 << 16 else steps
        hashes = chunk.hashes[order]
        nothing = pa.nulls(len(heads), pa.binary())
        counts = nothing if chunk.counts is None else _binary(chunk.counts[order].astype(np.uint32), cuts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(heads), pa.array(np.full(len(heads), number)), _binary(hashes, cuts), _binary(steps, cuts), counts, nothing],
            schema=_ARROW,
        )
    yield pa.RecordBatch.from_pylist(
        [{"bucket": int(mix(np.array([number], dtype=np.uint64))[0] % np.uint64(n_buckets)), "chunk": number, "places": chunk.known.astype(np.uint32).tobytes(), "payload": pack_batch(chunk.payload)}],
        schema=_ARROW,
    )


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Runs of rows with the same key from batches that are sorted by it."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0][key] != row[key]:
                yield held[0][key], held
                held = []
            held.append(row)
    if held:
        yield held[0][key], held


def _again(bucket: int, rows: list[dict], with_counts: bool) -> Iterator[dict]:
    """The places whose hash has a total of two or more in this bucket, by chunk."""
    sizes = np.array([len(r["hashes"]) // 8 for r in rows])
    hashes = np.frombuffer(b"".join(r["hashes"] for r in rows), dtype=np.uint64)
    order = np.argsort(hashes, kind="stable")
    heads = np.concatenate([[0], np.flatnonzero(hashes[order][1:] != hashes[order][:-1]) + 1])
    if with_counts:
        counts = np.frombuffer(b"".join(r["counts"] for r in rows), dtype=np.uint32)
        totals = np.add.reduceat(counts[order].astype(np.int64), heads)
    else:
        totals = np.diff(np.append(heads, len(order)))
    total = np.empty(len(order), dtype=np.int64)
    total[order] = np.repeat(totals, np.diff(np.append(heads, len(order))))
    at = 0
    for r, n in zip(rows, sizes, strict=True):
        mine = total[at : at + n]
        at += n
        hit = mine >= 2
        if hit.any():
            steps = np.frombuffer(r["places"], dtype=np.uint16 if len(r["places"]) == 2 * n else np.uint32)
            places = np.cumsum(steps, dtype=np.uint32)[hit]
            yield {
                "bucket": bucket, "chunk": r["chunk"], "places": places.tobytes(),
                "counts": np.minimum(mine[hit], 0xFFFFFFFF).astype(np.uint32).tobytes() if with_counts else None,
            }


def recurring(
    docs: DataFrame,
    chunks: Callable[[Iterator[pa.RecordBatch]], Iterator[Chunk]],
    finish: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch | pa.Table],
    schema: str,
    with_counts: bool = False,
) -> DataFrame:
    """``finish(payload, places, counts)`` of every chunk, with the places whose hash occurs twice or more in all chunks.

    ``docs`` must give the same rows in the same order when a task runs again, as a table scan does. ``counts`` (with
    ``with_counts``) holds the corpus-wide total for each place; ``Chunk.known`` places are returned in any case.
    """
    n_buckets = max(1024, 32 * shuffle_partitions(docs.sparkSession))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for i, chunk in enumerate(chunks(batches)):
            yield from _send(chunk, part + i, n_buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(batches, "bucket"):
            out = [r for r in rows if r["payload"] is not None]
            sent = [r for r in rows if r["payload"] is None]
            if sent:
                out += _again(bucket, sent, with_counts)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
        give_back()

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "chunk"):
            payload = next(r["payload"] for r in rows if r["payload"] is not None)
            places = np.frombuffer(b"".join(r["places"] for r in rows), dtype=np.uint32)
            counts = np.frombuffer(b"".join(r["counts"] or b"" for r in rows), dtype=np.uint32)
            done = finish(_unpack(payload), places, counts)
            yield from done.to_batches() if isinstance(done, pa.Table) else [done]
        give_back()

    sent = docs.mapInArrow(send, _POSTINGS)
    counted = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, _POSTINGS)
    return counted.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(end, schema)
