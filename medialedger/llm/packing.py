"""Best-fit packing of tokenised documents into fixed-length sequences, by linear grouping.

Documents become pieces of at most one sequence; pieces are dealt evenly into shards and every shard is packed by
itself: large lengths are rounded up to the longest of their equal-cardinality group, the few sizes that result are
covered by configurations from a column-generated linear program, actual pieces take the places, and small pieces (with
what the rounding of the program left over) go where they fit best.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialedger.llm.store import materialize
from medialedger.llm.wordscan import give_back

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: A Latin-1 word and what may follow it; its two parts are tokens of their own to the word tokenizer.
_PLAIN = re.compile(r'([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#$%&*()"]*)')


class WordIds(dict):
    """Token ids (little-endian uint32 bytes) of white-space-separated words, for tokenizers that drop white space.

    Words are kept up to a fixed number, then the table starts anew; long words are never kept. All ids come from the whole
    tokenizer, once for each word, or for the letters and the marks of a plain one, when it enters the table.
    """

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer, self.limit, self.parts = Tokenizer.from_file(path), limit, {}

    def encode(self, word: str) -> bytes:
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def part(self, text: str) -> bytes:
        ids = self.parts.get(text)
        if ids is None:
            if len(self.parts) >= 2 * self.limit:
                self.parts.clear()
            ids = self.parts[text] = self.encode(text)
        return ids

    def __missing__(self, word: str) -> bytes:
        if len(word) > 64:
            return self.encode(word)
        plain = _PLAIN.fullmatch(word)
        if plain is None:
            ids = self.encode(word)
        else:
            ids = self.part(plain[1].lower())
            if plain[2]:
                ids += self.part(plain[2])
        if len(self) >= self.limit:
            self.clear()
            self[""] = b""
        self[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        """The ids of a whole text: those of its words, since no token reaches over ASCII white space."""
        text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        return b"".join(map(self.__getitem__, text.split(" ")))


_tables: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, kept: int) -> WordIds:
    """The one table of this Python worker; it outlives a task."""
    if (path, kept) not in _tables:
        _tables.clear()
        _tables[path, kept] = WordIds(path, kept)
    return _tables[path, kept]


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, with_ids: bool = False, words_kept: int = 400_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, uint32 bytes) of every document's pieces.

    A document is its text's ids followed by ``end_id``; null and empty texts are ``end_id`` alone. Only documents of
    more than ``capacity`` ids are cut, every ``capacity`` ids. Repeated rows give repeated pieces. ``words_kept`` bounds the words (and twice as
    many parts) whose ids a Python worker keeps, about 200 bytes each: more of them save time, not results.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = word_ids(tokenizer, words_kept), int(end_id).to_bytes(4, "little")
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = ids_of.text(text.as_py() or "") + end
                for at in range(0, len(ids), 4 * capacity):
                    part = ids[at : at + 4 * capacity]
                    for column, x in zip(out, (doc, at // (4 * capacity), at // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                        column.append(x)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            columns = [pa.array(c, t) for c, t in zip(out, types, strict=True)][: 6 if with_ids else 5]
            yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])
        give_back()

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(cut, _PIECES + ", ids binary" * with_ids)


def _best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """The multiset of sizes within the capacity with the largest total value (unbounded knapsack by item number)."""
    best = np.zeros(capacity + 1)
    picks = []
    for _ in range(capacity // int(sizes.min())):
        now, pick = best.copy(), np.full(capacity + 1, -1)
        for i, s in enumerate(sizes):
            with_i = best[: capacity + 1 - s] + values[i]
            better = with_i > now[s:] + 1e-12
            now[s:][better] = with_i[better]
            pick[s:][better] = i
        picks.append(pick)
        if not (pick >= 0).any():
            break
        best = now
    pattern, room = np.zeros(len(sizes)), capacity
    for pick in reversed(picks):
        if pick[room] >= 0:
            pattern[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) of the rounded-down optimum of the configuration program, by column generation."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(40 * k):
        price = np.linalg.solve(basis.T, np.ones(k))
        pattern = _best_pattern(sizes, price, capacity)
        if pattern @ price <= 1 + 1e-9:
            break
        amount, step = np.linalg.solve(basis, demand), np.linalg.solve(basis, pattern)
        ratio = np.where(step > 1e-9, np.maximum(amount, 0) / np.maximum(step, 1e-9), np.inf)
        if not np.isfinite(ratio.min()):
            break
        basis[:, int(ratio.argmin())] = pattern
    amount = np.linalg.solve(basis, demand)
    return [(basis[:, j].astype(int), int(np.floor(amount[j] + 1e-9))) for j in range(k)]


def pack(lengths: np.ndarray, capacity: int, groups: int = 32, large: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; lengths over capacity / ``large`` are grouped into ``groups`` sizes."""
    bins, offsets, fill = np.full(len(lengths), -1), np.zeros(len(lengths), dtype=np.int64), []

    def put(i: int, b: int) -> None:
        bins[i], offsets[i] = b, fill[b]
        fill[b] += int(lengths[i])

    order = np.argsort(-lengths, kind="stable")
    whole = order[lengths[order] == capacity]
    rest = order[len(whole) :]
    big = rest[lengths[rest] * large > capacity]
    if len(big):
        per_group = -(-len(big) // groups)
        heads = np.arange(0, len(big), per_group)
        tops = lengths[big[heads]]
        sizes, owner = np.unique(-tops, return_inverse=True)  # groups that round up to one size are one group
        sizes = -sizes
        queues: list[list[int]] = [[] for _ in sizes]
        for place, i in enumerate(big):
            queues[owner[place // per_group]].append(int(i))
        queues = [q[::-1] for q in queues]  # the longest of a group is taken first
        demand = np.array([float(len(q)) for q in queues])
        for pattern, times in configurations(sizes, demand, capacity):
            for _ in range(times):
                taken = [q.pop() for q, n in zip(queues, pattern, strict=True) for _ in range(min(n, len(q)))]
                if taken:
                    fill.append(0)
                    for i in taken:
                        put(i, len(fill) - 1)
        big = np.array(sorted((i for q in queues for i in q), key=lambda i: -lengths[i]), dtype=np.int64)
    # Best fit: the bins by free room, and a bit set of the rooms there are.
    small = rest[lengths[rest] * large <= capacity]
    rooms: dict[int, list[int]] = {}
    bits = 0

    def offer(b: int) -> None:
        nonlocal bits
        room = capacity - fill[b]
        if room:
            rooms.setdefault(room, []).append(b)
            bits |= 1 << room

    for b in range(len(fill)):
        offer(b)
    for i in map(int, np.concatenate([big, small]).astype(np.int64)):
        fitting = bits >> int(lengths[i])
        if fitting:
            room = int(lengths[i]) + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                bits &= ~(1 << room)
        else:
            b = len(fill)
            fill.append(0)
        put(i, b)
        offer(b)
    for i in map(int, whole):
        fill.append(0)
        put(i, len(fill) - 1)
    return bins, offsets


def place(rows: DataFrame, capacity: int = 4096, per_shard: int = 8192) -> DataFrame:
    """``rows`` (doc_id, piece, length and more) with sequence_id and offset; rows should be a stored table.

    Shards of about ``per_shard`` pieces are packed apart, so that no task grows with the input; each may leave its last
    few sequences less full. sequence_id is the shard's number times 2**32 plus the sequence's number in it.
    """
    shards = max(1, -(-rows.count() // per_shard))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id bigint, offset bigint"

    def pack_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets = pack(rows["length"].to_numpy(dtype=np.int64), capacity)
        return rows.drop(columns="shard").assign(sequence_id=key[0] * (1 << 32) + bins, offset=offsets)

    # The row's own number takes part, so that rows that repeat are dealt over the shards as others are.
    shard = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)).alias("shard")
    return rows.select(shard, "*").groupBy("shard").applyInPandas(pack_shard, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, words_kept: int = 400_000) -> DataFrame:
    """Every piece of ``docs`` (doc_id, text) with its sequence_id and its offset there, gapless from 0.

    Null ids stay null; rows that repeat are packed as often as they occur; extra columns are ignored; an empty table
    gives no rows.
    """
    return place(materialize(pieces(docs, tokenizer, end_id, capacity, words_kept=words_kept), "pieces"), capacity)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """The training sequences themselves: sequence_id, ids (uint32 bytes), doc_ids and lengths in order of place."""
    cut = pieces(docs, tokenizer, end_id, capacity, with_ids=True)
    keys = ["doc_id", "piece", "ids_crc32"]
    placed = packed.select(*keys, "sequence_id", "offset").join(cut.dropDuplicates(keys).select(*keys, "ids", "length"), keys)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "length")))
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.expr("aggregate(p.ids, CAST('' AS BINARY), (a, x) -> concat(a, x))").alias("ids"),
        F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"),
    )
