"""Benchmark decontamination by pigeonhole edit matching over words.

An item of L words that occurs in a text with at most k word edits, cut into k + 1 pieces, leaves one piece untouched.
Exact hits of pieces are found by joining rolling hashes; each candidate is verified with Myers' bit-parallel edit distance
of the whole item against the words around its hits. The steps, all of them Spark jobs over tables of any size:

1. Items and texts are told apart by a hash of their words or bytes, so copies of either cost one row each.
2. The hashes of all pieces fill a bit table of bounded size. One pass over the documents sends, for each text and hash
   that the table lets pass, the places where it starts; the join with the pieces is exact.
3. Where a piece of many items starts in many texts, as a preamble that items share does, its items are cut finer and go by
   the k + 1 of these pieces that are rarest in corpus and benchmark: any k + 1 disjoint pieces do, so nothing is lost.
4. Items whose budget is 0 are one piece: such a hit is the match. For the others, the texts with candidates are read
   again and cut to the words around the hits, which meet the item's words for verification.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialedger.llm.store import discard, has_member, materialize, member_bits, small
from medialedger.llm.wordscan import mix, scan_words, slices, spans_hash, windows

_ITEMS = "item_id bigint, item bigint, item_words int, budget int, words binary"
_PIECES = "item bigint, piece bigint, length int, at int"
_HITS = "k1 bigint, k2 bigint, piece bigint, places array<int>"
_FOUND = "k1 bigint, k2 bigint, item bigint, distance int, start_word bigint, end_word bigint"
_MET = ("k1", "k2", "item", "places", "at")
_COUNTED = "piece bigint, n bigint"
_AROUND = "k1 bigint, k2 bigint, item bigint, begin bigint, around binary"
#: The candidates of one text are held in this many parts, each by one task.
_PARTS = 16
#: A piece that gives more (text, item) pairs than this has its items cut into 2 and 4 times as many pieces.
_CROWDED = 50_000
_FINER = (1, 2, 4)


def search(pattern: list[int], text: list[int], anchored: bool = False) -> list[int]:
    """For each end in ``text`` the least edits between ``pattern`` and a part ending there (Myers 1999, Hyyrö 2001).

    Parts start anywhere, or with ``anchored`` at the first symbol.
    """
    m = len(pattern)
    where: dict[int, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    up, down, score, out = full, 0, m, []
    for c in text:
        eq = where.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (~(xh | up) & full)
        mh = up & xh
        score += bool(ph & last) - bool(mh & last)
        ph = (ph << 1 | anchored) & full
        up = ((mh << 1) | ~(xv | ph)) & full
        down = ph & xv
        out.append(score)
    return out


def best_match(pattern: list[int], text: list[int], budget: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the closest part of ``text`` within the budget, the first and longest of equal ones."""
    scores = search(pattern, text)
    distance = min(scores, default=budget + 1)
    if distance > budget:
        return None
    end = scores.index(distance) + 1
    back = search(pattern[::-1], text[:end][::-1], anchored=True)
    length = max(i + 1 for i, d in enumerate(back) if d == min(back))
    return distance, end - length, end




def text_keys(text: Column) -> list[Column]:
    """Two hashes of a text that are independent of each other: k1, k2."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _rows(columns: dict[str, list | np.ndarray], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[t]) for n, t in fields], names=[n for n, _ in fields])


def items(benchmark: DataFrame, percent: int) -> DataFrame:
    """item_id, item (hash of the words), item_words, budget, words (hashes) of every row of the benchmark with a word."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            words = scan_words(part.column("text"), fold=True)
            full = np.flatnonzero(words.per_row)
            first = words.first
            keys = _sized(spans_hash(words.hash, first[full], first[full + 1], "gram"), words.per_row[full])
            ids = part.column("item_id").to_pylist()
            yield _rows({
                "item_id": [ids[i] for i in full], "item": keys, "item_words": words.per_row[full],
                "budget": words.per_row[full] * percent // 100, "words": [words.hash[first[i] : first[i + 1]].tobytes() for i in full],
            }, _ITEMS)

    return benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(read, _ITEMS)


def pieces(distinct: DataFrame, times: int = 1) -> DataFrame:
    """item, piece (hash), length, at (place in the item) of the budget + 1 pieces of every item, or ``times`` as many as far as
    its words go."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"item": [], "piece": [], "length": [], "at": []}
            for item, k, blob in zip(*(batch.column(c).to_pylist() for c in ("item", "budget", "words")), strict=True):
                hashes = np.frombuffer(blob, dtype=np.uint64)
                n = min(len(hashes), (k + 1) * times)
                cuts = np.arange(n + 1) * len(hashes) // n
                out["item"] += [item] * n
                out["piece"] += _sized(spans_hash(hashes, cuts[:-1], cuts[1:], "gram"), np.diff(cuts)).tolist()
                out["length"] += np.diff(cuts).tolist()
                out["at"] += cuts[:-1].tolist()
            yield _rows(out, _PIECES)

    return distinct.mapInArrow(cut, _PIECES)


def _sized(hashes: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Hashes of word runs that differ by the run's length too."""
    return mix(hashes + np.asarray(lengths, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def hits(docs: DataFrame, bits: np.ndarray, lengths: list[int]) -> DataFrame:
    """k1, k2, piece, places of every run of words in every text whose hash the bit table lets pass."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            words = scan_words(part.column("text"), fold=True)
            k1, k2, first = part.column("k1").to_numpy(), part.column("k2").to_numpy(), words.first
            for length in lengths:
                at, hashed = windows(words, length)
                hashed = _sized(hashed, length)
                hit = np.flatnonzero(has_member(bits, hashed))
                row, piece, place = words.row[at[hit]], hashed[hit], at[hit]
                order = np.lexsort((place, piece, row))
                row, piece, place = row[order], piece[order], place[order] - first[row[order]]
                heads = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (piece[1:] != piece[:-1]))) if len(row) else np.zeros(0, np.int64)
                places = pa.ListArray.from_arrays(pa.array(np.append(heads, len(row)), pa.int32()), pa.array(place, pa.int32()))
                columns = [pa.array(k1[row[heads]]), pa.array(k2[row[heads]]), pa.array(piece[heads]), places]
                yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "piece", "places"])

    text = F.col("text").cast("string")
    # Copies send the same rows; one of each is kept, first within each task.
    return docs.select(text.alias("text"), *text_keys(text)).mapInArrow(find, _HITS).dropDuplicates(["k1", "k2", "piece"])


def frequencies(docs: DataFrame, bits: np.ndarray, lengths: list[int]) -> DataFrame:
    """piece, n: in how many rows of ``docs`` a run of words starts that the bit table lets pass."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            words = scan_words(part.column("text"), fold=True)
            for length in lengths:
                at, hashed = windows(words, length)
                hashed = _sized(hashed, length)
                hit = np.flatnonzero(has_member(bits, hashed))
                pairs = np.unique(np.stack([words.row[at[hit]].astype(np.int64), hashed[hit]]), axis=1)
                piece, n = np.unique(pairs[1], return_counts=True)
                yield _rows({"piece": piece, "n": n}, _COUNTED)

    return docs.select(F.col("text").cast("string")).mapInArrow(count, _COUNTED).groupBy("piece").agg(F.sum("n").alias("n"))


def rarest_pieces(docs: DataFrame, crowded: DataFrame) -> DataFrame:
    """The columns of ``pieces`` for the budget + 1 pieces that each item goes by: of its cuts into more or fewer pieces, the one
    whose rarest pieces give the fewest pairs of text and item."""
    cuts = [pieces(crowded, t).withColumn("times", F.lit(t)) for t in _FINER]
    every = materialize(reduce(DataFrame.unionByName, cuts), "benchmark-finer")
    lengths = sorted(r["length"] for r in every.select("length").distinct().collect())
    found = frequencies(docs, _bits_of(every), lengths)
    # Pairs: texts that hold the piece, times the places in items that are this piece in the same cut.
    shared = every.groupBy("piece", "times").agg(F.count("*").alias("items"))
    priced = every.join(small(shared), ["piece", "times"]).join(found, "piece", "left").select("item", "times", (F.coalesce("n", F.lit(0)) * F.col("items")).alias("pairs"), "at", "piece", "length")
    cut = priced.groupBy("item", "times").agg(F.array_sort(F.collect_list(F.struct("pairs", "at", "piece", "length"))).alias("all"))
    cut = cut.join(crowded.select("item", "budget"), "item").select("item", "times", F.slice("all", F.lit(1), F.col("budget") + 1).alias("taken"))
    total = F.aggregate("taken", F.lit(0).cast("bigint"), lambda a, x: a + x["pairs"])
    best = cut.groupBy("item").agg(F.min(F.struct(total.alias("total"), "times", "taken")).alias("b"))
    out = materialize(best.select("item", F.explode("b.taken").alias("p")).select("item", "p.piece", "p.length", "p.at"), "benchmark-rarest")
    discard(every)
    return out


def _bits_of(parts: DataFrame) -> np.ndarray:
    """A bit table of the pieces: 64 bits for each, between 1 KB and 8 MB."""
    return member_bits(parts, F.col("piece"), min(26, max(13, int(64 * parts.count()).bit_length())))


def verify(around: DataFrame, distinct: DataFrame) -> DataFrame:
    """The closest match of every item within its budget in every text, from the words around the hits."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c.split(" ")[0]: [] for c in _FOUND.split(", ")}
            for r in batch.to_pylist():
                pattern, text = (np.frombuffer(r[c], dtype=np.uint64).tolist() for c in ("words", "around"))
                match = best_match(pattern, text, r["budget"])
                if match:
                    for name, x in zip(out, (r["k1"], r["k2"], r["item"], match[0], r["begin"] + match[1], r["begin"] + match[2]), strict=True):
                        out[name].append(x)
            yield _rows(out, _FOUND)

    return around.join(distinct.select("item", "budget", "words"), "item").mapInArrow(check, _FOUND)


def stretches(starts: np.ndarray, words: int, budget: int, size: int) -> Iterator[tuple[int, int]]:
    """The ranges of words around places where an item may start: hits of one occurrence lie within the budget of each other."""
    starts = np.unique(starts)
    cuts = np.flatnonzero(np.diff(starts) > 2 * budget + 1) + 1
    for group in np.split(starts, cuts):
        yield max(0, int(group[0]) - budget), min(size, int(group[-1]) + words + budget)


def around_hits(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """The words around the hits of each candidate (k1, k2, item, item_words, budget, starts), read from the texts again."""
    bits = member_bits(candidates, F.col("k1"))

    def candidate(bits: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has_member(bits, batch.column("k1").to_numpy())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            words = scan_words(part.column("text"), fold=True)
            out: dict[str, list] = {c.split(" ")[0]: [] for c in _AROUND.split(", ")}
            for row, (k1, k2, found) in enumerate(zip(*(part.column(c).to_pylist() for c in ("k1", "k2", "found")), strict=True)):
                a, size = int(words.first[row]), int(words.per_row[row])
                for c in found:
                    for begin, end in stretches(np.array(c["starts"]), c["item_words"], c["budget"], size):
                        for name, x in zip(out, (k1, k2, c["item"], begin, words.hash[a + begin : a + end].tobytes()), strict=True):
                            out[name].append(x)
                if len(out["k1"]) > 1000:
                    yield _rows(out, _AROUND)
                    out = {name: [] for name in out}
            yield _rows(out, _AROUND)

    text = F.col("text").cast("string")
    texts = docs.select(text.alias("text"), *text_keys(text)).mapInArrow(partial(candidate, bits), "text string, k1 bigint, k2 bigint")
    part = F.pmod("item", F.lit(_PARTS)).alias("part")
    grouped = candidates.groupBy("k1", "k2", part).agg(F.collect_list(F.struct("item", "item_words", "budget", "starts")).alias("found"))
    return texts.dropDuplicates(["k1", "k2"]).join(grouped, ["k1", "k2"]).select("k1", "k2", "text", "found").mapInArrow(cut, _AROUND)


def text_matches(docs: DataFrame, distinct: DataFrame, crowded: int = _CROWDED) -> DataFrame:
    """k1, k2, item, distance, start_word, end_word: the closest occurrence of each item in each text that has one."""
    parts = materialize(pieces(distinct), "benchmark-pieces")
    lengths = [r["length"] for r in parts.select("length").distinct().collect()]  # about 100 / percent of them at most
    held = materialize(hits(docs, _bits_of(parts), sorted(lengths)), "benchmark-hits")
    pairs = parts.groupBy("piece").agg(F.count("*").alias("items")).join(held.groupBy("piece").agg(F.count("*").alias("texts")), "piece")
    hot = pairs.where(F.col("items") * F.col("texts") > crowded).select("piece")
    hot = materialize(parts.join(hot, "piece", "left_semi").select("item").distinct(), "benchmark-crowded")
    spent = [parts, held, hot]
    if not hot.isEmpty():
        again = distinct.where("budget > 0").join(hot, "item", "left_semi")
        rare = rarest_pieces(docs, again)
        lengths = sorted(r["length"] for r in rare.select("length").distinct().collect())
        more = materialize(hits(docs, _bits_of(rare), lengths), "benchmark-rare-hits")
        rest = parts.join(again.select("item"), "item", "left_anti")
        met = held.join(small(rest), "piece").select(*_MET).unionByName(more.join(small(rare), "piece").select(*_MET))
        spent += [rare, more]
    else:
        met = held.join(small(parts), "piece").select(*_MET)
    met = met.join(small(distinct.select("item", "item_words", "budget")), "item")
    met = materialize(met.select("k1", "k2", "item", "item_words", "budget", F.transform("places", lambda p: p - F.col("at")).alias("starts")), "benchmark-met")
    first = F.array_min("starts").cast("bigint")
    whole = met.where("budget = 0").groupBy("k1", "k2", "item").agg(F.min(first).alias("start_word"), F.max("item_words").alias("n"))
    whole = whole.select("k1", "k2", "item", F.lit(0).alias("distance"), "start_word", (F.col("start_word") + F.col("n")).alias("end_word"))
    candidates = met.where("budget > 0").groupBy("k1", "k2", "item", "item_words", "budget").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    candidates = materialize(candidates, "benchmark-candidates")
    found = verify(around_hits(docs, candidates), distinct)
    best = found.groupBy("k1", "k2", "item").agg(F.min(F.struct("distance", "start_word", "end_word")).alias("m")).select("k1", "k2", "item", "m.*")
    out = materialize(whole.unionByName(best), "benchmark-matches")
    discard(*spent, met, candidates)
    return out


def _distinct(named: DataFrame) -> DataFrame:
    return materialize(named.drop("item_id").dropDuplicates(["item"]), "benchmark-items")


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = 15, crowded: int = _CROWDED) -> DataFrame:
    """Every (document, item) such that the item occurs in the document with at most ``percent`` % of its words edited.

    Words are runs of characters other than space and U+0009 to U+000D, A-Z as a-z; an edit inserts, drops or changes a
    word. Returns doc_id, item_id, item_words, distance, start_word, end_word of the closest occurrence (the first one of
    equal ones) in each row. Null and empty texts match nothing and items without words are in nothing; null ids stay
    null; repeated rows and items give repeated results; extra columns are ignored. ``docs`` is read three times, whatever
    the size of the benchmark, and twice more where a piece meets over ``crowded`` pairs of text and item.
    """
    named = items(benchmark, percent)
    found = text_matches(docs, _distinct(named), crowded)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint"), *text_keys(text))
    return (
        rows.join(small(found), ["k1", "k2"]).join(named.select("item_id", "item", "item_words"), "item")
        .select("doc_id", "item_id", "item_words", "distance", "start_word", "end_word")
    )


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = 15) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item by ``matches``, all columns as they are."""
    dirty = small(text_matches(docs, _distinct(items(benchmark, percent))).select("k1", "k2").distinct())
    k1, k2 = text_keys(F.col("text").cast("string"))
    # A null text hashes like no other and matches nothing.
    return docs.join(dirty, (k1 == dirty["k1"]) & (k2 == dirty["k2"]), "left_anti").select(*docs.columns)
