"""JSON arrays of any size, split over tasks by byte ranges.

Spark's text reader cuts a file into ranges and, with ``}`` in the place of the line's end, gives each piece to one of them. Whether
a brace counts depends on whether a string is open, which a range can't know by itself; so each is read for both cases first, the
ranges of a file are joined up in order, and a second pass, now knowing how each begins, takes the objects apart. What lies over a
border is put together from the parts on either side. Nothing is shuffled but these parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_ESCAPED = re.compile(rb"\\.", re.DOTALL)
_RANGE = "path string, block bigint, quoted0 int, depth0 bigint, quoted1 int, depth1 bigint, bytes bigint"
_RANGE_SCHEMA = pa.schema([("path", pa.string()), ("block", pa.int64()), ("quoted0", pa.int32()), ("depth0", pa.int64()), ("quoted1", pa.int32()), ("depth1", pa.int64()), ("bytes", pa.int64())])
_PART = "path string, block bigint, part int, value binary"
_PART_SCHEMA = pa.schema([("path", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("value", pa.binary())])
#: A whole object, and what of one lies before, through or after the borders of a range.
_WHOLE, _HEAD, _THROUGH, _TAIL = 3, 0, 1, 2


def _piece(text: bytes) -> tuple[int, int, int]:
    """Whether a piece opens or closes a string in all, and what it adds to the depth if it begins outside or inside of one."""
    runs = _ESCAPED.sub(b"", text).split(b'"')
    sums = [sum(r.count(b"{") - r.count(b"}") for r in runs[k::2]) for k in (0, 1)]
    return (len(runs) - 1) % 2, sums[0], sums[1]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], int, list[bytes]]]:
    """(path, start), the file's size and the pieces of each range, some at a time; ranges come one after the other."""
    for batch in batches:
        paths, blocks, sizes, values = (batch.column(c).to_pylist() for c in ("path", "block", "size", "value"))
        at = 0
        while at < len(paths):
            end = at
            while end < len(paths) and paths[end] == paths[at] and blocks[end] == blocks[at]:
                end += 1
            yield (paths[at], blocks[at]), sizes[at], values[at:end]
            at = end


def _ranges(pieces: DataFrame) -> DataFrame:
    """For each range where it ends, beginning outside or inside of a string, and how many bytes its pieces have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[dict] = []
        now, state, size = None, [(0, 0), (1, 0)], 0

        def done() -> None:
            if now is not None:
                (q0, d0), (q1, d1) = state
                found.append({"path": now[0], "block": now[1], "quoted0": q0, "depth0": d0, "quoted1": q1, "depth1": d1, "bytes": size})

        for key, _, texts in _runs(batches):
            if key != now:
                done()
                now, state, size = key, [(0, 0), (1, 0)], 0
            for text in texts:
                flips, *sums = _piece(text + b"}")
                state = [(quoted ^ flips, depth + sums[quoted]) for quoted, depth in state]
                size += len(text) + 1
        done()
        yield pa.RecordBatch.from_pylist(found, schema=_RANGE_SCHEMA)

    return pieces.mapInArrow(run, _RANGE)


def _starts(ranges: DataFrame) -> dict[tuple[str, int], tuple[int, int, int]]:
    """How each range but the first of a file begins: whether in a string, at what depth, and where its first piece lies."""
    by_file = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = F.collect_list(F.struct("quoted0", "depth0", "quoted1", "depth1", "bytes")).over(by_file)
    begin = F.struct(F.lit(0).alias("q"), F.lit(0).cast("bigint").alias("d"), F.lit(0).cast("bigint").alias("at"))
    of = lambda s, r, c: F.when(s["q"] == 0, r[f"{c}0"]).otherwise(r[f"{c}1"])
    joined = F.aggregate(before, begin, lambda s, r: F.struct(of(s, r, "quoted").alias("q"), (s["d"] + of(s, r, "depth")).alias("d"), (s["at"] + r["bytes"]).alias("at")))
    rows = ranges.withColumn("s", joined).where("block > 0").select("path", "block", "s.*").collect()
    return {(r["path"], r["block"]): (r["q"], r["d"], r["at"]) for r in rows}


def _parts(pieces: DataFrame, starts: dict[tuple[str, int], tuple[int, int, int]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, quoted, depth, at, begun = None, 0, 0, 0, True
        held: list[bytes] = []
        out: list[dict] = []

        def put(part: int) -> None:
            text = b"".join(held)
            held.clear()
            if part in (_TAIL, _WHOLE):
                text = text[text.find(b"{") :] if b"{" in text else b""
            if text:
                out.append({"path": now[0], "block": now[1], "part": part, "value": text})

        def close() -> None:
            """The range ends: an object is still open that began here, or that goes through all of it."""
            if held and (depth > 0 or quoted):
                put(_TAIL if begun else _THROUGH)
            held.clear()

        for key, size, texts in _runs(batches):
            if key != now:
                close()
                now, (quoted, depth, at) = key, starts.get(key, (0, 0, 0))
                begun = depth == 0 and not quoted
            for text in texts:
                at += len(text) + 1
                text += b"}" if at <= size else b""  # the last piece of a file may have none
                flips, *sums = _piece(text)
                depth, quoted = depth + sums[quoted], quoted ^ flips
                held.append(text)
                if depth == 0 and not quoted:
                    put(_WHOLE if begun else _HEAD)
                    begun = True
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=_PART_SCHEMA)
                out.clear()
        close()
        yield pa.RecordBatch.from_pylist(out, schema=_PART_SCHEMA)

    return pieces.mapInArrow(run, _PART)


def array_objects(spark: SparkSession, folder: str, names: str = "*") -> DataFrame:
    """(path, value): the text of every top-level object in the JSON arrays of a folder's files, or of the object alone.

    Files are read twice, by ranges of ``spark.sql.files.maxPartitionBytes``; the driver gets one row for each range after a file's
    first. Values that are no objects are left out; an object that never closes is one row, which no parser takes.
    """
    text = spark.read.option("lineSep", "}").option("pathGlobFilter", names).text(folder)
    meta = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "path"), ("file_block_start", "block"), ("file_size", "size"))]
    pieces = text.select(F.col("value").cast("binary").alias("value"), *meta)
    parts = _parts(pieces, _starts(_ranges(pieces)))
    whole = parts.where(F.col("part") == _WHOLE).select("path", F.col("value").cast("string"))
    # An object over borders is its first part, the ranges that it fills, and its last part, in order.
    by_file = W.partitionBy("path").orderBy("block", "part")
    numbered = parts.where(F.col("part") < _WHOLE).withColumn("object", F.sum((F.col("part") == _TAIL).cast("int")).over(by_file))
    joined = numbered.groupBy("path", "object").agg(F.array_sort(F.collect_list(F.struct("block", "part", F.hex("value").alias("value")))).alias("p"))
    return whole.unionByName(joined.select("path", F.unhex(F.array_join(F.transform("p", lambda x: x["value"]), "")).cast("string").alias("value")))
