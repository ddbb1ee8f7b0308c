"""Reference sequences in slices: a file is read by ranges of bytes, and no row holds a sequence.

A first pass counts, for each range, the bases before its first header and after its last one (a row a range, whatever
the lengths of lines and sequences). Added up in order they give what each range begins with, and a second pass gives
slices of equal width. A slice belongs to the range that its first base is in, which reads on to the slice's end.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bgzf

WIDTH = 1 << 12
SPLIT = 32 << 20
#: No header line is longer.
LONGEST_HEADER = 1 << 16
_BLANK = b" \t\r\n\x0b\x0c"


def _read(file, start: int, n: int) -> bytes:
    file.seek(start)
    return file.read(n)


def _parts(file, size: int, start: int, end: int) -> list[list]:
    """[name, bases] of each record in a range of bytes; the name of what it begins with is None. A header that begins in
    the range is read to its end."""
    back = _read(file, max(0, start - LONGEST_HEADER), min(start, LONGEST_HEADER))
    line = back.rfind(b"\n") + 1
    known = line > 0 or start <= LONGEST_HEADER
    inside = known and line < len(back) and back[line : line + 1] == b">"
    new_line = start == 0 or back.endswith(b"\n")
    data = _read(file, start, end - start)
    if inside:
        stop = data.find(b"\n")
        data, new_line = (b"", False) if stop < 0 else (data[stop + 1 :], True)
    heads = [m.start() + (m.group()[:1] == b"\n") for m in re.finditer(rb"\A>|\n>" if new_line else rb"\n>", data)]
    if heads and data.find(b"\n", heads[-1]) < 0:
        data += _read(file, end, LONGEST_HEADER).split(b"\n")[0]
    out = [[None, data[: heads[0] if heads else len(data)].translate(None, _BLANK)]]
    for k, at in enumerate(heads):
        body = data[at + 1 : heads[k + 1] if k + 1 < len(heads) else len(data)]
        title, _, bases = body.partition(b"\n")
        out.append([(title.split() or [b""])[0].decode(), bases.translate(None, _BLANK)])
    return out


def _further(file, size: int, at: int, wanted: int) -> bytes:
    """Up to `wanted` bases from a place inside a sequence on, to its end."""
    out, before = b"", _read(file, at - 1, 1)
    while len(out) < wanted and at < size:
        data = _read(file, at, max(4096, 2 * (wanted - len(out))))
        stop = re.search(rb"\A>|\n>" if before == b"\n" else rb"\n>", data)
        out += (data[: stop.start()] if stop else data).translate(None, _BLANK)
        if stop:
            break
        at, before = at + len(data), data[-1:]
    return out[:wanted]


def byte_ranges(spark: SparkSession, path: str, split: int = SPLIT, ending: str = "") -> DataFrame:
    """file, number, size, start, end of a file's or folder's ranges, and what each begins with: name, offset; with `last`
    (name of its last header) and `bases` (up to that header, or all)."""
    from pyarrow import fs

    ranges = []
    for file in bgzf.list_files(path, ending):
        system, name = fs.FileSystem.from_uri(file)
        size = system.get_file_info(name).size
        ranges += [(file, k, size, s, min(s + split, size)) for k, s in enumerate(range(0, size, split))]
    kinds = "file string, number long, size long, start long, end long"

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                parts = _parts(bgzf.open_file(r["file"])[0], r["size"], r["start"], r["end"])
                out.append({**r, "last": parts[-1][0], "bases": len(parts[0][1]), "after": len(parts[-1][1])})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("number", "size", "start", "end")), ("last", pa.string()), ("bases", pa.int64()), ("after", pa.int64())]))

    told = spark.createDataFrame(ranges, kinds).repartition(max(1, len(ranges))).mapInArrow(scan, f"{kinds}, last string, bases long, after long") if ranges else None
    placed, name, offset = [], None, 0
    for r in sorted(told.collect(), key=lambda r: (r["file"], r["number"])) if ranges else ():  # a row for each range
        if r["number"] == 0:
            name, offset = None, 0
        placed.append((r["file"], r["number"], r["size"], r["start"], r["end"], name, offset, r["last"], r["bases"]))
        name, offset = (r["last"], r["after"]) if r["last"] is not None else (name, offset + r["bases"])
    return spark.createDataFrame(placed, f"{kinds}, name string, offset long, last string, bases long")


def slices(spark: SparkSession, path: str, width: int = WIDTH, split: int = SPLIT, wanted: DataFrame | None = None, ending: str = "") -> DataFrame:
    """seq, slice, start, bases (upper case): `width` bases from slice * width on, fewer at a sequence's end.

    wanted: seq, slice; only ranges that can hold one of them are read again, and only those slices come.
    """
    ranges = byte_ranges(spark, path, split, ending)
    if wanted is not None:
        wanted = wanted.select("seq", F.col("slice").cast("bigint").alias("slice")).distinct()
        over = ranges.where("last is null and name is not null").select("file", "number", F.col("name").alias("seq"), F.explode(F.expr(f"sequence(offset div {width}, (offset + bases) div {width})")).alias("slice"))
        some = over.join(wanted, ["seq", "slice"], "left_semi").select("file", "number").distinct()
        ranges = ranges.where("last is not null").unionByName(ranges.where("last is null").join(some, ["file", "number"], "left_semi"))

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                file, size = bgzf.open_file(r["file"])
                parts = _parts(file, size, r["start"], r["end"])
                for k, (name, bases) in enumerate(parts):
                    name, offset = (r["name"], r["offset"]) if k == 0 else (name, 0)
                    if name is None or not bases:
                        continue
                    skip = -offset % width
                    lacks = -(offset + len(bases)) % width
                    if k == len(parts) - 1 and len(bases) > skip and lacks:
                        bases += _further(file, size, r["end"], lacks)
                    starts = range(skip, len(bases), width)
                    if starts:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * len(starts)), pa.array([(offset + s) // width for s in starts], pa.int64()), pa.array([offset + s for s in starts], pa.int64()), pa.array([bases[s : s + width].decode().upper() for s in starts])],
                            names=["seq", "slice", "start", "bases"],
                        )

    spread = ranges.select("file", "start", "end", "name", "offset").repartition("file", "start")
    found = spread.mapInArrow(cut, "seq string, slice long, start long, bases string")
    return found if wanted is None else found.join(wanted, ["seq", "slice"], "left_semi")


def sliced(sequences: DataFrame, width: int = WIDTH) -> DataFrame:
    """As slices(), of rows seq, bases that are there already."""
    at = F.explode(F.expr(f"sequence(0L, (length(bases) - 1) div {width})")).alias("slice")
    rows = sequences.where("length(bases) > 0").select("seq", F.upper("bases").alias("bases"), at)
    return rows.select("seq", "slice", (F.col("slice") * width).alias("start"), F.substr("bases", (F.col("slice") * width + 1).cast("int"), F.lit(width)).alias("bases"))


def lengths(slices_: DataFrame) -> DataFrame:
    return slices_.groupBy("seq").agg(F.max(F.col("start") + F.length("bases")).alias("len"))
