"""Tracks of aligned reads: contributions of each read over its interval, and the values they give at a position."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .raster import coverage_runs, projected

#: Flag bits of the alignment format.
PROPER, UNMAPPED_MATE, REVERSE, MATE_REVERSE, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x2, 0x8, 0x10, 0x20, 0x100, 0x200, 0x400, 0x800
#: Operation codes of a CIGAR.
M, I, D, N, S, H, P, EQ, X = range(9)
MIN_CLIP, MIN_ANCHOR, BIG_DEL = 18, 36, 36
#: Shares are summed as whole numbers of this part, so that what a read adds goes without a rest where it ends.
FIXED = 1 << 40
#: Of gc, whole numbers of this part and their rests, whole numbers of its square: right to the last bits of a double.
PART = 1 << 30
DINUCLEOTIDES = tuple(a + b for a in "ACGT" for b in "ACGT")


def _bit(bit: int) -> Column:
    return F.col("flag").bitwiseAND(F.lit(bit)) != 0


def admitted(reads: DataFrame) -> DataFrame:
    return reads.where(F.col("ref_end").isNotNull() & ~_bit(DUPLICATE) & ~_bit(QC_FAIL))


def non_overlapping_count(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def read_classes(has_bases: bool = False) -> dict[str, Column]:
    """What each read adds to a track at every position of its interval. has_bases: there are _bases, in upper case, their number _size, and for gc _gc, how many are G or C."""
    one = lambda c: F.when(c, 1).otherwise(0).cast("bigint")
    proper, reverse, mate_reverse, alone = _bit(PROPER), _bit(REVERSE), _bit(MATE_REVERSE), _bit(UNMAPPED_MATE)
    elsewhere = F.col("mate_seq") != F.col("seq")
    discordant = ~proper & ~elsewhere & ~alone
    primary = ~_bit(SECONDARY) & ~_bit(SUPPLEMENTARY)
    same = reverse == mate_reverse
    out = ~same & ((reverse & (F.col("tlen") > 0)) | (~reverse & (F.col("tlen") < 0)))
    lone = ~same & ~out & alone
    mapq, tlen = F.col("mapq").cast("bigint"), F.col("tlen")
    found = {
        "total": F.lit(1).cast("bigint"), "proper_pair": one(proper), "discordant": one(discordant), "primary": one(primary), "alternate": one(~primary),
        "mapq": mapq, "mapq_pp": mapq * one(proper), "mapq_dis": mapq * one(discordant), "tlen": tlen, "tlen_pp": tlen * one(proper), "tlen_dis": tlen * one(discordant),
        "fwd_rev_diff": F.when(reverse, -1).otherwise(1).cast("bigint"), "orient_same": one(same), "orient_out": one(out), "orient_um": one(lone), "orient_chr": one(~same & ~out & ~alone & elsewhere),
    }
    if has_bases:
        bases, n = F.col("_bases"), F.col("_size")
        share = lambda k: F.when(n > 0, F.floor(k / n * FIXED + 0.5)).otherwise(0)
        scaled, div = F.col("_gc") * PART, lambda a, b: F.call_function("div", a, b)
        found["gc"] = F.when(n > 0, div(scaled, n)).otherwise(0)
        found["gc_rest"] = F.when(n > 0, div(scaled % n * PART, n)).otherwise(0)
        found |= {f"{p[0]}_{p[1]}": share(non_overlapping_count(bases, p)) for p in DINUCLEOTIDES}
    return found


def mean_with_prior(total: Column, n: Column) -> Column:
    """The average that a track reports: one pseudo-read of value one, less one."""
    return (1 + total) / (1 + n) - 1


def interval_tracks(reads: DataFrame, keys: Sequence[str], names: Sequence[str], has_bases: bool = False) -> DataFrame:
    """keys, start, end, names: sums over reads of what they add, as runs. Only the tracks asked for are computed."""
    classes, known = read_classes(has_bases), admitted(reads)
    if has_bases:  # once a read, not once a track
        known = known.withColumns({"_bases": F.upper("bases"), "_size": F.length("bases")})
    sums = list(names)
    if has_bases and "gc" in names:
        known, sums = known.withColumn("_gc", F.length(F.regexp_replace("_bases", "[^GC]", "")).cast("bigint")), [*names, "gc_rest"]
    rows = known.select(*keys, F.col("pos").alias("start"), (F.col("pos") + F.col("rlen")).alias("end"), *(classes[n].alias(n) for n in sums))
    runs = coverage_runs(rows, keys, sums)
    shown = {n: F.round(F.col(n) / FIXED, 11) for n in (f"{p[0]}_{p[1]}" for p in DINUCLEOTIDES)}
    shown["gc"] = F.round((F.col("gc") + F.col("gc_rest") / PART) / PART, 11)
    return runs.select(*keys, "start", "end", *(shown[n].alias(n) if n in shown else F.col(n) for n in names))


def projected_tracks(reads: DataFrame, keys: Sequence[str], lengths: DataFrame | None = None) -> DataFrame:
    """keys, start, end and counts of reads stretched by their template length: of all classes that are reported so.

    lengths: seq, len, where stretched reads end; a sequence that it lacks has no end.
    """
    classes = read_classes()
    names = {"tlen_pp_rd": "proper_pair", "tlen_dis_rd": "discordant", "orient_same_rd": "orient_same", "orient_out_rd": "orient_out"}
    rows = admitted(reads).where("tlen != 0").withColumns({"start": F.col("pos"), "end": F.col("pos") + F.col("rlen")})
    limit = None
    if lengths is not None:
        rows = rows.join(F.broadcast(lengths.select("seq", F.col("len").alias("_len"))), "seq", "left")  # a row for each sequence
        limit = F.greatest(F.coalesce("_len", F.lit((1 << 63) - 1)), F.col("end"))
    low, high = projected("start", "end", "tlen", limit)
    rows = rows.select(*keys, low.alias("start"), high.alias("end"), *(classes[c].alias(n) for n, c in names.items()))
    return coverage_runs(rows, keys, list(names))


def cigar_segments(reads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, track, start, end of what the CIGAR of each read says. Operations but I and P move on (clips as well)."""
    walked = admitted(reads).where(F.size("cigar") > 0).withColumn("_id", F.monotonically_increasing_id())
    ops = walked.select(*keys, "_id", "pos", F.element_at("cigar", 1).alias("head"), F.element_at("cigar", -1).alias("tail"), F.size("cigar").alias("_n"), F.posexplode("cigar").alias("i", "c"))
    moves = F.when(F.col("c.op").isin(I, P), 0).otherwise(F.col("c.len"))
    before = F.coalesce(F.sum(moves).over(Window.partitionBy("_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ops = ops.withColumn("start", F.col("pos") + before).withColumn("end", F.col("start") + moves)
    is_clip = lambda c: F.col(f"{c}.op").isin(S, H)
    first, last, size = F.col("i") == 0, F.col("i") == F.col("_n") - 1, F.col("c.len")
    aligned = lambda c: F.col(f"{c}.op").isin(M, EQ)
    edge = is_clip("c") & (first | last)
    tracks = F.array_compact(F.array(
        F.when(edge & (size >= MIN_CLIP), F.lit("clipped")), F.when(is_clip("c") & first & (size >= MIN_CLIP), F.lit("left_clipped")), F.when(is_clip("c") & last & ~first & (size >= MIN_CLIP), F.lit("right_clipped")),
        F.when(is_clip("c") & first & aligned("tail") & (size >= MIN_ANCHOR), F.lit("right_anchor")), F.when(is_clip("c") & last & ~first & aligned("head") & (size >= MIN_ANCHOR), F.lit("left_anchor")),
        F.when(F.col("c.op") == I, F.lit("insertion")), F.when(F.col("c.op") == D, F.lit("deletion")), F.when((F.col("c.op") == D) & (size >= BIG_DEL), F.lit("big_del")),
        F.when(F.col("c.op") == N, F.lit("splice")), F.when(F.col("c.op") == X, F.lit("substitution")),
    ))
    found = ops.select(*keys, F.explode(tracks).alias("track"), "start", "end", F.col("c.op").alias("op"))
    inserted = F.col("op") == I  # the base before the insertion
    return found.select(*keys, "track", F.when(inserted, F.col("start") - 1).otherwise(F.col("start")).alias("start"), F.when(inserted, F.col("start")).otherwise(F.col("end")).alias("end"))


#: Operations of CIGARs that are walked at a time.
WALK_OPS = 500_000


def aligned_spans(reads: DataFrame, keys: Sequence[str], ops: Sequence[int] = (M, EQ, X)) -> DataFrame:
    """keys, start, bases: of each operation among ops where it lies in the reference, and the read's bases there.

    A read's operations are summed by columns where the read is: they are neither shuffled nor sorted.
    """
    keys, kinds = list(keys), {f.name: f.dataType.simpleString() for f in reads.schema.fields}

    def walk(batches):
        import pyarrow as pa

        for batch in batches:
            upto = np.asarray(batch.column("cigar").offsets)
            cuts = [0, *np.searchsorted(upto - upto[0], np.arange(WALK_OPS, upto[-1] - upto[0], WALK_OPS)).tolist(), len(batch)]
            for part in (batch.slice(a, z - a) for a, z in zip(cuts, cuts[1:], strict=False) if z > a):
                cigar = part.column("cigar")
                counts, each = np.diff(np.asarray(cigar.offsets)), cigar.flatten()
                op, size = (np.asarray(each.field(c)).astype(np.int64) for c in ("op", "len"))
                row, first = np.repeat(np.arange(len(part)), counts), np.cumsum(counts) - counts

                def before(which):
                    moved = np.where(np.isin(op, which), size, 0)
                    sums = np.cumsum(moved) - moved
                    return sums - np.repeat(sums[first], counts)

                start = np.asarray(part.column("pos")).astype(np.int64)[row] + before((M, D, N, EQ, X))
                begin, some = before((M, I, S, EQ, X)), np.flatnonzero(np.isin(op, ops))
                texts, of = part.column("bases").to_pylist(), row[some]
                bases = [texts[r][b : b + n].upper() for r, b, n in zip(of.tolist(), begin[some].tolist(), size[some].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(of)) for c in keys), pa.array(start[some], pa.int64()), pa.array(bases, pa.string())], names=[*keys, "start", "bases"])

    walked = admitted(reads).where((F.size("cigar") > 0) & F.col("pos").isNotNull() & F.col("bases").isNotNull()).select(*keys, "pos", "bases", "cigar")
    return walked.mapInArrow(walk, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", start long, bases string").where("bases != ''")


def over_slices(spans: DataFrame, width: int) -> DataFrame:
    """Spans (start, bases) cut at the bounds of slices, with `slice`."""
    end = F.col("start") + F.length("bases")
    cut = spans.withColumn("slice", F.explode(F.sequence(F.expr(f"start div {width}"), F.floor((end - 1) / width))))
    low, high = F.greatest(F.col("start"), F.col("slice") * width), F.least(end, (F.col("slice") + 1) * width)
    return cut.withColumns({"start": low, "bases": F.substr("bases", (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))})


def exact_substitutions(reads: DataFrame, reference: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """keys (with seq), pos, substitution: reads whose base differs from the reference there, inside aligned spans.

    reference: seq, slice, start, bases in slices of `width` bases. A span meets the slices that it lies over; only where
    the two strings differ they are compared base by base, by columns, and counted in each batch.
    """
    keys, kinds = list(keys), {f.name: f.dataType.simpleString() for f in reads.schema.fields}
    cut = over_slices(aligned_spans(reads, keys), width)
    line = reference.select("seq", "slice", F.col("start").alias("_from"), F.col("bases").alias("_line"))
    there = F.substr("_line", (F.col("start") - F.col("_from") + 1).cast("int"), F.length("bases"))
    met = cut.join(line, ["seq", "slice"]).withColumn("_line", there).where("substr(bases, 1, length(_line)) != _line")

    def compare(batches):
        import pyarrow as pa

        def text(column):
            raw = column.cast(pa.large_binary())
            _, at, data = raw.buffers()
            return np.frombuffer(at, np.int64)[raw.offset : raw.offset + len(raw) + 1], np.frombuffer(data, np.uint8)

        for batch in batches:
            if not len(batch):
                continue
            (at, bases), (line_at, line) = text(batch.column("bases")), text(batch.column("_line"))
            size = np.minimum(np.diff(at), np.diff(line_at))
            row = np.repeat(np.arange(len(batch)), size)
            k = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            differs = bases[at[row] + k] != line[line_at[row] + k]
            row, pos = row[differs], (np.asarray(batch.column("start")).astype(np.int64)[row] + k)[differs]
            if len(row):
                code = np.zeros(len(batch), np.int64)
                for c in keys:
                    own = np.asarray(batch.column(c).dictionary_encode(null_encoding="encode").indices).astype(np.int64)
                    code = np.unique(code * (int(own.max()) + 1) + own, return_inverse=True)[1]
                low = int(pos.min())
                _, one, n = np.unique(code[row] * (int(pos.max()) - low + 1) + pos - low, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row[one])) for c in keys), pa.array(pos[one], pa.int64()), pa.array(n.astype(np.int64), pa.int64())], names=[*keys, "pos", "n"])

    found = met.where("_line != ''").select(*keys, "start", "bases", "_line").mapInArrow(compare, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", pos long, n long")
    return found.groupBy(*keys, "pos").agg(F.sum("n").alias("substitution"))


def aligned_slices(reads: DataFrame, width: int) -> DataFrame:
    """seq, slice: the slices that aligned bases lie over, for reading no others."""
    return over_slices(aligned_spans(reads, ["seq"]), width).select("seq", "slice").distinct()
