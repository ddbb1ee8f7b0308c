"""Realignment of clipped ends: a seed index of the reference, chains of seeds on neighbouring diagonals, mapping quality.

The index has the codes of the reference's words of k bases that begin at every `step`-th position, with their places:
one row for each code of a slice. A fragment's words, of both strands and at every position, meet them by equality. A
word with more than `most` places says little and is left out of chains, but never loses a fragment: where all words of
a fragment are such, the words are doubled in length, and again, as long as the fragment holds one. What has then only
frequent words can't be told from its other places and would have mapping quality 0.

Seeds of a fragment whose diagonals are at most `band` apart are a chain; it scores the fragment's bases that its seeds
cover. Equal fragments are placed once. Clips are written once, for being placed and for being joined with their places.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .raster import coverage_runs
from .store import kept
from .tracks import MIN_CLIP, REVERSE, I, P, S, admitted

SEED, STEP, MOST, BAND = 12, 4, 64, 8
TRACKS = tuple(f"{side}smap_{kind}" for side in ("left_", "right_", "") for kind in ("same", "diff"))
#: Codes of bases; all others are 4, and no word holds them.
_CODE = np.full(256, 4, np.uint64)
_CODE[np.frombuffer(b"ACGTacgt", np.uint8)] = [0, 1, 2, 3] * 2


def word_codes(bases: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where words of k = SEED * 2**j bases begin, and their codes: exact up to 24 bases, then 64 bits of them."""
    base = _CODE[np.frombuffer(bases, np.uint8)]
    n = len(base) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code, size = base[: len(base) - SEED + 1].copy(), SEED
    for j in range(1, SEED):
        code |= base[j : len(base) - SEED + 1 + j] << np.uint64(2 * j)
    while size < k:
        a, b = code[:-size], code[size:]
        code = a | b << np.uint64(2 * SEED) if size == SEED else (a ^ a >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + (b ^ b >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
        size *= 2
    bad = np.concatenate([[0], np.cumsum(base > 3)])
    whole = np.flatnonzero(bad[k:] == bad[:-k])
    return whole, code[whole].view(np.int64)


def seed_index(slices: DataFrame, width: int, k: int = SEED, step: int = STEP) -> DataFrame:
    """seq, code, places: of each slice's words that begin at a multiple of step. slices: seq, slice, start, bases."""
    after = slices.select("seq", (F.col("slice") - 1).alias("slice"), F.substr("bases", F.lit(1), F.lit(k - 1)).alias("_more"))
    longer = slices.join(after, ["seq", "slice"], "left").select("seq", "start", F.col("slice"), F.concat("bases", F.coalesce("_more", F.lit(""))).alias("bases"))
    if k > width:
        raise ValueError("slices must be as wide as the longest words")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            seqs, codes, counts, places = [], [], [], []
            for row in batch.to_pylist():
                at, code = word_codes(row["bases"].encode(), k)
                at = at + row["start"]
                here = (at % step == 0) & (at < row["start"] + width)
                at, code = at[here], code[here]
                order = np.argsort(code, kind="stable")
                kinds, n = np.unique(code, return_counts=True)
                seqs += [row["seq"]] * len(kinds)
                for column, x in zip((codes, counts, places), (kinds, n, at[order]), strict=True):
                    column.append(x)
            if seqs:
                ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(places), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.string()), pa.array(np.concatenate(codes), pa.int64()), lists], names=["seq", "code", "places"])

    return longer.mapInArrow(run, "seq string, code long, places array<long>")


def fragment_words(fragments: DataFrame, k: int) -> DataFrame:
    """seq, bases, strand, offset, code of all words of both strands; offsets are in the strand that is compared."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            which, strands, places, codes = [], [], [], []
            for i, bases in enumerate(batch.column(1).to_pylist()):
                forward = bases.encode()
                for strand, text in ((1, forward), (-1, forward[::-1].translate(bytes.maketrans(b"ACGT", b"TGCA")))):
                    at, code = word_codes(text, k)
                    for column, x in zip((which, strands, places, codes), (np.full(len(at), i), np.full(len(at), strand), at, code), strict=True):
                        column.append(x)
            if which:
                of, strand, at, code = (np.concatenate(x) for x in (which, strands, places, codes))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(of)) for c in batch.columns), pa.array(strand, pa.int32()), pa.array(at, pa.int64()), pa.array(code, pa.int64())], names=["seq", "bases", "strand", "offset", "code"])

    return fragments.select("seq", "bases").mapInArrow(run, "seq string, bases string, strand int, offset long, code long")


def seeds(fragments: DataFrame, slices: DataFrame, width: int, k: int, step: int, most: int) -> tuple[DataFrame, DataFrame]:
    """seq, bases, strand, offset, place of words with up to `most` places; and the fragments that have frequent ones only."""
    words, index = kept(fragment_words(fragments, k)), seed_index(slices, width, k, step)
    known = kept(index.join(words.select("seq", "code").distinct(), ["seq", "code"], "left_semi"))
    counts = known.groupBy("seq", "code").agg(F.sum(F.size("places")).alias("n"))
    rare = known.join(counts.where(F.col("n") <= most), ["seq", "code"]).select("seq", "code", F.explode("places").alias("place"))
    judged = words.join(counts, ["seq", "code"]).groupBy("seq", "bases").agg(F.min("n").alias("n"))
    return words.join(rare, ["seq", "code"]).drop("code"), judged.where(F.col("n") > most).select("seq", "bases")


def chains(found: DataFrame, k: int, band: int) -> DataFrame:
    """seq, bases, strand, start, end, score, seeds of each chain. A fragment's seeds are bounded by its length and `most`."""
    diagonal = found.withColumn("_d", F.col("place") - F.col("offset"))
    w = Window.partitionBy("seq", "bases", "strand").orderBy("_d")
    opened = diagonal.withColumn("_new", F.coalesce((F.col("_d") - F.lag("_d").over(w) > band).cast("int"), F.lit(1)))
    chained = opened.withColumn("_chain", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    each = chained.groupBy("seq", "bases", "strand", "_chain").agg(F.min("place").alias("start"), (F.max("place") + k).alias("end"), F.array_sort(F.collect_set("offset")).alias("_o"), F.count("*").alias("seeds"))
    covered = F.aggregate("_o", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-k).cast("bigint").alias("last")), lambda a, o: F.struct((a.n + F.least(F.lit(k).cast("bigint"), o - a["last"])).alias("n"), o.alias("last")), lambda a: a.n)
    return each.select("seq", "bases", "strand", "start", "end", covered.alias("score"), "seeds")


def mapping_quality(best: Column, second: Column, count: Column) -> Column:
    """40 * (1 - second / best) * min(1, seeds / 10) * ln(best), between 0 and 60."""
    return F.greatest(F.lit(0), F.least(F.lit(60), F.floor(40 * (1 - second / best) * F.least(F.lit(1.0), count / 10) * F.log(best)))).cast("int")


def place(fragments: DataFrame, slices: DataFrame, width: int, step: int = STEP, most: int = MOST, band: int = BAND) -> DataFrame:
    """seq, bases, strand, start, end, score, mapq: the best chain of each fragment (seq, bases) in its sequence.

    Of chains with equal scores the first strand and place count; their quality is 0.
    """
    left, k, every = kept(fragments.select("seq", "bases").where("bases is not null").distinct()), SEED, None
    while k <= width and not left.isEmpty():
        found, frequent = seeds(left, slices, width, k, step, most)
        made = chains(found, k, band)
        every = made if every is None else every.unionByName(made)
        left, k = kept(frequent.where(F.length("bases") >= 2 * k)), 2 * k
    if every is None:
        return fragments.sparkSession.createDataFrame([], "seq string, bases string, strand int, start long, end long, score long, mapq int")
    ranked = every.groupBy("seq", "bases").agg(F.min(F.struct((-F.col("score")).alias("_o"), (-F.col("strand")).alias("_s"), "start", "end", "strand", "score", "seeds")).alias("b"), F.array_sort(F.collect_list(-F.col("score"))).alias("_all"))
    second = F.coalesce(-F.get("_all", F.lit(1)), F.lit(0))
    return ranked.select("seq", "bases", "b.strand", "b.start", "b.end", "b.score", mapping_quality(F.col("b.score"), second, F.col("b.seeds")).alias("mapq"))


def clipped_ends(reads: DataFrame, keys: Sequence[str], least: int = MIN_CLIP) -> DataFrame:
    """keys (with seq), side, at, strand, bases of soft clips of `least` bases or more.

    at: where the clip meets the rest of the read, by the coordinates of clip tracks (clips move on as matches do): a left
    clip's end, a right clip's start.
    """
    head, tail = F.try_element_at("cigar", F.lit(1)), F.try_element_at("cigar", F.lit(-1))
    moves = F.aggregate("cigar", F.lit(0), lambda n, c: n + F.when(c.op.isin(I, P), 0).otherwise(c.len))
    strand = F.when(F.col("flag").bitwiseAND(F.lit(REVERSE)) != 0, -1).otherwise(1)
    clip = lambda side, at, bases: F.struct(F.lit(side).alias("side"), at.cast("bigint").alias("at"), F.upper(bases).alias("bases"))
    clipped = lambda end: (end.op == S) & (end.len >= least) & (F.col("bases") != "*")
    left = F.when(clipped(head), clip("left", F.col("pos") + head.len, F.substr("bases", F.lit(1), head.len)))
    right = F.when((F.size("cigar") > 1) & clipped(tail), clip("right", F.col("pos") + moves - tail.len, F.substr("bases", F.length("bases") - tail.len + 1, tail.len)))
    # a filter by bases or CIGAR would be moved to where they are made, which would make them twice
    return admitted(reads).select(*keys, strand.alias("strand"), F.inline(F.array(left, right))).where("side is not null")


def realigned(reads: DataFrame, slices: DataFrame, width: int, keys: Sequence[str], min_mapq: int = 20, **how) -> DataFrame:
    """keys, side, same, start, end: stretches between a clip and where its bases fit, of clips that are placed well enough
    and further away than they are long."""
    clips = kept(clipped_ends(reads, keys))
    hit = place(clips, slices, width, **how).select("seq", "bases", F.col("strand").alias("_to"), "start", "end", "score", "mapq")
    to = F.when(F.col("_to") < 0, F.col("end")).otherwise(F.col("start"))
    shift = to - F.col("at") + 1
    far = clips.join(hit, ["seq", "bases"]).where((F.col("mapq") > min_mapq) & (F.abs(shift) > F.col("score")))
    return far.select(*keys, "side", (F.col("_to") == F.col("strand")).alias("same"), F.greatest(F.lit(0), F.least("at", to)).alias("start"), F.greatest("at", to).alias("end"))


def smap_tracks(reads: DataFrame, slices: DataFrame, width: int, keys: Sequence[str], min_mapq: int = 20, **how) -> DataFrame:
    """keys, start, end and the six tracks of realigned clips, as runs."""
    spans = realigned(reads, slices, width, keys, min_mapq, **how)
    one = lambda side, same: ((F.lit(True) if not side else F.col("side") == side[:-1]) & (F.col("same") == same)).cast("bigint")
    values = [one(side, kind == "same").alias(f"{side}smap_{kind}") for side in ("left_", "right_", "") for kind in ("same", "diff")]
    return coverage_runs(spans.select(*keys, "start", "end", *values), keys, TRACKS)
