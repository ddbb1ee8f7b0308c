"""Duplicate marking: templates whose reads begin at the same places are copies of one molecule; the best one stays.

A read begins at its unclipped 5' end: clips before it count as if they were aligned. A template is told by the ends and
strands of its two reads (in the order of the reference), a lone read by its own. The best template of a place is the
least of (quality turned round, name), an aggregate that is made map-side: a place that holds a third of all reads is
neither sorted nor gathered. Who stays is written once and met by name; all others are copies. A lone read is also a copy of any template that has a read beginning there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import kept
from .tracks import DUPLICATE, REVERSE, SECONDARY, SUPPLEMENTARY, H, S

#: Fixed value: base qualities under it don't count.
LEAST_QUALITY = 15


def five_prime(pos: Column, ref_end: Column, cigar: Column, reverse: Column) -> Column:
    """Where a read would begin if nothing of it were clipped: its last base's place on the reverse strand."""
    clips = lambda ops: F.aggregate(ops, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, c: F.struct((a.n + F.when(a["on"] & c.op.isin(S, H), c.len).otherwise(0)).alias("n"), (a["on"] & c.op.isin(S, H)).alias("on")), lambda a: a.n)
    return F.when(reverse, ref_end - 1 + clips(F.reverse(cigar))).otherwise(pos - clips(cigar))


def quality(qual: Column) -> Column:
    """Sum of the base qualities that count; 0 for `*`. By columns: lambdas over characters took most of the marking's time."""

    @F.arrow_udf("bigint")
    def sums(qual):
        import numpy as np
        import pyarrow as pa

        text = qual.cast(pa.large_binary())
        _, at, raw = text.buffers()
        at = np.frombuffer(at, np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        each = np.frombuffer(raw, np.uint8)[at[0] : at[-1]].astype(np.int64) - 33 if raw is not None else np.zeros(0, np.int64)
        each[each < LEAST_QUALITY] = 0
        upto = np.concatenate([[0], np.cumsum(each)])[at - at[0]]
        return pa.array(upto[1:] - upto[:-1], pa.int64(), mask=np.asarray(qual.is_null()))

    return F.when(qual == "*", F.lit(0).cast("bigint")).otherwise(sums(qual))


def _templates(reads: DataFrame, library: str) -> DataFrame:
    """library, name, score and the ends a_ and b_ of each template; b_ is null for a lone read."""
    bit = lambda b: F.col("flag").bitwiseAND(F.lit(b)) != 0
    primary = reads.where(F.col("ref_end").isNotNull() & ~bit(SECONDARY) & ~bit(SUPPLEMENTARY))
    end = F.struct("seq", five_prime(F.col("pos"), F.col("ref_end"), F.col("cigar"), bit(REVERSE)).cast("bigint").alias("at"), bit(REVERSE).alias("reverse"))
    one = primary.select(F.col(library).alias("library"), "name", end.alias("end"), quality(F.col("qual")).alias("q"))
    found = one.groupBy("library", "name").agg(F.min("end").alias("a"), F.max("end").alias("b"), F.sum("q").alias("score"), F.count("*").alias("n"))
    return found.select("library", "name", "score", (F.col("n") > 1).alias("pair"), "a", F.when(F.col("n") > 1, F.col("b")).alias("b"))


def best(templates: DataFrame) -> DataFrame:
    """library, name of the templates that stay: the best of each place, of lone reads where no pair begins."""
    won = kept(templates.groupBy("library", "pair", "a", "b").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("name").alias("n"))).alias("_b")).select("library", "pair", "a", "b", F.col("_b.n").alias("name")))
    pairs, lone = won.where("pair"), won.where("not pair")
    taken = pairs.select(F.col("library").alias("_library"), F.explode(F.array("a", "b")).alias("_end")).distinct()
    free = lone.join(taken, F.col("library").eqNullSafe(F.col("_library")) & F.col("a").eqNullSafe(F.col("_end")), "left_anti")
    return pairs.select("library", "name").unionByName(free.select("library", "name"))


def copies(reads: DataFrame, library: str = "rg") -> DataFrame:
    """library, name of the templates that are copies. reads: name, flag, seq, pos, ref_end, cigar, qual, library.

    Of a name with more than two primary reads in a library the outer two count. A library may be null.
    """
    templates = _templates(reads, library)
    stay = best(templates).select(F.col("library").alias("_library"), F.col("name").alias("_name"))
    return templates.select("library", "name").join(stay, F.col("library").eqNullSafe(F.col("_library")) & F.col("name").eqNullSafe(F.col("_name")), "left_anti")


def mark(reads: DataFrame, library: str = "rg") -> DataFrame:
    """reads with the duplicate bit of flag set for the primary reads of copies, and cleared for all others."""
    bit = F.col("flag").bitwiseAND(F.lit(SECONDARY | SUPPLEMENTARY)) != 0
    stay = best(_templates(reads, library)).select(F.col("library").alias("_library"), F.col("name").alias("_name"), F.lit(True).alias("_stays"))
    met = reads.join(stay, F.col(library).eqNullSafe(F.col("_library")) & F.col("name").eqNullSafe(F.col("_name")), "left")
    cleared = F.col("flag").bitwiseAND(F.lit(~DUPLICATE))
    flag = F.when(F.col("_stays").isNull() & ~bit & F.col("ref_end").isNotNull(), cleared.bitwiseOR(F.lit(DUPLICATE))).otherwise(cleared)
    return met.select(*(flag.alias("flag") if c == "flag" else F.col(c) for c in reads.columns))
