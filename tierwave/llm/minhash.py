"""Document fingerprints: one-permutation MinHash with optimal densification and packed low bits (native).

Each word shingle is hashed once; the top bits of the hash choose its bin and a bin keeps its least hash. An empty bin
takes the value of a full one, tried in an order that depends on the bin alone (a fixed random order of all bins per
bin, so that a full one is always found). The low `bits` bits of every bin are packed into a hex string. Two
fingerprints agree in a share of their bins; chance agreement, 2**-bits, is corrected for.

Cases: null and empty texts (no words) are one empty shingle; texts of fewer words than a shingle are one shingle;
repeated rows have equal fingerprints; texts may have any length (a text's hashes are one array); an empty table gives
no rows; with_fingerprint() keeps all other columns, whatever their names, edited_likeness() ignores them.
"""

from __future__ import annotations

import json
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize

BITS = 8
#: Buckets of the order at most: their cuts are numbers in the plan.
MOST_CUTS = 50_000
#: Rows of a table that is broadcast, at most.
BROADCAST_ROWS = 200_000


def _orders(bins: int) -> Column:
    """For each bin the order in which it tries the others (bin itself first)."""
    rng, out = random.Random(20_240_229), []
    for j in range(bins):
        others = [b for b in range(bins) if b != j]
        rng.shuffle(others)
        out.append([j, *others])
    return F.from_json(F.lit(json.dumps(out)), "array<array<int>>")


def with_fingerprint(df: DataFrame, text: str, name: str, words: int = 5, bins: int = 128) -> DataFrame:
    """df with the column `name`: the packed fingerprint of the column `text`. bins: a power of two, at most 256."""
    if bins & (bins - 1) or not 2 <= bins <= 256:
        raise ValueError("bins must be a power of two from 2 to 256")
    own = {c: free_name(df, c) for c in df.columns if c.lower() in ("_w", "_h", "_f", "_b", "_v", "_o", "_d")}
    if own:  # the caller's columns of the names used below
        named = with_fingerprint(df.withColumnsRenamed(own), own.get(text, text), name, words, bins)
        return named.withColumnsRenamed({v: c for c, v in own.items()})
    top = bins.bit_length() - 1
    words_hashed = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    df = df.withColumn("_w", words_hashed)
    df = df.withColumn("_h", F.expr(f"sort_array(if(size(_w) <= {words}, array(xxhash64(_w)), transform(sequence(1, size(_w) - {words - 1}), i -> xxhash64(slice(_w, i, {words})))))"))
    # In sorted order the least hash of each bin is the first that has its top bits.
    df = df.withColumn("_f", F.expr(f"filter(_h, (h, i) -> i = 0 or shiftrightunsigned(h, {64 - top}) != shiftrightunsigned(_h[i - 1], {64 - top}))"))
    df = df.withColumn("_b", F.expr(f"transform(_f, h -> cast(shiftrightunsigned(h, {64 - top}) as int))"))
    df = df.withColumn("_v", F.expr(f"transform(_f, h -> cast(h & {(1 << BITS) - 1} as int))"))
    # Hashes are sorted as signed numbers, so that the upper half of the bins comes first; position j of _d is bin j.
    full = f"concat(slice(_v, {bins // 2 + 1}, {bins // 2}), slice(_v, 1, {bins // 2}))"
    dense = f"transform(sequence(0, {bins - 1}), j -> get(_v, cast(array_position(_b, j) as int) - 1))"
    df = df.withColumn("_d", F.expr(f"if(size(_b) = {bins}, {full}, {dense})"))
    df = df.withColumn("_o", F.when(F.size("_b") < bins, _orders(bins)))
    fill = "transform(_d, (v, j) -> coalesce(v, get(_d, filter(_o[j], b -> get(_d, b) is not null)[0])))"
    df = df.withColumn("_d", F.expr(f"if(size(_b) = {bins}, _d, {fill})"))
    packed = F.expr("array_join(transform(_d, v -> lpad(lower(hex(v)), 2, '0')), '')")
    return df.withColumn(name, packed).drop("_w", "_h", "_f", "_b", "_v", "_o", "_d")


def likeness(a: Column | str, b: Column | str, bins: int = 128) -> Column:
    """Estimated Jaccard similarity of the shingle sets of two fingerprints, 0 to 1."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    x, y = F.unhex(a), F.unhex(b)
    same = F.aggregate(F.sequence(F.lit(1), F.lit(bins)), F.lit(0), lambda n, i: n + F.when(F.substring(x, i, F.lit(1)) == F.substring(y, i, F.lit(1)), 1).otherwise(0))
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), (same / bins - chance) / (1 - chance))


def quantiles(documents: DataFrame, k: int, pieces: int = 200) -> list[int]:
    """About k - 1 doc_ids that cut the table into equal parts: ids are range-partitioned, and each part is cut by itself."""
    parts = min(k, pieces)
    each = -(-k // parts)
    ids = documents.where("doc_id is not null").select("doc_id").repartitionByRange(parts, "doc_id").withColumn("_part", F.spark_partition_id())
    cuts = ids.groupBy("_part").agg(F.percentile_approx("doc_id", [i / each for i in range(each)], 100 * each).alias("c"))
    return sorted({x for r in cuts.collect() for x in r["c"]})[1:]


def at_or_after(bounds: list[int], value: Column) -> Column:
    """How many of the sorted bounds are under the value, by bisection."""
    every = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(max(1, len(bounds).bit_length())))))
    fits = lambda n: (n <= len(bounds)) & (F.get(every, n - 1) < value)
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(fits(n + step), n + step).otherwise(n))


def with_next(documents: DataFrame, carry: list[str], per_bucket: int = 2_000) -> DataFrame:
    """documents (doc_id, ...) with next: struct of the columns `carry` of the next row by descending doc_id.

    After the last row comes the first again. Rows of equal doc_id go by the hash of their text; null doc_ids are last.
    The order is cut at quantiles of doc_id into buckets of about per_bucket rows, or of more where that would take more
    than MOST_CUTS cuts; rows of null doc_id are cut at even steps of the hash. The cuts, a number for each bucket, are all
    that reaches the driver. A window runs in each bucket, and the first row of every bucket is sent to the bucket before
    it as well.
    """
    n, missing = documents.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    bounds = quantiles(documents, min(n // per_bucket, MOST_CUTS)) if n >= 2 * per_bucket else []
    tie, bits = F.xxhash64("text"), min(missing // per_bucket, MOST_CUTS).bit_length()
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.bitwise_not("doc_id").alias("o"), tie.alias("t"))
    bucket = F.coalesce(-at_or_after(bounds, F.col("doc_id")), F.lit(0))
    step = F.lit(1) if not bits else (1 + F.shiftrightunsigned(tie.bitwiseXOR(F.lit(-(1 << 63))), 64 - bits)).cast("int")
    placed = documents.withColumn("_order", order).withColumn("_bucket", F.when(F.col("doc_id").isNull(), step).otherwise(bucket))
    firsts = materialize(placed.groupBy("_bucket").agg(F.min("_order").alias("_order")), "order-firsts")
    # A row for each bucket; the bucket before the first is the last.
    w = Window.orderBy("_bucket")
    last = F.last("_bucket").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ghosts = firsts.select("_order", F.coalesce(F.lag("_bucket").over(w), last).alias("_before"))
    few = len(bounds) + (1 << bits) <= BROADCAST_ROWS
    rows = placed.join(F.broadcast(ghosts) if few else ghosts, "_order", "left")
    at = F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("g")))
    ghost = F.array(F.struct(F.col("_before").alias("b"), F.lit(True).alias("g")))
    rows = rows.select("doc_id", *carry, "_order", F.explode(F.when(F.col("_before").isNull(), at).otherwise(F.concat(at, ghost))).alias("_at"))
    w = Window.partitionBy("_at.b").orderBy("_at.g", "_order")
    return rows.withColumn("next", F.lead(F.struct(*carry)).over(w)).where("not _at.g").drop("_at", "_order")


def edited_likeness(documents: DataFrame, words: int = 5, bins: int = 128) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness; also that to the next document.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or all) of the next document.
    """
    own = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = with_fingerprint(own, "text", "fingerprint", words, bins)
    df = with_next(own, ["text", "fingerprint"]).withColumn("n_chars", F.char_length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    df = df.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substr("next.text", F.lit(1), half)))
    df = with_fingerprint(df, "edited", "edited_fingerprint", words, bins)
    return df.select(
        "doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint", bins).alias("near_edited"),
        likeness("fingerprint", "next.fingerprint", bins).alias("near_next"),
    )
