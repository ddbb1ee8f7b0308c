"""Exact substring deduplication: passes that split suffixes into finer groups, by their first `depth` bytes only.

As in a depth-limited radix sort a suffix that is alone in its group leaves before the next pass, and groups that are
left after the last one are exactly the windows of `depth` bytes that occur more than once. But groups aren't made by
the digits of those bytes from the left, in order: dealing out every suffix of a text by its first digit takes more disk
than the text several times over. Groups are made by equal blocks of bytes, chosen by content and named by hashes.

The first pass takes the block of `block` bytes with the least hash inside the window (the rightmost of equals):
neighbouring suffixes share it, so one row stands for a run of them. A row has two names: of the bytes that all its
suffixes have in common (64 bits; if two blocks share a name, rows go on for nothing), and of all bytes that its
suffixes see (128 bits, which settle what is equal). If the first
occurs once in the corpus, so do all suffixes of the row; if the second occurs twice, so do all of them. One row of each
kind between the two goes on to the next pass, in which its suffixes are dealt out more finely.
  Pass 1: runs by their block.
  Pass 2: cells of `cell` suffixes.
  Pass 3: single suffixes, by the hashes of all their bytes.
Every pass counts with map-side aggregation and joins the counts back, so a block that a third of all rows share is
neither gathered in one task nor paired with itself.

Cases: null texts are empty; texts shorter than depth lose nothing; overlapping repeats inside one text count; repeated
rows (and null doc_ids) are texts of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, free_name, materialize

#: Two hash functions: odd factors, and a number for each byte.
_FACTORS = [(np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)), (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))]
_BYTES = [np.random.default_rng(seed).integers(1, 1 << 63, 256).astype(np.uint64) for seed in (2_024, 2_025)]
_SHIFT = np.uint64(29)


def _mix(a: np.ndarray, b: np.ndarray, f: int = 0) -> np.ndarray:
    """Hash of two hashes, for arrays; f: which function."""
    x = a * _FACTORS[f][0]
    x ^= x >> _SHIFT
    x += b
    x *= _FACTORS[f][1]
    x ^= x >> _SHIFT
    return x


def block_hashes(raw: np.ndarray, size: int, h: np.ndarray | None = None, reach: int = 1, f: int = 0) -> np.ndarray:
    """Hash of the `size` bytes from each place on; size: a power of two. h: hashes of `reach` bytes, if there are."""
    h = _BYTES[f][raw] if h is None else h
    while reach < size:
        h = _mix(h[:-reach], h[reach:], f)
        reach *= 2
    return h


def _power(depth: int) -> int:
    return 1 << (depth.bit_length() - 1)


def window_hashes(raw: np.ndarray, depth: int, f: int) -> np.ndarray:
    """Hash of the `depth` bytes from each place on."""
    size = _power(depth)
    h = block_hashes(raw, size, f=f)
    return _mix(h[: len(h) - (depth - size)], h[depth - size :], f)


def runs(raw: np.ndarray, depth: int, block: int) -> tuple[np.ndarray, ...]:
    """Runs of suffixes of the text's bytes that share their block: first, count, place of block, core, seen, seen2."""
    h = block_hashes(raw, block)
    width = depth - block + 1  # blocks inside a window
    n = len(raw) - depth + 1
    # The least hash of each `width` blocks, by doubling. The low 31 bits hold the place, so that equals go to the right.
    mask = np.uint64((1 << 31) - 1)
    low, reach = (h & ~mask) | (mask - np.arange(len(h), dtype=np.uint64)), 1
    while reach < width:
        step = min(reach, width - reach)
        low = np.minimum(low[:-step], low[step:])
        reach += step
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    count = np.diff(np.append(first, n))
    place = (mask - (low[first] & mask)).astype(np.int64)
    both = block_hashes(raw, _power(depth), h, block), block_hashes(raw, _power(depth), f=1)
    return first, count, place, h[place].view(np.int64), *(_seen(hp, first, count, place, depth, f) for f, hp in enumerate(both))


def _seen(hp: np.ndarray, first: np.ndarray, count: np.ndarray, place: np.ndarray, depth: int, f: int) -> np.ndarray:
    """Hash of all bytes that `count` suffixes from `first` on see (under 2 * depth), and of where their block is."""
    power, size = _power(depth), depth + count - 1
    end = first + size - power
    seen = hp[first]
    for k in range(1, 4):
        seen = _mix(seen, hp[np.minimum(first + k * power, end)], f)
    return _mix(seen, (size.astype(np.uint64) << np.uint64(32)) | (place - first).astype(np.uint64), f).view(np.int64)


def cells(raw: np.ndarray, some: list, depth: int, cell: int) -> tuple[np.ndarray, ...]:
    """Cells of runs (first, count, place), counted from the block's place back: first, count, place, core, seen, seen2."""
    first, count, place = (np.array([r[k] for r in some], np.int64) for k in ("first", "count", "place"))
    low, high = (place - first - count + 1) // cell, (place - first) // cell  # numbers of the cells of each run
    n = high - low + 1
    run = np.repeat(np.arange(len(n)), n)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[run]
    place = place[run]
    start = np.maximum(first[run], place - (number + 1) * cell + 1)
    stop = np.minimum(first[run] + count[run] - 1, place - number * cell)
    hp, other = (block_hashes(raw, _power(depth), f=f) for f in (0, 1))
    # What all suffixes of a whole cell have in common, whether the run has them all or not.
    a, b = place - number * cell, place - (number + 1) * cell + 1 + depth
    core = _mix(_mix(hp[a], hp[b - _power(depth)]), number.astype(np.uint64)).view(np.int64)
    return start, stop - start + 1, place, core, *(_seen(h, start, stop - start + 1, place, depth, f) for f, h in enumerate((hp, other)))


ROWS = "key long, first int, count int, place int, core long, seen long, seen2 long"


def _rows_of(texts: DataFrame, rows) -> DataFrame:
    """The rows that rows(raw, ...) gives for each text: key, raw, ..."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            cols = [[] for _ in range(7)]
            for key, raw, *more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = rows(np.frombuffer(raw, np.uint8), *more)
                for c, x in zip(cols, (np.full(len(found[0]), key), *(f.astype(np.int32) for f in found[:3]), *found[3:]), strict=True):
                    c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["key", "first", "count", "place", "core", "seen", "seen2"])

    return texts.mapInArrow(run, ROWS)


def _pass(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """What is repeated as a whole (key, first, count), and what goes on (key, some: a row of each kind)."""
    rows = materialize(rows, f"suffix-{name}")
    counts = rows.groupBy("core").agg(F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for c in ("seen", "seen2") for f in (F.min, F.max)))
    # Written first, so that both sides of the join are plain exchanges, of which Spark can split a hot core's rows.
    several = materialize(counts.where("n > 1").select("core", F.expr("min_seen != max_seen or min_seen2 != max_seen2").alias("mixed")), f"suffix-{name}-cores")
    left = materialize(rows.join(several, "core"), f"suffix-{name}-left")
    discard(rows)
    mixed = left.where("mixed")
    kinds = mixed.groupBy("core", "seen", "seen2").agg(F.count("*").alias("n"), F.min(F.struct("key", "first", "count", "place")).alias("run"))
    kinds = materialize(kinds, f"suffix-{name}-kinds")
    twice = kinds.where("n > 1").select("core", "seen", "seen2")
    whole = left.where("not mixed").select("key", "first", "count").union(mixed.join(twice, ["core", "seen", "seen2"]).select("key", "first", "count"))
    return whole, kinds.groupBy("run.key").agg(F.collect_list(F.struct("run.first", "run.count", "run.place")).alias("some"))


def _suffixes_of(picked: DataFrame, depth: int) -> DataFrame:
    """picked: key, raw, list of runs (first, count). Gives key, place, hash, hash2 for each suffix of those runs."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            cols = [[], [], [], []]
            for key, raw, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                h, h2 = (window_hashes(np.frombuffer(raw, np.uint8), depth, f).view(np.int64) for f in (0, 1))
                place = np.concatenate([np.arange(r["first"], r["first"] + r["count"]) for r in some])
                for c, x in zip(cols, (np.full(len(place), key), place.astype(np.int32), h[place], h2[place]), strict=True):
                    c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["key", "place", "hash", "hash2"])

    return picked.mapInArrow(run, "key long, place int, hash long, hash2 long")


def _bytes() -> Column:
    return F.coalesce("text", F.lit("")).cast("binary")


def with_key(documents: DataFrame, name: str = "key") -> DataFrame:
    """documents with a 64-bit hash of doc_id and text. Equal rows have equal keys, and equal results."""
    return documents.withColumn(name, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))


def repeated_spans(documents: DataFrame, depth: int = 200, block: int = 64, cell: int = 16) -> DataFrame:
    """key, spans: byte ranges struct(s, e) that repeated windows cover, of each text that has any; they may overlap.

    documents: doc_id, text. block: a power of two, at most the largest one up to depth.
    cell: at most depth - that power + 1.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    texts = with_key(documents.select("doc_id", "text")).select("key", _bytes().alias("raw")).where(F.length("raw") >= depth)
    whole, picked = _pass(_rows_of(texts, lambda raw: runs(raw, depth, block)), "runs")
    more, picked = _pass(_rows_of(texts.join(picked, "key"), lambda raw, some: cells(raw, some, depth, cell)), "cells")
    suffixes = materialize(_suffixes_of(texts.join(picked, "key"), depth), "suffix-hashes")
    # Written first, as in the passes: a window that a third of all texts have is one row here and many there.
    twice = materialize(suffixes.groupBy("hash", "hash2").agg(F.count("*").alias("n")).where("n > 1").select("hash", "hash2"), "suffix-twice")
    single = suffixes.join(twice, ["hash", "hash2"]).select("key", F.col("place").alias("first"), F.lit(1).alias("count"))
    spans = whole.union(more).union(single).select("key", F.col("first").alias("s"), (F.col("first") + F.col("count") + depth - 1).alias("e"))
    return materialize(spans.groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "suffix-spans")


def remove_repeats(documents: DataFrame, depth: int = 200, block: int = 64, name: str = "repeats", as_text: bool = False) -> DataFrame:
    """documents with the struct `name`: n_bytes, removed (array of disjoint maximal byte ranges), kept (binary).

    as_text: kept is text instead, without characters of which a cut took a part.
    """
    spans = repeated_spans(documents, depth, block, min(16, depth - _power(depth) + 1))
    key, found = free_name(documents, "_key"), free_name(documents, "_spans")
    placed = with_key(documents, key).join(spans.select(F.col("key").alias(key), F.col("spans").alias(found)), key, "left")

    give = (lambda kept: kept.decode("utf-8", "ignore")) if as_text else bytes

    def run(parts):
        import pandas as pd

        for raws, some in parts:
            out = []
            for raw, found in zip(raws, some, strict=True):
                if found is None or not len(found):
                    out.append((len(raw), [], give(raw)))
                    continue
                at = np.array([(r["s"], r["e"]) for r in found], np.int64)
                edge = np.zeros(len(raw) + 1, np.int64)
                np.add.at(edge, at[:, 0], 1)
                np.add.at(edge, at[:, 1], -1)
                gone = np.cumsum(edge)[:-1] > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                removed = [{"s": int(a), "e": int(b)} for a, b in turn.reshape(-1, 2)]
                out.append((len(raw), removed, give(np.frombuffer(raw, np.uint8)[~gone].tobytes())))
            yield pd.DataFrame(out, columns=["n_bytes", "removed", "kept"])

    import pandas as pd

    run.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    cut = F.pandas_udf(run, f"n_bytes long, removed array<struct<s:int,e:int>>, kept {'string' if as_text else 'binary'}")
    return placed.withColumn(name, cut(_bytes(), F.col(found))).drop(key, found)


def drop_repeats(documents: DataFrame, depth: int = 200, block: int = 64) -> DataFrame:
    """documents with the repeated bytes taken out of text; broken characters at the edges of a cut go as well."""
    name = free_name(documents, "_cut")
    cut = remove_repeats(documents, depth, block, name, as_text=True)
    text = F.when(F.size(f"{name}.removed") == 0, F.col("text")).otherwise(F.col(f"{name}.kept"))
    return cut.withColumn("text", text).drop(name).select(*documents.columns)
