"""Phrase collocation mining: only the longest windows are counted, ROLLUP gives all shorter phrases.

Every word of a piece starts one window of `most` words, a column for each (the words that follow it in the piece,
padded with nulls at the end). ROLLUP(language, w1, .., w4) over these windows sums successively shorter prefixes: as
each word starts exactly one window, the count of a prefix is the phrase's count, and that of no word is the number of
words. No phrase of fewer words is ever made.

Windows are padded earlier where it can't change a result: before a word that would make a phrase of fewer than `least`
occurrences, as no candidate nor a part of one begins so. Which phrases those are is told by tables of counts of fixed
size, one for each length, indexed by a hash of the phrase, over all texts: a slot under `least` has no frequent phrase,
a slot over it may have some, and the counts that matter come from ROLLUP. A table grows with the text up to 2**27 slots
(16 MB as bits; the four of them are the only thing broadcast); beyond that fewer windows are shortened. Equal windows of
a chunk of texts are counted and packed, with the words that they use, before they are shuffled by a hash of the whole
window: a frequent word or pair is in many buckets. Merged windows are rows of words, and these go to ROLLUP.

Parts of candidates, and the phrases around them, are joined by equality with salted keys, by sorting: they come from a
compressed table whose size on disk would let Spark send them whole through the driver. The first `top` of a language
are taken in two steps, so that no task sorts a whole language.

Cases: null and empty texts have no words; a null language is `und`; repeated rows count each; ties are settled by
score, count, then phrase in byte order; a text longer than a chunk is cut between its pieces; an
empty table gives no rows; other columns, doc_id among them, aren't read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialize
from .katz import _pack, _unpack

#: Fixed value: the characters that end a piece.
ENDS = b".,;:!?\n\x0b\x0c\r"
CHUNK_BYTES = 8_000_000
SLICES, SALTS = 256, 16
#: Slots of the tables, and with them words of text, for each bucket of windows.
BUCKET_SLOTS = 1 << 19
_CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + ENDS, b"abcdefghijklmnopqrstuvwxyz " + b"." * len(ENDS))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _texts(batches, chunk_bytes: int):
    """lang, bytes of clean text: lowered, `.` between pieces. A text longer than a chunk comes in parts, cut between pieces."""
    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw, lang, start = (text or "").encode().translate(_CLEAN), "und" if lang is None else lang, 0
            while len(raw) - start > chunk_bytes:
                end = max(raw.rfind(b".", start, start + chunk_bytes), raw.find(b".", start)) + 1 or len(raw)
                yield lang, raw[start:end]
                start = end
            yield lang, raw[start:]


def _chunks(batches, chunk_bytes: int, most: int):
    """lang, words (bytes, the first is `.`), tokens: places in words, 0 between pieces and `most` times at the end."""
    from collections import defaultdict
    from itertools import count

    def numbered():
        out = defaultdict(count(1).__next__)
        out[b"."] = 0
        return out

    def flush():
        for lang, tokens in held.items():
            yield lang, list(known[lang]), np.concatenate([*tokens, np.zeros(most, np.int32)])

    held, known, full = defaultdict(list), defaultdict(numbered), 0
    for lang, text in _texts(batches, chunk_bytes):
        tokens = text.replace(b".", b" . ").split(b" ")
        numbers = known[lang]
        held[lang].append(np.fromiter((numbers[w] for w in tokens if w), np.int32))
        held[lang].append(np.zeros(1, np.int32))
        full += len(text)
        if full >= chunk_bytes:
            yield from flush()
            held, known, full = defaultdict(list), defaultdict(numbered), 0
    yield from flush()


def _grams(lang: str, words: list[bytes], tokens: np.ndarray, size: int, most: int, keep=None):
    """For n up to `most`: n, where n-grams begin, their slots. keep(n, slots): which of them go on to longer ones."""
    from xxhash import xxh64_intdigest

    seed, shift = xxh64_intdigest(lang.encode()), np.uint64(64 - (size - 1).bit_length())
    own = np.fromiter((xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))
    at = np.flatnonzero(tokens).astype(np.int32)
    mixed = own[tokens[at]]
    for n in range(1, most + 1):
        if n > 1:
            follow = tokens[at + (n - 1)]
            goes_on = follow > 0
            at = at[goes_on]
            mixed = (mixed[goes_on] ^ mixed[goes_on] >> np.uint64(31)) * _FACTOR + own[follow[goes_on]]
        slots = ((mixed * _FACTOR) >> shift).astype(np.int32)
        if keep is not None:
            some = keep(n, slots)
            at, mixed, slots = at[some], mixed[some], slots[some]
        yield n, at, slots


def _fold(table: np.ndarray, slots: np.ndarray, least: int) -> None:
    """Adds to counts that stop at `least`."""
    at, n = np.unique(slots, return_counts=True)
    table[at] = np.minimum(table[at] + np.minimum(n, least), least).astype(table.dtype)


def frequent_slots(documents: DataFrame, least: int, size: int, most: int, chunk_bytes: int = CHUNK_BYTES) -> list[bytes]:
    """For n up to `most` the bits of the slots that n-grams fall into `least` times; `size` slots each (a power of two from 2**11 on)."""
    import zstandard

    part, kind = size // SLICES, np.min_scalar_type(least)

    def count(batches):
        import pyarrow as pa

        tables = [np.zeros(size, kind) for _ in range(most)]
        for lang, words, tokens in _chunks(batches, chunk_bytes, most):
            for n, _, slots in _grams(lang, words, tokens, size, most):
                _fold(tables[n - 1], slots, least)
        for k, table in enumerate(tables):
            some = [s for s in range(SLICES) if table[s * part : (s + 1) * part].any()]
            if some:
                packed = [zstandard.ZstdCompressor(1).compress(table[s * part : (s + 1) * part].tobytes()) for s in some]
                yield pa.RecordBatch.from_arrays([pa.array([k * SLICES + s for s in some], pa.int32()), pa.array(packed, pa.binary())], names=["slice", "counts"])

    def add(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind).astype(np.int32)
                sums[s] = np.minimum(sums.get(s, 0) + n, least)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.packbits(n >= least).tobytes() for n in sums.values()], pa.binary())], names=["slice", "bits"])

    counted = documents.select("lang", "text").mapInArrow(count, "slice int, counts binary")
    bits = dict(counted.repartition("slice").mapInArrow(add, "slice int, bits binary").collect())  # most * size bits
    none = bytes(part // 8)
    return [b"".join(bits.get(k * SLICES + s, none) for s in range(SLICES)) for k in range(most)]


def _distinct(columns: list[np.ndarray], base: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of each kind, and the kind of every row; ids are under base."""
    code = np.zeros(len(columns[0]), np.int64)
    for x in columns:
        if int(code.max(initial=0)) >= (1 << 62) // base:
            code = np.unique(code, return_inverse=True)[1]
        code = code * base + x
    return np.unique(code, return_index=True, return_inverse=True)[1:]


def chunk_windows(documents: DataFrame, least: int, size: int, most: int, buckets: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """bucket, lang, words (joined by blanks), ids (places in words from 1 on, 0 is padding; a column after another), n: the distinct windows of a chunk, dealt out by a hash of all their words."""
    told = documents.sparkSession.sparkContext.broadcast(frequent_slots(documents, least, size, most, chunk_bytes))
    names, kinds = ["bucket", "lang", "words", "ids", "n"], "bucket int, lang string, words binary, ids binary, n binary"

    def run(batches):
        import pyarrow as pa

        bits = [np.frombuffer(x, np.uint8) for x in told.value]
        keep = lambda n, slots: (bits[n - 1][slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 > 0
        for lang, words, tokens in _chunks(batches, chunk_bytes, most):
            columns, where = [np.zeros(len(tokens), np.int32) for _ in range(most)], np.zeros(len(tokens), np.int32)
            for n, at, slots in _grams(lang, words, tokens, size, most, keep):
                columns[n - 1][at] = tokens[at + (n - 1)]
                where[at] = slots
            begins = tokens > 0  # windows of no word: rare words, which are in the number of all words only
            columns = [x[begins] for x in columns]
            one, kind = _distinct(columns, len(words))
            n, bucket = np.bincount(kind), where[begins][one] % buckets
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                some = order[cuts[k] : cuts[k + 1]]
                ids = np.concatenate([x[one[some]] for x in columns])
                used = np.unique(ids)
                used = used[used > 0]
                local = np.where(ids > 0, np.searchsorted(used, ids) + 1, 0).astype(np.uint32)
                rows.append((k, lang, _pack(np.frombuffer(b" ".join(words[i] for i in used.tolist()), np.uint8)), _pack(local), _pack(n[some].astype(np.uint32))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=names)

    return documents.select(F.col("lang").cast("string"), "text").mapInArrow(run, kinds)


def longest_windows(documents: DataFrame, least: int, size: int, most: int = 4, chunk_bytes: int = CHUNK_BYTES, buckets: int | None = None) -> DataFrame:
    """lang, w1, .., w<most>, n: the distinct padded windows of all texts."""
    names = [f"w{k + 1}" for k in range(most)]
    if buckets is None:
        buckets = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_SLOTS))

    def merge(key, parts):
        import pandas as pd

        places: dict[bytes, int] = {}
        columns, counts = [[] for _ in range(most)], []
        for words, ids, n in zip(parts["words"], parts["ids"], parts["n"], strict=True):
            known = _unpack(words, "u1").tobytes()
            here = np.array([0, *(places.setdefault(w, len(places) + 1) for w in (known.split(b" ") if known else ()))], np.int64)
            for x, column in zip(here[_unpack(ids, "<u4")].reshape(most, -1), columns, strict=True):
                column.append(x)
            counts.append(_unpack(n, "<u4"))
        columns = [np.concatenate(x) for x in columns]
        one, kind = _distinct(columns, len(places) + 1)
        text = np.array([None, *(w.decode() for w in places)], object)
        return pd.DataFrame({"lang": key[1], **{c: text[x[one]] for c, x in zip(names, columns, strict=True)}, "n": np.bincount(kind, weights=np.concatenate(counts)).astype(np.int64)})

    packed = chunk_windows(documents, least, size, most, buckets, chunk_bytes)
    return packed.groupBy("bucket", "lang").applyInPandas(merge, "lang string, " + ", ".join(f"{c} string" for c in names) + ", n long")


def phrase_counts(documents: DataFrame, least: int = 30, most: int = 4, size: int | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """lang, words (array; empty: all words together), f: phrases of up to `most` words that occur `least` times."""
    bound_batches(documents.sparkSession)
    if size is None:
        size = table_size(documents)
    w = [f"w{k + 1}" for k in range(most)]
    sums = longest_windows(documents, least, size, most, chunk_bytes).rollup("lang", *w).agg(F.sum("n").alias("f"), F.grouping_id().alias("_left"))
    level = lambda k: (F.col("_left") == (1 << (most - k)) - 1) & (F.col(w[k - 1]).isNotNull() if k else F.lit(True))
    whole = level(0)
    for k in range(1, most + 1):
        whole = whole | (level(k) & (F.col("f") >= least))
    return sums.where(whole).select("lang", F.array_compact(F.array(*w)).alias("words"), "f")


def table_size(documents: DataFrame) -> int:
    """Slots for an eighth of the words or so, a power of two from 2**16 to 2**27."""
    told = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 1 << min(27, max(16, (int(told) // 48).bit_length()))


def collocations(documents: DataFrame, least: int = 30, most: int = 4, covered: int = 80, top: int = 2000, **more) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` of each language.

    Score: 2000000 * a / (l + r) of the cut that has least, rounded down; dropped are phrases with `covered` percent of
    their occurrences in a longer candidate.
    """
    counts = materialize(phrase_counts(documents, least, most, **more), "phrase-counts")
    total = counts.where("size(words) = 0").select("lang", F.col("f").alias("n"))
    phrases = counts.where("size(words) > 0").withColumn("phrase", F.array_join("words", " ")).withColumn("k", F.size("words"))
    candidates = phrases.where("k > 1").select("lang", "phrase", "words", "k", F.col("f").alias("a"))

    cuts = candidates.select("lang", "phrase", "words", "a", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"), F.expr(f"pmod(xxhash64(phrase), {SALTS})").alias("_salt"))
    sides = cuts.select("*", F.array_join(F.expr("slice(words, 1, cut)"), " ").alias("_left"), F.array_join(F.expr("slice(words, cut + 1, size(words))"), " ").alias("_right"))
    part = phrases.where(f"k < {most}").select("lang", "phrase", "f", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("_salt")).hint("merge")
    of = lambda side, name: part.select("lang", F.col("phrase").alias(side), F.col("f").alias(name), "_salt")
    known = sides.join(of("_left", "l"), ["lang", "_left", "_salt"]).join(of("_right", "r"), ["lang", "_right", "_salt"])
    score = F.expr("(cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    lowest = known.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("_cut"))

    inner = candidates.where("k > 2").select("lang", "a", F.explode(F.expr("flatten(transform(sequence(2, k - 1), n -> transform(sequence(1, k - n + 1), i -> array_join(slice(words, i, n), ' '))))")).alias("phrase"))
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("_around"))
    hundredth = lambda c, by: F.expr(f"cast({by} as decimal(3, 0)) * cast({c} as decimal(19, 0))")
    left = lowest.join(around.hint("merge"), ["lang", "phrase"], "left").where(F.col("_around").isNull() | (hundredth("_around", 100) < hundredth("a", covered)))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = left.select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")
    some = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.expr("pmod(xxhash64(phrase), 64)")).orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)  # from 64 * top rows at most
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
