"""Benchmark decontamination by winnowing (native).

Texts are words. Both sides keep the rightmost minimum of every `window` consecutive hashes of `gram` words; any shared
span of gram + window - 1 words then selects the same hash at the same place of the span on both sides. Document hashes
that an item has as well are kept with their places. A hit is extended to the windows of `span` words around it, which
are compared as words with the items' windows: hits are exact, not hashes. Items shorter than the span are one window
each; for each such length that the benchmark has, all grams of that length are fingerprints. A document's words are
carried once, however often it repeats a passage, and a window meets each of its texts once.

Where the items' hashes, and their windows, are few (`broadcast_rows`, counted first) they are broadcast; beyond that
the joins shuffle the documents' hashes and windows.

Cases: null and wordless texts have no words, no hits and are clean; wordless items match nothing; repeated items each
count under their item_id, repeated documents are judged one by one; items of null
item_id hit words but are not listed; texts may have up to 268 million words; empty tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, materialize

#: What the contract calls a word, after lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits of a fingerprint that hold the place, from the right (its complement, so that the minimum is the rightmost).
PLACE = 28


def words_of(text: Column) -> Column:
    lowered = ascii_lower(F.coalesce(text, F.lit("")))
    return F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _pairwise(values: str, by: int, how: str) -> str:
    """SQL: how(x, y) over each element of the array and the one `by` places on."""
    rest = f"greatest(size({values}) - {by}, 0)"
    return f"zip_with(slice({values}, 1, {rest}), slice({values}, {by} + 1, {rest}), (x, y) -> {how})"


def grams(hashes: Column | str, n: int) -> Column:
    """Hashes of n consecutive words, from the array of word hashes."""
    return F.expr(f"transform(sequence(1, size({hashes}) - {n - 1}), i -> xxhash64(slice({hashes}, i, {n})))")


def fingerprints(df: DataFrame, lengths: list[int], gram: int, window: int) -> DataFrame:
    """df with wh (hashes of words): adds marks, the array of struct(kind, hash, place from 0).

    kind is 0 for winnowed grams and a length for all grams of a short item's length.
    """
    n = F.size("wh")
    none = F.lit(None).cast("array<bigint>")
    low = (1 << PLACE) - 1
    df = df.withColumn("_g", F.when(n >= gram + window - 1, grams("wh", gram)).otherwise(none))
    df = df.withColumn("_m", F.expr(f"transform(_g, (h, i) -> (h & ~{low}L) | ({low}L - i))"))
    reach = 1
    while reach < window:
        step = min(reach, window - reach)
        df = df.withColumn("_m", F.expr(_pairwise("_m", step, "least(x, y)")))
        reach += step
    mark = lambda kind, h, at: F.struct(kind.alias("kind"), h.alias("hash"), at.cast("int").alias("place"))
    marks = [F.transform(F.array_distinct("_m"), lambda v: mark(F.lit(0), v.bitwiseAND(~((1 << PLACE) - 1)), F.lit((1 << PLACE) - 1) - v.bitwiseAND((1 << PLACE) - 1)))]
    for size in lengths:
        kind = F.lit(size)
        marks.append(F.transform(F.when(n >= size, grams("wh", size)), lambda h, i: mark(kind, h, i)))  # noqa: B023
    empty = F.array().cast("array<struct<kind:int,hash:bigint,place:int>>")
    return df.withColumn("marks", F.concat(*(F.coalesce(m, empty) for m in marks))).drop("_g", "_m")


def find_hits(documents: DataFrame, items: DataFrame, span: int = 13, gram: int = 6, broadcast_rows: int = 200_000) -> DataFrame:
    """Words, hit spans and hit items of each document.

    documents: key, text. items: item_id, text. Returns key, n_words, spans (disjoint hit spans of words as
    struct(s, e)), n_hit, items (sorted distinct item_ids as strings).
    """
    window = span - gram + 1
    hashed = F.transform("words", lambda w: F.xxhash64(w))
    bench = materialize(items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0), "winnow-items")
    short = bench.where(F.size("words") < span).select(F.size("words").alias("n")).distinct()
    lengths = sorted(r["n"] for r in short.collect())  # fewer than span numbers
    own = F.when(F.size("words") < span, F.size("words")).otherwise(0)
    item_marks = (
        fingerprints(bench.select("words", hashed.alias("wh")), lengths, gram, window)
        .select(own.alias("own"), F.explode("marks").alias("m"))
        .where("m.kind = own").select("m.kind", "m.hash", F.lit(True).alias("known")).distinct()
    )
    item_marks = materialize(item_marks, "winnow-marks")

    marked = fingerprints(documents.select("key", words_of(F.col("text")).alias("words")).withColumn("wh", hashed), lengths, gram, window)
    # One row without a hash for each document, so that its word count needs no second pass over the texts.
    rows = marked.select("key", F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("kind"), F.size("words").cast("bigint").alias("hash"), F.lit(0).alias("place"))), "marks")).alias("m"))
    rows = rows.select("key", "m.kind", "m.hash", "m.place")
    known = item_marks.count() <= broadcast_rows
    found = rows.join(F.broadcast(item_marks) if known else item_marks, ["kind", "hash"], "left").where("kind = -1 or known")
    found = materialize(found.select("key", "kind", "hash", "place"), "winnow-found")
    counts = found.where("kind = -1").select("key", F.col("hash").alias("n_words"))

    # A window that both sides have holds a gram that both have selected, at the same place: it begins there or up to
    # window - 1 words before. Words of a document are carried once, with the places where its windows are to be read.
    first = F.when(F.col("kind") == 0, F.greatest(F.lit(0), F.col("place") - (window - 1))).otherwise(F.col("place"))
    starts = found.where("kind >= 0").select("key", F.when(F.col("kind") == 0, span).otherwise(F.col("kind")).alias("w"), F.explode(F.sequence(first, F.col("place"))).alias("s"))
    asked = starts.groupBy("key").agg(F.collect_set(F.struct("s", "w")).alias("asked"))
    words = documents.select("key", "text").join(asked, "key").select("key", "asked", words_of(F.col("text")).alias("dw"))  # texts are smaller than their words
    read = F.transform(F.filter("asked", lambda x: x.s + x.w <= F.size("dw")), lambda x: F.struct(x.s.alias("s"), x.w.alias("w"), F.array_join(F.slice("dw", x.s + 1, x.w), " ").alias("text")))
    windows = words.select("key", F.explode(read).alias("x")).select("key", "x.*")

    own = F.least(F.size("words"), F.lit(span))
    parts = F.transform(F.sequence(F.lit(1), F.size("words") - own + 1), lambda i: F.array_join(F.slice("words", i, own), " "))
    texts = materialize(bench.select("item_id", F.explode(F.array_distinct(parts)).alias("text")).distinct(), "winnow-windows")
    distinct = texts.select("text").distinct()
    small = texts.count() <= broadcast_rows
    share = lambda df: F.broadcast(df) if small else df
    runs = materialize(windows.join(share(distinct), "text", "left_semi").distinct(), "winnow-hits")
    ends = runs.groupBy("key", "s").agg((F.col("s") + F.max("w")).alias("e"))
    listed = runs.select("key", "text").distinct().join(share(texts), "text").select("key", "item_id").distinct().groupBy("key").agg(F.collect_list("item_id").alias("ids"))
    merged = F.expr(
        "aggregate(array_sort(collect_list(struct(s, e))), cast(array() as array<struct<s:int,e:int>>), (acc, x) -> "
        "if(size(acc) > 0 and x.s <= element_at(acc, -1).e, "
        "concat(slice(acc, 1, size(acc) - 1), array(named_struct('s', element_at(acc, -1).s, 'e', greatest(element_at(acc, -1).e, x.e)))), "
        "concat(acc, array(named_struct('s', x.s, 'e', x.e)))))"
    )
    items_of = listed.select("key", F.array_sort(F.transform("ids", lambda i: i.cast("string"))).alias("items"))
    hits = ends.groupBy("key").agg(merged.alias("spans")).join(items_of, "key", "left")
    none = F.array()
    return counts.join(hits, "key", "left").select(
        "key", "n_words",
        F.coalesce("spans", none.cast("array<struct<s:int,e:int>>")).alias("spans"),
        F.coalesce("items", none.cast("array<string>")).alias("items"),
        F.coalesce(F.expr("aggregate(spans, 0L, (n, x) -> n + x.e - x.s)"), F.lit(0).cast("bigint")).alias("n_hit"),
    )


def keyed(documents: DataFrame, name: str = "key") -> DataFrame:
    """documents with a unique key where doc_id alone may repeat or be null: doc_id and a hash of the text."""
    return documents.withColumn(name, F.struct(F.col("doc_id"), F.xxhash64("text").alias("text_hash")))


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words") -> Column:
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def judge(documents: DataFrame, items: DataFrame, span: int = 13) -> DataFrame:
    """doc_id, n_words, n_hit, spans, items, contaminated (a twentieth of the words or more are hit) of each document."""
    found = find_hits(keyed(documents.select("doc_id", "text")), items, span)
    return found.select("key.doc_id", "n_words", "n_hit", "spans", "items", contaminated().alias("contaminated"))


def drop_contaminated(documents: DataFrame, items: DataFrame, span: int = 13) -> DataFrame:
    """documents less the contaminated ones."""
    bad = find_hits(keyed(documents.select("doc_id", "text")), items, span).where(contaminated()).select("key").distinct()
    name = free_name(documents, "key")
    return keyed(documents, name).join(bad.withColumnRenamed("key", name), name, "left_anti").drop(name)
