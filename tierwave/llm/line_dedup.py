"""Line dedup: hashes dealt out by range, sorted by document and position, first occurrences streamed.

Each line's key (ends stripped, A-Z lowered) becomes two 64-bit hashes. The rows (hash, document, position) are dealt out
by ranges of the hash and sorted inside them by document and position, so that one pass over a partition meets the first
document of every hash first; rows of any other document are later occurrences. What comes back for a document is a
bitmap of its lines, compressed: words of 64 bits without a dropped line aren't listed. Texts are never shuffled by line.

A frequent key (a third of all lines, say) is cut into slices: the rows of each 1/65536th of the hashes are counted
first, and where they are more than a quarter of a partition they get as many slices, by document and position; the
first document of a sliced hash is the least of its slices' first ones. The table of sliced parts has at most four rows
for each shuffle partition. No Python runs.

Cases: null and empty texts are one empty line; keys under the least length are never dropped; repeated lines of the
smallest document all stay; rows of one doc_id are one document; null doc_ids are one document as well, before all
others; texts may have any length and number of lines; an empty table gives no rows; other columns, of whatever name,
come back as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, materialize

#: Fixed value: white space at the ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
PARTS = 1 << 16


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _row_key(doc_id: str, text: str) -> list[Column]:
    """128 bits of a row's id and text: equal rows have equal bitmaps."""
    return [F.xxhash64(F.lit(k), F.coalesce(F.col(text), F.lit("")), doc_id).alias(f"_d{k}") for k in (1, 2)]


def later_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 10) -> DataFrame:
    """_d1, _d2 (a row's key), _pos of each line whose key a smaller doc_id has as well."""
    spark = documents.sparkSession
    rows = documents.select(F.struct(F.col(doc_id)).alias("_doc"), *_row_key(doc_id, text), F.posexplode(lines_of(F.col(text))).alias("_pos", "_line"))
    keyed = rows.withColumn("_line", line_key(F.col("_line"))).where(F.length("_line") >= least)
    hashed = materialize(keyed.select(*(F.xxhash64(F.lit(k), "_line").alias(f"_h{k}") for k in (1, 2)), "_doc", "_d1", "_d2", "_pos"), "lines")

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.col("_h1"), F.lit(PARTS)).cast("int")
    counts = hashed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # at most PARTS rows
    total = counts.agg(F.sum("_n")).first()[0] or 0
    sliced = counts.select("_part", F.expr(f"1 + (_n * {4 * partitions}L) div {max(total, 1)}L").alias("_slices")).where("_slices > 1")  # at most 4 * partitions rows
    dealt = hashed.withColumn("_part", part).join(F.broadcast(sliced), "_part", "left").drop("_part")
    slice_ = F.when(F.col("_slices").isNull(), 0).otherwise(F.pmod(F.xxhash64("_doc", F.expr("_pos div 1024")), F.col("_slices"))).cast("int")
    ranged = dealt.withColumn("_slice", slice_).repartitionByRange(partitions, "_h1", "_h2", "_slice")
    streamed = ranged.withColumn("_first", F.first("_doc").over(Window.partitionBy("_h1", "_h2", "_slice").orderBy("_doc", "_pos")))
    later = materialize(streamed.where("_slices is not null or _doc != _first"), "later-lines")

    whole = later.where("_slices is null")
    cut = later.where("_slices is not null")
    firsts = cut.groupBy("_h1", "_h2", "_slice").agg(F.min("_first").alias("_first"))
    least_of = firsts.withColumn("_least", F.min("_first").over(Window.partitionBy("_h1", "_h2"))).drop("_first")  # a row for each slice
    settled = cut.join(least_of, ["_h1", "_h2", "_slice"]).where("_doc != _least")
    return whole.select("_d1", "_d2", "_pos").unionByName(settled.select("_d1", "_d2", "_pos"))


def keep_bitmaps(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 10) -> DataFrame:
    """_d1, _d2, n_dropped, keep of rows that lose lines. keep: struct(word, bits), bit k of word w for line 64 * w + k."""
    word = F.expr("_pos div 64").cast("int").alias("_word")
    bits = later_lines(documents, doc_id, text, least).groupBy("_d1", "_d2", word).agg(F.bit_or(F.expr("shiftleft(1L, cast(_pos % 64 as int))")).alias("_lost"))
    entry = F.struct(F.col("_word").alias("word"), F.bitwise_not("_lost").alias("bits"))
    return bits.groupBy("_d1", "_d2").agg(F.sum(F.bit_count("_lost")).cast("bigint").alias("n_dropped"), F.array_sort(F.collect_list(entry)).alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The text without the lines that its bitmap (null: none) drops."""
    lines = lines_of(text)
    of_word = lambda x: F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.when(F.getbit(x.bits, k) == 0, x.word * 64 + k)), lambda p: p.isNotNull())
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.flatten(F.transform(keep, of_word)))
    return F.when(keep.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda p: F.get(lines, p)), "\n"))


def dedup_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 10) -> DataFrame:
    """documents with a struct `lines` (or lines_, ...): n_lines, n_dropped, keep (null: all), kept (the text that stays)."""
    name = free_name(documents, "lines")
    keyed = documents.select(F.struct("*").alias("_row"), *_row_key(doc_id, text))
    found = keyed.join(keep_bitmaps(documents, doc_id, text, least).hint("shuffle_hash"), ["_d1", "_d2"], "left")
    body = F.col("_row")[text]
    lines = F.struct(F.size(lines_of(body)).cast("bigint").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"), "keep", kept_text(body, F.col("keep")).alias("kept"))
    return found.select(*(F.col("_row")[c].alias(c) for c in documents.columns), lines.alias(name))
