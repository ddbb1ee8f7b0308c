"""Readers of alignment text, headers, reference sequences and cohort tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: letters of CIGAR operations by their code.
OPS = "MIDNSHP=X"


def cigar_ops(text: Column) -> Column:
    """Array of struct(op, len); null for `*`."""
    found = F.regexp_extract_all(text, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    one = F.transform(found, lambda x: F.struct((F.instr(F.lit(OPS), F.right(x, F.lit(1))) - 1).alias("op"), F.substring(x, 1, 9).substr(F.lit(1), F.length(x) - 1).cast("int").alias("len")))
    return F.when(text != "*", one)


def sam_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def sequence_dictionary(lines: DataFrame) -> DataFrame:
    """seq, len of the @SQ lines (of an alignment or a .dict file), longest first."""
    sq = lines.where(F.col("value").startswith("@SQ"))
    return sq.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("seq"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("bigint").alias("len")).orderBy(F.desc("len"), "seq")


def read_groups(lines: DataFrame) -> DataFrame:
    """rg, sm of the @RG lines."""
    rg = lines.where(F.col("value").startswith("@RG"))
    return rg.select(F.regexp_extract("value", r"\tID:([^\t]+)", 1).alias("rg"), F.regexp_extract("value", r"\tSM:([^\t]+)", 1).alias("sm"))


def groups_of_samples(groups: DataFrame) -> DataFrame:
    return groups.groupBy("sm").agg(F.array_sort(F.collect_list("rg")).alias("rgs"))


def sam_reads(lines: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Reads in the canonical schema. ref_end is null for unmapped ones; a read without a group has rg null.

    groups: rg, sm, as a header lists them: sent to every task, as a group may hold all reads.
    """
    f = [F.get(F.split("value", "\t"), k) for k in range(11)]
    cigar = cigar_ops(f[5])
    body = lines.where(~F.col("value").startswith("@") & (F.col("value") != "")).select(
        f[0].alias("name"), (f[7].try_cast("bigint") - 1).alias("mate_pos"), f[10].alias("qual"),
        F.regexp_extract("value", r"\tRG:Z:([^\t]+)", 1).alias("rg"), f[2].alias("seq"), (f[3].try_cast("bigint") - 1).alias("pos"), f[1].try_cast("int").alias("flag"), f[4].try_cast("int").alias("mapq"),
        F.when(f[6] == "=", f[2]).otherwise(f[6]).alias("mate_seq"), f[8].try_cast("bigint").alias("tlen"), cigar.alias("cigar"), f[9].alias("bases"),
    ).withColumn("rg", F.when(F.col("rg") != "", F.col("rg")))
    covers = F.aggregate("cigar", F.lit(0), lambda n, c: n + F.when(c.op.isin(0, 2, 3, 7, 8), c.len).otherwise(0))
    reads = body.withColumn("ref_end", F.when((F.col("seq") != "*") & F.col("cigar").isNotNull(), F.col("pos") + covers)).withColumn("rlen", F.when(F.col("bases") != "*", F.length("bases")).otherwise(0))
    return reads.withColumn("sm", F.lit(None).cast("string")) if groups is None else reads.join(F.broadcast(groups), "rg", "left")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """seq, bases, a row for each sequence: for short ones (primers, contigs). fasta.slices() is for all others."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where("trim(value) != ''")
    head, rest = F.substring_index("value", "\n", 1), F.expr("substring(value, instr(concat(value, '\n'), '\n') + 1)")
    return records.select(F.regexp_extract(head, r"^(\S+)", 1).alias("seq"), F.regexp_replace(rest, r"\s", "").alias("bases"))


def cohort(spark: SparkSession, path: str) -> DataFrame:
    """sample, population, rg, library, platform, coverage of `sample \\t population \\t rg;lib;platform;cov,...`."""
    rows = spark.read.csv(path, sep="\t", schema="sample string, population string, runs string")
    part = F.split("run", ";")
    one = rows.select("sample", "population", F.explode(F.split("runs", ",")).alias("run"))
    return one.select("sample", "population", part[0].alias("rg"), part[1].alias("library"), part[2].alias("platform"), part[3].cast("double").alias("coverage"))


def run_statistics(spark: SparkSession, path: str, genome: float = 3e9) -> DataFrame:
    """sample, rgs (array of struct(rg, platform, library, coverage, mapq)) of a headed statistics table."""
    raw = spark.read.csv(path, sep="\t", header=True)
    c = raw.columns
    row = F.struct(F.col(c[6]).alias("rg"), F.col(c[4]).alias("platform"), F.col(c[5]).alias("library"), (F.col(c[8]).cast("double") / genome).alias("coverage"), F.col(c[14]).alias("mapq"))
    return raw.groupBy(F.col(c[3]).alias("sample")).agg(F.array_sort(F.collect_list(row)).alias("rgs"))


def genes_json(spark: SparkSession, path: str) -> DataFrame:
    """gene, ord, seq, start, end of {gene: [[seq, start, end], ...]}."""
    places = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<array<string>>>")).alias("gene", "places"))
    return places.select("gene", F.posexplode("places").alias("ord", "p")).select("gene", "ord", F.col("p")[0].alias("seq"), F.col("p")[1].cast("bigint").alias("start"), F.col("p")[2].cast("bigint").alias("end"))


def to_fastq(reads: DataFrame) -> DataFrame:
    """rg, value: four-line records; write with partitionBy('rg') as (compressed) text."""
    return reads.select("rg", F.concat_ws("\n", F.concat(F.lit("@"), F.col("name")), "bases", F.lit("+"), "qual").alias("value"))
