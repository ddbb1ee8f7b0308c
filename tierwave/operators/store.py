"""A Parquet store of features that can be added to, its attributes and its catalog.

Rows lie in partitions by feature, sample, read group, window, sequence, track and slice of tiles. Writing replaces rows
of equal keys and keeps all others, those of the same partition as well. String keys may be null, empty or look like
numbers: folders' names mark the first two, and are never read as numbers.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

PARTITIONS = ("feature", "sm", "rg", "window", "seq", "track", "slice")
LEVELS = ("sm", "rg", "seq", "track", "feature", "window")
#: Keys that are strings, whatever they look like: `0012` and a sequence `7` stay what they are.
STRINGS = ("feature", "sm", "rg", "seq", "track")
#: Tiles in a slice: what is read and written again when a tile of it changes.
SLICE = 1_000_000
#: In names of folders: stands before names that begin with it, alone for the empty string, and with 0 for null.
MARK = "~"


def scratch(spark: SparkSession) -> str:
    """A new folder in that of spark.checkpoint.dir; where that is unset and Spark runs on this machine alone, a local one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-tierwave-")
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df written to a new folder and read again: it is used several times."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def _marked(column: Column) -> Column:
    """A string key as the name of its folder: names of folders can't be null or empty."""
    return F.when(column.isNull(), MARK + "0").when((column == "") | column.startswith(MARK), F.concat(F.lit(MARK), column)).otherwise(column)


def _unmarked(column: Column) -> Column:
    return F.when(column == MARK + "0", F.lit(None)).when(column.startswith(MARK), F.substring(column, 2, 1 << 30)).otherwise(column)


def _with_keys(df: DataFrame, how, keys: Sequence[str]) -> DataFrame:
    return df.select(*(how(F.col(c)).alias(c) if c in keys else F.col(c) for c in df.columns))


def _equal(left: str, right: str, columns: Sequence[str]) -> Column:
    return functools.reduce(lambda a, b: a & b, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns))


def stored(spark: SparkSession, path: str, strings: Sequence[str] = STRINGS) -> DataFrame:
    """The table at path with folders' names as they are: `strings`, the partitions that are strings, are read as such."""
    found = spark.read.parquet(path).schema
    schema = StructType([StructField(f.name, StringType() if f.name in strings else LongType() if f.name in ("window", "slice") else f.dataType) for f in found])
    return spark.read.schema(schema).parquet(path)


def read_table(spark: SparkSession, path: str, strings: Sequence[str] = STRINGS) -> DataFrame:
    """All rows that merge_into wrote, with the keys that they were written with. strings: the partitions that are strings."""
    return _with_keys(stored(spark, path, strings), _unmarked, strings)


def _folders(spark: SparkSession, path: str, start: str) -> list[str]:
    """Folders in path whose names begin with start."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sorted(f.getPath().toString() for f in fs.listStatus(where) if f.isDirectory() and f.getPath().getName().startswith(start)) if fs.exists(where) else []


def _delete(spark: SparkSession, folder: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def _replace(staged: DataFrame, path: str, partitions: Sequence[str], sort: Sequence[str]) -> None:
    spread = staged.repartition(*partitions).sortWithinPartitions(*partitions, *sort)
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*partitions).parquet(path)


def recover(spark: SparkSession, path: str, partitions: Sequence[str], sort: Sequence[str] = ()) -> int:
    """Does again what a stopped merge_into had staged in full, and drops what it hadn't. Returns how many were done."""
    done = 0
    for folder in _folders(spark, path, "_staged-"):
        if exists(spark, f"{folder}/_SUCCESS"):
            _replace(spark.read.parquet(folder), path, partitions, sort)
            done += 1
        _delete(spark, folder)
    return done


def merge_into(df: DataFrame, path: str, partitions: Sequence[str], keys: Sequence[str], sort: Sequence[str] = ()) -> None:
    """Writes df into a partitioned table: rows of equal keys are replaced, all others stay. One writer at a time.

    keys include the partitions; null is a key like any other, and so is the empty string. Of rows of df with equal keys
    the one with the greatest rest stays. Only partitions that df has rows for are read and written. What they will hold
    is staged in full inside the table's folder before any of them is replaced: a merge that stops before that changed
    nothing, and one that stops later is finished by the next one, or by recover().
    """
    spark = df.sparkSession
    recover(spark, path, partitions, sort)
    rest = [c for c in df.columns if c not in keys]
    marked = _with_keys(df, _marked, [c for c in partitions if isinstance(df.schema[c].dataType, StringType)])
    one = marked.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_rest")).select(*keys, "_rest.*") if rest else marked.distinct()
    new, staged = one.select(*df.columns), f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    had = exists(spark, path)
    if had:
        aside = scratch(spark)
        new.write.parquet(aside)
        new = spark.read.schema(new.schema).parquet(aside)
        old = spark.read.schema(new.schema).parquet(path)
        touched = new.select(*partitions).distinct()
        touched = F.broadcast(touched) if touched.count() <= 100_000 else touched
        stays = old.alias("o").join(touched.alias("t"), _equal("o", "t", partitions), "left_semi").alias("o").join(new.select(*keys).alias("n"), _equal("o", "n", keys), "left_anti")
        new = new.unionByName(stays.select(*df.columns))
    new.write.parquet(staged)
    _replace(spark.read.schema(new.schema).parquet(staged), path, partitions, sort)
    _delete(spark, staged)
    if had:
        _delete(spark, aside)


def write(df: DataFrame, path: str, feature: str, bins: Sequence[str] = ()) -> None:
    """Adds rows to the store. df: sm, rg, seq, track, window, tile, `bins` (for counts: bin, or from_bin, to_bin) and fields.

    A long sequence is many slices, each a file sorted by tile. Of two rows of df with equal keys the greater one stays.
    """
    sliced = df.withColumns({"feature": F.lit(feature), "window": F.col("window").cast("bigint"), "slice": F.floor(F.col("tile") / SLICE).cast("bigint")})
    merge_into(sliced, path, PARTITIONS, [*PARTITIONS, "tile", *bins], ["tile"])


def read(spark: SparkSession, path: str, **wanted) -> DataFrame:
    """Rows by keys (a value, a list that may hold None, or None for all) and by start and end positions.

    All of them prune the partitions read.
    """
    start, end = wanted.pop("start", None), wanted.pop("end", None)
    as_folder = lambda x: MARK + "0" if x is None else MARK + x if x == "" or x.startswith(MARK) else x
    several = lambda v: list(v) if isinstance(v, (list, tuple, set)) else [v]
    df = query(stored(spark, path), **{k: [as_folder(x) for x in several(v)] if k in STRINGS and v is not None and v != "all" else v for k, v in wanted.items()})
    width = F.col("window") * SLICE
    if start is not None:
        df = df.where((F.col("slice") >= F.floor(F.lit(start) / width)) & (F.col("tile") >= F.floor(F.lit(start) / F.col("window"))))
    if end is not None:
        df = df.where((F.col("slice") < F.ceil(F.lit(end) / width)) & (F.col("tile") < F.ceil(F.lit(end) / F.col("window"))))
    return _with_keys(df.drop("slice"), _unmarked, STRINGS)


def attributes(features: DataFrame, lengths: DataFrame, branch: int, bins: Sequence[float] | None = None, max_depth: int | None = None) -> DataFrame:
    """What describes each dataset: keys, len, window_branch, window_root (the coarsest), first_tile, tiles, and for counts
    the bins' edges and their number, for all whether every window is there (tile) and the depth limit it was made with.

    len is null where lengths lacks the sequence.
    """
    told = [c for c in ("n", "sum", "min", "max") if c in features.columns]
    each = features.groupBy(*LEVELS).agg(F.min("tile").alias("first_tile"), F.count_distinct("tile").alias("tiles"), *(f.alias(f"total_{c}") for c, f in (("n", F.sum("n")), ("sum", F.sum("sum")), ("min", F.min("min")), ("max", F.max("max"))) if c in told))
    known = each.withColumn("window_root", F.max("window").over(Window.partitionBy("sm", "rg", "seq", "track", "feature")))  # a row for each dataset
    known = known.join(lengths.select("seq", "len"), "seq", "left").withColumns({"window_branch": F.lit(branch), "max_depth": F.lit(max_depth).cast("bigint"), "tile": F.col("tiles") == F.ceil(F.col("len") / F.col("window"))})
    counts = F.col("feature").isin("spectrum", "transitions")
    edges = F.array(*(F.lit(float(e)) for e in bins)) if bins is not None else F.lit(None).cast("array<double>")
    return known.withColumns({"bins": F.when(counts, edges), "bin_count": F.when(counts, F.size(edges) - 1)})


def write_attributes(rows: DataFrame, path: str) -> None:
    """Adds or replaces descriptions in the stored catalog; `path` is a table of its own."""
    merge_into(rows, path, ["feature"], list(LEVELS))


def catalogs(spark: SparkSession, stores: dict[str, str]) -> DataFrame:
    """The stored catalogs of several stores (name to path of the catalog), with the column store."""
    out = None
    for name, path in stores.items():
        one = read_table(spark, path, ["feature"]).withColumn("store", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def store_of(catalog_: DataFrame) -> DataFrame:
    """sm, and the first store (by name) that has it."""
    return catalog_.groupBy("sm").agg(F.min("store").alias("store"))


def query(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows whose keys are among those wanted; None or 'all' stands for every value."""
    for key, value in wanted.items():
        if value is not None and value != "all":
            df = df.where(F.col(key).isin(list(value) if isinstance(value, (list, tuple, set)) else [value]))
    return df


def catalog(features: DataFrame) -> DataFrame:
    """The distinct keys of stored rows."""
    return features.select(*LEVELS).distinct()


def stored_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The distinct keys of a store, and of each the slices and bytes it has, from the list of its files alone: no row is read."""
    files = spark.createDataFrame([(f,) for f in spark.read.parquet(path).inputFiles()], "file string") if exists(spark, path) else spark.createDataFrame([], "file string")
    of = lambda k: F.url_decode(F.replace(F.regexp_extract("file", f"/{k}=([^/]*)/", 1), F.lit("+"), F.lit("%2B")))
    keys = files.select(*(of(k).alias(k) for k in PARTITIONS)).withColumns({"window": F.col("window").cast("bigint"), "slice": F.col("slice").cast("bigint")})
    twice = keys.select(*(F.url_decode(F.replace(k, F.lit("+"), F.lit("%2B"))).alias(k) if k in STRINGS else F.col(k) for k in PARTITIONS))
    return _with_keys(twice, _unmarked, STRINGS).groupBy(*LEVELS).agg(F.count_distinct("slice").alias("slices"))


def windows_by_sequence(catalog_: DataFrame) -> DataFrame:
    """seq, windows (sorted as numbers), uniform (whether each sample, group and track of it has the same ones)."""
    one = catalog_.groupBy("seq", "sm", "rg", "track", "feature").agg(F.array_sort(F.collect_set("window")).alias("w"))
    return one.groupBy("seq").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("w")))).alias("windows"), (F.count_distinct("w") == 1).alias("uniform"))


def base_window(catalog_: DataFrame) -> DataFrame:
    return catalog_.groupBy("seq").agg(F.min("window").alias("window"))


def merge_stores(stores: Sequence[DataFrame], samples: Sequence[str] | None = None, seqs: Sequence[str] | None = None) -> DataFrame:
    out = stores[0]
    for s in stores[1:]:
        out = out.unionByName(s)
    return query(out, sm=samples, seq=seqs)


def rename_sample(store: DataFrame, name: str) -> DataFrame:
    return store.withColumn("sm", F.lit(name))


def to_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def missing(wanted: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """What is still to be made."""
    return wanted.join(done, list(on), "left_anti")


def check(moments: DataFrame, spectrum: DataFrame, transitions: DataFrame, keys: Sequence[str], window: int) -> DataFrame:
    """keys, and whether n, the spectrum's and the transitions' counts are what every full window must have."""
    group = [*keys, "tile"]
    s = spectrum.groupBy(*group).agg(F.sum("cnt").alias("s"))
    t = transitions.groupBy(*group).agg(F.sum("cnt").alias("t"))
    all_ = moments.select(*group, "n").join(s, group, "left").join(t, group, "left")
    holds = lambda c, n: F.bool_and(F.coalesce(F.col(c), F.lit(0)) == n)
    return all_.groupBy(*keys).agg(holds("n", window).alias("moments_ok"), holds("s", window).alias("spectrum_ok"), holds("t", window - 1).alias("transitions_ok"))
