"""Embedding whitening with MLlib's BlockMatrix.

Rows are indexed into blocks of `block_rows` rows of a distributed BlockMatrix, centred on the mean of the distinct
vectors. The transpose times the matrix, split along the rows so that no task holds them all, is the scatter; its
eigenvectors (local, dimensions squared in size) over the roots of their values are the whitening matrix, and BlockMatrix
multiplication by it projects the rows. Components count from the largest eigenvalue; those under 1e-12 of the largest
one, which are rounding errors of a flat direction, aren't given.

Entries become whole numbers x = floor(scale * c). A constant added to all x changes none of the results, so none is.
The mean and the covariance are of the distinct x vectors; their sums are exact. Blocks of the distinct vectors and
blocks of all rows, with their ids, are written apart: a frequent vector is a row like any other in the latter.

Cases: rows whose vector is null, or holds null or entries that aren't finite, are dropped, as are empty vectors and
those of another length than most have (the longer where two lengths are as frequent); null and repeated ids stay;
repeated vectors count once in the mean and covariance; a table of no usable rows, or of one distinct vector, gives no
rows; a deviation past 64 bits is null; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

BLOCK_ROWS = 1024


def whole_vectors(embeddings: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """id, v (array of floor(scale * c)) of the usable rows."""
    good = embeddings.select(F.col(vec_id).alias("id"), F.col(vector).alias("v")).where("size(v) > 0 and forall(v, c -> c is not null and not isnan(c) and abs(double(c)) < double('Infinity'))")
    widths = good.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if widths is None:
        return good.selectExpr("id", "transform(v, c -> 0L) v")
    return good.where(F.size("v") == widths["width"]).select("id", F.expr(f"transform(v, c -> floor({scale} * double(c))) v"))


def in_blocks(rows: DataFrame, block_rows: int, label: str) -> DataFrame:
    """rows (id, v) as block (numbered from 0), ids, v (flat, row by row): up to block_rows rows in each, written."""
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, number, ids, flat, width, held = TaskContext.get().partitionId(), 0, [], [], 0, 0

        def flush():
            v = np.concatenate(flat)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(ids[0].type)), pa.array([v], pa.list_(pa.int64()))], names=["part", "number", "ids", "v"])

        for batch in batches:
            done = 0
            while done < len(batch):
                cut = batch.slice(done, min(len(batch) - done, block_rows - held))
                ids.append(cut.column(0))
                flat.append(cut.column(1).flatten().to_numpy(zero_copy_only=False))
                done, held = done + len(cut), held + len(cut)
                if held == block_rows:
                    yield flush()
                    number, ids, flat, held = number + 1, [], [], 0
        if held:
            yield flush()

    cut = materialize(rows.select("id", "v").mapInArrow(run, f"part long, number long, ids array<{id_type}>, v array<long>"), label)
    before, offsets = 0, {}
    for part, n in sorted(cut.groupBy("part").count().collect()):  # a row for each partition
        offsets[part], before = before, before + n
    spark = rows.sparkSession
    starts = spark.createDataFrame(list(offsets.items()), "part long, start long")
    return cut.join(F.broadcast(starts), "part").select((F.col("start") + F.col("number")).cast("int").alias("block"), "ids", "v")


def matrix(blocks: DataFrame, mean: np.ndarray, block_rows: int, count: int):
    """BlockMatrix of the centred rows. What a last, smaller block lacks is rows of zeros, which add nothing to products."""
    from pyspark.mllib.linalg import DenseMatrix
    from pyspark.mllib.linalg.distributed import BlockMatrix

    width = len(mean)

    def block(row):
        x = np.array(row["v"], np.float64).reshape(-1, width) - mean
        full = np.zeros((block_rows, width))
        full[: len(x)] = x
        return (row["block"], 0), DenseMatrix(block_rows, width, full.ravel(order="F"))

    return BlockMatrix(blocks.select("block", "v").rdd.map(block), block_rows, width, count * block_rows, width)


def product(left, right, splits: int = 1):
    """left times right. splits: parts of the dimension that is summed over, each of them in a task of its own."""
    from pyspark.mllib.linalg.distributed import BlockMatrix

    return BlockMatrix(left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits), left.rowsPerBlock, right.colsPerBlock)


def gram(m, blocks: int) -> np.ndarray:
    """The transpose of m times m: a small matrix, summed from parts of some eight blocks."""
    return product(m.transpose(), m, max(1, -(-blocks // 8))).toLocalMatrix().toArray()


def sums_of(blocks: DataFrame, width: int) -> tuple[int, list[int]]:
    """The number of rows and their sum per dimension, exact."""

    def run(batches):
        import pyarrow as pa

        n, total = 0, [0] * width
        for batch in batches:
            for v in batch.column(0):
                x = v.values.to_numpy(zero_copy_only=False).reshape(-1, width)
                n, total = n + len(x), [a + int(b) for a, b in zip(total, x.sum(0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[str(x) for x in total]], pa.list_(pa.string()))], names=["n", "total"])

    each = blocks.select("v").mapInArrow(run, "n long, total array<string>").select("n", F.posexplode("total").alias("k", "s"))
    rows = each.groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("k").collect()  # a row for each dimension
    return rows[0]["n"], [int(r["s"]) for r in rows]


def whiten(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 64, components: int = 16, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n, deviation, whitened (array, one for each component), explained (array), identity_error."""
    from pyspark.mllib.linalg import DenseMatrix
    from pyspark.mllib.linalg.distributed import BlockMatrix

    spark = embeddings.sparkSession
    vectors = whole_vectors(embeddings, vec_id, vector, scale)
    every = in_blocks(vectors, block_rows, "whitening-rows")
    kind = vectors.schema["id"].dataType.simpleString()
    schema = f"{vec_id} {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    first = every.select(F.size("ids").alias("n"), F.size("v").alias("entries")).first()
    if first is None:
        return spark.createDataFrame([], schema)
    width = first["entries"] // first["n"]
    fit = in_blocks(vectors.select("v").distinct().select(F.lit(0).alias("id"), "v"), block_rows, "whitening-fit")
    n, s = sums_of(fit, width)
    mean = np.array([x // n + (x % n) / n for x in s])
    fit_blocks, all_blocks = fit.count(), every.count()

    centred = matrix(fit, mean, block_rows, fit_blocks)
    covariance = gram(centred, fit_blocks) / n
    values, directions = np.linalg.eigh((covariance + covariance.T) / 2)
    order = [k for k in np.argsort(-values, kind="stable")[:components] if values[k] > 1e-12 * values.max() > 0]
    if not order:
        return spark.createDataFrame([], schema)
    weights = directions[:, order] / np.sqrt(values[order])
    local = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(width, len(order), weights.ravel(order="F")))], 1), width, len(order), width, len(order))
    identity_error = float(np.abs(gram(product(centred, local), fit_blocks) / n - np.eye(len(order))).max())
    explained = (values[order] / np.trace(covariance)).tolist()

    projected = product(matrix(every, mean, block_rows, all_blocks), local)
    rows = projected.blocks.map(lambda b: (b[0][0], b[1].toArray().ravel().tolist())).toDF("block int, w array<double>")

    def out(batches):
        import pyarrow as pa

        for batch in batches:
            for ids, v, w in zip(batch.column("ids"), batch.column("v"), batch.column("w"), strict=True):
                x = v.values.to_numpy(zero_copy_only=False).reshape(-1, width)
                w = w.values.to_numpy(zero_copy_only=False).reshape(-1, len(order))[: len(x)]
                limit = max(abs(n * int(x.max())), abs(n * int(x.min()))) + max(map(abs, s))
                if width * limit * limit < 1 << 63:
                    off = n * x - np.array(s)
                    deviation = (off * off).sum(1).tolist()
                else:  # whole numbers of any length
                    deviation = [sum((n * int(a) - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x.tolist()]
                    deviation = [d if d < 1 << 63 else None for d in deviation]
                of = ids.values
                yield pa.RecordBatch.from_arrays(
                    [of, pa.array([n] * len(x), pa.int64()), pa.array(deviation, pa.int64()), pa.array(list(w), pa.list_(pa.float64())), pa.array([explained] * len(x), pa.list_(pa.float64())), pa.array([identity_error] * len(x), pa.float64())],
                    names=[vec_id, "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return every.join(rows, "block").select("ids", "v", "w").mapInArrow(out, schema)
