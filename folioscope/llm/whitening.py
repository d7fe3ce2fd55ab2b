"""Embedding whitening with distributed block matrices.

Vectors become integers, are centred without rounding (``n * x - S`` in whole numbers) and indexed into blocks of rows. The
blocks' transpose times the blocks is the scatter, its products of blocks spread over ``splits`` tasks and summed; only this
square of the dimension reaches the driver, which takes its eigenvectors. The blocks times the whitening matrix are the
projected rows. Blocks grow with the input from ``MAX_BLOCKS`` blocks on, for their places are listed on the driver.

Defined cases: vectors that are null, empty, or hold null, NaN or infinite components take no part; all others must have one
length and components whose sums stay within 64-bit integers, else ValueError; equal rows and equal or null ids get rows of
their own; components without variance (at most ``dim`` roundings of the largest) are left out; no usable vector gives no rows.
Of further columns those in ``keep`` stay, unless they are named like a result.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, functions as F

from folioscope.sources.storage import materialise

SCALE = 64
SHIFT = 1_000_000
TOP = 32
BLOCK_ROWS = 1024
MAX_BLOCKS = 1 << 14
ADDED = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def quantised(vectors: DataFrame, keep: list[str], scale: int = SCALE) -> DataFrame:
    """``keep`` as __0, __1, ..., and y = floor(scale * component) of the usable vectors."""
    usable = (F.size("embedding") > 0) & F.forall(
        "embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    )
    rows = vectors.select(*(F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(keep)), "embedding")
    rows = rows.where(F.coalesce(usable, F.lit(False)))
    return rows.select(*(f"__{k}" for k in range(len(keep))), F.transform("embedding", lambda c: F.floor(c.cast("double") * scale)).alias("y"))


def indexed(rows: DataFrame) -> DataFrame:
    """``rows`` (with the column at of ``monotonically_increasing_id``) numbered from 0 without gaps, as ``index``.

    The counts of the writing tasks, one small row each, are summed up on the driver.
    """
    spark = rows.sparkSession
    task = F.shiftright("at", 33)
    sizes = sorted((r["task"], r["count"]) for r in rows.groupBy(task.alias("task")).count().collect())
    starts = itertools.accumulate((n for _, n in sizes), initial=0)
    offsets = spark.createDataFrame([(t, s) for (t, _), s in zip(sizes, starts)], "task long, start long")
    within = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("task", task).join(offsets, "task").withColumn("index", F.col("start") + within).drop("task", "start")


def blocks_of(rows: DataFrame, n: int, dim: int, block_rows: int) -> BlockMatrix:
    """The rows (index, v array<double>) as blocks of ``block_rows`` rows."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("v").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, dim).toBlockMatrix(block_rows, dim)


def scatter(blocks: BlockMatrix, splits: int) -> np.ndarray:
    """Transpose times matrix, the block products dealt over ``splits`` tasks (the Python call has no such argument)."""
    left, right = blocks.transpose(), blocks
    product = left._java_matrix_wrapper._java_model.multiply(right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, blocks.colsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def whiten(
    vectors: DataFrame, keep: list[str] | None = None, top: int = TOP, scale: int = SCALE, shift: int = SHIFT, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(``keep``, component, n, deviation, whitened, explained, identity_error) of every usable row and component up to ``top``.

    ``vectors`` has a column embedding; x = floor(scale * component) + shift. ``deviation`` is a decimal, for it may pass 64 bits.
    """
    spark = vectors.sparkSession
    keep = [c for c in (["vec_id"] if keep is None else keep) if c not in ADDED]
    names = [f"__{k}" for k in range(len(keep))]
    kinds = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in keep)
    empty = spark.createDataFrame([], f"{kinds}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    rows = materialise(quantised(vectors, keep, scale).withColumn("at", F.monotonically_increasing_id()), "usable")
    size = F.size("y")
    low, high = F.min(F.array_min("y")), F.max(F.array_max("y"))
    n, shortest, dim, low, high = rows.agg(F.count("*"), F.min(size), F.max(size), low, high).first()
    if not n:
        return empty
    if shortest != dim:
        raise ValueError(f"the vectors have from {shortest} to {dim} components")
    # the shift changes no difference; n * y and S = sum of y stay below n * reach, their difference below twice that
    reach = max(abs(low), abs(high), 1)
    if 2 * n * reach >= 1 << 62:
        raise ValueError(f"components up to {reach} are too large for exact sums of {n} vectors")
    sums = {r["pos"]: r["total"] for r in rows.select(F.posexplode("y").alias("pos", "c")).groupBy("pos").agg(F.sum("c").alias("total")).collect()}
    total = F.array(*(F.lit(sums[d]).cast("long") for d in range(dim)))
    centred = indexed(rows).withColumn("total", total).withColumn("d", F.zip_with("y", "total", lambda y, s: y * F.lit(n) - s))
    small = (2 * n * reach) ** 2 * dim < 1 << 62
    exact = "long" if small else "decimal(38,0)"
    squares = F.aggregate(
        F.transform("d", lambda d: d.cast("decimal(19,0)") * d.cast("decimal(19,0)") if not small else d * d),
        F.lit(0).cast(exact), lambda s, q: (s + q).cast(exact),
    )
    told = materialise(centred.select("index", *names, squares.cast("decimal(38,0)").alias("deviation"), F.transform("d", lambda d: d.cast("double")).alias("v")), "centred")

    block_rows = max(block_rows, -(-n // MAX_BLOCKS))
    splits = min(-(-n // block_rows), 4 * spark.sparkContext.defaultParallelism)
    blocks = blocks_of(told, n, dim, block_rows)
    covariance = scatter(blocks, splits) / float(n) ** 3
    covariance = (covariance + covariance.T) / 2
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")
    values, axes = values[order], axes[:, order]
    count = int(min(top, (values > dim * np.finfo(float).eps * max(values[0], 0.0)).sum())) if values[0] > 0 else 0
    if not count:
        return empty
    explained = values[:count] / np.trace(covariance)
    matrix = axes[:, :count] / np.sqrt(values[:count]) / float(n)
    one = spark.sparkContext.parallelize([((0, 0), DenseMatrix(dim, count, matrix.flatten(order="F").tolist()))], 1)
    projected = blocks.multiply(BlockMatrix(one, dim, count, dim, count)).toIndexedRowMatrix()
    white = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)
    white = materialise(white.select("index", vector_to_array("vector").alias("z")), "white")

    means = white.agg(*(F.avg(F.col("z")[c]).alias(f"m{c}") for c in range(count))).first()
    centre = F.array(*(F.lit(float(m)) for m in means))
    level = white.withColumn("centre", centre).select("index", F.zip_with("z", "centre", lambda z, m: z - m).alias("v"))
    error = float(np.abs(scatter(blocks_of(level, n, count, block_rows), splits) / n - np.eye(count)).max())
    shares = F.array(*(F.lit(float(e)) for e in explained))
    return (
        told.select("index", *names, "deviation").join(white, "index").withColumn("shares", shares)
        .select(*names, "deviation", "shares", F.posexplode("z").alias("pos", "whitened"))
        .select(
            *(F.col(x).alias(c) for x, c in zip(names, keep)), (F.col("pos") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"),
            "deviation", "whitened", F.col("shares")[F.col("pos")].alias("explained"), F.lit(error).alias("identity_error"),
        )
    )
