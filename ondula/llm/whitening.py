"""Embedding whitening: MLlib's computeSVD over centred distributed rows, singular values rescaled by divisor n.

Every usable vector becomes integers x = floor(64 c) + 1000000, so that counts and sums per dimension are exact longs: NumPy adds them up within a batch, Spark adds
the batches. A row is centred as (n x - S) / n, whose numerator is exact. `RowMatrix.computeSVD` gives the right singular vectors V and values s of the centred rows;
the components are the columns of V and their variances e = s^2 / n. At least half of the dimensions are asked for, so that MLlib decomposes its Gramian (dimensions
squared, on the driver) by LAPACK to double precision and not by Arnoldi steps to 1e-10. The total variance does not come from the decomposition, which may be cut:
it is the exact sum of all rows' deviations, sum of (n x - S)^2, by n cubed. A second pass projects the rows and adds up their products, the covariance that
`identity_error` compares with the identity.

Nothing is shuffled but one row of sums for each Arrow batch. To the driver go the sums (one row a dimension) and products (components squared), and V.

Defined cases: rows whose vector is null, or holds a null, a NaN or an infinity, are left out of fit and result. Vectors of unequal lengths raise an error, and so do
deviations beyond a long (overflow). Repeated rows, null and repeated ids count each. Components with a variance below 1e-10 of the largest (dimensions that depend on
others, fewer rows than dimensions) cannot be rescaled to the promised error and are left out; with no variance at all, or an empty table, the result has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ondula.llm.common import arrow_map

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
#: Singular values below this part of the largest are left out.
LEAST_RATIO = 1e-5
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(vector: Column) -> Column:
    """Not null and without null, NaN or infinite entries."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))


def fit_list(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and the integers x of each row that takes part."""
    whole = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET)
    return vectors.filter(usable(F.col(vector_col))).select(F.col(id_col).alias("vec_id"), whole.alias("x"))


def matrix(column: pa.ListArray) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    width = len(values) // max(len(column), 1)
    if len(column) and np.any(np.diff(column.offsets.to_numpy()) != width):
        raise ValueError("vectors have unequal lengths")
    return values.reshape(len(column), width)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = matrix(batch.column("x"))
            yield pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([x.sum(0).tolist()], pa.list_(pa.int64()))], ["n", "sums"])


def totals(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and their exact sum in each dimension."""
    parts = arrow_map(rows.select("x"), _sums, "n long, sums array<long>")
    by_place = parts.select("n", F.posexplode("sums").alias("place", "part")).groupBy("place").agg(F.sum("n").alias("n"), F.sum("part").alias("total")).orderBy("place").collect()
    if len({r["n"] for r in by_place}) > 1:
        raise ValueError("vectors have unequal lengths")
    return (by_place[0]["n"] if by_place else 0), [r["total"] for r in by_place]


def deviations(n: int, sums: list[int]) -> Column:
    """n x - S, exact."""
    total = F.array(*[F.lit(s).cast("long") for s in sums])
    return F.zip_with("x", total, lambda x, s: x * F.lit(n).cast("long") - s)


def components(rows: DataFrame, n: int, sums: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as columns and their variances, largest first, at most k."""
    d = len(sums)
    centred = rows.select(array_to_vector(F.transform(deviations(n, sums), lambda q: q.cast("double") / F.lit(float(n)))).alias("features"))
    found = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "features"), n, d).computeSVD(min(d, max(k, d // 2 + 1)), computeU=False, rCond=LEAST_RATIO)
    values = found.s.toArray()
    return found.V.toArray()[:, : min(k, len(values))], values[:k] ** 2 / n


def _project(n: int, sums: list[int], scaled: np.ndarray, products: bool):
    """The whitened rows, or the sums of their products in each batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.array(sums, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            z = ((matrix(batch.column("x")) * n - total) / n) @ scaled
            if products:
                yield pa.RecordBatch.from_arrays([pa.array([(z.T @ z).ravel().tolist()], pa.list_(pa.float64()))], ["products"])
            else:
                ends = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1], pa.int32())
                rest = [batch.column(c) for c in ("vec_id", "deviation")]
                yield pa.RecordBatch.from_arrays([*rest, pa.ListArray.from_arrays(ends, pa.array(z.ravel()))], ["vec_id", "deviation", "z"])

    return work


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component."""
    spark = vectors.sparkSession
    rows = fit_list(vectors, id_col, vector_col)
    n, sums = totals(rows)
    squares = F.aggregate(deviations(n, sums), F.lit(0).cast("long"), lambda a, q: a + q * q) if sums else F.lit(0).cast("long")
    spread = rows.agg(F.sum(squares.cast("decimal(38,0)"))).first()[0] if n else None
    if not spread:
        return spark.createDataFrame([], RESULT)
    trace = Fraction(int(spread), n**3)
    axes, variances = components(rows, n, sums, k)
    scaled = axes / np.sqrt(variances)
    made = arrow_map(rows.select("x"), _project(n, sums, scaled, True), "products array<double>")
    products = made.select(F.posexplode("products").alias("place", "part")).groupBy("place").agg(F.sum("part").alias("total")).orderBy("place").collect()
    error = float(np.abs(np.array([r["total"] for r in products]).reshape(len(variances), -1) / n - np.eye(len(variances))).max())
    kind = rows.schema["vec_id"].dataType.simpleString()
    out = arrow_map(rows.select("vec_id", squares.alias("deviation"), "x"), _project(n, sums, scaled, False), f"vec_id {kind}, deviation long, z array<double>")
    explained = F.array(*[F.lit(float(e / float(trace))) for e in variances])
    return out.select("vec_id", "deviation", F.posexplode("z").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("place") + 1).alias("explained"), F.lit(error).alias("identity_error")
    )


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
