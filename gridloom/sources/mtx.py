"""MatrixMarket coordinate files: reading through Spark's text source, writing in parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matrix import SparseMatrix, wrong_entry


def read_mtx(spark: SparkSession, path: str, check: bool = True) -> SparseMatrix:
    """A real, integer or pattern matrix; symmetric ones get their other half.

    Lines starting with % are comments, wherever they are.  The size line is the first
    other one, of a folder of parts that of the first part by name; the driver takes it
    and the banner from there, executors parse the rest.  A matrix that isn't square, another kind of banner, or (with check) a
    wrong number of entries is an error.
    """
    first = spark.read.format("binaryFile").load(path).agg(F.min("path")).first()[0]  # of a folder of parts, the first by name
    if first is None:
        raise ValueError(f"no file in {path}")
    told = ~F.col("value").startswith("%") & (F.trim("value") != "")
    top = spark.read.text(first)
    banner, head = top.head(1), top.where(told).head(1)
    kind = (banner[0].value if banner and banner[0].value.startswith("%%MatrixMarket") else "%%MatrixMarket matrix coordinate real general").lower().split()
    if kind[1:3] != ["matrix", "coordinate"] or kind[3] not in ("real", "integer", "pattern") or kind[4] not in ("general", "symmetric"):
        raise ValueError(f"not a coordinate matrix of numbers: {' '.join(kind)}")
    if not head:
        raise ValueError(f"no size line in {path}")
    size = head[0].value.split()
    rows, cols, count = map(int, size[:3])
    if rows != cols:
        raise ValueError(f"the matrix is not square: {rows} x {cols}")
    data = spark.read.text(path).where(told).select(F.split(F.trim("value"), "\\s+").alias("f"))
    value = F.lit(1.0) if kind[3] == "pattern" else F.get("f", F.lit(2)).cast("double")
    same = F.col("f") == F.array(*[F.lit(x) for x in size])
    entries = data.select(same.alias("same"), (F.get("f", F.lit(0)).cast("long") - 1).alias("row"), (F.get("f", F.lit(1)).cast("long") - 1).alias("col"), value.alias("val"))
    # one scan counts and checks; an entry can look like the size line (1 1 1), and one of equal lines is the size line
    found, twins, bad = entries.agg(F.count("*") - 1, F.sum(F.col("same").cast("long")) - 1, F.max((~F.col("same") & wrong_entry(rows)).cast("int"))).first()
    if check and found != count:
        raise ValueError(f"{path} has {found} entries; its size line says {count}")
    if check and bad:
        raise ValueError(f"{path} has entries outside the matrix or that aren't finite numbers")
    plain = entries.where(~F.col("same"))
    entries = plain.unionByName(entries.where("same").limit(twins)) if twins else plain
    entries = entries.select("row", "col", "val")
    if kind[4] == "symmetric":
        entries = entries.unionByName(entries.where("row <> col").select(F.col("col").alias("row"), F.col("row").alias("col"), "val"))
    return SparseMatrix.of(entries, rows, check=False)


def write_mtx(matrix: SparseMatrix, path: str) -> None:
    """A folder of text parts whose concatenation in name order is the file; values in full precision.

    Spark's commit makes the folder whole or absent.  The first part holds the banner
    and the size line; entries follow in row order.
    """
    spark, n = matrix.entries.sparkSession, matrix.n
    count = matrix.entries.count()
    head = spark.createDataFrame([(-2, -1, "%%MatrixMarket matrix coordinate real general"), (-1, -1, f"{n} {n} {count}")], "row long, col long, value string")
    body = matrix.entries.select("row", "col", F.concat_ws(" ", F.col("row") + 1, F.col("col") + 1, F.col("val").cast("string")).alias("value"))
    body.unionByName(head).repartitionByRange("row").sortWithinPartitions("row", "col").select("value").write.text(path)


def vector_frame(df: DataFrame) -> DataFrame:
    """Any (id, x) table as a vector."""
    return df.select(F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"))
