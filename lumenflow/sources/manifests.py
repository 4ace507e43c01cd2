"""CSV manifests that drive batch jobs: fixed layouts, columns by name, relative paths, finished work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Layouts: columns in order and whether the file has a header line.
LAYOUTS: dict[str, tuple[str, bool]] = {
    "phantom": ("id string, label string", True),
    "training": ("id string, label string, image string", True),
    "preprocessed": ("id string, mask string, image string, roi string", False),
    "bezier": ("id string, mask string, image string", False),
    "processed": ("subject_id string, session string, timepoint string, image string, mask string", True),
    "summary": (
        "id string, dsc_pre double, dsc_post double, improvement double, n_auto int, n_review int, n_reject int, status string", True,
    ),
}


def read(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """A manifest of a known layout: cells trimmed, blank ones null, rows without their first cell dropped. A last column
    that a file lacks is null."""
    schema, header = LAYOUTS[layout]
    df = spark.read.schema(schema).option("header", header).option("enforceSchema", True).option("mode", "PERMISSIVE").csv(path)
    df = df.select(*[F.nullif(F.trim(F.col(f.name)), F.lit("")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema])
    return df.where(F.col(df.columns[0]).isNotNull())


def named(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One column of any manifest with a header, found by its name; blank cells go."""
    df = spark.read.option("header", True).csv(path)
    real = next((c for c in df.columns if c.strip() == column), None)
    if real is None:
        raise ValueError(f"no column {column} among {df.columns}")
    return df.select(F.trim(F.col(f"`{real}`")).alias(column)).where(F.col(column) != "")


def write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def resolve(base: str, path: Column) -> Column:
    """Paths against the manifest's folder; absolute ones and URIs stay."""
    absolute = path.rlike(r"^(/|[A-Za-z][A-Za-z0-9+.-]*:)")
    return F.when(absolute, path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(path, r"^\./", "")))


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files of a folder by name: (path, name, length)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length").orderBy("name")


def existing(rows: DataFrame, files: DataFrame, column: str) -> DataFrame:
    """Rows whose file is listed."""
    return rows.join(files.select(F.col("name").alias("_n")), F.element_at(F.split(column, "/"), -1) == F.col("_n"), "left_semi")


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows without an output yet."""
    return rows.join(done.select(key), key, "left_anti")


def paired(images: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """Images with their labels by id; both sides must hold the same ids."""
    both = images.join(labels, key, "full_outer")
    odd = both.where(F.isnull("image") | F.isnull("label")).limit(1).count()
    if odd:
        raise ValueError("an image or a label is missing")
    return both


def with_defaults(rows: DataFrame, params: DataFrame, defaults: dict[str, float], key: str = "id") -> DataFrame:
    """Saved parameters of each row, defaults where there are none; ``defaulted`` tells which."""
    joined = rows.join(params.withColumn("_has", F.lit(True)), key, "left")
    cols = [F.coalesce(F.col(c), F.lit(v)).alias(c) if c in params.columns else F.lit(v).alias(c) for c, v in defaults.items()]
    return joined.select(*rows.columns, *cols, F.col("_has").isNull().alias("defaulted"))
