"""File listings: content hashes, sample names, image sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def hash_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SHA-256 and size of every file below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Paths only; file contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"))


def samples_from_paths(df: DataFrame, path: str | Column = "path") -> DataFrame:
    """``sample_<start>_<stop>`` folder names or file stems with their indices; other paths are dropped."""
    source = F.col(path) if isinstance(path, str) else path
    name = F.regexp_extract(source, r"(?:^|[/\\])(sample_\d+_\d+)(?:[/\\.]|$)", 1)
    named = df.withColumn("sample_name", name).where("sample_name <> ''")
    start = F.regexp_extract("sample_name", r"^sample_(\d+)_(\d+)$", 1).cast("bigint")
    stop = F.regexp_extract("sample_name", r"^sample_(\d+)_(\d+)$", 2).cast("bigint")
    return named.withColumns(
        {"start_index": start, "stop_index": stop, "window_length": stop - start + 1}
    )


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded size and mode per image; a file that is not an image keeps a row with null size."""
    raw = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path)
    ok = F.col("image.height") > 0
    return raw.select(
        F.col("image.origin").alias("path"),
        *[F.when(ok, F.col(f"image.{c}")).alias(c) for c in ("height", "width", "nChannels", "mode")],
    )


def image_census(images: DataFrame) -> DataFrame:
    """Number of images per size and mode."""
    return images.groupBy("height", "width", "nChannels", "mode").agg(F.count(F.lit(1)).alias("images"))


def bad_images(images: DataFrame, height: int = 360, width: int = 360) -> DataFrame:
    """Images that cannot be decoded or have another size."""
    right = (F.col("height") == height) & (F.col("width") == width)
    return images.where(~F.coalesce(right, F.lit(False)))
