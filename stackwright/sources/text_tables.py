"""Text formats of microscope parameters, read and written by Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.operators.sequence import numbered, runs

#: Column widths of fixed-width parameter lines (fixed values of the format).
PAR_WIDTHS = [7, 8, 8, 8, 8, 8, 8, 6, 9, 9, 8, 7]
PAR_NAMES = ["IDX", "PSI", "THETA", "PHI", "SHX", "SHY", "MAG", "FILM", "DF1", "DF2", "ANGAST", "CCMAX"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines numbered from 0 in the order of files and of places in them, however the files are split."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_nth"))
    return numbered(rows, ["_file", "_start", "_nth"], "_line").drop("_file", "_start", "_nth")


def _limited(df: DataFrame, num: int | None) -> DataFrame:
    return df if num is None else df.orderBy("_line", "_copy").limit(num) if "_copy" in df.columns else df.orderBy("_line").limit(num)


def read_ctf_text(spark: SparkSession, path: str, num: int | None = None) -> DataFrame:
    """Seven comma-separated columns; the first tells how many images share the line."""
    part = F.split(F.trim("value"), r"\s*,\s*")
    rows = _lines(spark, path).where(F.trim("value") != "").withColumn("p", part)
    rows = rows.select("_line", "p", F.explode(F.sequence(F.lit(1), F.col("p")[0].cast("double").cast("int"))).alias("_copy"))
    rows = _limited(rows, num)
    return rows.select("_line", "_copy", *[F.col("p")[i + 1].cast("double").alias(n) for i, n in enumerate(["MAG", "FILM", "DF1", "DF2"])], F.radians(F.col("p")[5].cast("double")).alias("ANGAST"), F.col("p")[6].cast("double").alias("FLAG"))


def read_defocus_text(spark: SparkSession, path: str, num: int | None = None) -> DataFrame:
    """Four columns; lines that do not start with a blank are headers."""
    rows = _limited(_lines(spark, path).where(F.col("value").startswith(" ") & (F.trim("value") != "")), num)
    part = F.split(F.trim("value"), r"\s+")
    return rows.select("_line", *[part[i].cast("double").alias(n) for i, n in enumerate(["FILM", "DF1", "DF2"])], F.radians(part[3].cast("double")).alias("ANGAST"))


def read_par(spark: SparkSession, path: str, num: int | None = None) -> DataFrame:
    """Twelve fixed-width columns; lines that start with c or C are comments."""
    rows = _lines(spark, path).where(~F.lower("value").startswith("c") & (F.trim("value") != ""))
    rows, at, columns = _limited(rows, num), 1, []
    for name, width in zip(PAR_NAMES, PAR_WIDTHS, strict=True):
        value = F.trim(F.substring("value", at, width)).cast("double")
        columns.append((F.radians(value) if name == "ANGAST" else value.cast("int") if name in ("IDX", "FILM") else value).alias(name))
        at += width
    return rows.select("_line", *columns)


def read_parameters(spark: SparkSession, path: str, num: int | None = None) -> DataFrame:
    """Chooses the reader by extension, then by the first line's number of columns."""
    if path.rstrip("/").endswith(".par"):
        return read_par(spark, path, num)
    head = spark.read.text(path).first()
    return read_ctf_text(spark, path, num) if head and "," in head["value"] else read_defocus_text(spark, path, num)


def write_lines(df: DataFrame, order: str, line, header: list[str], path: str) -> None:
    """One text file, header first: small tables of one line per image series."""
    body = df.select(F.col(order).cast("long").alias("_o"), line.alias("value"))
    head = df.sparkSession.createDataFrame([(-len(header) + i, h) for i, h in enumerate(header)], "_o long, value string") if header else None
    rows = body if head is None else head.unionByName(body)
    rows.coalesce(1).sortWithinPartitions("_o").select("value").write.mode("overwrite").text(path)


def write_defocus_text(df: DataFrame, order: str, path: str) -> None:
    line = F.format_string(" %6d %10.2f %10.2f %8.3f", F.col("FILM").cast("int"), "DF1", "DF2", F.degrees("ANGAST"))
    write_lines(df, order, line, ["C film df1 df2 angast"], path)


def write_poses(df: DataFrame, order: str, path: str) -> None:
    """Ground-truth poses with the optics of each image."""
    line = F.format_string("%7d %8.3f %8.3f %8.3f %8.3f %8.3f %6d %9.1f %9.1f %8.2f", F.col(order).cast("int"), "PHI", "THETA", "PSI", "SHX", "SHY", F.col("FILM").cast("int"), "DF1", "DF2", F.degrees("ANGAST"))
    write_lines(df, order, line, ["C row phi theta psi shx shy film df1 df2 angast"], path)


def ctf_ids(rows: DataFrame) -> DataFrame:
    """Adds image_id by file order and ctf_id: a new one wherever the optics differ from the row before."""
    order = ["_line", "_copy"] if "_copy" in rows.columns else ["_line"]
    return runs(numbered(rows, order, "image_id").drop(*order), ["image_id"], ["DF1", "DF2", "ANGAST"], out="ctf_id")


def counts(rows: DataFrame) -> DataFrame:
    """(ctfs, images) of a table with ctf_id."""
    return rows.agg(F.count_distinct("ctf_id").alias("ctfs"), F.count(F.lit(1)).alias("images"))


def generated(ctfs: DataFrame, posed: DataFrame, fields: list[str]) -> DataFrame:
    """Images (image_id, ctf_id, fields) with the optics (ctf_id, ...) they were made with, as a reader gives
    them."""
    return posed.select("image_id", "ctf_id", *fields).join(ctfs, "ctf_id")
