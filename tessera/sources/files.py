"""Readers and writers for the inputs and outputs: telemetry, completion points, repositories, WFDB records, signals."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import columns as C

TELEMETRY = "deviceId string, period string, timedate string, deviceType string, " + ", ".join(f"t{i} double" for i in range(1, 14)) + ", x1 double, x2 double, x3 double"
POINTS = "repo string, revision string, path string, prefix string, suffix string, modified array<string>"
EXTENSIONS = {"python": ".py", "kotlin": ".kt"}


def telemetry(spark: SparkSession, path: str) -> DataFrame:
    """CSV readings; the first 19 characters of timedate are the time, NaN readings become null as means skip them."""
    rows = spark.read.schema(TELEMETRY).option("header", True).csv(path)
    numbers = [c for c, t in rows.dtypes if t == "double"]
    return rows.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) if c in numbers else F.col(c) for c in rows.columns], F.to_timestamp_ntz(F.substring("timedate", 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"))


def completion_points(spark: SparkSession, path: str) -> DataFrame:
    """The points, with their place in the input as ordinal: file, start of the block that a task read, row in the task. It sorts as the input does."""
    rows = spark.read.schema(POINTS).json(path).withColumn("modified", F.coalesce("modified", F.array().cast("array<string>")))
    return rows.withColumn("ordinal", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))


def repository(spark: SparkSession, path: str, language: str, min_lines: int = 10) -> DataFrame:
    """(rel_path, content, n_lines) of the files of a language with enough lines; files that aren't UTF-8 are left out."""
    if language not in EXTENSIONS:
        raise ValueError(f"unknown language {language!r}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{EXTENSIONS[language]}").load(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    # Paths come back as URIs, some with an empty authority: both are cut behind the root's own path, at its
    # first occurrence, as it may come again below.
    own = re.sub(r"^[a-z0-9+.-]+:/*", "/", root) + "/"
    below = F.substring(F.col("path"), F.locate(own, F.col("path")) + F.lit(len(own)), F.length("path"))
    text = files.select(below.alias("rel_path"), F.try_validate_utf8(F.col("content").cast("string")).alias("content")).filter("content is not null")
    return text.withColumn("n_lines", F.size(C.lines(F.col("content")))).filter(F.col("n_lines") >= min_lines)


IMAGES = r"(?i)\.(png|jpg|jpeg|bmp|tif|tiff|webp)$"


def images(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, name, size) of the images at a path: a folder's (recursive: also below it) or a pattern's files of the known endings in either
    case, or one file of any ending. The order is that of the paths, by range; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size"))
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = not re.search(r"[*?\[{]", path) and own.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(own).isFile()
    return (found if single else found.filter(F.col("path").rlike(IMAGES))).orderBy("path")


def image_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, left, right): paths of images of one name, such as an image and its mask."""
    return left.select("name", F.col("path").alias("left")).join(right.select("name", F.col("path").alias("right")), "name")


def write_by_period(rows: DataFrame, path: str) -> None:
    rows.write.partitionBy("period").option("header", True).csv(path)


def write_predictions(rows: DataFrame, path: str, ordinal: str = "ordinal") -> None:
    """The rows but for the ordinal as JSON lines in its order: each file holds a range of it, and the files' names sort as the ranges do, so that
    they can be put end to end. No task sees all rows."""
    rows.repartitionByRange(F.col(ordinal)).sortWithinPartitions(ordinal).drop(ordinal).write.json(path)


def recent_files(points: DataFrame, files: DataFrame, min_lines: int = 10) -> DataFrame:
    """(q, f, path, pos): the files of a point's list of modified ones that exist and are long enough, in the list's order. points (q, repo,
    modified), files (repo, f, path, n_lines)."""
    listed = points.select("q", "repo", F.posexplode("modified").alias("pos", "path"))
    return listed.join(files.filter(F.col("n_lines") >= min_lines).select("repo", "f", "path"), ["repo", "path"]).select("q", "f", "path", "pos")


def write_submission(rows: DataFrame, path: str) -> None:
    """The rows as Parquet and as CSV with a header, below path."""
    rows.write.parquet(f"{path}/parquet")
    rows.write.option("header", True).csv(f"{path}/csv")


def write_signals(rows: DataFrame, path: str) -> None:
    """rows (record, lead, values) as long CSV: record, lead, sample_idx, value_mv."""
    rows.select("record", "lead", F.posexplode("values").alias("sample_idx", "value_mv")).write.option("header", True).csv(path)


def append_metrics(rows: DataFrame, path: str) -> None:
    """One more epoch's metrics; earlier files stay, so a run cut short loses nothing."""
    rows.write.mode("append").parquet(path)


ANNOTATION = "leads array<struct<lead_name: string, plotted_pixels: array<array<double>>>>"


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(file, lead, place, x, y): the pixels plotted for each lead of annotation files, one JSON document a file."""
    rows = spark.read.schema(ANNOTATION).option("multiLine", True).json(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), F.explode("leads").alias("l"))
    return rows.select("file", F.col("l.lead_name").alias("lead"), F.posexplode("l.plotted_pixels").alias("place", "p")).select("file", "lead", "place", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(record, fs, n_samples, leads): WFDB headers; gain is the text before "(", baseline the number in it or 0."""
    x = spark.read.option("pathGlobFilter", "*.hea").text(path, wholetext=True)
    rows = F.filter(F.split("value", r"\r?\n"), lambda s: (F.length(C.strip(s)) > 0) & ~s.startswith("#"))
    first = F.split(C.strip(F.get(rows, 0)), r"\s+")
    n = F.get(first, 1).cast("int")

    def lead(s):
        part = F.split(C.strip(s), r"\s+")
        gain = F.get(part, 2)
        return F.struct(F.element_at(part, -1).alias("name"), F.regexp_extract(gain, r"^([^(]*)\(", 1).try_cast("double").alias("gain"), F.coalesce(F.regexp_extract(gain, r"\((-?\d+)\)", 1).try_cast("int"), F.lit(0)).alias("baseline"))

    return x.select(F.get(first, 0).alias("record"), F.get(first, 2).cast("double").alias("fs"), F.get(first, 3).cast("int").alias("n_samples"), F.transform(F.slice(rows, F.lit(2), n), lead).alias("leads"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, lead, sample_idx, value_mv): interleaved 16-bit samples, scaled by the header's gain and baseline."""
    heads = read_headers(spark, path)
    data = spark.read.format("binaryFile").option("pathGlobFilter", "*.dat").load(path).select(F.regexp_extract("path", r"([^/]+)\.dat$", 1).alias("record"), "content")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                raw = np.frombuffer(r.content, "<i2")
                if len(raw) != r.n_samples * len(r.leads):
                    raise ValueError(f"{r.record}: {len(raw)} samples, {r.n_samples} x {len(r.leads)} expected")
                for lead, own in zip(r.leads, raw.reshape(r.n_samples, len(r.leads)).T, strict=True):
                    yield pd.DataFrame({"record": r.record, "lead": lead["name"], "sample_idx": np.arange(len(own), dtype=np.int32), "value_mv": (own - lead["baseline"]) / (lead["gain"] or np.nan)})

    return data.join(heads, "record").mapInPandas(run, "record string, lead string, sample_idx int, value_mv double")
