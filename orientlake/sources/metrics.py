"""Training metrics as CSV, and run logs as text."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from orientlake.frames import MissingColumns

# Metric columns that are kept, and the words of one comparison log.
METRIC_TYPES = {
    "step": "bigint", "epoch": "bigint", "loss": "double", "val_loss": "double",
    "geo_degs_epoch": "double", "val_geo_degs": "double", "val_median_geo_degs": "double",
}
#: figure -> (start of the section's title, or None where there is one such line only; label of the line)
LOG_FIGURES = {
    "mean_deg": ("analyzing angular differences", "mean"),
    "median_deg": ("analyzing angular differences", "median"),
    "pct5": (None, "< 5°"),
    "pct10": (None, "< 10°"),
    "shift_mean": ("shift errors", "mean"),
    "shift_median": ("shift errors", "median"),
    "minutes": (None, "run time"),
}
LOG_COUNT = ("found", "matching particles")


def known_columns(df: DataFrame) -> DataFrame:
    """The metric columns that the table has, in fixed order."""
    return df.select(*[c for c in METRIC_TYPES if c in df.columns])


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric CSV files with a header each, in any order of columns; absent values and columns are NULL.

    Files are grouped by their header line, and each group is read with it.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value").withColumn(
        "line", F.monotonically_increasing_id())
    headers = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "line").alias("header"))
    out = None
    for r in headers.groupBy("header").agg(F.collect_list("file").alias("files")).orderBy("header").collect():
        columns = next(csv.reader([r["header"]]))
        schema = T.StructType([T.StructField(c.strip(), T._parse_datatype_string(METRIC_TYPES.get(c.strip(), "string")), True) for c in columns])
        part = known_columns(spark.read.option("header", True).schema(schema).csv(r["files"]))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in METRIC_TYPES.items()))
    return known_columns(out)


def _log_lines(value: Column) -> Column:
    """The lines of a log as (section, label, number): a line that ends in a colon is a title and opens a section; the others are ``label: number unit``."""
    def read(state: Column, line: Column) -> Column:
        text = F.lower(F.trim(line))
        label, rest = F.trim(F.substring_index(text, ":", 1)), F.trim(F.substring_index(text, ":", -1))
        title = text.endswith(":")
        entry = F.struct(state["section"].alias("section"), label.alias("label"), F.regexp_extract(rest, r"^-?[0-9]*[.]?[0-9]+", 0).try_cast("double").alias("number"), text.alias("text"))
        return F.struct(F.when(title, text).otherwise(state["section"]).alias("section"),
                        F.when(title | (text == ""), state["lines"]).otherwise(F.concat(state["lines"], F.array(entry))).alias("lines"))

    start = F.struct(F.lit("").alias("section"), F.from_json(F.lit("[]"), "array<struct<section:string,label:string,number:double,text:string>>").alias("lines"))
    return F.aggregate(F.split(value, "\r?\n"), start, read)["lines"]


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row per comparison log: run folder, file and the figures found in it (NULL where a log does not have one).

    ``minutes`` is the run time; a log may give it in seconds, minutes or hours.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), _log_lines(F.col("value")).alias("lines"))
    part = F.split("file", "/")
    first, last = LOG_COUNT
    counts = F.filter("lines", lambda line: line["text"].startswith(first) & line["text"].contains(last))
    cells = [F.regexp_extract(F.get(counts, 0)["text"], r"[0-9]+", 0).try_cast("bigint").alias("n")]
    for name, (section, label) in LOG_FIGURES.items():
        found = F.get(F.filter("lines", lambda line: (line["label"] == label) & (line["section"].startswith(section) if section else F.lit(True))), 0)
        number = found["number"]
        if name == "minutes":
            unit = F.regexp_extract(found["text"], r"[0-9]\s*([smh])", 1)
            number = F.when(unit == "s", number / 60).when(unit == "h", number * 60).otherwise(number)
        cells.append(number.alias(name))
    return files.select(F.element_at(part, -2).alias("run"), F.element_at(part, -1).alias("file"), *cells)


def roll_up_runs(logs: DataFrame) -> DataFrame:
    """One row per run: counts and run time added over its halves, every other figure averaged."""
    return logs.groupBy("run").agg(*[F.sum(c).alias(c) for c in ("n", "minutes")], *[F.avg(c).alias(c) for c in LOG_FIGURES if c != "minutes"])


def write_table_csv(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """A curve or report as CSV with a fixed header and column order.

    Rows are range-partitioned by ``order``, so file after file the table is
    in order; a short curve is one file.
    """
    missing = [c for c in [*columns, *order] if c not in df.columns]
    if missing:
        raise MissingColumns(f"missing columns in a CSV table: {missing}")
    df.orderBy(*order).select(*columns).write.option("header", True).csv(path)
