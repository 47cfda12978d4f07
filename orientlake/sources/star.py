"""STAR tables: many text files with named blocks, read line by line in parallel.

A file is never held as one value: its lines are split like any text, and only
the few header lines of each file are brought together, to tell every data
line which block and which columns it belongs to.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from orientlake.frames import MissingColumns
from orientlake.session import cut

BLOCKS = T.ArrayType(T.StructType([
    T.StructField("block", T.StringType()), T.StructField("at", T.StringType()),
    T.StructField("columns", T.ArrayType(T.StringType())), T.StructField("values", T.ArrayType(T.StringType())),
    T.StructField("looped", T.BooleanType())]))
# a quote closes a value only before a blank or the end of the line
TOKEN = r"""'(?:[^']|'(?!\s|$))*'(?=\s|$)|"(?:[^"]|"(?!\s|$))*"(?=\s|$)|\S+"""
QUOTED = r"""(?s)^'(.*)'$|^"(.*)"$"""
#: A missing text; the same letters as a value are written in quotes.
MISSING = "<NA>"
#: Text that would be read as something else if it stood without quotes.
NEEDS_QUOTES = r"""\s|^$|^[_#'"]|^data_|^loop_|^<NA>$"""
# a test by pattern: casting text that is no number costs an exception per row
WHOLE = r"^[+-]?\d{1,18}$"
LONG = r"^[+-]?\d{19,}$"
NUMBER = r"^(?i:[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?|nan|[+-]?inf(inity)?)$"
OPTICS_LIMIT = 100_000
#: Of so many files at most the headers are sent to all tasks; of more the lines are moved to the headers.
SENT_HEADERS = 4_000
#: Blanks between values other than one space.
OTHER_BLANKS = ("  ", "\t", "\x0b", "\f", "\r")


def _position(block_at, line_at) -> F.Column:
    """Place of a line in its file as text that sorts like (split start, line)."""
    return F.concat(F.lpad(block_at.cast("string"), 20, "0"), F.lpad(line_at.cast("string"), 20, "0"))


def _parse_headers(headers: pd.Series) -> pd.Series:
    """Blocks of one file from its header lines in order; single values become one-row blocks.

    In a loop a header line is a name alone or a name and a number mark; any
    other line with a leading underscore is a row there.
    """
    out = []
    for lines in headers:
        blocks, current, looped = [], None, False
        for item in lines:
            text = item["text"].strip()
            if text.startswith("data_"):
                current = {"block": text[5:], "at": item["at"], "columns": [], "values": [], "looped": False}
                blocks.append(current)
                looped = False
            elif text.startswith("loop_"):
                looped = True
                if current is not None:
                    current["looped"] = True
            elif current is not None and text.startswith("_"):
                parts = text.split(None, 1)
                if not looped:
                    value = parts[1].strip() if len(parts) > 1 else ""
                    inner = re.match(QUOTED, value)
                    current["columns"].append(parts[0][1:])
                    current["values"].append((inner[1] if inner[1] is not None else inner[2]) if inner else None if value == MISSING else value)
                elif len(parts) == 1 or parts[1].startswith("#"):
                    current["columns"].append(parts[0][1:])
        out.append(blocks)
    return pd.Series(out)


def read_blocks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Every data row: file, block, position, columns and tokens; and one row without tokens for each table, which may have no rows."""
    raw = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_at"), F.col("value"),
    ).withColumn("line_at", F.monotonically_increasing_id())
    lines = raw.withColumn("text", F.trim("value")).where((F.col("text") != "") & ~F.col("text").startswith("#"))
    lines = lines.select("file", "text", _position(F.col("block_at"), F.col("line_at")).alias("at"))
    return assign_blocks(lines, tables=True, sent=len(raw.inputFiles()) <= SENT_HEADERS)


def assign_blocks(lines: DataFrame, tables: bool = False, sent: bool = False) -> DataFrame:
    """Data rows of (file, at, text) lines, each with its block, the columns of that and a number for their layout.

    With ``tables`` every table also has a row of its own, without tokens.
    With ``sent`` the headers go to the lines, which then stay where they are.
    """
    named = F.col("text").startswith("_")
    is_header = named | F.col("text").startswith("data_") | F.col("text").startswith("loop_")
    pair = named & F.col("text").rlike(r"^_\S*\s+[^#\s]")
    parse = F.pandas_udf(_parse_headers, BLOCKS)
    headers = lines.where(is_header).groupBy("file").agg(
        F.sort_array(F.collect_list(F.struct("at", "text"))).alias("h")).select("file", parse("h").alias("blocks"))
    rows = lines.where(~is_header | pair).join(F.broadcast(headers) if sent else headers, "file")
    before = F.filter("blocks", lambda b: b["at"] < F.col("at"))
    special = F.col("text").contains("'") | F.col("text").contains('"') | F.col("text").contains(MISSING)
    uneven = reduce(or_, [F.col("text").contains(b) for b in OTHER_BLANKS])
    placed = rows.withColumn("b", F.try_element_at(before, F.lit(-1))).where(~named | F.col("b.looped"))
    looped = placed.select(
        "file", "at", F.col("b.block").alias("block"), F.col("b.columns").alias("columns"),
        F.when(special, F.transform(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), lambda t: F.when(t != MISSING, F.regexp_replace(t, QUOTED, "$1$2"))))
        .when(uneven, F.split("text", r"\s+")).otherwise(F.split("text", " ")).alias("tokens"))
    single = headers.select("file", F.explode("blocks").alias("b")).where(F.size("b.values") > 0).select(
        "file", F.col("b.at").alias("at"), F.col("b.block").alias("block"), F.col("b.columns").alias("columns"), F.col("b.values").alias("tokens"))
    found = looped.unionByName(single)
    if tables:
        found = found.unionByName(headers.select("file", F.explode("blocks").alias("b")).where("b.looped").select(
            "file", F.col("b.at").alias("at"), F.col("b.block").alias("block"), F.col("b.columns").alias("columns"), F.lit(None).cast("array<string>").alias("tokens")))
    return found.withColumn("layout", F.xxhash64("columns"))


def block_layouts(rows: DataFrame) -> dict[str, dict[int, list[str]]]:
    """Per block its column layouts by number, first file first: a table of headers, not of rows."""
    found: dict[str, dict[int, list[str]]] = {}
    # distinct first, by hash: the least of a struct over all rows would sort them
    heads = rows.select("block", "layout", "file", "columns").distinct().groupBy("block", "layout").agg(F.min(F.struct("file", "columns")).alias("f")).orderBy("f.file")
    for r in heads.collect():
        found.setdefault(r["block"], {})[r["layout"]] = list(r["f"]["columns"])
    return found


def layout_columns(layouts: dict[int, list[str]]) -> list[str]:
    return list(dict.fromkeys(c for columns in layouts.values() for c in columns))


def pick_block(found: dict[str, dict[int, list[str]]], required: list[str] = ()) -> str:
    """particles, else data_particles, else the first block with the required columns."""
    for name in ("particles", "data_particles"):
        if name in found:
            return name
    for name, layouts in found.items():
        if set(required) <= set(layout_columns(layouts)):
            return name
    raise MissingColumns(f"no block with {list(required)}; blocks are {list(found)}")


def _value(column: str, layouts: dict[int, list[str]]) -> F.Column:
    """The token of a column; one plain position when all layouts agree on it."""
    places = {number: columns.index(column) if column in columns else None for number, columns in layouts.items()}
    if len(set(places.values())) == 1:
        return F.get("tokens", F.lit(next(iter(places.values()))))
    value = F.lit(None).cast("string")
    for number, place in places.items():
        if place is not None:
            value = F.when(F.col("layout") == number, F.get("tokens", F.lit(place))).otherwise(value)
    return value


def typed_table(rows: DataFrame, block: str, layouts: dict[int, list[str]]) -> DataFrame:
    """One block as a table; a column is BIGINT or DOUBLE when all its values read as such. Order: file, at.

    Whole numbers of more than 18 digits keep their column text, so that none loses a digit.
    """
    columns = layout_columns(layouts)
    texts = rows.where((F.col("block") == block) & F.col("tokens").isNotNull()).select("file", "at", *[_value(c, layouts).alias(c) for c in columns])
    tests = []
    for c in columns:
        # a pattern is tried only where those before leave the value open
        tests.append(F.max(F.when(F.col(c).isNull(), None).when(F.col(c).rlike(WHOLE), 0).when(
            F.col(c).rlike(NUMBER) & ~((F.length(c) > 18) & F.col(c).rlike(LONG)), 1).otherwise(2)).alias(c))
    seen = texts.agg(*tests).first()
    out = []
    for i, c in enumerate(columns):
        kind = {0: "bigint", 1: "double"}.get(seen[i], "string")
        value = F.col(c).cast(kind)
        out.append((F.nanvl(value, F.lit(None).cast("double")) if kind == "double" else value).alias(c))
    return texts.select("file", F.col("at").alias("file_order"), *out)


def read_star(spark: SparkSession, paths: str | list[str], required: list[str] = ()) -> tuple[DataFrame, DataFrame | None]:
    """(particles, optics or None) of many STAR files.

    The text is taken apart once, into a columnar table in the shared folder;
    finding the types and reading the values then cost no second parse.
    """
    rows = cut(read_blocks(spark, paths), "star")
    found = block_layouts(rows)
    block = pick_block(found, required)
    missing = [c for c in required if c not in layout_columns(found[block])]
    if missing:
        raise MissingColumns(f"missing columns in block {block}: {missing}")
    optics = None
    if "optics" in found and block != "optics":
        # a table of its own, whose size is known when it is joined
        optics = cut(typed_table(rows, "optics", found["optics"]).drop("file", "file_order").distinct(), "optics")
    return typed_table(rows, block, found[block]), optics


def quoted(field: T.StructField) -> F.Column:
    """A value as it stands in a STAR line; missing numbers are ``nan``, missing texts ``<NA>``.

    Text with a line break, or with both quotes before a blank, fits no line and is refused.
    """
    name = field.name
    text, missing = F.col(name).cast("string"), F.lit(MISSING if field.dataType.simpleString() == "string" else "nan")
    if isinstance(field.dataType, T.NumericType):
        return F.coalesce(text, missing)
    single, double = text.rlike(r"'(\s|$)"), text.rlike(r'"(\s|$)')
    wrapped = F.when(text.rlike(r"[\r\n]"), F.raise_error(F.lit(f"column {name}: a text with a line break fits no STAR line"))).when(
        ~single, F.concat(F.lit("'"), text, F.lit("'"))).when(~double, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(
        F.raise_error(F.lit(f"column {name}: a text with both quotes before blanks fits no STAR line")))
    return F.coalesce(F.when(text.rlike(NEEDS_QUOTES), wrapped).otherwise(text), missing)


def star_lines(df: DataFrame, block: str, preamble: list[str]) -> DataFrame:
    """Rows as STAR text; every partition starts with the preamble and the header of the block."""
    head = [*preamble, "", f"data_{block}", "", "loop_", *[f"_{c} #{i + 1}" for i, c in enumerate(df.columns)]]

    if df.isEmpty():  # one block without rows, so that its columns can be read back
        return df.sparkSession.createDataFrame([("\n".join(head),)], "value string")
    body = df.select(F.concat_ws(" ", *[quoted(f) for f in df.schema.fields]).alias("value"))

    def run(batches):
        started = False
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if not started:
                started = True
                yield pa.RecordBatch.from_arrays([pa.array(head, batch.schema.field(0).type)], schema=batch.schema)
            yield batch
    return body.mapInArrow(run, "value string")


def write_star(df: DataFrame, optics: DataFrame | None, path: str, group: str = "optics_group", order: list[str] = ()) -> None:
    """A folder of STAR files, each complete with header and the optics rows in use."""
    preamble: list[str] = []
    if optics is not None:
        used = optics.join(df.select(group).distinct(), group, "left_semi").select(*optics.columns) if group in df.columns else optics
        written = used.select(*([group] if group in used.columns else []), F.concat_ws(" ", *[
            quoted(f) for f in used.schema.fields]).alias("_line"))
        rows = (written.orderBy(group) if group in used.columns else written).select("_line").limit(OPTICS_LIMIT + 1).collect()
        if len(rows) > OPTICS_LIMIT:
            raise ValueError("optics table too large for a file header")
        preamble = ["data_optics", "", "loop_", *[f"_{c} #{i + 1}" for i, c in enumerate(optics.columns)],
                    *[r["_line"] for r in rows]]
    ordered = df.orderBy(*order) if order else df
    star_lines(ordered, "particles", preamble).write.text(path)
