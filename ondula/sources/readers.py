"""Recordings from text exports, CSV files, staged binary records and plain tables, as Datasets.

Files are read as distributed lines, so a large file is split, and every step stays with the splits: a line's place is (start of its split, its order there), and counts and
values that go on from line to line are carried from split to split by one small row for each (`along`). Headers differ from file to file:
they are a small table that is joined to the lines, and only distinct header lines reach the driver, which must know the channels' names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ondula.dataset import Dataset, quoted

DEFAULT_RATE = 200.0


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """filename, block and id (place in the file), line of every line of text files."""
    place = F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("filename"), *place, F.regexp_replace("value", "\r", "").alias("line"))


def along(rows: DataFrame, counts: dict[str, Column] | None = None, before: dict[str, Column] | None = None, last: dict[str, Column] | None = None) -> DataFrame:
    """Adds running values over each file's lines: counts of a condition up to and with the line, and the last known value before it, or up to and with it.

    Windows are by split; what earlier splits of the file hold comes to a split as a row ahead of its lines.
    """
    counts, before, last = counts or {}, before or {}, last or {}
    known = before | last
    rows = rows.withColumns({**{c: F.coalesce(v.cast("long"), F.lit(0)) for c, v in counts.items()}, **known})
    told = rows.groupBy("filename", "block").agg(*[F.sum(c).alias(c) for c in counts], *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c) for c in known], F.count(F.lit(1)).alias("_lines"))
    so_far = Window.partitionBy("filename").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    told = told.select("filename", "block", F.lit(-1).cast("long").alias("id"), *[F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(c) for c in counts], *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in known])
    own = Window.partitionBy("filename", "block").orderBy("id")
    until, ahead = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    both = rows.unionByName(told, allowMissingColumns=True)
    running = {**{c: F.sum(c).over(until) for c in counts}, **{c: F.last(c, ignorenulls=True).over(ahead) for c in before}, **{c: F.last(c, ignorenulls=True).over(until) for c in last}}
    return both.withColumns(running).filter("id >= 0")


def _distinct(heads: DataFrame) -> list[str]:
    """Names in the order of first sight over distinct headers (column names)."""
    return list(dict.fromkeys(c for r in sorted(r["names"] for r in heads.select("names").distinct().collect()) for c in r))


def _tidy(column: Column) -> Column:
    return F.upper(F.regexp_replace(F.regexp_replace(column, " ", ""), r"^[(){}]+|[(){}]+$", ""))


def _cell(name: str) -> Column:
    """The row's number under its file's column of that name; 0 where there is none."""
    return F.coalesce(F.try_element_at("cells", F.nullif(F.array_position("names", name), F.lit(0)).cast("int")).try_cast("double"), F.lit(0.0))


def _clean(name: str) -> str:
    return name.replace(" ", "").strip("(){}").upper()


def labchart(spark: SparkSession, path: str | list[str]) -> Dataset:
    """Tab-separated exports: header blocks, then rows that start with a digit; "#* text" is a comment, "#N Event Marker" a marker id.

    The first row of every block is commented RESET. Cells that are no number are 0, short rows are filled with 0. Recordings with other channels than the union hold 0.
    """
    rows = lines(spark, path)
    place = F.struct("block", "id")
    titles = rows.filter(F.col("line").startswith("ChannelTitle=")).groupBy("filename").agg(F.min_by("line", place).alias("line"))
    heads = F.split("line", "\t")
    names = F.transform(F.filter(F.slice(heads, F.lit(2), F.size(heads)), lambda c: F.trim(c) != ""), _tidy)
    titles = titles.select("filename", F.concat(F.array(F.lit("TIME")), names).alias("names"))
    channels = tuple(_distinct(titles))
    is_row = F.col("line").rlike("^[0-9]")
    begins = rows.filter(is_row).groupBy("filename").agg(F.min(place).alias("begin"))
    stated = F.regexp_extract("line", r"^Interval=\s*([0-9.eE+-]+)", 1).try_cast("double")
    steps = rows.filter(F.col("line").startswith("Interval=")).withColumn("rate", F.try_divide(F.lit(1.0), stated)).join(begins, "filename", "left")
    ahead = F.col("begin").isNull() | (place < F.col("begin"))
    steps = steps.groupBy("filename").agg(F.max_by("rate", F.when(ahead, place)).alias("rate"), F.collect_set(F.when(~ahead, F.col("rate"))).alias("later"), F.count_if(F.col("rate").isNull()).alias("bad"))
    complaint = F.when(F.col("bad") > 0, F.lit("malformed Interval= line in ")).when(F.size(F.filter("later", lambda r: r != F.col("rate"))) > 0, F.lit("sampling frequencies differ within "))
    steps = steps.select("filename", F.when(complaint.isNotNull(), F.raise_error(F.concat(complaint, F.col("filename"))).cast("double")).otherwise(F.col("rate")).alias("rate"))
    rows = along(rows, counts={"idx": is_row}, before={"_follows": is_row}).filter(is_row)
    cells = rows.withColumns({"cells": F.split("line", "\t"), "idx": F.col("idx") - 1, "starts": ~F.coalesce("_follows", F.lit(False))})
    cells = cells.join(titles, "filename", "left").join(steps, "filename", "left")
    note = F.regexp_extract("line", r"#\* ([^\t]*)", 1)
    event = F.regexp_extract("line", r"#(\d+) Event Marker", 1)
    samples = cells.select(
        F.col("filename").alias("rec"), "filename", "idx", F.coalesce("rate", F.lit(DEFAULT_RATE)).alias("frequency"),
        F.when(F.col("starts"), F.lit("RESET")).otherwise(_tidy(note)).alias("comment"),
        F.when(event != "", F.array(F.concat(F.lit("#"), event))).otherwise(F.array().cast("array<string>")).alias("markers"),
        *[_cell(c).alias(c) for c in channels],
    )
    return Dataset(samples, channels)


def terason(spark: SparkSession, path: str | list[str]) -> Dataset:
    """Key-value lines, {Data}, a line of names, rows. Rows of deleted data repeat the last good row; the rate is rows over the stated seconds, rounded half to even."""
    rows = along(lines(spark, path), counts={"after": F.trim("line") == "{Data}"}, before={"_ahead": F.trim("line")})
    body = rows.filter("after > 0").withColumn("head", F.col("_ahead") == "{Data}")
    heads = body.filter("head").groupBy("filename").agg(F.min_by("line", F.struct("block", "id")).alias("line"))
    name = lambda c: F.upper(F.regexp_replace(F.regexp_replace(c, r"(?i)\((sec|cm|cm/s)\)", ""), r"[()\s]", ""))
    heads = heads.select("filename", F.transform(F.split("line", ","), name).alias("names"))
    listed = _distinct(heads)
    times = rows.groupBy("filename").agg(*[F.max(F.when(F.col("line").startswith(k), _seconds(F.col("line")))).alias(a) for k, a in (("Start Time", "t0"), ("End Time", "t1"))])
    data = body.filter((F.trim("line") != "{Data}") & ~F.coalesce("head", F.lit(False)) & (F.trim("line") != "")).withColumn("cells", F.split("line", ",")).join(heads, "filename")
    number = {c: _cell(c) for c in listed}
    gone = next((c for c in listed if c.startswith("DELETED")), None)
    wave = next((c for c in listed if c.replace("-", "") == "RWAVE"), None)
    kept = F.struct(*[v.alias(f"x{i}") for i, v in enumerate(number.values())])
    sizes = data.groupBy("filename").agg(F.count(F.lit(1)).alias("rows_in"))
    filled = along(data, counts={"idx": F.lit(True)}, last={"row": F.when(number[gone] == 0, kept) if gone else kept})
    filled = filled.withColumn("idx", F.col("idx") - 1).join(sizes, "filename").join(times, "filename")
    none = F.array().cast("array<string>")
    marks = F.filter(F.slice("names", 2, 2), F.isnotnull)
    samples = filled.select(
        F.col("filename").alias("rec"), "filename", "idx",
        F.coalesce(F.bround(F.try_divide("rows_in", F.col("t1") - F.col("t0"))), F.lit(DEFAULT_RATE)).cast("double").alias("frequency"), F.lit("").alias("comment"),
        (F.when(F.abs(number[wave] - 1) < 1e-9, marks).otherwise(none) if wave else none).alias("markers"),
        *[F.coalesce(F.col(f"row.x{i}"), F.lit(0.0)).alias(c) for i, c in enumerate(listed)],
    )
    return Dataset(samples, tuple(listed))


def _seconds(line: Column) -> Column:
    part = lambda i: F.regexp_extract(line, r"(\d+):(\d+):(\d+(?:\.\d+)?)", i)
    return F.when(part(1) != "", part(1).cast("double") * 3600 + part(2).cast("double") * 60 + part(3).cast("double"))


def respirac(spark: SparkSession, path: str | list[str], time_column: str = "MR Time(s)", columns: dict[str, str] | None = None) -> Dataset:
    """Rows of breaths, held for their length at 1000 samples a second; the last sample of a breath is marked for every channel."""
    raw = spark.read.csv(path, header=True).withColumn("filename", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    return breaths(raw, time_column, columns or {c: _clean(c.split("(")[0].strip().replace(" ", "_")) for c in raw.columns if c != "filename"})


def breaths(raw: DataFrame, time_column: str, columns: dict[str, str], rate: float = 1000.0) -> Dataset:
    order = Window.partitionBy("filename").orderBy("_t")
    rows = raw.withColumn("_t", F.expr(f"try_cast(`{time_column}` as double)"))
    rows = rows.withColumn("_gap", (F.lead("_t").over(order) - F.col("_t")) * rate)
    mean = F.avg("_gap").over(Window.partitionBy("filename"))
    rows = rows.withColumn("_n", F.coalesce(F.col("_gap"), mean, F.lit(1000.0 * rate)).cast("long")).filter("_n > 0")
    channels = (*columns.values(), "RESPIRATORY_LENGTH")
    values = [F.coalesce(F.expr(f"try_cast(`{c}` as double)"), F.lit(float("nan"))).alias(n) for c, n in columns.items()]
    rows = rows.withColumn("_end", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spread = rows.select("filename", "_end", *values, F.col("_n").cast("double").alias("RESPIRATORY_LENGTH"), F.explode(F.sequence(F.col("_end") - F.col("_n"), F.col("_end") - 1)).alias("idx"))
    samples = spread.select(
        F.col("filename").alias("rec"), "filename", "idx", F.lit(rate).alias("frequency"), F.lit("").alias("comment"),
        F.when(F.col("idx") == F.col("_end") - 1, F.array(*map(F.lit, channels))).otherwise(F.array().cast("array<string>")).alias("markers"), *[quoted(c) for c in channels],
    )
    return Dataset(samples, channels, rates=(rate,))


def staged(records: DataFrame, least_rate: float = 200.0) -> Dataset:
    """Records of a binary format after parsing: (rec, channel, record, fs, sample_idx, value), brought to one rate by holding values.

    Slower channels are upsampled on an even grid, records follow each other, channels that are shorter are filled with 0 from the left, and a record's
    first sample is commented RESET.
    """
    top = records.groupBy("rec").agg(F.greatest(F.lit(least_rate), F.max("fs")).alias("rate"))
    key = ["rec", "channel", "record", "fs"]
    sizes = records.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("sample_idx").alias("first"), F.max("sample_idx").alias("last")).join(top, "rec")
    whole = F.col("last") - F.col("first") + 1 == F.col("n")
    n = F.when(whole, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("samples missing in a record of "), F.col("rec").cast("string"))).cast("long"))
    slow = F.col("fs") < F.col("rate")
    sizes = sizes.withColumn("n", n).withColumn("new", F.when(slow, F.greatest(F.lit(1), F.floor(F.col("n") * F.col("rate") / F.col("fs")))).otherwise(F.col("n")).cast("long"))
    order = Window.partitionBy("rec", "channel").orderBy("record")
    sizes = sizes.withColumn("end", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.max("end").over(Window.partitionBy("rec"))
    own = F.max("end").over(Window.partitionBy("rec", "channel"))
    sizes = sizes.select(*key, "rate", "n", "new", "first", (F.col("end") - F.col("new") + total - own).alias("shift"))
    # sample k of a slow record is held at the places i with floor(i step) = k, the last one at all that are left
    flat = records.join(sizes, key).withColumn("at", F.col("sample_idx") - F.col("first"))
    step = F.try_divide("n", F.greatest(F.col("new") - 1, F.lit(1)))
    near = F.sequence(F.greatest(F.lit(0), F.floor(F.col("at") / step) - 1).cast("long"), F.least(F.col("new") - 1, F.ceil((F.col("at") + 1) / step) + 1).cast("long"))
    held = F.filter(near, lambda i: F.least(F.floor(i * step), F.col("n") - 1) == F.col("at"))
    flat = flat.select("rec", "channel", "rate", "record", "shift", "value", F.explode(F.when(slow, held).otherwise(F.array(F.col("at")))).alias("k")).withColumn("idx", (F.col("shift") + F.col("k")).cast("long"))
    names = [r[0] for r in records.select("channel").distinct().orderBy("channel").collect()]  # the channels of a device
    wide = flat.groupBy("rec", "idx").agg(F.first("rate").alias("frequency"), F.max(F.col("k") == 0).alias("start"), *[F.coalesce(F.max(F.when(F.col("channel") == c, F.col("value"))), F.lit(0.0)).alias(c.upper()) for c in names])
    samples = wide.select(
        "rec", F.col("rec").cast("string").alias("filename"), "idx", "frequency", F.when(F.col("start"), F.lit("RESET")).otherwise(F.lit("")).alias("comment"), F.array().cast("array<string>").alias("markers"),
        (F.col("idx") / F.col("frequency")).alias("TIME"), *[quoted(c.upper()) for c in names],
    )
    return Dataset(samples, ("TIME", *[c.upper() for c in names]))


def adi(spark: SparkSession, path: str | list[str]) -> Dataset:
    """Records of binary files that a parser outside of Spark has staged as Parquet, with the columns of `staged`; the binary format itself has no public reader here."""
    return staged(spark.read.parquet(*([path] if isinstance(path, str) else path)))


def from_events(events: DataFrame, rate: float = 10.0) -> Dataset:
    """A table of timed events as recordings: one per user, its value as channel VALUE, its type as comment and marker."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    samples = events.select(
        F.col("user_id").alias("rec"), F.col("user_id").cast("string").alias("filename"), (F.row_number().over(order) - 1).cast("long").alias("idx"), F.lit(rate).alias("frequency"),
        F.upper("event_type").alias("comment"), F.array(F.upper("event_type")).alias("markers"), F.col("value").alias("VALUE"),
    )
    return Dataset(samples, ("VALUE",), rates=(rate,))
