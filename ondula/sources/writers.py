"""Results as text lines and as plot data."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ondula.dataset import Dataset, PipelineError, quoted
from ondula.functions import kernels
from ondula.operators.samples import tidy

PLOT_RATE = 50.0


def _shown(decimal: int, delim: str) -> Callable[[Column], Column]:
    """Numbers as text by the rule that rounds to the nearest decimal of the exact value, which column functions do not have."""

    @F.pandas_udf("string")
    def shown(values: pd.Series) -> pd.Series:
        return values.map(lambda cell: delim.join(str(round(float("nan" if v is None else v), decimal)) for v in cell), na_action="ignore")

    return shown


def text_lines(ds: Dataset, form: str, delim: str = ",", decimal: int = 2, name: str = "") -> DataFrame:
    """rec, n, line: a template with {CHANNEL}, {FILENAME}, {FREQUENCY} and {NAME} filled in.

    A channel of one cycle fills every line of its recording; channels of more cycles give a line each, to the shortest. Unknown keys stay as they are. Lines are joined to
    cycles by their number; no recording is gathered into a row.
    """
    form, delim = form.upper(), delim.upper()
    shown = _shown(decimal, delim)
    keys = [k for k in dict.fromkeys(re.findall(r"\{([^{}]+)\}", form)) if ds.has(k)]
    rows, many = ds.recordings(), {}
    for i, key in enumerate(keys):
        order = Window.partitionBy("rec").orderBy("wave_no")
        cells = ds.cycles(key).select("rec", (F.row_number().over(order) - 1).alias("n"), F.count(F.lit(1)).over(Window.partitionBy("rec")).alias("of"), shown("values").alias(f"many{i}"))
        known = cells.filter("n = 0").select("rec", F.col("of").alias(f"of{i}"), F.when(F.col("of") == 1, F.col(f"many{i}")).alias(f"one{i}"))
        rows = rows.join(known, "rec", "left").withColumn(f"of{i}", F.coalesce(f"of{i}", F.lit(0)))
        many[i] = cells.filter("of > 1").drop("of")
    lengths = [F.when(F.col(f"of{i}") != 1, F.col(f"of{i}")) for i in many]
    count = F.coalesce(F.least(*lengths) if len(lengths) > 1 else lengths[0], F.lit(1)) if lengths else F.lit(1)
    rows = rows.withColumn("n", F.explode(F.when(count > 0, F.sequence(F.lit(0), count.cast("int") - 1))))
    for cells in many.values():
        rows = rows.join(cells, ["rec", "n"], "left")
    line = F.replace(F.lit(form.replace("{NAME}", name)), F.lit("{FILENAME}"), F.col("filename"))
    line = F.replace(line, F.lit("{FREQUENCY}"), shown(F.array(F.col("frequency").cast("double"))))
    for i, key in enumerate(keys):
        line = F.replace(line, F.lit("{" + key + "}"), F.coalesce(f"one{i}", f"many{i}"))
    return rows.select("rec", F.col("n").cast("int").alias("n"), line.alias("line"))


def save(ds: Dataset, path: str, form: str, header: str = "", delim: str = ",", append: bool = False, decimal: int = 2, name: str = "") -> None:
    """Writes the lines in order of recordings as text files under `path`, whose names sort as they do, headed by one line of header."""
    body = text_lines(ds, form, delim, decimal, name)
    rows = body.select(F.lit(1).alias("part"), "rec", "n", "line")
    if header:
        rows = rows.unionByName(body.sparkSession.createDataFrame([(0, header.upper())], "part int, line string"), allowMissingColumns=True)
    rows.orderBy("part", "rec", "n").select("line").write.mode("append" if append else "overwrite").text(path)


def plot_data(ds: Dataset, channels: list[str], rate: float = PLOT_RATE) -> DataFrame:
    """rec, channel, t, value at a rate fit for a screen: the recording's time in equal steps, which are a little wider than 1 / rate where no whole number of those fills it."""
    kind = ds.samples.schema["rec"].dataType.simpleString()

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("idx")
        seconds = len(frame) / float(frame["frequency"].iloc[0])
        n = max(1, int(seconds * rate))
        return pd.concat([pd.DataFrame({"rec": frame["rec"].iloc[0], "channel": c, "t": [k * seconds / n for k in range(n)], "value": kernels.fourier_resample(frame[f"x{i}"].to_numpy(float), n)}) for i, c in enumerate(channels)])

    picked = ds.samples.select("rec", "idx", "frequency", *[quoted(c).alias(f"x{i}") for i, c in enumerate(channels) if c in ds.channels])
    return picked.groupBy("rec").applyInPandas(work, f"rec {kind}, channel string, t double, value double")


def plotted(ds: Dataset, channels: list[str], index: list[str] = (), comments: list[str] = (), title: str = "", name: str = "") -> DataFrame:
    """rec, filename, title, panel, channel, kind, t, value, text: all that a plot shows, a panel for each channel that there is.

    kind is "line", "marker" (a sample that carries the panel's marker, at its own value) or "comment". index has a marker for each channel, or is taken again from its start; one that
    is no channel marks nothing, and a panel whose marker is empty shows neither markers nor comments. title is a template of {NAME} and {FILENAME}.
    """
    panels = [(i, c, index[i % len(index)] if index else "") for i, c in enumerate(channels) if c in ds.channels]
    if not panels:
        raise PipelineError(f"nothing to plot: none of {', '.join(channels)} is a channel")
    lines = plot_data(ds, list(dict.fromkeys(c for _, c, _ in panels)))
    own = F.array(*[F.struct(F.lit(i).alias("panel"), F.lit(c).alias("channel")) for i, c, _ in panels])
    lines = lines.withColumn("p", F.explode(F.filter(own, lambda p: p["channel"] == F.col("channel")))).select("rec", "p.panel", "channel", F.lit("line").alias("kind"), "t", "value", F.lit("").alias("text"))
    drawn = []
    for i, c, mark in panels:
        if not mark:
            continue
        point = lambda kind, value, text, i=i, c=c: F.struct(F.lit(i).alias("panel"), F.lit(c).alias("channel"), F.lit(kind).alias("kind"), value.cast("double").alias("value"), text.alias("text"))
        if mark in ds.channels:
            drawn.append(F.when(F.array_contains("markers", mark), point("marker", quoted(c), F.lit(mark))))
        if comments:
            drawn.append(F.when(F.col("comment").isin([tidy(x) for x in comments]), point("comment", F.lit(None), F.col("comment"))))
    if drawn:
        points = ds.samples.select("rec", (F.col("idx") / F.col("frequency")).alias("t"), F.explode(F.filter(F.array(*drawn), lambda p: p.isNotNull())).alias("p"))
        lines = lines.unionByName(points.select("rec", "t", "p.*"))
    files = ds.recordings().select("rec", "filename", F.replace(F.lit(title.upper().replace("{NAME}", name)), F.lit("{FILENAME}"), F.col("filename")).alias("title"))
    return lines.join(files, "rec").select("rec", "filename", "title", "panel", "channel", "kind", "t", "value", "text")
