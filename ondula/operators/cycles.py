"""Steps over cycles: cutting samples into them, masks, selection, arithmetic, aggregation, shape."""

from __future__ import annotations

import logging
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ondula.dataset import Dataset, PipelineError, Table, _column, _mask, by_time, quoted, whole
from ondula.functions import cycles as C
from ondula.functions import kernels
from ondula.functions.duration import duration
from ondula.operators import chunks
from ondula.operators.samples import per_batch, to_here

log = logging.getLogger("ondula")


def by_wave() -> WindowSpec:
    return Window.partitionBy("rec").orderBy("wave_no")



def _none() -> Column:
    return F.array().cast("array<double>")


def partition(ds: Dataset, channels: list[str], index: str, outs: list[str] | None = None, del_first: bool = False, del_last: bool = False) -> Dataset:
    """Cuts channels into cycles that start at the samples marked `index`; several channels cost one pass.

    Samples before the first marker are cycle 0, which is there even when it is empty.
    """
    ds.needs(*channels)
    outs = outs or channels
    starts = F.array_contains("markers", index).cast("int")
    first = F.lag("idx").over(by_time()).isNull()
    rows = ds.samples.select("rec", "idx", "frequency", first.alias("first"), F.sum(starts).over(to_here()).cast("int").alias("wave_no"), *[quoted(c).alias(f"x{i}") for i, c in enumerate(channels)])
    in_order = F.array_sort(F.collect_list(F.struct("idx", *[f"x{i}" for i in range(len(channels))])))
    cut = rows.groupBy("rec", "wave_no").agg(in_order.alias("v"), F.first("frequency").alias("frequency"), F.max("first").alias("first"))
    columns = {_column(o): _field("v", f"x{k}") for k, o in enumerate(outs)}
    # an empty cycle 0 where the first sample is marked
    twice = F.when((F.col("wave_no") == 1) & F.col("first"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    cut = cut.withColumn("empty", F.explode(twice))
    every = cut.select("rec", F.when(F.col("empty"), 0).otherwise(F.col("wave_no")).alias("wave_no"), "frequency", *[F.when(F.col("empty"), _none()).otherwise(v).alias(c) for c, v in columns.items()])
    if del_first:
        every = every.filter("wave_no > 0").withColumn("wave_no", F.col("wave_no") - 1)
    if del_last:
        every = every.withColumn("_last", F.max("wave_no").over(whole())).filter(F.col("wave_no") < F.col("_last")).drop("_last")
    return ds.add_table(Table(every, tuple(outs), sparse=del_first or del_last))


def _field(array: str, name: str) -> Column:
    return F.transform(array, lambda s: s[name])


def measured(ds: Dataset, channel: str, form: str, out: str | None = None) -> Dataset:
    """One number per cycle."""
    value = C.measure(ds.values(channel), form, F.col("frequency"))
    return ds.derive(channel, out or channel, F.when(ds.values(channel).isNotNull(), F.array(value)))


def normalized(ds: Dataset, channel: str, height: float = 1, shift: float = 0, out: str | None = None) -> Dataset:
    return ds.derive(channel, out or channel, C.rescaled(ds.values(channel), height, shift))


def sliced(ds: Dataset, channel: str, start: float, end: float, out: str | None = None) -> Dataset:
    """The part of every cycle between two shares of its length."""
    a, b = min(max(start, 0.0), 1.0), min(max(end, 0.0), 1.0)
    if a > b:
        raise PipelineError(f"a slice cannot start at {start} and end at {end}")
    return ds.derive(channel, out or channel, C.part(ds.values(channel), a, b))


def arithmetic(ds: Dataset, channel: str, operator: str, second: str | None = None, num: float | None = None, out: str | None = None) -> Dataset:
    """A channel and a number, or two channels cycle by cycle and value by value, to the shorter of them. "-1" is the reciprocal, with 0 for that of 0.

    A recording without cycles of the channel gets one, of a NaN.
    """
    out = out or channel
    return _never_empty(_calculated(ds, channel, operator, second, num, out), out)


def _never_empty(ds: Dataset, channel: str) -> Dataset:
    table = ds.tables[ds.table_of(channel)]
    if not table.sparse:
        return ds
    own = table.frame.select("rec", "wave_no", "frequency", _column(channel)).filter(ds.values(channel).isNotNull())
    without = ds.recordings().join(own.select("rec").distinct(), "rec", "left_anti")
    nan = without.select("rec", F.lit(0).cast("int").alias("wave_no"), "frequency", F.array(F.lit(C.NAN)).alias(_column(channel)))
    return ds.add_table(Table(own.unionByName(nan), (channel,), sparse=False))


def _calculated(ds: Dataset, channel: str, operator: str, second: str | None, num: float | None, out: str) -> Dataset:
    if operator == "-1":
        if second:
            raise PipelineError("a reciprocal takes one channel")
        return ds.derive(channel, out, F.transform(ds.values(channel), lambda x: F.when(x == 0, F.lit(0.0)).otherwise(F.try_divide(F.lit(1.0), x))))
    if second is None:
        if num is None:
            raise PipelineError("arithmetic needs a second channel or a number")
        return ds.derive(channel, out, F.transform(ds.values(channel), lambda x: C.calculate(x, operator, F.lit(float(num)))))
    ds, _ = ds.together([channel, second])
    return ds.derive(channel, out, C.zipped(ds.values(channel), ds.values(second), operator))


# masks


def check(ds: Dataset, channel: str, variable: str, compare: str, num: float | None = None, time: str = "", form: str = "Y", mask: str = "") -> Dataset:
    """Multiplies a mask by whether each cycle's statistic (form Y) or its place (form X) compares to num, or to a duration in samples."""
    if not mask:
        raise PipelineError("check needs the name of a mask")
    variable, form = variable.upper(), form.upper()
    ds, i = ds.together([channel], [mask])
    values = ds.values(channel)
    stat = C.statistic(values, variable)
    if form == "X":
        place = F.array_position(values, stat)
        stat = {"START": F.when(F.size(values) > 0, F.lit(0.0)), "END": F.when(F.size(values) > 0, F.size(values).cast("double"))}.get(variable, F.when(place > 0, (place - 1).cast("double")))
    if compare.startswith("%"):
        if compare[1:2] != "X":
            raise PipelineError(f"unknown comparison {compare!r}")
        stat, compare = F.try_divide(stat, F.size(values)), compare[2:]
    bound = duration(time).samples(F.col("frequency")).cast("double") if time else F.lit(float(num))
    good = C.compares(stat, compare, bound).cast("int")
    return ds.set_mask(i, mask, F.when(values.isNotNull(), ds.ok(i, mask) * good).otherwise(F.col(_mask(mask)) if mask in ds.tables[i].masks else F.lit(None).cast("int")))


def merged(ds: Dataset, first: str, second: str, form: str, out: str) -> Dataset:
    """Two masks (or channels, by whether a cycle has values) combined: AND OR NAND NOR XOR XNOR; or the longer or shorter channel: GREATER LESSER."""
    form = form.upper()
    if form in ("GREATER", "LESSER"):
        return _longer(ds, first, second, form == "GREATER", out)
    a, b = (ds.mask(n).select("rec", "wave_no", F.col("ok").alias(k)) if ds.mask_table(n) is not None else ds.cycles(n).select("rec", "wave_no", (F.size("values") > 0).cast("int").alias(k)) for n, k in ((first, "a"), (second, "b")))
    x, y = F.col("a") != 0, F.col("b") != 0
    forms = {"AND": x & y, "OR": x | y, "NAND": ~(x & y), "NOR": ~(x | y), "XOR": F.col("a") != F.col("b"), "XNOR": F.col("a") == F.col("b")}
    if form not in forms:
        raise PipelineError(f"unknown combination {form!r}")
    both = a.join(b, ["rec", "wave_no"]).select("rec", "wave_no", forms[form].cast("int").alias(_mask(out)))
    home = ds.mask_table(first)
    if home is None:
        return ds.add_table(Table(both, (), (out,)))
    table = ds.tables[home]
    frame = table.frame.drop(_mask(out)).join(both, ["rec", "wave_no"], "left")
    return ds.put(home, replace(table, frame=frame, masks=(*(m for m in table.masks if m != out), out)))


def _longer(ds: Dataset, first: str, second: str, greater: bool, out: str) -> Dataset:
    def side(name: str, order: int) -> DataFrame:
        table = ds.tables[ds.table_of(name)]
        return table.frame.select("rec", "wave_no", "frequency", ds.values(name).alias("v"), F.lit(order).alias("_side")).filter("v is not null")

    every = side(first, 1).unionByName(side(second, 2))
    counts = every.groupBy("rec").agg(F.count(F.when(F.col("_side") == 1, 1)).alias("a"), F.count(F.when(F.col("_side") == 2, 1)).alias("b"))
    better = (F.col("a") > F.col("b")) if greater else (F.col("a") < F.col("b"))
    chosen = every.join(counts.select("rec", F.when(better, 1).otherwise(2).alias("_side")), ["rec", "_side"])
    return ds.add_table(Table(chosen.select("rec", "wave_no", "frequency", F.col("v").alias(_column(out))), (out,)))


def take(ds: Dataset, channel: str, consecutive: bool, waves: int = 0, time: str = "", mask: str = "", direction: str = "+", maximum: bool = False, minimum: bool = True, out: str | None = None) -> Dataset:
    """The first valid cycles, in scan order, that reach a number of cycles or a duration; consecutive ones only, if asked.

    Where no run reaches it: nothing, or with minimum off (or maximum on) the longest run, the first of equals.
    """
    out = out or channel
    ds, i = ds.together([channel], [mask] if mask else [])
    rows = ds.tables[i].frame.select("rec", "wave_no", "frequency", ds.values(channel).alias("v"), ds.ok(i, mask).alias("ok")).filter("v is not null")
    scan = Window.partitionBy("rec").orderBy(F.col("wave_no") if direction == "+" else F.desc("wave_no"))
    run = F.sum(1 - F.col("ok")).over(scan.rowsBetween(Window.unboundedPreceding, 0)) if consecutive else F.lit(0).cast("long")
    size = F.lit(1).cast("long") if waves > 0 else F.size("v").cast("long")
    target = F.lit(int(waves)).cast("long") if waves > 0 else duration(time).samples(F.col("frequency"))
    valid = rows.withColumn("run", run).filter("ok = 1").withColumns({"size": size, "target": target})
    in_run = Window.partitionBy("rec", "run").orderBy(F.col("wave_no") if direction == "+" else F.desc("wave_no")).rowsBetween(Window.unboundedPreceding, 0)
    valid = valid.withColumn("reached", F.sum("size").over(in_run)).withColumn("before", F.col("reached") - F.col("size"))
    runs = valid.groupBy("rec", "run").agg(F.max("reached").alias("length"), F.max("target").alias("target"))
    hit = F.min(F.when(F.col("length") >= F.col("target"), F.col("run"))).over(whole())
    longest = F.max(F.struct("length", (-F.col("run")).alias("r"))).over(whole())
    chosen = runs.withColumns({"hit": F.lit(None).cast("long") if maximum else hit, "any": F.max((F.col("length") >= F.col("target")).cast("int")).over(whole()), "best": -longest["r"]})
    allowed = (F.col("any") == 1) if minimum else F.lit(True)
    chosen = chosen.filter((F.col("length") > 0) & (F.col("hit").isNotNull() & (F.col("run") == F.col("hit")) | F.col("hit").isNull() & (F.col("run") == F.col("best")) & allowed))
    kept = valid.join(chosen.select("rec", "run", F.col("hit").isNotNull().alias("stops")), ["rec", "run"]).filter(~F.col("stops") | (F.col("before") < F.col("target")))
    table = kept.select("rec", (F.row_number().over(by_wave()) - 1).alias("wave_no"), "frequency", F.col("v").alias(_column(out)))
    return ds.add_table(Table(table, (out,)))


def priority(ds: Dataset, channels: list[str], out: str) -> Dataset:
    """For every recording the first channel that has cycles."""
    sides = []
    for order, name in enumerate(c for c in channels if ds.has(c)):
        table = ds.tables[ds.table_of(name)]
        sides.append(table.frame.select("rec", "wave_no", "frequency", ds.values(name).alias("v"), F.lit(order).alias("o")).filter("v is not null"))
    if not sides:
        raise PipelineError(f"none of the channels {channels} is there")
    every = sides[0]
    for side in sides[1:]:
        every = every.unionByName(side)
    first = every.withColumn("_first", F.min("o").over(whole())).filter("o = _first")
    return ds.add_table(Table(first.select("rec", "wave_no", "frequency", F.col("v").alias(_column(out))), (out,)))


# aggregation


def _outliers(rows: DataFrame, method: str, num: float) -> DataFrame:
    """Adds `out`: whether the value at this position is an outlier among the recording's cycles. NaN is skipped."""
    by = Window.partitionBy("rec", "pos")
    x = F.when(~F.isnan("x"), F.col("x"))
    if method == "z_transform":
        spread = F.stddev_pop(x).over(by)
        return rows.withColumn("out", F.coalesce(F.abs(F.try_divide(F.col("x") - F.avg(x).over(by), spread)) > (num or 3.0), F.lit(False)) & ~F.isnan("x"))
    if method == "mad":
        rows = rows.withColumn("_median", F.percentile(x, F.lit(0.5)).over(by))
        rows = rows.withColumn("_mad", F.percentile(F.when(~F.isnan("x"), F.abs(F.col("x") - F.col("_median"))), F.lit(0.5)).over(by))
        off = F.abs(F.col("x") - F.col("_median"))
        return rows.withColumn("out", F.coalesce(F.when(F.col("_mad") == 0, off > 0).otherwise(F.try_divide(off * 0.6745, F.col("_mad")) > (num or 3.5)), F.lit(False)) & ~F.isnan("x")).drop("_median", "_mad")
    if method == "iqr":
        rows = rows.withColumns({"_a": F.percentile(x, F.lit(0.25)).over(by), "_b": F.percentile(x, F.lit(0.75)).over(by)})
        reach = (F.col("_b") - F.col("_a")) * (num or 1.5)
        return rows.withColumn("out", F.coalesce((F.col("x") < F.col("_a") - reach) | (F.col("x") > F.col("_b") + reach), F.lit(False)) & ~F.isnan("x")).drop("_a", "_b")
    raise PipelineError(f"unknown outlier method {method!r}")


def aggregated(ds: Dataset, channel: str, form: str, mask: str = "", weights: str = "", outlier: str = "none", outlier_num: float = 0, out: str | None = None) -> Dataset:
    """One row per recording from its valid cycles, value by value: mean (weighted), variance, std, min, max, difference, median, mode.

    Outliers are judged over all cycles and then leave the mask. Valid cycles of unequal length are an error when it runs. Recordings without a valid cycle give NaN.
    A dataset without the channel passes through.
    """
    return aggregated_each(ds, [(channel, out or channel)], form, mask, weights, outlier, outlier_num)


def aggregated_each(ds: Dataset, channels: list[tuple[str, str]], form: str, mask: str = "", weights: str = "", outlier: str = "none", outlier_num: float = 0) -> Dataset:
    """`aggregated` for channels by the names of their results; those of one table take one pass over its cycles, unless outliers are judged."""
    passes: dict[tuple, list[tuple[str, str]]] = {}
    for channel, out in channels:
        if not ds.has(channel):
            log.debug("no cycles %s to aggregate", channel)
            continue
        passes.setdefault((ds.table_of(channel), channel if outlier != "none" else ""), []).append((channel, out))
    for own in passes.values():
        ds = _aggregated(ds, own, form.lower(), mask, weights, outlier, outlier_num)
    return ds


def _aggregated(ds: Dataset, channels: list[tuple[str, str]], form: str, mask: str, weights: str, outlier: str, outlier_num: float) -> Dataset:
    names, each = [c for c, _ in channels], range(len(channels))
    weighted = weights and ds.has(weights)
    ds, i = ds.together([*names, weights] if weighted else names, [mask] if mask else [])
    frame = ds.tables[i].frame
    weight = F.element_at(ds.values(weights), 1) if weighted else F.lit(1.0)
    rows = frame.select("rec", "wave_no", "frequency", *[ds.values(c).alias(f"v{k}") for k, c in enumerate(names)], weight.alias("w"), ds.ok(i, mask).alias("ok")).filter(F.coalesce(*[F.col(f"v{k}") for k in each]).isNotNull())
    if outlier != "none":
        at = rows.select("rec", "wave_no", F.posexplode("v0").alias("pos", "x"))
        bad = _outliers(at, outlier, outlier_num).groupBy("rec", "wave_no").agg(F.max("out").alias("bad"))
        rows = rows.join(bad, ["rec", "wave_no"], "left").withColumn("ok", F.when(F.col("bad"), 0).otherwise(F.col("ok")))
        if mask:
            flags = rows.select("rec", "wave_no", F.col("ok").alias(_mask(mask)))
            table = ds.tables[i]
            ds = ds.put(i, replace(table, frame=table.frame.drop(_mask(mask)).join(flags, ["rec", "wave_no"], "left"), masks=tuple(dict.fromkeys((*table.masks, mask)))))

    def size(v: str) -> Column:
        """A valid cycle's length."""
        valid = F.col(v).isNotNull() & (F.col("ok") == 1)
        return F.when(valid & ~F.exists(v, F.isnan) & ~F.isnan("w") if form == "mean" else valid, F.size(v))

    forms = {
        "mean": lambda x, n: F.try_divide(F.sum(F.col("w") * x), F.sum(F.when(n.isNotNull(), F.col("w")))),
        "variance": lambda x, n: F.var_pop(x),
        "std": lambda x, n: F.stddev_pop(x),
        "min": lambda x, n: F.min(x),
        "max": lambda x, n: F.max(x),
        "difference": lambda x, n: F.max(x) - F.min(x),
        "median": lambda x, n: F.percentile(x, F.lit(0.5)),
        "mode": lambda x, n: F.mode(x, True),
    }
    if form not in forms:
        raise PipelineError(f"unknown aggregate {form!r}")
    rows = rows.withColumns({f"n{k}": size(f"v{k}") for k in each})
    lists = rows.select("rec", "frequency", "w", *[f"n{k}" for k in each], *[F.col(f"v{k}").isNotNull().alias(f"any{k}") for k in each], *[F.when(F.col(f"n{k}").isNotNull(), F.col(f"v{k}")).otherwise(_none()).alias(f"v{k}") for k in each])
    at = lists.select("rec", "frequency", "w", *[f"{c}{k}" for c in ("n", "any") for k in each], F.posexplode_outer(F.arrays_zip(*[f"v{k}" for k in each])).alias("pos", "x"))
    x = [F.when(~F.isnan(F.col(f"x.v{k}")), F.col(f"x.v{k}")) for k in each]
    found = {f"y{k}": F.coalesce(forms[form](x[k], F.col(f"n{k}")), F.lit(C.NAN)) for k in each}
    lengths = [c for k in each for c in (F.min(f"n{k}").alias(f"a{k}"), F.max(f"n{k}").alias(f"b{k}"), F.max(f"any{k}").alias(f"any{k}"))]
    made = at.groupBy("rec", "pos").agg(F.first("frequency").alias("frequency"), *lengths, *[y.alias(c) for c, y in found.items()])
    lengths = [c for k in each for c in (F.min(f"a{k}").alias(f"a{k}"), F.max(f"b{k}").alias(f"b{k}"), F.max(f"any{k}").alias(f"any{k}"))]
    done = made.groupBy("rec").agg(F.first("frequency").alias("frequency"), *lengths, F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", *found)))).alias("at"))
    unequal = F.raise_error(F.concat(F.lit("cycles of unequal length in recording "), F.col("rec").cast("string"))).cast("int")
    done = done.withColumns({f"n{k}": F.when(F.col(f"a{k}") != F.col(f"b{k}"), unequal).otherwise(F.coalesce(f"b{k}", F.lit(0))) for k in each})

    def result(k: int) -> Column:
        n = F.least(F.col(f"n{k}"), F.lit(1)) if form == "mode" else F.col(f"n{k}")
        return F.when(F.col(f"any{k}"), F.when(n > 0, F.transform(F.slice("at", F.lit(1), n), lambda s: s[f"y{k}"])).otherwise(F.array(F.lit(C.NAN))))

    outs = tuple(dict.fromkeys(o for _, o in channels))
    table = done.select("rec", F.lit(0).alias("wave_no"), "frequency", *[result(k).alias(_column(o)) for k, (_, o) in enumerate(channels)])
    return ds.add_table(Table(table, outs))


# kernels over cycles


def interpolated(ds: Dataset, channel: str, length: int | None = None, frequency: float | None = None, out: str | None = None, rates: DataFrame | None = None) -> Dataset:
    """Every cycle on a new number of points by a monotone cubic. rates: (filename, rate) to go by instead of one frequency; others keep their own."""
    if not length and not frequency and rates is None:
        raise PipelineError("interpolate needs a length or a frequency")

    def kernel(v: np.ndarray, row: dict) -> list:
        to = row.get("_rate", frequency)
        n = int((len(v) - 1) / row["frequency"] * to) + 1 if to else int(length)
        return kernels.resample_cycle(v, n).tolist()

    side = None if rates is None else ds.recordings().join(rates, "filename", "left").select("rec", F.coalesce("rate", "frequency").alias("_rate"))
    return _by_kernel(ds, channel, out or channel, kernel, side)


def shaped(ds: Dataset, channel: str, features: list[str], mask: str = "", prominence_level: float = 0.05, out: str | None = None, flats: bool = True) -> Dataset:
    """Shape features of every cycle, one vector each, in the order of `features`. flats: a plateau counts as a peak or valley, at its middle."""
    features = [f.upper() for f in features]
    if unknown := [f for f in features if f not in kernels.SHAPE_WIDTHS]:
        raise PipelineError(f"unknown features {unknown}")
    ds, i = ds.together([channel], [mask] if mask else [])
    ok = _mask(mask) if mask and mask in ds.tables[i].masks else None

    def kernel(v: np.ndarray, row: dict) -> list:
        return kernels.shape(v, row["frequency"], ok is None or row[ok] != 0, features, prominence_level, flats)

    return _by_kernel(ds, channel, out or channel, kernel)


def _by_kernel(ds: Dataset, channel: str, out: str, kernel, side: DataFrame | None = None) -> Dataset:
    i = ds.table_of(channel)
    table = ds.tables[i]
    frame = table.frame.withColumn("_v", ds.values(channel))
    slim = frame.select("rec", "wave_no", "frequency", *[_mask(m) for m in table.masks], "_v")
    if side is not None:
        slim = slim.join(side, "rec", "left")
    done = slim.mapInPandas(per_batch(kernel), slim.schema).drop("_rate")
    return ds.add_table(Table(done.withColumnRenamed("_v", _column(out)), (out,), ()))


def expanded(ds: Dataset, channel: str, weights: str = "", mask: str = "", method: str = "FLAT", out: str | None = None) -> Dataset:
    """A sample channel that holds every cycle's value for weight seconds; invalid cycles hold 0, and the last value fills up to the recording's end.

    Cycles that together hold longer than their recording are an error when it runs.
    """
    out = out or channel
    if not ds.has(channel):
        return ds
    names = [channel, *([weights] if weights and ds.has(weights) else [])]
    ds, i = ds.together(names, [mask] if mask else [])
    weight = F.element_at(ds.values(weights), 1) if len(names) > 1 else F.lit(1.0)
    held = F.when(ds.ok(i, mask) == 1, F.element_at(ds.values(channel), 1)).otherwise(F.lit(0.0))
    spans = ds.tables[i].frame.filter(ds.values(channel).isNotNull()).select("rec", "wave_no", held.alias("y"), (weight * F.col("frequency")).cast("long").alias("n"))
    spans = spans.withColumn("end", F.sum("n").over(by_wave().rowsBetween(Window.unboundedPreceding, 0))).filter("n > 0")
    lengths = ds.samples.groupBy("rec").agg(F.count(F.lit(1)).alias("_size"))
    longer = F.raise_error(F.concat(F.lit("cycles hold longer than recording "), F.col("rec").cast("string"), F.lit(", to sample "), F.col("end").cast("string"))).cast("long")
    spans = spans.join(lengths, "rec").withColumn("n", F.when(F.col("end") > F.col("_size"), longer).otherwise(F.col("n")))
    if method.upper() == "FLAT":
        known = spans.select("rec", "y", (F.col("end") - F.col("n")).alias("idx"))  # what follows a start is filled from it
    else:
        kind = ds.samples.schema["rec"].dataType.simpleString()

        def work(frame):
            frame = frame.sort_values("idx")
            return frame.assign(y=kernels.smooth(frame["y"].to_numpy(float), method.upper()))[["rec", "y", "idx"]]

        every = spans.select("rec", "y", F.explode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1)).alias("idx"))
        known = every.groupBy("rec").applyInPandas(work, f"rec {kind}, y double, idx long")
    joined = ds.samples.join(known.withColumnRenamed("y", "_held"), ["rec", "idx"], "left")
    filled = chunks.joined_up(joined, ["_held"], before=0, after=0).filter("_own").withColumn(out, F.coalesce("_held", F.lit(0.0)))
    return ds.with_samples(filled.select(*[quoted(c) for c in dict.fromkeys([*ds.samples.columns, out])]), out)


def marker_intervals(ds: Dataset, first: str, second: str, out: str) -> Dataset:
    """Seconds between two kinds of markers, as cycles of one value."""
    from ondula.operators.samples import intervals

    found = intervals(ds, first, second)
    rate = ds.samples.groupBy("rec").agg(F.first("frequency").alias("frequency"))
    return ds.add_table(Table(found.join(rate, "rec").select("rec", "wave_no", "frequency", F.col("values").alias(_column(out))), (out,)))
