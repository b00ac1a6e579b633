"""Column expressions over one cycle, an array of doubles. NaN follows IEEE comparison rules, as named in each function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    return F.try_divide(total(values), F.size(values))


def median(values: Column) -> Column:
    """Mean of the middle two; null for an empty cycle."""
    s, n = F.array_sort(values), F.size(values)
    return F.when(n > 0, (F.element_at(s, F.greatest(F.lit(1), F.floor((n + 1) / 2)).cast("int")) + F.element_at(s, F.greatest(F.lit(1), F.floor(n / 2) + 1).cast("int"))) / 2)


def first_mode(values: Column) -> Column:
    """The most common value, the first met of equals."""
    kinds = F.array_distinct(values)
    counted = F.transform(kinds, lambda v: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), (-F.array_position(values, v)).alias("p"), v.alias("v")))
    return F.when(F.size(values) > 0, F.array_max(counted)["v"])


def without_nan(values: Column) -> Column:
    return F.filter(values, lambda x: ~F.isnan(x))


def longest_flat(values: Column, step: float = 0.1) -> Column:
    """The most samples in a row that each differ from the one before by `step` at most; 0 for an empty cycle."""
    start = F.struct(F.lit(None).cast("double").alias("before"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def follow(a: Column, x: Column) -> Column:
        run = F.when(F.abs(x - a["before"]) <= step, a["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("before"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(values, start, follow, lambda a: a["best"]).cast("double")


def measure(values: Column, form: str, frequency: Column) -> Column:
    """One number of a cycle; 0 for an empty cycle."""
    n = F.size(values)
    forms = {
        "mean": lambda: mean(values),
        "median": lambda: median(values),
        "mode": lambda: first_mode(values),
        "min": lambda: F.array_min(values),
        "max": lambda: F.array_max(values),
        "period": lambda: n / frequency,
        "amplitude": lambda: F.array_max(values) - F.array_min(values),
        "frequency": lambda: F.try_divide(frequency, n),
        "delta": lambda: F.try_element_at(values, F.lit(-1)) - F.try_element_at(values, F.lit(1)),
    }
    if form not in forms:
        raise ValueError(f"unknown measurement {form!r}")
    return F.when(n > 0, forms[form]().cast("double")).otherwise(F.lit(0.0))


def statistic(values: Column, name: str) -> Column:
    """A number to check a cycle by; NaN is skipped, null means that there is none."""
    clean = without_nan(values)
    forms = {
        "MAX": lambda: F.array_max(clean),
        "MIN": lambda: F.array_min(clean),
        "MEAN": lambda: F.coalesce(mean(clean), F.lit(NAN)),
        "MEDIAN": lambda: F.coalesce(median(clean), F.lit(NAN)),
        "START": lambda: F.try_element_at(values, F.lit(1)),
        "END": lambda: F.try_element_at(values, F.lit(-1)),
        "AMP": lambda: F.array_max(clean) - F.array_min(clean),
        "FLAT": lambda: longest_flat(values),
    }
    if name not in forms:
        raise ValueError(f"unknown statistic {name!r}")
    return forms[name]()


def compares(value: Column, operator: str, bound: Column) -> Column:
    """A comparison in which NaN differs from everything and null fails."""
    forms = {">": value > bound, "<": value < bound, ">=": value >= bound, "<=": value <= bound, "==": value == bound, "!=": value != bound}
    if operator not in forms:
        raise ValueError(f"unknown comparison {operator!r}")
    odd = F.isnan(value) | F.isnan(bound)
    return F.coalesce(F.when(odd, F.lit(operator == "!=")).otherwise(forms[operator]), F.lit(False))


def calculate(x: Column, operator: str, y: Column) -> Column:
    """Arithmetic in which division by zero gives NaN."""
    forms = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.when(y == 0, F.lit(NAN)).otherwise(F.try_divide(x, y)), "^": lambda: F.pow(x, y)}
    if operator not in forms:
        raise ValueError(f"unknown operation {operator!r}")
    return forms[operator]()


def zipped(left: Column, right: Column, operator: str) -> Column:
    """Elementwise over the shorter of two cycles."""
    n = F.least(F.size(left), F.size(right))
    return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(1), n), lambda x, y: calculate(x, operator, y))


def rescaled(values: Column, height: float, shift: float) -> Column:
    """To the range shift .. shift + height; a constant cycle stays."""
    low, high = F.array_min(values), F.array_max(values)
    return F.when((F.size(values) > 0) & (high != low), F.transform(values, lambda x: F.lit(float(height)) * (x - low) / (high - low) + F.lit(float(shift)))).otherwise(values)


def part(values: Column, start: float, end: float) -> Column:
    n = F.size(values)
    a, b = (n * F.lit(float(start))).cast("int"), (n * F.lit(float(end))).cast("int")
    return F.slice(values, a + 1, F.greatest(b - a, F.lit(0)))
