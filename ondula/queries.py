"""One query per step over the driver's tables, and the SQL that gives the same rows.

events is read as recordings: one per user, VALUE its channel, event types its comments and markers, ten samples a second; cycles start at purchases.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ondula.dataset import Dataset, quoted
from ondula.functions import carried, kernels
from ondula.operators import cycles as cyc
from ondula.operators import samples as smp
from ondula.plans.pipeline import run
from ondula.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

S = "s AS (SELECT user_id AS rec, value AS x, upper(event_type) AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
W = S + ", w AS (SELECT rec, idx, x, CAST(sum(CASE WHEN c = 'PURCHASE' THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY idx ROWS UNBOUNDED PRECEDING) AS INT) AS wave_no FROM s)"
C = W + ", c0 AS (SELECT rec, wave_no, list(x ORDER BY idx) AS v FROM w GROUP BY rec, wave_no UNION ALL SELECT rec, 0, [] FROM w GROUP BY rec HAVING min(wave_no) > 0)"
GOOD = C + ", k AS (SELECT rec, wave_no, v, CASE WHEN len(v) > 0 AND list_max(v) > 60 THEN 1 ELSE 0 END AS ok FROM c0)"


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Dataset], DataFrame]], None]:
    """Registers a function of the events dataset."""

    def put(make: Callable[[Dataset], DataFrame]) -> None:
        QUERIES[name] = lambda spark, sf_dir: make(readers.from_events(spark.read.parquet(f"{sf_dir}/events.parquet")))
        if sql:
            SQL[name] = sql

    return put


def near(column: Column | str, places: int = 6) -> Column:
    """Rounded, with NaN as null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(F.when(~F.isnan(c), c), places)


def cut_up(ds: Dataset) -> Dataset:
    return cyc.partition(ds, ["VALUE"], "PURCHASE", ["V"])


def scalar(ds: Dataset, channel: str) -> DataFrame:
    return ds.cycles(channel).select("rec", "wave_no", near(F.element_at("values", 1)).alias("y"))


def listed(ds: Dataset, channel: str) -> DataFrame:
    """One row per cycle that tells its values: their number, sum and places."""
    weighted = F.aggregate(F.zip_with("values", F.sequence(F.lit(1), F.greatest(F.size("values"), F.lit(1))), lambda x, i: F.coalesce(x, F.lit(0.0)) * i), F.lit(0.0), lambda a, x: a + x)
    return ds.cycles(channel).select("rec", "wave_no", F.size("values").cast("long").alias("n"), near(F.aggregate("values", F.lit(0.0), lambda a, x: a + x)).alias("total"), near(weighted).alias("moment"))


def listed_sql(source: str) -> str:
    """The same of (rec, wave_no, v)."""
    return f"SELECT rec, wave_no, CAST(len(v) AS BIGINT) AS n, round(coalesce(list_sum(v), 0), 6) AS total, round(coalesce(list_sum(list_transform(v, lambda x, i: x * i)), 0), 6) AS moment FROM {source}"


def sampled(ds: Dataset, channel: str) -> DataFrame:
    return ds.samples.select("rec", "idx", near(quoted(channel)).alias("y"))


# flagship: the period-weighted mean of cycle means


@query("weighted_cycle_mean", f"WITH {C}, m AS (SELECT rec, coalesce(list_avg(v), 0) AS y, len(v) / CAST(10 AS DOUBLE) AS p FROM c0) SELECT rec, round(sum(y * p) / sum(p), 6) AS y, CAST(count(*) AS BIGINT) AS n_cycles FROM m GROUP BY rec")
def _(ds: Dataset) -> DataFrame:
    ds = cyc.measured(cut_up(ds), "V", "mean", "M")
    ds = cyc.measured(ds, "V", "period", "P")
    n = ds.cycles("M").groupBy("rec").agg(F.count(F.lit(1)).alias("n_cycles"))
    made = cyc.aggregated(ds, "M", "mean", weights="P", out="A")
    return scalar(made, "A").drop("wave_no").join(n, "rec")


# partition, measurement, arithmetic

query("partition_waves", f"WITH {C} {listed_sql('c0')}")(lambda ds: listed(cut_up(ds), "V"))
query("partition_trim", f"WITH {C}, t AS (SELECT rec, CAST(wave_no - 1 AS INT) AS wave_no, v FROM (SELECT *, max(wave_no) OVER (PARTITION BY rec) AS last FROM c0) WHERE wave_no > 0 AND wave_no < last) {listed_sql('t')}")(
    lambda ds: listed(cyc.partition(ds, ["VALUE"], "PURCHASE", ["V"], del_first=True, del_last=True), "V")
)
MEASURES = {
    "mean": "list_avg(v)", "median": "list_median(v)", "min": "list_min(v)", "max": "list_max(v)", "period": "len(v) / 10.0", "amplitude": "list_max(v) - list_min(v)", "frequency": "10.0 / len(v)", "delta": "v[-1] - v[1]",
    "mode": "list_sort(list_transform(list_distinct(v), lambda a: {'n': -len(list_filter(v, lambda b: b = a)), 'p': list_position(v, a), 'a': a}))[1].a",
}
for form, body in MEASURES.items():
    query(f"measure_{form}", f"WITH {C} SELECT rec, wave_no, CASE WHEN len(v) = 0 THEN 0 ELSE round({body}, 6) END AS y FROM c0")(lambda ds, form=form: scalar(cyc.measured(cut_up(ds), "V", form, "M"), "M"))
for name, op, body in (("add", "+", "x + 3"), ("subtract", "-", "x - 3"), ("multiply", "*", "x * 3"), ("divide", "/", "x / 3"), ("power", "^", "x ** 3")):
    query(f"arith_const_{name}", f"WITH {C}, t AS (SELECT rec, wave_no, list_transform(v, lambda x: {body}) AS v FROM c0) {listed_sql('t')}")(lambda ds, op=op: listed(cyc.arithmetic(cut_up(ds), "V", op, num=3, out="A"), "A"))
query("arith_zero_division", f"WITH {C} SELECT rec, wave_no, CAST(len(v) AS BIGINT) AS n_nan FROM c0")(
    lambda ds: cyc.arithmetic(cut_up(ds), "V", "/", num=0, out="A").cycles("A").select("rec", "wave_no", F.size(F.filter("values", F.isnan)).cast("long").alias("n_nan"))
)
query("arith_reciprocal", f"WITH {C}, t AS (SELECT rec, wave_no, list_transform(v, lambda x: CASE WHEN x = 0 THEN 0 ELSE 1 / x END) AS v FROM c0) {listed_sql('t')}")(lambda ds: listed(cyc.arithmetic(cut_up(ds), "V", "-1", out="A"), "A"))
for name, op in (("add", "+"), ("subtract", "-"), ("multiply", "*"), ("divide", "/")):
    query(f"arith_channels_{name}", f"WITH {C} SELECT rec, wave_no, CASE WHEN len(v) = 0 THEN {'NULL' if op == '/' else '0'} ELSE round((list_max(v) - list_min(v)) {op} list_avg(v), 6) END AS y FROM c0")(
        lambda ds, op=op: scalar(cyc.arithmetic(cyc.measured(cyc.measured(cut_up(ds), "V", "amplitude", "A"), "V", "mean", "M"), "A", op, "M", out="R"), "R")
    )
query("normalize_wave", f"WITH {C}, t AS (SELECT rec, wave_no, CASE WHEN list_max(v) <> list_min(v) THEN list_transform(v, lambda x: 2 * (x - list_min(v)) / (list_max(v) - list_min(v)) + 1) ELSE v END AS v FROM c0) {listed_sql('t')}")(lambda ds: listed(cyc.normalized(cut_up(ds), "V", 2, 1, "N"), "N"))
query("slice_wave", f"WITH {C}, t AS (SELECT rec, wave_no, v[CAST(floor(len(v) * CAST(0.25 AS DOUBLE)) AS BIGINT) + 1 : CAST(floor(len(v) * CAST(0.75 AS DOUBLE)) AS BIGINT)] AS v FROM c0) {listed_sql('t')}")(lambda ds: listed(cyc.sliced(cut_up(ds), "V", 0.25, 0.75, "P"), "P"))

# masks and selection


def masked(ds: Dataset, *args, **named) -> DataFrame:
    return cyc.check(cut_up(ds), "V", *args, mask="OK", **named).mask("OK").select("rec", "wave_no", F.col("ok").cast("int").alias("ok"))


def mask_sql(condition: str) -> str:
    return f"WITH {C} SELECT rec, wave_no, CASE WHEN len(v) > 0 AND ({condition}) THEN 1 ELSE 0 END AS ok FROM c0"


STATS = {"MAX": "list_max(v)", "MIN": "list_min(v)", "MEAN": "list_avg(v)", "MEDIAN": "list_median(v)", "START": "v[1]", "END": "v[-1]", "AMP": "list_max(v) - list_min(v)"}
BOUNDS = {"MAX": 60, "MIN": 20, "MEAN": 40, "MEDIAN": 40, "START": 40, "END": 40, "AMP": 50}
for stat, body in STATS.items():
    query(f"check_{stat.lower()}_y", mask_sql(f"{body} > {BOUNDS[stat]}"))(lambda ds, stat=stat: masked(ds, stat, ">", BOUNDS[stat]))
for stat, body in {"MAX": "list_position(v, list_max(v)) - 1", "MIN": "list_position(v, list_min(v)) - 1", "START": "0", "END": "len(v)"}.items():
    query(f"check_{stat.lower()}_x", mask_sql(f"{body} <= 2"))(lambda ds, stat=stat: masked(ds, stat, "<=", 2, form="X"))
query("check_max_pct", mask_sql("(list_position(v, list_max(v)) - 1) / CAST(len(v) AS DOUBLE) < 0.5"))(lambda ds: masked(ds, "MAX", "%X<", 0.5, form="X"))
query("check_end_time", mask_sql("len(v) >= 4"))(lambda ds: masked(ds, "END", ">=", time="400ms", form="X"))
query(
    "check_flat",
    f"WITH {W}, d AS (SELECT *, CASE WHEN abs(x - lag(x) OVER (PARTITION BY rec, wave_no ORDER BY idx)) <= 0.1 THEN 0 ELSE 1 END AS b FROM w), r AS (SELECT rec, wave_no, sum(b) OVER (PARTITION BY rec, wave_no ORDER BY idx) AS g FROM d), "
    "f AS (SELECT rec, wave_no, max(k) AS flat FROM (SELECT rec, wave_no, g, count(*) AS k FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2), a AS (SELECT rec, wave_no, flat FROM f UNION ALL SELECT rec, 0, 0 FROM w GROUP BY rec HAVING min(wave_no) > 0) SELECT rec, wave_no, CASE WHEN flat < 2 THEN 1 ELSE 0 END AS ok FROM a",
)(lambda ds: masked(ds, "FLAT", "<", 2))
query("check_accumulates", mask_sql("list_max(v) > 60 AND list_min(v) < 30"))(
    lambda ds: cyc.check(cyc.check(cut_up(ds), "V", "MAX", ">", 60, mask="OK"), "V", "MIN", "<", 30, mask="OK").mask("OK")
)


def two_masks(ds: Dataset) -> Dataset:
    return cyc.check(cyc.check(cut_up(ds), "V", "MAX", ">", 60, mask="A"), "V", "MIN", "<", 30, mask="B")


for form, body in {"AND": "a AND b", "OR": "a OR b", "NAND": "NOT (a AND b)", "NOR": "NOT (a OR b)", "XOR": "a <> b", "XNOR": "a = b"}.items():
    query(f"merge_{form.lower()}", f"WITH {C}, m AS (SELECT rec, wave_no, coalesce(list_max(v) > 60, false) AS a, coalesce(list_min(v) < 30, false) AS b FROM c0) SELECT rec, wave_no, CASE WHEN {body} THEN 1 ELSE 0 END AS ok FROM m")(
        lambda ds, form=form: cyc.merged(two_masks(ds), "A", "B", form, "R").mask("R")
    )
for form, sign in (("GREATER", ">"), ("LESSER", "<")):
    query(
        f"merge_{form.lower()}",
        f"WITH {C}, z AS (SELECT rec, idx, x, CAST(sum(CASE WHEN c = 'SIGNUP' THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY idx ROWS UNBOUNDED PRECEDING) AS INT) AS wave_no FROM s), d0 AS (SELECT rec, wave_no, list(x ORDER BY idx) AS v FROM z GROUP BY rec, wave_no UNION ALL SELECT rec, 0, [] FROM z GROUP BY rec HAVING min(wave_no) > 0), "
        f"k AS (SELECT a.rec, a.n {sign} b.n AS first FROM (SELECT rec, count(*) AS n FROM c0 GROUP BY 1) a JOIN (SELECT rec, count(*) AS n FROM d0 GROUP BY 1) b ON a.rec = b.rec), t AS (SELECT c0.* FROM c0 JOIN k USING (rec) WHERE first UNION ALL SELECT d0.* FROM d0 JOIN k USING (rec) WHERE NOT first) {listed_sql('t')}",
    )(lambda ds, form=form: listed(cyc.merged(cyc.partition(cut_up(ds), ["VALUE"], "SIGNUP", ["Z"]), "V", "Z", form, "R"), "R"))


def take_sql(order: str, consecutive: bool, size: str, target: int, minimum: bool = True, maximum: bool = False) -> str:
    run = f"sum(1 - ok) OVER (PARTITION BY rec ORDER BY wave_no {order} ROWS UNBOUNDED PRECEDING)" if consecutive else "0"
    hit = "NULL" if maximum else f"min(CASE WHEN length >= {target} THEN run END) OVER (PARTITION BY rec)"
    return (
        f"WITH {GOOD}, r AS (SELECT *, {run} AS run, {size} AS size FROM k), g AS (SELECT *, sum(size) OVER (PARTITION BY rec, run ORDER BY wave_no {order} ROWS UNBOUNDED PRECEDING) AS reached FROM r WHERE ok = 1), "
        f"q AS (SELECT rec, run, max(reached) AS length FROM g GROUP BY 1, 2), h AS (SELECT *, {hit} AS hit, max(CASE WHEN length >= {target} THEN 1 ELSE 0 END) OVER (PARTITION BY rec) AS reach_any, row_number() OVER (PARTITION BY rec ORDER BY length DESC, run) AS best FROM q), "
        f"p AS (SELECT rec, run, hit IS NOT NULL AS stops FROM h WHERE length > 0 AND (run = hit OR hit IS NULL AND best = 1 AND (reach_any = 1 OR {not minimum}))), "
        f"t AS (SELECT rec, CAST(row_number() OVER (PARTITION BY rec ORDER BY wave_no) - 1 AS INT) AS wave_no, v FROM g JOIN p USING (rec, run) WHERE NOT stops OR reached - size < {target}) {listed_sql('t')}"
    )


def taken(ds: Dataset, **named) -> DataFrame:
    return listed(cyc.take(cyc.check(cut_up(ds), "V", "MAX", ">", 60, mask="OK"), "V", mask="OK", out="T", **named), "T")


for name, order, direction in (("fwd", "", "+"), ("bwd", "DESC", "-")):
    for suffix, consecutive in (("", False), ("_consec", True)):
        query(f"take_n_{name}{suffix}", take_sql(order, consecutive, "1", 3))(lambda ds, d=direction, c=consecutive: taken(ds, waves=3, consecutive=c, direction=d))
        query(f"take_time_{name}{suffix}", take_sql(order, consecutive, "len(v)", 20))(lambda ds, d=direction, c=consecutive: taken(ds, time="2s", consecutive=c, direction=d))
query("take_longest", take_sql("", True, "1", 3, minimum=False, maximum=True))(lambda ds: taken(ds, waves=3, consecutive=True, minimum=False, maximum=True))
query("priority_channel", f"WITH {GOOD}, a AS (SELECT rec, wave_no, v FROM k WHERE ok = 1 QUALIFY count(*) OVER (PARTITION BY rec) >= 8 AND row_number() OVER (PARTITION BY rec ORDER BY wave_no) <= 8), t AS (SELECT rec, CAST(row_number() OVER (PARTITION BY rec ORDER BY wave_no) - 1 AS INT) AS wave_no, v FROM a UNION ALL SELECT rec, wave_no, v FROM c0 WHERE rec NOT IN (SELECT rec FROM a)) {listed_sql('t')}")(
    lambda ds: listed(cyc.priority(cyc.take(cyc.check(cut_up(ds), "V", "MAX", ">", 60, mask="OK"), "V", mask="OK", waves=8, consecutive=False, out="T"), ["T", "V"], "R"), "R")
)

# aggregation

AGGREGATES = {"mean": "avg(y)", "variance": "var_pop(y)", "std": "stddev_pop(y)", "min": "min(y)", "max": "max(y)", "difference": "max(y) - min(y)", "median": "median(y)"}
MEANS = GOOD + ", m AS (SELECT rec, wave_no, coalesce(list_avg(v), 0) AS y, len(v) AS n, ok FROM k)"


def means(ds: Dataset) -> Dataset:
    return cyc.measured(cyc.check(cut_up(ds), "V", "MAX", ">", 60, mask="OK"), "V", "mean", "M")


for form, body in AGGREGATES.items():
    query(f"agg_{form}", f"WITH {MEANS} SELECT rec, round({body.replace('(y)', '(y) FILTER (ok = 1)')}, 6) AS y FROM m GROUP BY rec")(lambda ds, form=form: scalar(cyc.aggregated(means(ds), "M", form, mask="OK", out="A"), "A").drop("wave_no"))
query("agg_mode", f"WITH {C}, z AS (SELECT rec, len(v) / 10.0 AS y, count(*) AS k FROM c0 GROUP BY 1, 2) SELECT rec, round(arg_min(y, (-k, y)), 6) AS y FROM z GROUP BY rec")(lambda ds: scalar(cyc.aggregated(cyc.measured(cut_up(ds), "V", "period", "P"), "P", "mode", out="A"), "A").drop("wave_no"))
OUT = {
    "z_transform": "coalesce(abs((y - avg(y) OVER p) / nullif(stddev_pop(y) OVER p, 0)) > 1.5, false)",
    "iqr": "y < quantile_cont(y, 0.25) OVER p - 0.5 * (quantile_cont(y, 0.75) OVER p - quantile_cont(y, 0.25) OVER p) OR y > quantile_cont(y, 0.75) OVER p + 0.5 * (quantile_cont(y, 0.75) OVER p - quantile_cont(y, 0.25) OVER p)",
}
for method, body in OUT.items():
    query(f"agg_outlier_{method}", f"WITH {MEANS}, o AS (SELECT *, {body} AS out FROM m WINDOW p AS (PARTITION BY rec)) SELECT rec, round(avg(y) FILTER (ok = 1 AND NOT out), 6) AS y FROM o GROUP BY rec")(
        lambda ds, method=method: scalar(cyc.aggregated(means(ds), "M", "mean", mask="OK", outlier=method, outlier_num={"z_transform": 1.5, "iqr": 0.5}[method], out="A"), "A").drop("wave_no")
    )
query(
    "agg_outlier_mad",
    f"WITH {MEANS}, d AS (SELECT *, abs(y - median(y) OVER (PARTITION BY rec)) AS d FROM m), o AS (SELECT *, median(d) OVER (PARTITION BY rec) AS mad FROM d) SELECT rec, round(avg(y) FILTER (ok = 1 AND NOT (CASE WHEN mad = 0 THEN d > 0 ELSE 0.6745 * d / mad > 1.5 END)), 6) AS y FROM o GROUP BY rec",
)(lambda ds: scalar(cyc.aggregated(means(ds), "M", "mean", mask="OK", outlier="mad", outlier_num=1.5, out="A"), "A").drop("wave_no"))

# samples

query("filter_derivative", f"WITH {S} SELECT rec, idx, round(CASE WHEN idx = 0 THEN lead(x) OVER o - x WHEN idx = n - 1 THEN x - lag(x) OVER o ELSE (lead(x) OVER o - lag(x) OVER o) / 2 END, 6) AS y FROM s WINDOW o AS (PARTITION BY rec ORDER BY idx)")(lambda ds: sampled(smp.filtered(ds, "derivative", "VALUE", "D"), "D"))
query("filter_average", f"WITH {S} SELECT rec, idx, round(sum(x) OVER (PARTITION BY rec ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS y FROM s")(lambda ds: sampled(smp.filtered(ds, "average", "VALUE", "A", time="500ms"), "A"))
query(
    "filter_sliding_standard",
    f"WITH {S}, e AS (SELECT rec, n, idx, x FROM s UNION ALL SELECT rec, n, -idx, x FROM s WHERE idx BETWEEN 1 AND 3 UNION ALL SELECT rec, n, 2 * (n - 1) - idx, x FROM s WHERE idx BETWEEN n - 4 AND n - 2), "
    "m AS (SELECT rec, n, idx, x, avg(x) OVER f AS a, avg(x * x) OVER f AS q FROM e WINDOW f AS (PARTITION BY rec ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING)) SELECT rec, idx, round((x - a) / sqrt(greatest(q - a * a, 1e-10)), 6) AS y FROM m WHERE idx BETWEEN 0 AND n - 1",
)(lambda ds: sampled(smp.filtered(ds, "sliding_standard", "VALUE", "A", time="600ms"), "A"))
KALMAN = (
    f"WITH RECURSIVE {S}, k AS (SELECT rec, CAST(-1 AS BIGINT) AS idx, x AS pos, CAST(0 AS DOUBLE) AS speed, CAST(1000 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(1000 AS DOUBLE) AS d FROM s WHERE idx = 0 UNION ALL "
    "SELECT rec, idx, guess + k0 * (x - guess), speed + k1 * (x - guess), (1 - k0) * a, (1 - k0) * b, d - k1 * b FROM (SELECT *, a / (a + CAST(0.1 AS DOUBLE)) AS k0, b / (a + CAST(0.1 AS DOUBLE)) AS k1 FROM "
    "(SELECT s.rec, s.idx, s.x, k.pos + k.speed AS guess, k.speed, k.a + 2 * k.b + k.d + CAST(0.025 AS DOUBLE) AS a, k.b + k.d + CAST(0.05 AS DOUBLE) AS b, k.d + CAST(0.1 AS DOUBLE) AS d FROM k JOIN s ON s.rec = k.rec AND s.idx = k.idx + 1))) "
    "SELECT rec, idx, round(pos, 6) AS y FROM k WHERE idx >= 0"
)
query("filter_kalman", KALMAN)(lambda ds: sampled(smp.filtered(ds, "kalman", "VALUE", "K"), "K"))
_FITS = {0: (31, 9, -3, -5, 3), 1: (9, 13, 12, 6, -5)}  # a parabola through five samples, at its first and second
_AHEAD, _BACK = (lambda w, f=f, to=to: " + ".join(f"{c} * {f}(x, {k}) OVER o" for c, k in zip(w, to)) for f, to in (("lead", (0, 1, 2, 3, 4)), ("lag", (0, 1, 2, 3, 4))))
query("filter_savgol", f"WITH {S} SELECT rec, idx, round((CASE idx WHEN 0 THEN {_AHEAD(_FITS[0])} WHEN 1 THEN {' + '.join(f'{c} * lead(x, {k}) OVER o' for c, k in zip(_FITS[1], (-1, 0, 1, 2, 3)))} WHEN n - 1 THEN {_BACK(_FITS[0])} WHEN n - 2 THEN {' + '.join(f'{c} * lag(x, {k}) OVER o' for c, k in zip(_FITS[1], (-1, 0, 1, 2, 3)))} "
      "ELSE -3 * lag(x, 2) OVER o + 12 * lag(x) OVER o + 17 * x + 12 * lead(x) OVER o - 3 * lead(x, 2) OVER o END) / 35, 6) AS y FROM s WINDOW o AS (PARTITION BY rec ORDER BY idx)")(lambda ds: sampled(smp.filtered(ds, "savgol", "VALUE", "K", window=5, power=2), "K"))


def zero_phase_sql(b: list[float], a: list[float], steady: list[float]) -> str:
    """A filter of second order over the odd extension of s, forward (f) and back (g), sample by sample."""
    (b0, b1, b2), (_, a1, a2), (z1, z2) = ([f"CAST({v!r} AS DOUBLE)" for v in values] for values in (b, a, steady))
    pad = 9

    def once(name: str, source: str, first: str, there: str) -> str:
        y = f"({b0} * e.x + p.z1)"
        return (
            f"{name} AS (SELECT rec, n, CAST(-1 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS x, {z1} * x AS z1, {z2} * x AS z2 FROM {source} WHERE k = {first} UNION ALL "
            f"SELECT e.rec, e.n, p.k + 1, {y}, {b1} * e.x - {a1} * {y} + p.z2, {b2} * e.x - {a2} * {y} FROM {name} p JOIN {source} e ON e.rec = p.rec AND e.k = {there})"
        )

    return (
        f"h AS (SELECT rec, max(CASE WHEN idx = 0 THEN x END) AS first, max(CASE WHEN idx = n - 1 THEN x END) AS last FROM s GROUP BY rec), e0 AS (SELECT rec, n, idx + {pad} AS k, x FROM s UNION ALL SELECT rec, n, {pad} - idx, 2 * first - x FROM s JOIN h USING (rec) WHERE idx BETWEEN 1 AND {pad} "
        f"UNION ALL SELECT rec, n, {pad} + 2 * (n - 1) - idx, 2 * last - x FROM s JOIN h USING (rec) WHERE idx BETWEEN n - 1 - {pad} AND n - 2), "
        f"{once('f', 'e0', '0', 'p.k + 1')}, e1 AS (SELECT * FROM f WHERE k >= 0), {once('g', 'e1', f'n + {2 * pad - 1}', f'p.n + {2 * pad - 2} - p.k')} SELECT rec, n + {pad - 1} - k AS idx, round(x, 6) AS y FROM g WHERE k BETWEEN {pad} AND n + {pad - 1}"
    )


_B, _A = kernels.butterworth(2, 2.0, "low", 10.0)
query("filter_butterworth", f"WITH RECURSIVE {S}, {zero_phase_sql(_B.tolist(), _A.tolist(), carried.zero_phase(tuple(_B), tuple(_A)).steady.tolist())}")(lambda ds: sampled(smp.filtered(ds, "butterworth", "VALUE", "K", power=2, frequency=2, ftype="low"), "K"))


def marked(ds: Dataset, channel: str) -> DataFrame:
    return ds.samples.filter(F.array_contains("markers", channel)).select("rec", "idx")


PEAK = "x > lag(x) OVER o AND x > lead(x) OVER o"
query("peaks_plain", f"WITH {S} SELECT rec, idx FROM s WINDOW o AS (PARTITION BY rec ORDER BY idx) QUALIFY {PEAK}")(lambda ds: marked(smp.peaks(ds, "VALUE", flats=False), "VALUE"))
query("peaks_min", f"WITH {S} SELECT rec, idx FROM s WINDOW o AS (PARTITION BY rec ORDER BY idx) QUALIFY {PEAK.replace('>', '<')}")(lambda ds: marked(smp.peaks(ds, "VALUE", form="MIN", flats=False), "VALUE"))
query("peaks_height", f"WITH {S} SELECT rec, idx FROM s WINDOW o AS (PARTITION BY rec ORDER BY idx) QUALIFY {PEAK} AND x >= 50")(lambda ds: marked(smp.peaks(ds, "VALUE", height=50, flats=False), "VALUE"))
query(
    "peaks_prominence",
    f"WITH {S}, t AS (SELECT rec, idx, x FROM s WINDOW o AS (PARTITION BY rec ORDER BY idx) QUALIFY {PEAK}), b AS (SELECT t.rec, t.idx, t.x, (SELECT coalesce(max(idx), -1) FROM s WHERE s.rec = t.rec AND s.idx < t.idx AND s.x > t.x) AS l, (SELECT coalesce(min(idx), 1000000000) FROM s WHERE s.rec = t.rec AND s.idx > t.idx AND s.x > t.x) AS r FROM t), "
    "m AS (SELECT b.rec, b.idx, b.x, min(CASE WHEN s.idx <= b.idx THEN s.x END) AS a, min(CASE WHEN s.idx >= b.idx THEN s.x END) AS c FROM b JOIN s ON s.rec = b.rec AND s.idx > b.l AND s.idx < b.r GROUP BY 1, 2, 3) SELECT rec, idx FROM m WHERE x - greatest(a, c) >= 20",
)(lambda ds: marked(smp.peaks(ds, "VALUE", prominence=20, flats=False), "VALUE"))
query(
    "peaks_distance",
    f"WITH {S}, t AS (SELECT rec, idx, x FROM s WINDOW o AS (PARTITION BY rec ORDER BY idx) QUALIFY {PEAK}), "
    "h AS (SELECT rec, list_reduce(list([idx] ORDER BY x DESC, idx DESC), lambda a, b: CASE WHEN len(list_filter(a, lambda y: abs(y - b[1]) < 5)) > 0 THEN a ELSE list_concat(a, b) END) AS kept FROM t GROUP BY rec) SELECT rec, unnest(kept) AS idx FROM h",
)(lambda ds: marked(smp.peaks(ds, "VALUE", difference="500ms", flats=False), "VALUE"))
query(
    "marker_interval",
    f"WITH {S}, h AS (SELECT rec, idx, c, max(CASE WHEN c = 'SIGNUP' THEN idx END) OVER (PARTITION BY rec ORDER BY idx) AS a, max(CASE WHEN c = 'PURCHASE' THEN idx END) OVER (PARTITION BY rec ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s) "
    "SELECT rec, CAST(row_number() OVER (PARTITION BY rec ORDER BY idx) - 1 AS INT) AS wave_no, round((idx - a) / CAST(10 AS DOUBLE), 6) AS y FROM h WHERE c = 'PURCHASE' AND a IS NOT NULL AND (b IS NULL OR a > b)",
)(lambda ds: scalar(cyc.marker_intervals(ds, "SIGNUP", "PURCHASE", "T"), "T"))
_ROWS = "PARTITION BY rec ORDER BY idx ROWS BETWEEN"
_TANGENTS = (
    "e AS (SELECT rec, idx, x, coalesce(x < lag(x) OVER o AND x < lead(x) OVER o, false) AS lo, coalesce(x > lag(x) OVER o AND x > lead(x) OVER o, false) AS hi FROM s WINDOW o AS (PARTITION BY rec ORDER BY idx)), "
    f"r AS (SELECT *, max(CASE WHEN lo THEN idx END) OVER ({_ROWS} UNBOUNDED PRECEDING AND CURRENT ROW) AS low, max(CASE WHEN hi THEN idx END) OVER ({_ROWS} UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, "
    f"min(CASE WHEN hi THEN idx END) OVER ({_ROWS} CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_hi, min(CASE WHEN lo THEN idx END) OVER ({_ROWS} 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_lo FROM e), "
    "i AS (SELECT * FROM r WHERE low IS NOT NULL AND next_hi IS NOT NULL AND (top IS NULL OR top <= low) AND (next_lo IS NULL OR next_lo > next_hi)), "
    "d AS (SELECT rec, low, idx, x, CASE WHEN lag(x) OVER o IS NULL THEN lead(x) OVER o - x WHEN lead(x) OVER o IS NULL THEN x - lag(x) OVER o ELSE (lead(x) OVER o - lag(x) OVER o) / 2 END AS slope FROM i WINDOW o AS (PARTITION BY rec, low ORDER BY idx)), "
    "g AS (SELECT rec, low, arg_max(idx, (slope, -idx)) AS at_idx, arg_max(x, (slope, -idx)) AS at_x, max(slope) AS steep, min(x) AS base FROM d GROUP BY rec, low HAVING count(*) >= 3) "
    "SELECT DISTINCT rec, arg_min(idx, (abs(steep * (idx - at_idx) + at_x - base), idx)) AS idx FROM d JOIN g USING (rec, low) GROUP BY rec, low"
)
query("tangents", f"WITH {S}, {_TANGENTS}")(lambda ds: marked(smp.tangents(_feet(ds), "VALUE", "TOP", "FOOT"), "VALUE"))


def _feet(ds: Dataset) -> Dataset:
    """Copies of the channel that carry its maxima and minima as markers."""
    for name, form in (("TOP", "MAX"), ("FOOT", "MIN")):
        ds = smp.peaks(ds.with_samples(ds.samples.withColumn(name, quoted("VALUE")), name), name, form=form, height=0, flats=False)
    return ds


CUT = "SELECT rec, CAST(row_number() OVER (PARTITION BY rec ORDER BY idx) - 1 AS BIGINT) AS idx, round(x, 6) AS y FROM z"
query("cut_comment", f"WITH {S}, b AS (SELECT *, coalesce(max(CASE WHEN c = 'PURCHASE' THEN idx END) OVER (PARTITION BY rec), 0) AS a FROM (SELECT * FROM s WHERE rec IN (SELECT rec FROM s WHERE c = 'PURCHASE'))), e AS (SELECT *, coalesce(min(CASE WHEN c = 'SIGNUP' AND idx >= a THEN idx END) OVER (PARTITION BY rec), n) AS z FROM b), z AS (SELECT * FROM e WHERE idx >= a AND idx < z) {CUT}")(
    lambda ds: sampled(smp.cut_comment(_with_purchase(ds), ["purchase"], ["signup"]), "VALUE")
)
query("cut_comment_star", f"WITH {S}, b AS (SELECT *, max(CASE WHEN c = 'PURCHASE' THEN idx END) OVER (PARTITION BY rec) AS a FROM s), z AS (SELECT * FROM b WHERE idx = a) {CUT}")(lambda ds: sampled(smp.cut_comment(_with_purchase(ds), ["purchase"], ["*"]), "VALUE"))
query("cut_outside", f"WITH {S}, b AS (SELECT *, max(CASE WHEN c = 'PURCHASE' THEN idx END) OVER (PARTITION BY rec) AS a FROM s), z AS (SELECT * FROM b WHERE idx <> a AND a IS NOT NULL) {CUT}")(lambda ds: sampled(smp.cut_comment(_with_purchase(ds), ["purchase"], ["*"], boundary="outside"), "VALUE"))
query("cut_time_fwd", f"WITH {S}, z AS (SELECT * FROM s WHERE idx >= 5 AND idx < 25) {CUT}")(lambda ds: sampled(smp.cut_time(ds, "500ms", "2s"), "VALUE"))
query("cut_time_bwd", f"WITH {S}, z AS (SELECT * FROM s WHERE idx >= greatest(0, n - 25) AND idx < greatest(0, n - 5)) {CUT}")(lambda ds: sampled(smp.cut_time(ds, "500ms", "2s", "-"), "VALUE"))


def _with_purchase(ds: Dataset) -> Dataset:
    """Recordings that have the comment; for the others the cut is an error."""
    own = ds.samples.groupBy("rec").agg(F.max((F.col("comment") == "PURCHASE").cast("int")).alias("has")).filter("has = 1").select("rec")
    return ds.with_samples(ds.samples.join(own, "rec", "left_semi"))


query(
    "expand_flat",
    f"WITH {C}, g AS (SELECT rec, wave_no, coalesce(list_avg(v), 0) AS y, len(v) AS k FROM c0), e AS (SELECT rec, y, sum(k) OVER (PARTITION BY rec ORDER BY wave_no) - k AS a, k FROM g) SELECT s.rec, s.idx, round(e.y, 6) AS y FROM s JOIN e ON s.rec = e.rec AND s.idx >= e.a AND s.idx < e.a + e.k",
)(lambda ds: sampled(cyc.expanded(cyc.measured(cyc.measured(cut_up(ds), "V", "mean", "M"), "V", "period", "P"), "M", weights="P", out="E"), "E"))
def pchip_sql(source: str, places: str, keys: str) -> str:
    """Tables d (slopes at evenly spaced samples) and r (values at `places` points t, in samples). source: keys, idx, x, n; places: keys, j, t."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return (
        f"e AS (SELECT *, lead(x) OVER o - x AS s, x - lag(x) OVER o AS p, lead(x, 2) OVER o - lead(x) OVER o AS s2, lag(x) OVER o - lag(x, 2) OVER o AS p2 FROM {source} WINDOW o AS (PARTITION BY {keys} ORDER BY idx)), "
        "f AS (SELECT *, coalesce((3 * coalesce(s, p) - coalesce(CASE WHEN p IS NULL THEN s2 ELSE p2 END, coalesce(s, p))) / 2, 0) AS y, coalesce(s, p) AS q, CASE WHEN p IS NULL THEN s2 ELSE p2 END AS q2 FROM e), "
        "d AS (SELECT *, CASE WHEN p IS NULL OR s IS NULL THEN CASE WHEN q2 IS NULL THEN q WHEN sign(y) <> sign(q) THEN 0 WHEN sign(q) <> sign(q2) AND abs(y) > 3 * abs(q) THEN 3 * q ELSE y END WHEN p * s > 0 THEN 2 * p * s / (p + s) ELSE 0 END AS g FROM f), "
        f"r AS (SELECT {', '.join('b.' + k for k in keys.split(', '))}, b.j, a.x * (1 + 2 * u) * (1 - u) * (1 - u) + a.g * u * (1 - u) * (1 - u) + c.x * u * u * (3 - 2 * u) + c.g * u * u * (u - 1) AS y "
        f"FROM (SELECT *, t - i AS u FROM (SELECT *, CAST(least(floor(t), n - 2) AS BIGINT) AS i FROM {places})) b JOIN d a ON {on} AND a.idx = b.i JOIN d c ON {on.replace('a.', 'c.')} AND c.idx = b.i + 1)"
    )


query(
    "interp_wave",
    f"WITH {C}, x AS (SELECT rec, wave_no, row_number() OVER (PARTITION BY rec, wave_no ORDER BY idx) - 1 AS idx, x, count(*) OVER (PARTITION BY rec, wave_no) AS n FROM w), "
    "t AS (SELECT rec, wave_no, n, j, j * (n - 1) / CAST(11 AS DOUBLE) AS t FROM (SELECT DISTINCT rec, wave_no, n FROM x WHERE n > 1), range(0, 12) AS g(j)), "
    f"{pchip_sql('x', 't', 'rec, wave_no')}, v AS (SELECT rec, wave_no, list(y ORDER BY j) AS v FROM r GROUP BY ALL UNION ALL SELECT rec, wave_no, list_transform(range(0, 12), lambda j: j / CAST(11 AS DOUBLE)) FROM c0 WHERE len(v) < 2) {listed_sql('v')}",
)(lambda ds: listed(cyc.interpolated(cut_up(ds), "V", length=12, out="I"), "I"))
_SHARE = "((k - 1) / CAST(n - 1 AS DOUBLE))"
query(
    "interp_markers",
    f"WITH {S}, m AS (SELECT *, CAST(floor((n - 1) / CAST(10 AS DOUBLE) * 4) AS BIGINT) + 1 AS k FROM s WHERE n > 1), p AS (SELECT *, CAST(round_even(idx * {_SHARE}, 0) AS BIGINT) AS place, greatest(1, least(k, CAST(floor(n * {_SHARE}) AS BIGINT))) AS room FROM m), "
    "t AS (SELECT rec, idx, c, place, least(place, room - 1) AS said FROM p), a AS (SELECT rec, place AS idx, max_by(c, idx) AS markers FROM t GROUP BY 1, 2), b AS (SELECT rec, said AS idx, max_by(c, idx) AS comment FROM t GROUP BY 1, 2), "
    "g AS (SELECT DISTINCT rec, unnest(range(0, k)) AS idx FROM m UNION SELECT rec, 0 FROM s WHERE n = 1), o AS (SELECT rec, idx, markers, comment FROM a FULL JOIN b USING (rec, idx) UNION ALL SELECT rec, 0, c, c FROM s WHERE n = 1) SELECT rec, idx, coalesce(markers, '') AS markers, coalesce(comment, '') AS comment FROM g LEFT JOIN o USING (rec, idx)",
)(lambda ds: smp.resampled(ds, frequency=4.0).samples.select("rec", "idx", F.array_join("markers", ",").alias("markers"), "comment"))
query(
    "interp_recording",
    f"WITH {S}, m AS (SELECT rec, n, CAST(floor((n - 1) / CAST(10 AS DOUBLE) * 25) AS BIGINT) + 1 AS k FROM s WHERE idx = 0), t AS (SELECT rec, n, j, j * (n - 1) / CAST(k - 1 AS DOUBLE) AS t FROM m, LATERAL (SELECT unnest(range(0, k)) AS j)), "
    f"{pchip_sql('s', 't', 'rec')} SELECT rec, j AS idx, round(y, 6) AS y FROM r",
)(lambda ds: sampled(smp.resampled(ds, frequency=25.0), "VALUE"))


@query(
    "adjust_align",
    f"WITH {S}, f AS (SELECT rec, max(CASE WHEN c = 'PURCHASE' THEN idx END) AS anchor, max(n) AS n FROM s GROUP BY rec), g AS (SELECT s.rec, coalesce(min(CASE WHEN s.x <> z.x THEN s.idx END), 0) AS c FROM s JOIN s z ON z.rec = s.rec AND z.idx = 0 GROUP BY s.rec), "
    "p AS (SELECT f.rec, coalesce(anchor + 1, 0) - c AS start FROM f JOIN g USING (rec)) SELECT s.rec, s.idx, round(coalesce(o.x, 0), 6) AS y FROM s JOIN p USING (rec) LEFT JOIN s o ON o.rec = s.rec AND o.idx = s.idx - greatest(start, 0) + greatest(0, -start)",
)
def _(ds: Dataset) -> DataFrame:
    return sampled(smp.aligned(ds, ds, "VALUE", "VALUE", "COPY", comments=["purchase"]), "COPY")


query("save_lines", f"WITH {C} SELECT rec, CAST(wave_no AS INT) AS n, CAST(rec AS VARCHAR) || ';' || CAST(len(v) AS VARCHAR) || '.0' AS line FROM c0")(
    lambda ds: writers.text_lines(cyc.arithmetic(cyc.measured(cut_up(ds), "V", "period", "P"), "P", "*", num=10, out="P"), "{FILENAME};{P}", decimal=1)
)
_TURN = "2 * pi() * m"
query(
    "plot_data",
    f"WITH {S}, f AS (SELECT rec, n, m, sum(x * cos({_TURN} * idx / n)) AS re, -sum(x * sin({_TURN} * idx / n)) AS im FROM s, LATERAL (SELECT unnest(range(0, n // 2 + 1)) AS m) GROUP BY ALL), "
    "k AS (SELECT DISTINCT rec, n, greatest(1, CAST(floor(n / CAST(10 AS DOUBLE) * 50) AS BIGINT)) AS wide FROM s), j AS (SELECT rec, wide, unnest(range(0, wide)) AS j FROM k) "
    f"SELECT rec, 'VALUE' AS channel, round(j * (n / CAST(10 AS DOUBLE)) / wide, 6) AS t, round(sum(CASE WHEN m = 0 OR 2 * m = n THEN 1 ELSE 2 END * (re * cos({_TURN} * j / wide) - im * sin({_TURN} * j / wide))) / n, 6) AS value FROM f JOIN j USING (rec) GROUP BY rec, n, wide, j",
)(lambda ds: writers.plot_data(ds, ["VALUE"]).select("rec", "channel", near("t").alias("t"), near("value").alias("value")))

# shape

query(
    "morph_scalars",
    f"WITH {C}, x AS (SELECT rec, wave_no, row_number() OVER q - 1 AS i, count(*) OVER (PARTITION BY rec, wave_no) AS n, x, lag(x) OVER q AS a, lead(x) OVER q AS b FROM w WINDOW q AS (PARTITION BY rec, wave_no ORDER BY idx)), "
    "p AS (SELECT rec, wave_no, min(CASE WHEN x > a AND x > b THEN i END) AS top, count(CASE WHEN x > a AND x > b THEN 1 END) AS peaks FROM x GROUP BY ALL), "
    "g AS (SELECT rec, wave_no FROM x JOIN p USING (rec, wave_no) WHERE n > 3 AND peaks >= 3 AND x < a AND x < b AND i >= top GROUP BY ALL HAVING count(*) >= 2), "
    "z AS (SELECT x.*, x - avg(x) OVER w AS d, count(*) OVER (PARTITION BY rec, wave_no, x) AS same FROM x JOIN g USING (rec, wave_no) WINDOW w AS (PARTITION BY rec, wave_no)), "
    "m AS (SELECT rec, wave_no, sum(x) AS auc, sum(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE abs(b - 2 * x + a) / power(1 + (x - a) * (x - a), 1.5) END) AS vci, avg(x) AS mean, quantile_cont(x, 0.5) AS median, stddev_samp(x) AS std, var_samp(x) AS var, "
    "CASE WHEN sum(x) = 0 THEN 0 ELSE sum(i * x) / sum(x) END AS centre FROM x JOIN g USING (rec, wave_no) GROUP BY ALL), "
    "o AS (SELECT rec, wave_no, arg_min(x, (-same, i)) AS mode, avg(d * d * d) / power(avg(d * d), 1.5) AS skew, avg(d * d * d * d) / (avg(d * d) * avg(d * d)) - 3 AS kurtosis FROM z GROUP BY ALL) "
    "SELECT rec, wave_no, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("auc", "vci", "mean", "median", "mode", "std", "var", "centre", "skew", "kurtosis")) + " FROM c0 LEFT JOIN m USING (rec, wave_no) LEFT JOIN o USING (rec, wave_no)",
)(
    lambda ds: cyc.shaped(cut_up(ds), "V", ["AUC", "VCI", "STATS_Y", "STATS_X"], prominence_level=0, out="S", flats=False).cycles("S").select(
        "rec", "wave_no", *[(near(F.element_at("values", k) * 1e6, 0) / 1e6).alias(c) for k, c in enumerate(("auc", "vci", "mean", "median", "mode", "std", "var", "centre", "skew", "kurtosis"), 1)]
    )
)


def shape_columns(features: list[str]) -> list[str]:
    """A name for every value of a shape vector."""
    return [f"{f.lower()}_{k}" for f in features for k in range(kernels.SHAPE_WIDTHS[f])]


def shape_table(ds: Dataset, features: list[str], **named) -> DataFrame:
    made = cyc.shaped(cut_up(ds), "V", features, out="S", **named).cycles("S")
    return made.select("rec", "wave_no", *[near(F.element_at("values", k)).alias(c) for k, c in enumerate(shape_columns(features), 1)])


POINTS = ["X", "Y", "CURVATURE", "SLOPE", "INTEGRAL", "ANGLE"]
_POINT = {
    "X": lambda k: f"t[{k + 1}] / CAST(10 AS DOUBLE)",
    "Y": lambda k: f"v[t[{k + 1}] + 1]",
    "CURVATURE": lambda k: f"abs(v[t[{k + 2}] + 2] - 2 * v[t[{k + 2}] + 1] + v[t[{k + 2}]]) / power(1 + power(v[t[{k + 2}] + 1] - v[t[{k + 2}]], 2), 1.5)",
    "SLOPE": lambda k: f"10 * (v[t[{k + 2}] + 1] - v[t[{k + 1}] + 1]) / (t[{k + 2}] - t[{k + 1}])",
    "INTEGRAL": lambda k: f"CASE WHEN t IS NOT NULL THEN list_sum(v[t[{k + 1}] + 1 : t[{k + 2}]]) END",
    "ANGLE": lambda k: f"CASE WHEN t IS NOT NULL THEN acos(least(1, greatest(-1, (u[{k + 1}] * u[{k + 2}] + w[{k + 1}] * w[{k + 2}]) / (sqrt(u[{k + 1}] * u[{k + 1}] + w[{k + 1}] * w[{k + 1}]) * sqrt(u[{k + 2}] * u[{k + 2}] + w[{k + 2}] * w[{k + 2}]))))) END",
}
query(
    "morph_points",
    f"WITH {C}, x AS (SELECT rec, wave_no, row_number() OVER q - 1 AS i, x, lag(x) OVER q AS a, lead(x) OVER q AS b FROM w WINDOW q AS (PARTITION BY rec, wave_no ORDER BY idx)), "
    "h AS (SELECT rec, wave_no, list(i ORDER BY i) AS p FROM x WHERE x > a AND x > b GROUP BY ALL HAVING count(*) >= 3), l AS (SELECT rec, wave_no, list(i ORDER BY i) AS d FROM x JOIN h USING (rec, wave_no) WHERE x < a AND x < b AND i >= p[1] GROUP BY ALL HAVING count(*) >= 2), "
    "t AS (SELECT rec, wave_no, v, [0, p[1], d[1], p[2], d[2], p[3], len(v) - 1] AS t FROM c0 JOIN h USING (rec, wave_no) JOIN l USING (rec, wave_no) WHERE len(v) > 3), "
    "q AS (SELECT *, list_transform(range(1, 7), lambda k: t[k + 1] - t[k]) AS u, list_transform(range(1, 7), lambda k: v[t[k + 1] + 1] - v[t[k] + 1]) AS w FROM t) "
    "SELECT rec, wave_no, " + ", ".join(f"round({_POINT[f](k)}, 6) AS {f.lower()}_{k}" for f in POINTS for k in range(kernels.SHAPE_WIDTHS[f])) + " FROM c0 LEFT JOIN (SELECT rec, wave_no, t, u, w FROM q) USING (rec, wave_no)",
)(lambda ds: shape_table(ds, POINTS, prominence_level=0))
query("morphology_full")(lambda ds: shape_table(ds, ["X", "Y", "WIDTH_50", "PROMINENCE", "CURVATURE", "SLOPE", "INTEGRAL", "ANGLE", "STATS_Y", "STATS_X", "AUC", "DECAY", "VCI"]))

# macros

BEATS = (
    f"WITH {C}, b AS (SELECT rec, wave_no, len(v) / CAST(10 AS DOUBLE) AS period, CASE WHEN len(v) > 0 THEN list_min(v) ELSE 0 END AS dias, coalesce(list_avg(v), 0) AS mean, CASE WHEN len(v) > 0 THEN list_max(v) ELSE 0 END AS sys, "
    "CASE WHEN len(v) > 0 THEN list_max(v) - list_min(v) ELSE 0 END AS amp, CASE WHEN len(v) > 0 THEN CAST(600 AS DOUBLE) / len(v) ELSE 0 END AS hr FROM c0) "
)


def _mean_sql(value: str, name: str, places: int = 6) -> str:
    known = f"CASE WHEN {value} IS NOT NULL THEN period END"
    return f"round(sum(period * ({value})) / nullif(sum({known}), 0), {places}) AS {name}"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} <> 0 THEN {a} / {b} END"


def finals(ds: Dataset, places: int = 6, **channels: str) -> DataFrame:
    """One row per recording of what a macro leaves."""
    made = None
    for i in dict.fromkeys(map(ds.table_of, channels.values())):
        own = {name: ds.values(c) for name, c in channels.items() if ds.table_of(c) == i}
        one = ds.tables[i].frame.filter(reduce(and_, [v.isNotNull() for v in own.values()])).select("rec", *[near(F.element_at(v, 1), places).alias(name) for name, v in own.items()])
        made = one if made is None else made.join(one, "rec")
    return made.select("rec", *channels)


def macro(ds: Dataset, **block: object) -> Dataset:
    return run(ds.samples.sparkSession, [{"class_name": "meta", "name": "X"} | block], {"X": ds})["X"]


PULSE = {"dias": "dias", "mean": "mean", "sys": "sys", "amp": "amp", "pi": _ratio("amp", "mean"), "ri": _ratio("amp", "sys"), "sd": _ratio("sys", "dias")}
for kind, tag, rate in (("bp", "BP", "HR_BP"), ("mcav", "MCAV", "HR_MCA"), ("tonometer", "TONO", "")):
    columns = {k: f"{k.upper()}_{tag}" for k in PULSE} | {"spread": f"AMP_{tag}_DIFFERENCE"} | ({"hr": rate} if rate else {})
    query(f"macro_{kind}", f"{BEATS} SELECT rec, {', '.join(_mean_sql(v, k) for k, v in PULSE.items())}, round(max(amp) - min(amp), 6) AS spread{', ' + _mean_sql('hr', 'hr') if rate else ''} FROM b GROUP BY rec")(
        lambda ds, kind=kind, columns=columns: finals(macro(cut_up(ds), meta_name=kind, channel_name="V"), **columns)
    )
query("macro_cardiac_output", f"WITH {C}, b AS (SELECT rec, len(v) / CAST(10 AS DOUBLE) AS period, CASE WHEN len(v) > 0 THEN list_median(v) ELSE 0 END AS m FROM c0) SELECT rec, {_mean_sql('m', 'co')}, {_mean_sql('m', 'sv')} FROM b GROUP BY rec")(
    lambda ds: finals(macro(cut_up(ds), meta_name="cardiac_output", co_channel_name="V", sv_channel_name="V"), co="CARDIAC_OUTPUT", sv="STROKE_VOLUME")
)
query("macro_co2", f"WITH {C} SELECT rec, round(avg(coalesce(list_avg(v), 0)), 6) AS y FROM c0 GROUP BY rec")(
    lambda ds: finals(macro(ds, meta_name="co2", index_channel="PURCHASE", channel_name="VALUE", out_channel="Y"), y="Y")
)
query("macro_respiract", f"WITH {C}, b AS (SELECT rec, len(v) / CAST(10 AS DOUBLE) AS period, CASE WHEN len(v) > 0 THEN list_median(v) ELSE 0 END AS m FROM c0) SELECT rec, {_mean_sql('m', 'y')} FROM b GROUP BY rec")(
    lambda ds: finals(macro(_renamed(ds, "PURCHASE"), meta_name="respiract", channels=["PURCHASE"], index="PURCHASE"), y="PURCHASE")
)


def _renamed(ds: Dataset, name: str) -> Dataset:
    return Dataset(ds.samples.withColumnRenamed("VALUE", name), (name,))


def _faster(ds: Dataset, rate: float) -> Dataset:
    """The same samples at another rate."""
    return Dataset(ds.samples.withColumn("frequency", F.lit(rate)), ds.channels, rates=(rate,))


_LINE = {0: (0.6, 0.4, 0.2, 0.0, -0.2), 1: (0.4, 0.3, 0.2, 0.1, 0.0)}  # a line through five samples, at its first and second


def _line_sql(function: str, row: int) -> str:
    """The line's value `row` samples from an end, by lead (start) or lag (end)."""
    return " + ".join(f"CAST({c} AS DOUBLE) * {function}(pos, {k - row}) OVER o" for k, c in enumerate(_LINE[row]))


query(
    "macro_filter_signal",
    KALMAN[: KALMAN.rindex(" SELECT rec, idx, round(pos, 6)")]
    + f", z AS (SELECT *, count(*) OVER (PARTITION BY rec) AS n FROM k WHERE idx >= 0) SELECT rec, idx, round(CASE WHEN idx = 0 THEN {_line_sql('lead', 0)} WHEN idx = 1 THEN {_line_sql('lead', 1)} WHEN idx = n - 1 THEN {_line_sql('lag', 0)} WHEN idx = n - 2 THEN {_line_sql('lag', 1)} "
    "ELSE avg(pos) OVER (PARTITION BY rec ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END, 6) AS y FROM z WINDOW o AS (PARTITION BY rec ORDER BY idx)",
)(lambda ds: sampled(macro(_faster(ds, 100.0), meta_name="filter_signal", channel_name="VALUE"), "VALUE"))

VESSEL = {"diameter": "v", "area": "list_transform(v, lambda x: x * x * CAST(0.7854 AS DOUBLE))", "velocity": "v", "flow": "list_transform(v, lambda x: x * x * x * CAST(0.7854 AS DOUBLE))"}
KINDS = {"sys": "list_max({0})", "mean": "list_avg({0})", "dias": "list_min({0})", "amp": "list_max({0}) - list_min({0})"}
RATIOS = {"pi": ("amp", "mean"), "ri": ("amp", "sys"), "sd": ("sys", "dias")}
_KINDS_SQL = ", ".join(f"CASE WHEN len(v) > 0 THEN {form.format(body)} ELSE 0 END AS {kind}_{tag}_w" for tag, body in VESSEL.items() for kind, form in KINDS.items())
VESSEL_MEANS = {f"{k}_{tag}": f"{k}_{tag}_w" for tag in VESSEL for k in KINDS} | {f"{k}_{tag}": _ratio(f"{a}_{tag}_w", f"{b}_{tag}_w") for tag in ("velocity", "flow") for k, (a, b) in RATIOS.items() if k != "sd"}  # a beat's minimum may be near 0
query("macro_terason_tools", f"WITH {C}, b AS (SELECT rec, len(v) / CAST(10 AS DOUBLE) AS period, {_KINDS_SQL} FROM c0) SELECT rec, {', '.join(_mean_sql(v, k, 4) for k, v in VESSEL_MEANS.items())} FROM b GROUP BY rec")(
    lambda ds: finals(macro(cut_up(ds), meta_name="terason_tools", diameter_wave="V", velocity_wave="V"), places=4, **{k: k.upper() for k in VESSEL_MEANS})
)
