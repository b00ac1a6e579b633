"""Runs blocks over a catalog of datasets: everything stays lazy until a block saves."""

from __future__ import annotations

import logging
import tomllib
from collections.abc import Callable, Iterable
from dataclasses import replace
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ondula.dataset import Dataset, PipelineError
from ondula.operators import cycles as cyc
from ondula.operators import samples as smp
from ondula.plans.macros import expand
from ondula.plans.spec import STEPS, Setting, steps
from ondula.sources import readers, writers

Catalog = dict[str, Dataset]
log = logging.getLogger("ondula")
READERS = {"LABCHART": readers.labchart, "TERASON": readers.terason, "RESPIRAC": readers.respirac, "ADI": readers.adi}
EXTRA: dict[str, Callable[[Dataset, dict[str, Any]], Dataset]] = {}


def register_step(name: str, settings: dict[str, Setting], make: Callable[[Dataset, dict[str, Any]], Dataset]) -> None:
    """Adds a step of one's own: from a dataset and settings to a dataset."""
    STEPS[name] = settings
    EXTRA[name] = make


def _union(parts: list[Dataset]) -> Dataset:
    samples, channels = parts[0].samples, list(parts[0].channels)
    for part in parts[1:]:
        samples = samples.unionByName(part.samples, allowMissingColumns=True)
        channels += [c for c in part.channels if c not in channels]
    rates = None if any(p.rates is None for p in parts) else tuple(dict.fromkeys(r for p in parts for r in p.rates))
    return Dataset(samples.fillna(0.0, channels), tuple(channels), rates=rates)


def _one(ds: Dataset, kind: str, s: dict[str, Any], catalog: Catalog) -> Dataset:
    source, out = s.get("in_channel"), s.get("out_channel")
    if kind in EXTRA:
        return EXTRA[kind](ds, s)
    if kind == "cut":
        return smp.cut_time(ds, s["start"], s["period"], s["direction"], s["boundary"]) if s["form"] == "TIME" else smp.cut_comment(ds, s["comment1"], s["comment2"], s["reset"], s["boundary"])
    if kind == "filter":
        return smp.filtered(ds, s["function"], source, out, s["power"], s["window"], s["time"], s["frequency"], s["ftype"])
    if kind == "peaks":
        return smp.peaks(ds, source, s["difference"], s["prominence"], s["height"], s["format"], s["overwrite"])
    if kind == "inttan":
        return smp.tangents(ds, source, s["max_index"], s["min_index"])
    if kind == "marker":
        return cyc.marker_intervals(ds, source, s["in_channel_2"], out)
    if kind == "partition":
        return cyc.partition(ds, [source], s["index"], [out], s["del_first"], s["del_last"])
    if kind == "slice":
        return cyc.sliced(ds, source, s["start"], s["end"], out)
    if kind == "expand":
        return cyc.expanded(ds, source, s["weights"], s["mask"] or s["alright"], s["method"], out)
    if kind == "interpolate":
        rate, rates = s["frequency"], None
        if s["in_frequency"] and not rate:  # of recordings with one file name the first counts
            rates = catalog[s["in_frequency"]].recordings().groupBy("filename").agg(F.min_by("frequency", "rec").alias("rate"))
        return smp.resampled(ds, rate, s["length"], rates) if source == "DATA" else cyc.interpolated(ds, source, s["length"], rate, out, rates)
    if kind == "adjust":
        return smp.aligned(ds, catalog[s["in_2"]], source, s["in_channel_2"], out, s["comments"], s["shift"], s["direction"])
    if kind == "check":
        return cyc.check(ds, source, s["variable"], s["compare"], s["num"], s["time"], s["format"], s["mask"])
    if kind == "merge":
        return cyc.merged(ds, source, s["in_channel_2"], s["format"], out)
    if kind == "take":
        if s["consecutive"] is None:
            raise PipelineError("take needs consecutive")
        return cyc.take(ds, source, s["consecutive"], s["waves"], s["time"], s["mask"], s["direction"], s["maximum"], s["minimum"], out)
    if kind == "priority":
        return cyc.priority(ds, s["channels"], out)
    if kind == "arithmetic":
        return cyc.arithmetic(ds, source, s["format"], s["in_channel_2"] or None, s["num"], out)
    if kind == "normalize":
        return cyc.normalized(ds, source, s["height"], s["shift"], out)
    if kind == "measurement":
        return cyc.measured(ds, source, s["format"], out)
    if kind == "aggregate":
        return cyc.aggregated(ds, source, s["format"], s["mask"], s["weights"], s["outlier"], s["outlier_num"] or 0, out)
    if kind == "morphology":
        return cyc.shaped(ds, source, s["features"], s["mask"], s["prominence_level"], out)
    raise PipelineError(f"unknown step {kind!r}")


def _fused(planned: list[tuple[str, dict[str, Any]]]) -> list[tuple[str, dict[str, Any]]]:
    """Neighbouring partitions of one variable at one index become one pass over the samples, neighbouring aggregates of one form, mask and weights one over the cycles."""
    out: list[tuple[str, dict[str, Any]]] = []
    same = ("in", "out", "index", "del_first", "del_last")
    alike = ("in", "out", "format", "mask", "weights")
    for kind, s in planned:
        if kind == "aggregate" and s["outlier"] == "none":
            last = out[-1][1] if out and out[-1][0] == "aggregates" and all(out[-1][1][k] == s[k] for k in alike) else None
            made = [o for _, o in last["each"]] if last else []
            if last and not {s["in_channel"], s["weights"], s["out_channel"]} & set(made):
                last["each"].append((s["in_channel"], s["out_channel"]))
            else:
                out.append(("aggregates", s | {"each": [(s["in_channel"], s["out_channel"])]}))
            continue
        if kind == "partition" and out and out[-1][0] == "partitions" and all(out[-1][1][k] == s[k] for k in same) and s["out_channel"] not in out[-1][1]["outs"]:
            out[-1][1]["channels"].append(s["in_channel"])
            out[-1][1]["outs"].append(s["out_channel"])
        elif kind == "partition":
            out.append(("partitions", s | {"channels": [s["in_channel"]], "outs": [s["out_channel"]]}))
        else:
            out.append((kind, s))
    return out


def run(spark: SparkSession, blocks: Iterable[dict[str, Any]], catalog: Catalog | None = None) -> Catalog:
    """Checks all blocks, then applies them in order. Datasets of the catalog are never changed in place."""
    catalog = dict(catalog or {})
    flat = [b for block in blocks for b in (expand(block) if str(block.get("class_name", "")).lower() == "meta" else [block])]
    for kind, s in _fused([x for b in flat for x in steps(b)]):
        log.info("%s %s", kind, s)
        if kind == "read":
            if s["format"] not in READERS:
                raise PipelineError(f"unknown format {s['format']!r}; there are {', '.join(READERS)}")
            catalog[s["out"]] = READERS[s["format"]](spark, f"{s['folder']}{s['file']}{s['ext']}")
            continue
        if s["in"] not in catalog:
            if kind == "delete":
                log.warning("no variable %s to delete", s["in"])
                continue
            raise PipelineError(f"no variable {s['in']!r}")
        ds = catalog[s["in"]]
        if kind == "delete":
            del catalog[s["in"]]
        elif kind == "save":
            writers.save(ds, f"{s['folder']}{s['save_name']}", s["format"], s["header"], s["delim"], s["append"], s["decimal"], s["in"])
        elif kind == "plot":
            made = writers.plotted(ds, s["in_channel"], s["index"], s["comments"], s["title"], s["in"])
            made.write.mode("overwrite").partitionBy("filename").parquet(s["save"].replace("{NAME}", s["in"]).replace("{FILENAME}", "").rstrip("/_- "))
        elif kind == "partitions":
            catalog[s["out"]] = cyc.partition(ds, s["channels"], s["index"], s["outs"], s["del_first"], s["del_last"])
        elif kind == "aggregates":
            catalog[s["out"]] = cyc.aggregated_each(ds, s["each"], s["format"], s["mask"], s["weights"])
        else:
            catalog[s["out"]] = _one(ds, kind, s, catalog)
    return catalog


def run_files(spark: SparkSession, paths: list[str]) -> Catalog:
    """TOML files in the order given; they share their variables."""
    catalog: Catalog = {}
    for path in paths:
        with open(path, "rb") as f:
            catalog = run(spark, tomllib.load(f).get("command", []), catalog)
    return catalog


def combined(*parts: Dataset) -> Dataset:
    """Recordings of several datasets as one; channels that a recording lacks are 0."""
    return replace(_union(list(parts)))
