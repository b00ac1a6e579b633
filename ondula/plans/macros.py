"""Macros: named groups of blocks, written by rules instead of listed."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Callable
from typing import Any

from ondula.dataset import PipelineError
from ondula.plans.spec import STEPS

Block = dict[str, Any]
#: Settings that are lists by nature and are not spread over several blocks.
ATOMIC = {"channels", "features", "comments", "comment1", "comment2"}


def _measure(name: str, channel: str, form: str, out: str) -> Block:
    return {"class_name": "measurement", "in": name, "in_channel": channel, "format": form, "out_channel": out, "out": name}


def _divide(name: str, a: str, b: str, out: str) -> Block:
    return {"class_name": "arithmetic", "in": name, "in_channel": a, "in_channel_2": b, "format": "/", "out_channel": out, "out": name}


def _average(name: str, channel: str, weights: str, out: str, mask: str = "") -> Block:
    return {"class_name": "aggregate", "in": name, "in_channel": channel, "format": "mean", "weights": weights, "mask": mask, "out_channel": out, "out": name}


def _filter(name: str, function: str, channel: str, out: str, **more: Any) -> Block:
    return {"class_name": "filter", "in": name, "function": function, "in_channel": channel, "out_channel": out, "out": name} | more


def _indices(name: str, tag: str) -> list[Block]:
    """Pulsatility, resistance and systolic-diastolic ratio of the beats."""
    wave = lambda k: f"{k}_{tag}_wave"
    return [_divide(name, wave("amp"), wave("mean"), wave("pi")), _divide(name, wave("amp"), wave("sys"), wave("ri")), _divide(name, wave("sys"), wave("dias"), wave("sd"))]


def pulse(name: str, channel: str, mask: str, tag: str, period: str, rate: tuple[str, str] | None = None) -> list[Block]:
    """Diastolic, mean, systolic, amplitude of every beat, the indices between them, and their period-weighted means. rate: names of beats a minute, each and mean."""
    kinds = {"dias": "min", "mean": "mean", "sys": "max", "amp": "amplitude"}
    made = [_measure(name, channel, form, f"{k}_{tag}_wave") for k, form in kinds.items()]
    made.append(_measure(name, channel, "period", period))
    if rate:
        made.append(_measure(name, channel, "frequency", rate[0]))
    made += _indices(name, tag)
    if rate:
        made.append({"class_name": "arithmetic", "in": name, "in_channel": rate[0], "format": "*", "num": 60, "out_channel": rate[0], "out": name})
    made += [_average(name, f"{k}_{tag}_wave", period, f"{k}_{tag}", mask) for k in ("dias", "mean", "sys", "pi", "ri", "sd", "amp")]
    made.append(_average(name, f"amp_{tag}_wave", period, f"amp_{tag}_difference", mask) | {"format": "difference"})
    if rate:
        made.append(_average(name, rate[0], period, rate[1], mask))
    return made


def gas(name: str, index_channel: str, channel_name: str, out_channel: str) -> list[Block]:
    """One channel cut at an index and averaged; the periods are taken of the means, so that every cycle weighs the same."""
    return [
        {"class_name": "partition", "in": name, "index": index_channel, "in_channel": channel_name, "out_channel": "petco2_wave", "out": name},
        _measure(name, "petco2_wave", "mean", "petco2_wave"),
        _measure(name, "petco2_wave", "period", "petco2_wave_period"),
        _average(name, "petco2_wave", "petco2_wave_period", out_channel),
    ]


def detect(name: str, channel: str, index: str, smooth: str = "125ms", span: str = "5s", **peaks: Any) -> list[Block]:
    """Smoothed, standardised, then peaks marked under `index`."""
    return [_filter(name, "savgol", channel, "mid1", window=smooth), _filter(name, "sliding_standard", "mid1", index, time=span), {"class_name": "peaks", "in": name, "in_channel": index, "out": name} | peaks]


def vessel(name: str, diameter: str, velocity: str, mask: str) -> list[Block]:
    """Area and flow of a vessel, beat by beat, and means of diameter, area, velocity and flow, all weighted by the diameter's periods and side by side, so that they are one pass."""
    period, means = "period_diameter_wave", []
    made: list[Block] = [
        {"class_name": "arithmetic", "in": name, "in_channel": diameter, "in_channel_2": diameter, "format": "*", "out_channel": "diameter2_wave", "out": name},
        {"class_name": "arithmetic", "in": name, "in_channel": "diameter2_wave", "format": "*", "num": 0.7854, "out_channel": "area_wave", "out": name},
        {"class_name": "arithmetic", "in": name, "in_channel": velocity, "in_channel_2": "area_wave", "format": "*", "out_channel": "flow_wave", "out": name},
        _measure(name, diameter, "period", period),
    ]
    for channel, tag in ((diameter, "diameter"), ("area_wave", "area"), (velocity, "velocity"), ("flow_wave", "flow")):
        kinds = ["sys", "mean", "dias", "amp"]
        made += [_measure(name, channel, form, f"{k}_{tag}_wave") for k, form in zip(kinds, ("max", "mean", "min", "amplitude"), strict=True)]
        if tag in ("velocity", "flow"):
            made += _indices(name, tag)
            kinds += ["pi", "ri", "sd"]
        means += [_average(name, f"{k}_{tag}_wave", period, f"{k}_{tag}", mask) for k in kinds]
    return made + means


def terason_dist(name: str, index_channel_terason: str, channel_name_diameter: str, channel_name_velocity: str, diameter_mask_name: str) -> list[Block]:
    """The last ten good beats of a scan: beats too thin, too slow, too long or too short are masked."""
    waves = ["diameter_wave", "velocity_wave"]
    cut = {"class_name": "partition", "in": name, "index": index_channel_terason, "in_channel": [channel_name_diameter, channel_name_velocity], "out_channel": waves, "out": name}
    last = {"class_name": "take", "in": name, "in_channel": waves, "out_channel": waves, "waves": 10, "consecutive": True, "direction": "-", "out": name}
    limits = (("diameter_wave", "min", "y", ">=", {"num": 0.1}), ("velocity_wave", "min", "y", ">=", {"num": 10.5}), ("diameter_wave", "end", "x", "<=", {"time": "40BPM"}), ("diameter_wave", "end", "x", ">=", {"time": "150BPM"}))
    checks = [{"class_name": "check", "in": name, "in_channel": c, "variable": v, "format": f, "compare": how, "mask": diameter_mask_name, "out": name} | limit for c, v, f, how, limit in limits]
    return [cut, last, *checks, *vessel(name, *waves, diameter_mask_name)]


def take_max(name: str, channel: str, mask_name: str, time: str, resultant: str) -> list[Block]:
    """The first cycles in a row that fill the time, or the first at all. Both runs keep to the mask, as its name asks, where an older form of this macro takes any cycle."""
    take = lambda out, run: {"class_name": "take", "in": name, "in_channel": channel, "mask": mask_name, "time": time, "consecutive": run, "out_channel": out, "out": name}
    return [take("take_consecs", True), take("take_nonconsecs", False), {"class_name": "priority", "in": name, "channels": ["take_consecs", "take_nonconsecs"], "out_channel": resultant, "out": name}]


def respiratory_cycle(name: str, index_channel: str, out_channel_name: str) -> list[Block]:
    return [
        *detect(name, "co2", index_channel, "500ms", "8s", difference="1s", height=0.5, format="max"),
        {"class_name": "partition", "in": name, "index": index_channel, "in_channel": "pco2", "out_channel": "pco2_wave", "out": name},
        _measure(name, "pco2_wave", "max", "petco2_internal"),
        _measure(name, "pco2_wave", "period", "petco2_period_internal"),
        {"class_name": "arithmetic", "in": name, "in_channel": "petco2_internal", "format": "*", "num": 7.13, "out_channel": "petco2_internal", "out": name},
        {"class_name": "expand", "in": name, "in_channel": "petco2_internal", "weights": "petco2_period_internal", "out_channel": out_channel_name, "out": name},
    ]


#: Channels of a gas controller's record (fixed values).
CONTROLLER = (
    "desired_pco2", "desired_po2", "achievable_po2", "achievable_pco2", "po2_respirac", "pco2_respirac", "tidal_volume", "respiration_rate", "resting_po2",
    "resting_pco2", "breath_idx", "o2_adjustment", "co2_adjustment", "g1_target_vol", "g1_fco2", "g1_fo2", "g2_fco2", "g2_fo2",
)


def respiract(name: str, channels: list[str] = CONTROLLER, index: str = "desired_pco2") -> list[Block]:
    """Every channel cut at one index, its medians averaged by the periods of the index channel."""
    period, channels = "respiract_period_internal", list(channels)
    cuts = [{"class_name": "partition", "in": name, "index": index, "in_channel": c, "out_channel": c, "out": name} for c in channels]
    return [*cuts, _measure(name, index, "period", period), *[_measure(name, c, "median", c) for c in channels], *[_average(name, c, period, c) for c in channels]]


MACROS: dict[str, Callable[..., list[Block]]] = {
    "bp": lambda name, channel_name, mask_name="": pulse(name, channel_name, mask_name, "bp", "bp_period_wave", ("bp_freq_wave", "hr_bp")),
    "mcav": lambda name, channel_name, mask_name="": pulse(name, channel_name, mask_name, "mcav", "mca_period_wave", ("mca_freq_wave", "hr_mca")),
    "tonometer": lambda name, channel_name, mask_name="": pulse(name, channel_name, mask_name, "tono", "tono_period_wave"),
    "cardiac_output": lambda name, co_channel_name, sv_channel_name, mask_name="": [
        _measure(name, co_channel_name, "median", "mean_co_wave"), _measure(name, co_channel_name, "period", "period_co_wave"), _measure(name, sv_channel_name, "median", "mean_sv_wave"),
        _average(name, "mean_co_wave", "period_co_wave", "cardiac_output", mask_name), _average(name, "mean_sv_wave", "period_co_wave", "stroke_volume", mask_name),
    ],
    "co2": gas,
    "respiratory_cycle": respiratory_cycle,
    "respiract": respiract,
    "terason_dist": terason_dist,
    "terason_tools": lambda name, diameter_wave, velocity_wave, diameter_mask_name="": vessel(name, diameter_wave, velocity_wave, diameter_mask_name),
    "peak_start": lambda name, channel_name, index_channel: detect(name, channel_name, index_channel, difference="0.25s", prominence=1, format="max"),
    "peak_start_smooth": lambda name, channel_name, index_channel: detect(name, channel_name, index_channel, difference="0.25s", prominence=0.5, format="max"),
    "peak_foot": lambda name, channel_name, index_channel: detect(name, channel_name, index_channel, difference="0.25s", prominence=1, format="min"),
    "int_tan": lambda name, channel_name: [
        *detect(name, channel_name, "peak_index", difference="0.25s", prominence=1, format="max"), *detect(name, channel_name, "min_index", difference="0.25s", prominence=1, format="min"),
        {"class_name": "inttan", "in": name, "in_channel": channel_name, "max_index": "peak_index", "min_index": "min_index", "out": name},
    ],
    "filter_signal": lambda name, channel_name: [_filter(name, "kalman", channel_name, channel_name), _filter(name, "savgol", channel_name, channel_name, window="50ms")],
    "take_max": take_max,
}


def _filled(value: Any, given: Block) -> Any:
    """A setting with its placeholders filled in; one that is nothing but a placeholder becomes what is given, a number stays a number and a list a list."""
    if isinstance(value, str):
        if (alone := re.fullmatch(r"\{(\w+)\}", value)) and alone[1] in given:
            return given[alone[1]]
        return re.sub(r"\{(\w+)\}", lambda m: str(given[m.group(1)]) if m.group(1) in given else m.group(0), value)
    if isinstance(value, list):
        return [_filled(v, given) for v in value]
    return {k: _filled(v, given) for k, v in value.items()} if isinstance(value, dict) else value


def _listed(table: Block) -> list[Block]:
    """The `command` blocks of a TOML document, those under headings included."""
    return [b for k, v in table.items() for b in (v if k == "command" else _listed(v) if isinstance(v, dict) else [])]


def from_file(path: str) -> Callable[..., list[Block]]:
    """A macro of one's own: a TOML file of blocks, in which {parameter} stands for what the calling block gives. Other braces stay, as templates use them."""
    with open(path, "rb") as f:
        blocks = _listed(tomllib.load(f))
    return lambda **given: [_filled(b, given) for b in blocks]


def _by_nature(block: Block, name: str) -> bool:
    settings = STEPS.get(str(block.get("class_name", "")).lower(), {})
    return name in settings and settings[name].many


def spread(block: Block) -> list[Block]:
    """A block for each value of its lists, shorter lists taken again from their start; lists by nature stay whole."""
    wide = {k: v for k, v in block.items() if isinstance(v, list) and v and not _by_nature(block, k)}
    return [{k: (v[i % len(v)] if k in wide else v) for k, v in block.items()} for i in range(max(map(len, wide.values()), default=1))]


def expand(block: Block) -> list[Block]:
    """The blocks of a macro, built in or a TOML file. A list given for a parameter makes of every block that uses it one for each value, before the next block comes."""
    given = {k: v for k, v in block.items() if k not in ("class_name", "meta_name", "verbosity")}
    called = str(block.get("meta_name", ""))
    if called.lower() not in MACROS:
        if not called.endswith(".toml"):
            raise PipelineError(f"unknown macro {called!r}")
        return [one for b in from_file(called)(**given) for one in spread(b)]
    make = MACROS[called.lower()]
    lists = {k: v for k, v in given.items() if isinstance(v, list) and k not in ATOMIC}
    count = max(map(len, lists.values()), default=1)
    made = [make(**{k: (v[i % len(v)] if k in lists else v) for k, v in given.items()}) for i in range(count)]
    return [b for same in zip(*made, strict=True) for k, b in enumerate(same) if b not in same[:k]]
