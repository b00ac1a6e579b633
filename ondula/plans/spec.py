"""Blocks of a pipeline: checked settings, one step each.

A block is a dict with class_name and settings, as written in TOML. Scalar settings may be lists; the block is then as many steps as the longest list,
each seeing the results of the one before. Names of variables, channels and masks are upper-cased.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass
from typing import Any

from ondula.dataset import PipelineError


@dataclass(frozen=True)
class Setting:
    """kind: name (upper-cased), choice (upper-cased), text, number, whole, flag; many: the setting is a list by nature."""

    kind: str
    default: Any = None
    many: bool = False


NAME, TEXT = Setting("name", ""), Setting("text", "")
IN_OUT = {"in": NAME, "out": NAME}
CHANNELS = IN_OUT | {"in_channel": NAME, "out_channel": NAME}
STEPS: dict[str, dict[str, Setting]] = {
    "read": {"out": NAME, "folder": TEXT, "file": TEXT, "ext": TEXT, "format": Setting("choice", "LABCHART")},
    "save": {"in": NAME, "folder": TEXT, "save_name": TEXT, "format": TEXT, "header": TEXT, "delim": Setting("text", ","), "append": Setting("flag", False), "decimal": Setting("whole", 2)},
    "plot": {"in": NAME, "in_channel": Setting("name", (), True), "index": Setting("name", (), True), "comments": Setting("text", (), True), "title": TEXT, "save": TEXT},
    "delete": {"in": NAME},
    "cut": IN_OUT | {"form": Setting("choice", "COMMENT"), "comment1": Setting("text", (), True), "comment2": Setting("text", (), True), "reset": Setting("flag", False), "boundary": TEXT, "start": TEXT, "period": TEXT, "direction": Setting("text", "+")},
    "filter": CHANNELS | {"function": Setting("choice", ""), "power": Setting("whole", 1), "window": TEXT, "time": TEXT, "frequency": Setting("number", 1), "ftype": Setting("text", "low")},
    "peaks": CHANNELS | {"difference": TEXT, "prominence": Setting("number", 0), "height": Setting("number", 0), "format": Setting("choice", "MAX"), "overwrite": Setting("flag", True)},
    "inttan": CHANNELS | {"max_index": NAME, "min_index": NAME},
    "marker": CHANNELS | {"in_channel_2": NAME},
    "partition": CHANNELS | {"index": NAME, "del_first": Setting("flag", False), "del_last": Setting("flag", False)},
    "slice": CHANNELS | {"start": Setting("number", 0.0), "end": Setting("number", 1.0)},
    "expand": CHANNELS | {"mask": NAME, "alright": NAME, "weights": NAME, "method": Setting("choice", "FLAT")},
    "interpolate": CHANNELS | {"function": Setting("choice", "PCHIP"), "length": Setting("whole"), "frequency": Setting("number"), "in_frequency": NAME},
    "adjust": CHANNELS | {"in_2": NAME, "in_channel_2": NAME, "comments": Setting("text", (), True), "shift": Setting("text", "0s"), "direction": Setting("text", "+")},
    "check": CHANNELS | {"variable": Setting("choice", ""), "format": Setting("choice", "Y"), "compare": TEXT, "num": Setting("number"), "time": TEXT, "mask": NAME},
    "merge": CHANNELS | {"in_channel_2": NAME, "format": Setting("choice", "")},
    "take": CHANNELS | {"waves": Setting("whole", 0), "time": TEXT, "mask": NAME, "consecutive": Setting("flag"), "direction": Setting("text", "+"), "maximum": Setting("flag", False), "minimum": Setting("flag", True)},
    "priority": CHANNELS | {"channels": Setting("name", (), True)},
    "arithmetic": CHANNELS | {"format": TEXT, "in_channel_2": NAME, "num": Setting("number")},
    "normalize": CHANNELS | {"height": Setting("number", 1), "shift": Setting("number", 0)},
    "measurement": CHANNELS | {"format": TEXT},
    "aggregate": CHANNELS | {"format": TEXT, "mask": NAME, "weights": NAME, "outlier": Setting("text", "none"), "outlier_num": Setting("number", 0)},
    "morphology": CHANNELS | {"mask": NAME, "features": Setting("choice", (), True), "prominence_level": Setting("number", 0.05)},
}
KINDS = {"name": str, "choice": str, "text": (str, int), "number": (int, float), "whole": int, "flag": bool}


def checked(name: str, setting: Setting, value: Any, where: str) -> Any:
    if value is None:
        return None
    if isinstance(value, (list, tuple)):
        return [checked(name, setting, v, where) for v in value]
    if not isinstance(value, KINDS[setting.kind]) or isinstance(value, bool) != (setting.kind == "flag"):
        raise PipelineError(f"{where}: {name} = {value!r} is no {setting.kind}")
    return value.upper() if setting.kind in ("name", "choice") else value


def steps(block: dict[str, Any]) -> list[tuple[str, dict[str, Any]]]:
    """The steps of a block, with defaults filled in: out falls back to in, out_channel to in_channel."""
    kind = str(block.get("class_name", "")).lower()
    if kind not in STEPS:
        raise PipelineError(f"unknown step {block.get('class_name')!r}")
    settings = STEPS[kind]
    if unknown := set(block) - set(settings) - {"class_name", "verbosity"}:
        logging.getLogger("ondula").warning("%s: settings without effect: %s", kind, ", ".join(sorted(unknown)))
        block = {k: v for k, v in block.items() if k not in unknown}
    values = {}
    for name, setting in settings.items():
        value = block.get(name, setting.default)
        values[name] = checked(name, setting, value, kind)
        if setting.many and not isinstance(values[name], list):
            values[name] = [values[name]] if values[name] and not isinstance(values[name], tuple) else list(values[name])
    wide = {n: v for n, v in values.items() if isinstance(v, list) and not settings[n].many}
    count = max(map(len, wide.values()), default=1)
    if bad := [n for n, v in wide.items() if len(v) not in (1, count)]:
        raise PipelineError(f"{kind}: lists of unequal length: {', '.join(bad)}")
    out = []
    for i in range(count):
        one = {n: (v[i % len(v)] if n in wide else v) for n, v in values.items()}
        for target, source in (("out", "in"), ("out_channel", "in_channel")):
            if target in one and source in one and not one[target]:
                one[target] = one[source]
        out.append((kind, one))
    return out
