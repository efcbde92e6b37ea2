"""The parameter model: named values by block, with kinds, bounds, sources and a record.

Blocks are the frozen dataclasses of the plans; a value is addressed as ``block.name``.
Overrides come nested, dotted or mixed; each is checked by the field's kind, and a name
that does not exist is answered with the nearest ones.
"""

from __future__ import annotations

import difflib
import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, replace
from types import UnionType
from typing import Any, get_args, get_origin, get_type_hints

from pyspark.sql import DataFrame, SparkSession

from .compartments import RADIUS, TIBIA, Calibration, Compartments
from .morphometry import Maps, Segmentation
from .pores import Pores
from .workflow import Evaluation

PRESETS = {"tibia": Evaluation(), "radius": Evaluation(compartments=RADIUS)}
BLOCKS: dict[str, type] = {"compartments": Compartments, "segmentation": Segmentation, "maps": Maps, "pores": Pores, "calibration": Calibration}
#: Other names for values.
ALIASES = {"compartments.open": "compartments.open_", "compartments.close1": "compartments.close_first", "compartments.close2": "compartments.close_last"}
CHOICES = {
    "segmentation.border": ("duplicate", "zero", "none"), "segmentation.rounding": ("ceil", "floor"), "segmentation.order": ("periosteal_first", "gobj_first"), "segmentation.overlap": ("trab", "cort"),
    "maps.version": (1, 2, 3), "maps.cort_object": ("cort_mask", "periosteal_minus_trab"), "maps.thickness_object": ("seg", "trab_seg"), "maps.fraction_object": ("seg", "trab_seg"), "pores.mode": (0, 1), "porosity": ("contour", "pore_plus_bone"),
}
#: Least values (``>``: exclusive).
LEAST = {"compartments.sigma": (">", 0), "compartments.support": (">=", 1), "compartments.erode": (">=", 0), "compartments.dilate": (">=", 0), "compartments.close_first": (">=", 0), "compartments.open_": (">=", 0), "compartments.close_last": (">=", 0), "compartments.peel": (">=", 0), "maps.epsilon": (">=", 0), "maps.assign": (">=", 0), "segmentation.least_cort": (">=", 0), "segmentation.least_trab": (">=", 0), "pores.least": (">=", 0), "calibration.mu_scaling": (">", 0)}
_NULLS = {"none", "null", ""}


class ParameterError(ValueError):
    """A parameter that does not exist or cannot take a value."""


def kinds() -> dict[str, Any]:
    """The type of every value by name."""
    out = {f"{b}.{f.name}": get_type_hints(t)[f.name] for b, t in BLOCKS.items() for f in fields(t)}
    return out | {"porosity": str}


def coerce(name: str, value: Any) -> Any:
    """The value as its kind; strings are read as such where the kind allows."""
    names = kinds()
    name = ALIASES.get(name, name)
    if name not in names:
        close = difflib.get_close_matches(name, names, 3) or difflib.get_close_matches(name.split(".")[-1], [n.split(".")[-1] for n in names], 3)
        raise ParameterError(f"no parameter {name!r}" + (f"; did you mean {', '.join(close)}?" if close else ""))
    kind = names[name]
    if isinstance(kind, UnionType):
        if value is None or (isinstance(value, str) and value.strip().lower() in _NULLS):
            return None
        kind = next(k for k in get_args(kind) if k is not type(None))
    try:
        out = _as(kind, value)
    except (TypeError, ValueError) as e:
        raise ParameterError(f"{name}: {value!r} is no {getattr(kind, '__name__', kind)} ({e})") from None
    if name in CHOICES and out not in CHOICES[name]:
        raise ParameterError(f"{name}: {out!r} is not one of {CHOICES[name]}")
    if name in LEAST:
        sign, bound = LEAST[name]
        if not (out > bound if sign == ">" else out >= bound):
            raise ParameterError(f"{name}: {out!r} is not {sign} {bound}")
    return out


def _as(kind: Any, value: Any) -> Any:
    if get_origin(kind) is tuple:
        inner = get_args(kind)
        items = [v for v in value.replace(",", " ").split()] if isinstance(value, str) else list(value) if isinstance(value, (list, tuple)) else [value]
        if inner[-1] is Ellipsis:
            return tuple(_as(inner[0], v) for v in items)
        if len(items) == 1:
            items *= len(inner)
        if len(items) != len(inner):
            raise ValueError(f"{len(inner)} values are needed")
        return tuple(_as(k, v) for k, v in zip(inner, items, strict=True))
    if kind is bool:
        words = {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}
        if isinstance(value, bool):
            return value
        if str(value).lower() not in words:
            raise ValueError("true or false")
        return words[str(value).lower()]
    if isinstance(value, bool):
        raise ValueError("a number is needed")
    if kind is int:
        number = float(value)
        if number != int(number):
            raise ValueError("a whole number is needed")
        return int(number)
    if kind is float:
        number = float(value)
        if number != number or number in (float("inf"), float("-inf")):
            raise ValueError("a finite number is needed")
        return number
    return str(value)


def flat(overrides: Mapping[str, Any], prefix: str = "") -> dict[str, Any]:
    """Nested, dotted and mixed overrides as dotted names; the same name twice is refused."""
    out: dict[str, Any] = {}
    for key, value in overrides.items():
        name = f"{prefix}{key}"
        part = flat(value, name + ".") if isinstance(value, Mapping) else {ALIASES.get(name, name): value}
        if twice := out.keys() & part.keys():
            raise ParameterError(f"{', '.join(sorted(twice))}: given twice")
        out |= part
    return out


def parse_setting(text: str) -> tuple[str, Any]:
    """``name=value``, the value as JSON or a bare word."""
    name, sign, value = text.partition("=")
    if not sign or not name.strip():
        raise ParameterError(f"{text!r} is not name=value")
    try:
        return name.strip(), json.loads(value)
    except ValueError:
        return name.strip(), value.strip()


@dataclass(frozen=True)
class Resolved:
    """An evaluation, the preset it comes from, and where each other value came from."""

    values: Evaluation
    preset: str
    sources: dict[str, str] = field(default_factory=dict)
    not_applied: dict[str, Any] = field(default_factory=dict)

    def non_default(self) -> dict[str, Any]:
        own, base = named(self.values), named(PRESETS[self.preset])
        return {k: v for k, v in own.items() if v != base[k]}

    def in_context(self, *, separation: bool = True, porosity: bool = True) -> Resolved:
        """Values of steps that will not run go back to the preset, and are recorded."""
        base, off = PRESETS[self.preset], {}
        now = self.values
        for block, runs in (("compartments", separation), ("pores", porosity)):
            if not runs:
                off |= {k: v for k, v in self.non_default().items() if k.startswith(block + ".")}
                now = replace(now, **{block: getattr(base, block)})
        return Resolved(now, self.preset, {k: s for k, s in self.sources.items() if k not in off}, off)

    def statement(self) -> str:
        changed = self.non_default()
        text = ", ".join(f"{k} = {v} ({self.sources.get(k, 'preset')})" for k, v in sorted(changed.items()))
        return f"preset {self.preset}" + (f"; changed: {text}" if text else "; all values as in the preset")

    def to_json(self) -> str:
        return json.dumps({"preset": self.preset, "values": named(self.values), "sources": self.sources}, sort_keys=True)


def named(values: Evaluation) -> dict[str, Any]:
    """All values by dotted name."""
    return {f"{b}.{k}": v for b in BLOCKS for k, v in asdict(getattr(values, b)).items()} | {"porosity": values.porosity}


def apply(values: Evaluation, overrides: Mapping[str, Any]) -> Evaluation:
    changes: dict[str, dict[str, Any]] = {}
    for name, raw in flat(overrides).items():
        value = coerce(name, raw)
        block, _, key = ALIASES.get(name, name).rpartition(".")
        changes.setdefault(block, {})[key] = value
    for block, part in changes.items():
        values = replace(values, **(part if not block else {block: replace(getattr(values, block), **part)}))
    return validated(values)


def validated(values: Evaluation) -> Evaluation:
    """Checks that concern more than one value."""
    c, s, p = values.compartments, values.segmentation, values.pores
    for ok, text in ((c.lower_mgha < c.upper_mgha, "compartments.lower_mgha is not below upper_mgha"), (1 <= c.rank_first <= c.rank_last, "compartments ranks do not rise"), (c.share_low <= c.share_high, "compartments.share_low is above share_high"), (s.low <= s.high, "segmentation.low is above high"), (p.low <= p.high, "pores.low is above high"), (p.share_low <= p.share_high, "pores.share_low is above share_high")):
        if not ok:
            raise ParameterError(text)
    return values


def resolve(preset: str = "tibia", file: Mapping[str, Any] | None = None, keywords: Mapping[str, Any] | None = None) -> Resolved:
    """Preset, then a parameter file, then keywords; the later one counts.

    A file may be partial, or a complete record (with its own ``preset`` and ``values``).
    """
    sources: dict[str, str] = {}
    if file and "values" in file:
        preset, file = file.get("preset", preset), {k: v for k, v in file["values"].items() if v != named(PRESETS.get(file.get("preset", preset), TIBIA_EVALUATION)).get(k)}
    if preset not in PRESETS:
        raise ParameterError(f"no preset {preset!r}: one of {', '.join(PRESETS)}")
    values = PRESETS[preset]
    for name, part in (("file", file), ("keyword", keywords)):
        if part:
            values = apply(values, part)
            sources |= dict.fromkeys((ALIASES.get(k, k) for k in flat(part)), name)
    return Resolved(values, preset, sources)


TIBIA_EVALUATION = Evaluation(compartments=TIBIA)


def describe(spark: SparkSession, values: Evaluation | None = None) -> DataFrame:
    """``name, kind, value, standard``: all parameters as a table."""
    own, base, types = named(values or TIBIA_EVALUATION), named(TIBIA_EVALUATION), kinds()
    rows = [(n, getattr(types[n], "__name__", str(types[n])), json.dumps(own[n]), json.dumps(base[n])) for n in sorted(own)]
    return spark.createDataFrame(rows, "name string, kind string, value string, standard string")
