"""Which parts of nested records stay: a rewrite of structs, arrays of structs and maps by path.

A policy names every key of a record by its path: ``meta.site``, ``duplicates[].path`` inside of an
array, ``inputs{}.sha256`` inside of the values of a map, ``evidence{log}`` for one key of a map.  Its
rules are ``keep`` (a value), ``whole`` (a part with everything in it), ``drop``, or a function
from column to column that is put in the value's place.  A key without a rule is refused by its path
before anything is read, so a field that is new to a record never slips through.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Rule = str | Callable[[Column], Column]
_RULES = ("keep", "whole", "drop")


class PolicyError(ValueError):
    """A key without a rule, or a rule that fits nothing."""


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


class _Rewrite:
    def __init__(self, policy: Mapping[str, Rule]):
        for path, rule in policy.items():
            if not callable(rule) and rule not in _RULES:
                raise PolicyError(f"{path}: {rule!r} is no rule")
        self.policy, self.used, self.unknown = policy, set(), []

    def kept(self, value: Column, kind: T.DataType, path: str) -> Column | None:
        """What is left of a value; None if nothing is."""
        rule = self.policy.get(path)
        if rule is not None:
            self.used.add(path)
        if rule == "drop":
            return None
        if callable(rule):
            return rule(value)
        if rule == "whole":
            return value
        if isinstance(kind, T.StructType):
            return self._struct(value, kind, path)
        if isinstance(kind, T.ArrayType) and self._nested(kind.elementType):
            return F.transform(value, lambda x: self._or_null(x, kind.elementType, f"{path}[]"))  # called at once, so unknown paths show
        if isinstance(kind, T.MapType):
            return self._map(value, kind, path)
        if rule is None:
            self.unknown.append(path)
        return value

    @staticmethod
    def _nested(kind: T.DataType) -> bool:
        return isinstance(kind, T.StructType | T.ArrayType | T.MapType)

    def _or_null(self, value: Column, kind: T.DataType, path: str) -> Column:
        out = self.kept(value, kind, path)
        return F.lit(None) if out is None else out

    def _struct(self, value: Column, kind: T.StructType, path: str) -> Column | None:
        fields = []
        for f in kind.fields:
            below = f"{path}.{f.name}" if path else f.name
            out = self.kept(value.getField(_quoted(f.name) if "." in f.name or "`" in f.name else f.name), f.dataType, below)
            if out is not None:
                fields.append(out.alias(f.name))
        if not fields:
            return None
        return F.when(value.isNotNull(), F.struct(*fields))  # a record that is not there stays so

    def _map(self, value: Column, kind: T.MapType, path: str) -> Column:
        gone = [p[len(path) + 1 : -1] for p, rule in self.policy.items() if rule == "drop" and p.startswith(path + "{") and p.endswith("}") and p != path + "{}"]
        self.used |= {f"{path}{{{k}}}" for k in gone}
        out = F.map_filter(value, lambda k, _: ~k.cast("string").isin(*gone)) if gone else value
        if self.policy.get(path) == "keep" and not self._nested(kind.valueType):
            return out
        return F.transform_values(out, lambda _, v: self._or_null(v, kind.valueType, f"{path}{{}}"))


def apply_policy(df: DataFrame, policy: Mapping[str, Rule], strict: bool = True) -> DataFrame:
    """``df`` with the parts that the policy keeps, at every depth.

    Nulls stay null, and empty arrays and maps empty; a struct of which nothing stays goes.  With
    ``strict`` a rule whose path is not in the schema is refused too (a misspelt rule would
    otherwise drop nothing).  All of it is one projection of built-in functions.
    """
    work = _Rewrite(policy)
    columns = []
    for f in df.schema.fields:
        out = work.kept(df[_quoted(f.name)], f.dataType, f.name)
        if out is not None:
            columns.append(out.alias(f.name))
    if work.unknown:
        raise PolicyError(f"no rule for {', '.join(sorted(set(work.unknown)))}")
    unused = sorted(policy.keys() - work.used - _covered(policy, work.used))
    if strict and unused:
        raise PolicyError(f"no such part: {', '.join(unused)}")
    return df.select(*columns)


def _covered(policy: Mapping[str, Rule], used: set[str]) -> set[str]:
    """Rules below a part that goes or stays as a whole are never asked for."""
    ends = [p for p in used if callable(policy[p]) or policy[p] in ("drop", "whole")]
    return {p for p in policy if any(p.startswith(e) and p[len(e) : len(e) + 1] in (".", "[", "{") for e in ends)}
