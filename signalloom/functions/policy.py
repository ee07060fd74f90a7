"""Capture and attribution policies, compiled to one Boolean column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import glob



def _any(terms: Sequence[Column]) -> Column:
    return reduce(or_, terms, F.lit(False))


def _all(terms: Sequence[Column]) -> Column:
    return reduce(and_, terms, F.lit(True))


def _known(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def label_matches(labels: Column, rule: tuple) -> Column:
    """One selector term (P8): (key, "eq"|"ne", value), (key, "exists"|"missing") or (key, "in"|"notin", values). A missing key passes the negative forms."""
    key, op, *value = rule
    found = F.coalesce(labels, F.create_map().cast("map<string,string>"))[key]
    if op == "eq":
        return _known(found == value[0])
    if op == "ne":
        return F.coalesce(found != value[0], F.lit(True))
    if op == "exists":
        return found.isNotNull()
    if op == "missing":
        return found.isNull()
    if op == "in":
        return _known(found.isin(*value[0]))
    if op == "notin":
        return F.coalesce(~found.isin(*value[0]), F.lit(True))
    raise ValueError(f"unknown selector {op!r}")


def selector(labels: Column, rules: Sequence[tuple]) -> Column:
    return _all([label_matches(labels, r) for r in rules])


@dataclass(frozen=True)
class CapturePolicy:
    """Exclude wins, then the include gate, then the default (P10). Names are globs."""

    default_capture: bool = True
    exclude_namespaces: Sequence[str] = ()
    exclude_labels: Mapping[str, str] = field(default_factory=dict)
    exclude_selectors: Sequence[Sequence[tuple]] = ()
    exclude_processes: Sequence[str] = ()
    exclude_containers: Sequence[str] = ()
    include_namespaces: Sequence[str] = ()
    include_labels: Mapping[str, str] = field(default_factory=dict)
    include_any: Sequence[Sequence[tuple]] = ()

    def column(self, namespace: Column, labels: Column, process: Column, container: Column) -> Column:
        excluded = _any(
            [_known(glob(p, namespace)) for p in self.exclude_namespaces]
            + [label_matches(labels, (k, "eq", v)) for k, v in self.exclude_labels.items()]
            + [selector(labels, s) for s in self.exclude_selectors]
            + [_known(glob(p, process)) for p in self.exclude_processes]
            + [_known(glob(p, container)) for p in self.exclude_containers]
        )
        gates = []
        if self.include_namespaces:
            gates.append(_any([_known(glob(p, namespace)) for p in self.include_namespaces]))
        if self.include_labels:
            gates.append(_all([label_matches(labels, (k, "eq", v)) for k, v in self.include_labels.items()]))
        if self.include_any:
            gates.append(_any([selector(labels, s) for s in self.include_any]))
        return F.when(excluded, False).otherwise(_all(gates) if gates else F.lit(self.default_capture))


@dataclass(frozen=True)
class AttributionScope:
    """Which pods are attributed (P11). An unknown node fails only where nodes are listed."""

    allow_namespaces: Sequence[str] = ()
    deny_namespaces: Sequence[str] = ()
    allow_nodes: Sequence[str] = ()
    deny_nodes: Sequence[str] = ()
    select: Sequence[tuple] = ()
    exclude: Sequence[Sequence[tuple]] = ()

    def column(self, namespace: Column, node: Column, labels: Column) -> Column:
        terms = []
        if self.allow_namespaces:
            terms.append(_known(namespace.isin(*self.allow_namespaces)))
        if self.deny_namespaces:
            terms.append(F.coalesce(~namespace.isin(*self.deny_namespaces), F.lit(True)))
        if self.allow_nodes:
            terms.append(_known(node.isin(*self.allow_nodes)))
        if self.deny_nodes:
            terms.append(F.coalesce(~node.isin(*self.deny_nodes), F.lit(True)))
        if self.select:
            terms.append(selector(labels, self.select))
        terms += [~selector(labels, s) for s in self.exclude]
        return _all(terms)
