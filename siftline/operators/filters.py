"""Filters: the payload dialect, facets, time windows, permissions, and why rows were rejected."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compiled(conditions: dict[str, Any], array_columns: tuple[str, ...] = ()) -> Column:
    """``{field: value | list | {"eq" | "in" | "any": ...}}`` as one predicate; a missing field never matches."""
    out = F.lit(True)
    for field, spec in conditions.items():
        op, value = "eq", spec
        if isinstance(spec, dict):
            if len(spec) != 1 or next(iter(spec)) not in ("eq", "in", "any"):
                raise ValueError(f"{field}: exactly one of eq, in, any")
            op, value = next(iter(spec.items()))
        elif isinstance(spec, (list, tuple, set)):
            op = "in"
        values = list(value) if op in ("in", "any") else [value]
        if not values:
            raise ValueError(f"{field}: an empty list matches nothing")
        if field in array_columns:
            hit = F.arrays_overlap(F.col(field), F.array(*map(F.lit, values)))
        else:
            hit = F.col(field).isin(*values)
        out = out & F.coalesce(hit, F.lit(False))
    return out


def in_window(occurred: Column, created: Column, low: str | Column, high: str | Column) -> Column:
    """Both ends included, on the moment it occurred or else was created; unknown moments are outside."""
    moment = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("timestamp")
    return F.coalesce(F.coalesce(occurred, created).cast("timestamp").between(moment(low), moment(high)), F.lit(False))


def permitted(source: Column, source_roles: Column, chunk_roles: Column, role: str, access: tuple[str, ...] = (), denied: tuple[str, ...] = ()) -> Column:
    """A denied source is closed; an access list, if any, must name the source; empty role lists are open."""
    open_to = lambda roles: F.coalesce((F.size(roles) == 0) | F.array_contains(roles, role), F.lit(True))
    ok = ~source.isin(*denied) if denied else F.lit(True)
    ok = ok & (source.isin(*access) if access else open_to(source_roles))
    return F.coalesce(ok, F.lit(False)) & open_to(chunk_roles)


def rejection(permission: Column, wanted: Column, present: Column) -> Column:
    """Why a candidate goes: it is missing, not permitted, or filtered, tested in that order; null if it stays."""
    return F.when(~present, "missing").when(~permission, "permission").when(~wanted, "filter")


def rejection_counts(rows: DataFrame, reason: Column) -> DataFrame:
    return rows.select(F.coalesce(reason, F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def contains_text(column: Column, needle: str) -> Column:
    """Substring test without regard to case; % and _ are ordinary characters."""
    return F.contains(F.lower(column), F.lit(needle.lower()))


def redacted(properties: Column) -> Column:
    """Map values under secret-looking keys masked."""
    secret = lambda k: F.lower(k).rlike("password|passwd|secret|token|api_?key|credential")
    return F.transform_values(properties, lambda k, v: F.when(secret(k), F.lit("***")).otherwise(v))
