"""Values of single fields: typing of record ids, vocabularies, rates, reasoning, composed texts, locators, checked objects."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# The pattern of each type's ids, in the order in which they are tried; the longest id.
RECORD_IDS = (("customer", "^C[0-9]{4,8}$"), ("transaction", "^TX[0-9]{4,8}$"), ("incident", "^INC[0-9]{3,8}$"), ("asset", "^AST[0-9]{3,8}$"))
LONGEST_ID = 16
# Words for true and false; tags around a model's reasoning.
TRUE, FALSE = ("1", "t", "true", "yes", "y"), ("0", "f", "false", "no", "n")
REASONING = ("think", "thinking", "reasoning", "scratchpad", "reflection")


def _trimmed(value: Column) -> Column:
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def text_or_null(value: Column) -> Column:
    """Trimmed; nothing counts as null."""
    return F.nullif(_trimmed(value), F.lit(""))


def number_or_null(value: Column) -> Column:
    """A finite number, or null."""
    number = _trimmed(value).try_cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), F.lit(None)).otherwise(number)


def boolean_or_null(value: Column) -> Column:
    word = F.lower(_trimmed(value))
    return F.when(word.isin(*TRUE), True).when(word.isin(*FALSE), False)


def record_type(value: Column) -> Column:
    """struct(type, id): the first type whose pattern fits the trimmed, upper-cased id; nulls if none does."""
    plain = _trimmed(value)
    known = F.upper(plain)
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(RECORD_IDS):
        kind = F.when(known.rlike(pattern), name).otherwise(kind)
    kind = F.when(F.length(plain) <= LONGEST_ID, kind)
    return F.struct(kind.alias("type"), F.when(kind.isNotNull(), known).alias("id"))


def without_reasoning(text: Column) -> Column:
    """struct(text, had_reasoning): reasoning in tags goes, with what precedes a tag that only closes or follows one that
    only opens."""
    whole = F.coalesce(text, F.lit(""))
    tags = "|".join(REASONING)
    shown = F.regexp_replace(whole, rf"(?is)<({tags})\b[^>]*>.*?</\1\s*>", "")
    shown = F.regexp_replace(shown, rf"(?is)\A.*?</(?:{tags})\s*>", "")
    shown = _trimmed(F.regexp_replace(shown, rf"(?is)<(?:{tags})\b[^>]*>.*\z", ""))
    return F.struct(shown.alias("text"), (shown != _trimmed(whole)).alias("had_reasoning"))


def rate(value: Column) -> Column:
    """``30000/1001`` as a number of three places, a plain number as it is; null without a denominator."""
    over, under = F.split_part(value, F.lit("/"), F.lit(1)), F.split_part(value, F.lit("/"), F.lit(2))
    ratio = F.round(F.try_divide(over.try_cast("double"), under.try_cast("double")), 3)
    return F.when(F.contains(value, F.lit("/")), ratio).otherwise(value.try_cast("double"))


def labelled_lines(head: Column, *lines: tuple[str, Column], least: int = 1) -> Column:
    """The head and a line ``label: value`` for each value that is not empty; "" with fewer than ``least`` such lines.
    A value without a label stands alone."""
    shown = F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{name}: " if name else ""), v)) for name, v in lines]))
    return F.when(F.size(shown) < least, "").otherwise(F.array_join(F.concat(F.array(head), shown), "\n"))


def locator(modality: Column, asset: Column, source: Column, chunk: Column, ordinal: Column, title: Column, metadata: Column) -> Column:
    """Where a chunk came from, from its own columns alone: what they don't say stays null. ``metadata``: map of strings."""
    said = lambda key: F.try_element_at(metadata, F.lit(key))
    timed = modality.isin("video", "audio")
    record = modality == "database"
    other = modality.isin("external", "graph")
    paged = ~(timed | record | other | (modality == "image"))
    kind = F.when(modality.isin("image", "video", "audio", "database"), modality).when(other, "external").otherwise("document")
    return F.struct(
        kind.alias("kind"), F.when(record | other, source).otherwise(asset).alias("id"),
        F.when(paged, said("page").try_cast("int")).alias("page"), F.when(paged, F.coalesce(title, said("section"))).alias("section"), F.when(paged, ordinal).alias("paragraph"),
        F.when(modality == "video", said("scene_id")).when(modality == "audio", said("segment_id")).alias("part"),
        F.when(timed, said("start_seconds").try_cast("double")).alias("start_s"), F.when(timed, said("end_seconds").try_cast("double")).alias("end_s"),
        F.when(record, F.coalesce(said("table"), F.lit("unknown"))).when(other, F.coalesce(said("resource"), asset)).alias("table"),
        F.when(record, F.coalesce(said("primary_key"), F.lit("id"))).alias("key"),
        F.when(record, F.coalesce(said("record_id"), chunk)).when(other, said("record_id")).alias("record"),
    )


def byte_range(header: Column, total: Column) -> Column:
    """struct(status, first, last) of a ``bytes=a-b`` header, both ends included: 200 without one, 206 with the end clamped to
    the object, 416 outside of it, 400 for anything else."""
    shape = r"^\s*bytes=(\d*)-(\d*)\s*$"
    said = lambda i: F.nullif(F.regexp_extract(header, shape, i), F.lit("")).cast("long")
    first, last = F.coalesce(said(1), F.lit(0).cast("long")), F.coalesce(said(2), total - 1)
    outside = (first >= total) | (first > last)
    status = F.when(header.isNull(), 200).when(~header.rlike(shape), 400).when(outside, 416).otherwise(206)
    inside = status == 206
    return F.struct(status.alias("status"), F.when(inside, first).alias("first"), F.when(inside, F.least(last, total - 1)).alias("last"))


def confined(path: Column, root: str) -> Column:
    """The path below ``root`` that a relative or absolute path leads to, or null if it leaves the root."""
    parts = F.split(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path)), "/", -1)
    parts = F.filter(parts, lambda p: ~p.isin("", "."))
    up = lambda at, p: F.when(p == "..", F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.concat(at, F.array(p)))
    whole = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/"))
    return F.when((whole == root.rstrip("/")) | whole.startswith(root.rstrip("/") + "/"), whole)


def safe_name(name: Column) -> Column:
    """The last part of a path in plain characters, 180 at most."""
    last = F.replace(F.regexp_replace(name, r"^.*[/\\]", ""), F.lit(".."), F.lit("_"))
    return F.left(F.regexp_replace(last, "[^A-Za-z0-9._-]+", "_"), F.lit(180))


def upload_reason(name: Column, size: Column, kinds: tuple[str, ...], largest: int) -> Column:
    """Why an upload is refused: empty, too large, or of another type; ok if it is not."""
    kind = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(size <= 0, "empty").when(size > largest, "size").when(~kind.isin(*kinds), "type").otherwise("ok")


_KINDS = {"string": "^STRING$", "integer": "^(TINYINT|SMALLINT|INT|BIGINT)$", "number": "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$", "object": "^OBJECT", "array": "^ARRAY"}


def violations(value: Column, schema: dict[str, Any]) -> Column:
    """array<string>: how a JSON text departs from an object schema: type, required, enum, bounds, number of items, unknown
    properties. Properties of properties are checked the same way; empty if all is well."""
    return F.array_compact(F.array(*_checks(F.try_parse_json(value), "$", schema)))


def _checks(root: Column, path: str, schema: dict[str, Any]) -> list[Column]:
    at = F.try_variant_get(root, path, "variant")
    there = at.isNotNull()
    name = path.removeprefix("$").removeprefix(".") or "(root)"
    wrong = lambda when, what: F.when(when, F.lit(f"{name}: {what}"))
    kind, out = schema.get("type"), []
    if kind:
        out.append(wrong((there if path != "$" else F.lit(True)) & ~F.coalesce(F.schema_of_variant(at).rlike(_KINDS[kind]), F.lit(False)), f"expected {kind}"))
    if "enum" in schema:
        out.append(wrong(there & ~F.coalesce(F.to_json(at).isin(*[json.dumps(v) for v in schema["enum"]]), F.lit(False)), "not one of the values"))
    number = F.try_variant_get(root, path, "double")
    for bound, off in (("minimum", lambda b: number < b), ("maximum", lambda b: number > b)):
        if bound in schema:
            out.append(wrong(off(F.lit(float(schema[bound]))), f"beyond {bound} {schema[bound]}"))
    if "maxItems" in schema:
        out.append(wrong(F.size(F.try_variant_get(root, path, "array<variant>")) > schema["maxItems"], f"more than {schema['maxItems']} items"))
    properties = schema.get("properties", {})
    for key in schema.get("required", []):
        out.append(F.when(F.try_variant_get(root, f"{path}.{key}", "variant").isNull(), F.lit(f"{name}: {key} is required")))
    if schema.get("additionalProperties") is False:
        keys = F.map_keys(F.try_variant_get(root, path, "map<string,variant>"))
        unknown = F.array_sort(F.filter(keys, lambda k: ~k.isin(*properties))) if properties else F.array_sort(keys)
        out.append(F.when(F.size(unknown) > 0, F.concat(F.lit(f"{name}: unknown "), F.array_join(unknown, ", "))))
    for key, sub in properties.items():
        out += _checks(root, f"{path}.{key}", sub)
    return out


def with_defaults(value: Column, schema: dict[str, Any]) -> Column:
    """map<string, string> of the properties as JSON, those with a default filled in where they are absent."""
    given = F.transform_values(F.try_variant_get(F.try_parse_json(value), "$", "map<string,variant>"), lambda _, v: F.to_json(v))
    given = F.coalesce(given, F.create_map().cast("map<string,string>"))
    defaults = {k: json.dumps(s["default"]) for k, s in schema.get("properties", {}).items() if "default" in s}
    if not defaults:
        return given
    more = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])
    return F.map_concat(given, F.map_filter(more, lambda k, _: ~F.map_contains_key(given, k)))
