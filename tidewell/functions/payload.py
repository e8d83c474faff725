"""Predicates on typed JSON payloads: a missing or null key fails every one of them, NOT IN too."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(payload: Column | str) -> Column:
    """A JSON text as a variant, null where it doesn't parse."""
    return F.try_parse_json(payload)


def field(payload: Column | str, key: str) -> Column:
    """The text of a field, as ``payload->>key`` gives it; a JSON null is null, objects and lists are JSON text."""
    return F.try_variant_get(payload, path_of(key), "string")


def path_of(key: str) -> str:
    """A key's path; keys may hold any character but a double quote."""
    if '"' in key:
        raise ValueError("keys with a double quote can't be named in a path")
    return f'$["{key}"]'


def equals(payload: Column | str, key: str, value: str) -> Column:
    return F.coalesce(field(payload, key) == F.lit(value), F.lit(False))


def among(payload: Column | str, key: str, values: Sequence[str]) -> Column:
    return F.coalesce(field(payload, key).isin(list(values)), F.lit(False)) if values else F.lit(False)


def not_among(payload: Column | str, key: str, values: Sequence[str]) -> Column:
    """Only rows that have the key pass; with no values all of those do."""
    text = field(payload, key)
    return F.coalesce(~text.isin(list(values)), F.lit(False)) if values else text.isNotNull()


def number_in(payload: Column | str, key: str, low: float, high: float) -> Column:
    """A field that is a number from ``low`` to below ``high``; texts that look like one don't count."""
    kind = F.schema_of_variant(F.try_variant_get(payload, path_of(key), "variant"))
    number = F.try_variant_get(payload, path_of(key), "double")
    return F.coalesce((kind != "STRING") & (kind != "BOOLEAN") & (number >= low) & (number < high), F.lit(False))
