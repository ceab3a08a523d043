"""Additive merges of JSON documents whose keys aren't known beforehand, and filters on their provenance."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that say nothing.
NOTHING = {"", "unknown", "unclassified", "null", "none"}
MERGED = T.StructType([T.StructField("merged", T.StringType()), T.StructField("conflicts", T.ArrayType(T.StringType()))])


def says_nothing(value) -> bool:
    return value is None or value == [] or value == {} or (isinstance(value, str) and value.strip().lower() in NOTHING)


def additive(old, new, path: str = "") -> tuple[object, list[str]]:
    """What is missing is filled, objects are merged within, and where both say something else the old value stays."""
    if says_nothing(old):
        return new if not says_nothing(new) else old, []
    if says_nothing(new) or old == new:
        return old, []
    if isinstance(old, dict) and isinstance(new, dict):
        out, conflicts = dict(old), []
        for k, v in new.items():
            out[k], more = additive(old.get(k), v, f"{path}.{k}" if path else k)
            conflicts += more
        return out, conflicts
    return old, [path]


@F.pandas_udf(MERGED)
def merge_json(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    """struct<merged, conflicts>; a text that isn't JSON counts as missing."""

    def load(text):
        try:
            return json.loads(text) if text else None
        except ValueError:
            return None

    rows = [additive(load(a), load(b)) for a, b in zip(old, new, strict=True)]
    return pd.DataFrame({"merged": [None if m is None else json.dumps(m, sort_keys=True) for m, _ in rows], "conflicts": [sorted(c) for _, c in rows]})


def not_duplicate(raw: Column) -> Column:
    """Rows that no reconciliation has marked as a duplicate."""
    mark = F.try_variant_get(F.try_parse_json(raw), "$.reconciliation_metadata.legacy_duplicate_candidate", "string")
    return F.lower(F.coalesce(mark, F.lit("false"))) != "true"


def from_sources(source: Column, raw: Column, wanted: list[str]) -> Column:
    """Rows of the wanted sources; a mixed row counts if one of its own providers is wanted."""
    doc = F.try_parse_json(raw)
    provider = F.try_variant_get(doc, "$.provider_provenance.provider", "string")
    providers = F.try_variant_get(doc, "$.provider_provenance.providers", "array<string>")
    inside = provider.isin(*wanted) | F.exists(providers, lambda p: p.isin(*wanted))
    return F.coalesce(source.isin(*wanted) | ((source == "mixed") & F.coalesce(inside, provider.isin(*wanted), F.lit(False))), F.lit(False)) if wanted else F.lit(False)


def provider_evidence(providers: Column, ids: Column, provider: Column, own_id: Column) -> tuple[Column, Column]:
    """The providers of a record with one more, in order, and its ids by provider with the new one added."""
    return F.array_sort(F.array_union(F.coalesce(providers, F.array().cast("array<string>")), F.array(provider))), F.map_concat(F.map_filter(F.coalesce(ids, F.create_map().cast("map<string,string>")), lambda k, _: k != provider), F.create_map(provider, own_id.cast("string")))
