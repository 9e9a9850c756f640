"""Three ways to take the first of several keys of a JSON object of unknown schema (a VARIANT column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundmill.functions.text import filled, not_junk


def at(value: Column, key: str) -> Column:
    return F.try_variant_get(value, f"$.{key}", "variant")


def text_at(value: Column, key: str) -> Column:
    """The value as text: strings as they are, anything else as JSON; null if missing or null."""
    return F.try_variant_get(value, f"$.{key}", "string")


def present(value: Column, keys: list[str]) -> Column:
    """By presence: the first key that exists, even if its value is null; as text."""
    out = F.lit(None).cast("string")
    for key in reversed(keys):
        out = F.when(at(value, key).isNotNull(), text_at(value, key)).otherwise(out)
    return out


def truthy(value: Column, keys: list[str]) -> Column:
    """By truth: the first value that is not missing, null, false, zero or empty; as text."""
    texts = F.array(*(text_at(value, key) for key in keys))
    return F.get(F.filter(texts, lambda t: ~t.isin("", "false", "0", "0.0", "[]", "{}")), 0)


def worded(value: Column, keys: list[str], junk: bool = False) -> Column:
    """By words: the first string that is not blank (nor, if asked, stands for no value), stripped."""
    clean = not_junk if junk else filled
    strings = [F.when(F.schema_of_variant(at(value, key)) == "STRING", text_at(value, key)) for key in keys]
    return F.get(F.filter(F.transform(F.array(*strings), clean), lambda s: s.isNotNull()), 0)
