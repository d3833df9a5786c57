"""JSON as models write it."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.schemas import CLASSIFICATION


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_llm_json(text: Column) -> Column:
    """The JSON in a reply: the first part between code fences that has a brace, without the first "json" in it.

    All in built-in expressions. Filtering on the result repeats them, so select it into a table first where it is
    used more than once.
    """
    bare = strip(text)
    fenced = F.get(F.filter(F.split(bare, "```", -1), lambda p: p.contains("{")), 0)
    inner = F.when(bare.contains("```"), F.coalesce(fenced, bare)).otherwise(bare)
    return strip(F.regexp_replace(inner, r"(?s)^(.*?)json", "$1"))


@F.pandas_udf(T.StringType())
def strict_json(text: pd.Series) -> pd.Series:
    """Canonical text of the JSON value, as Python's strict reader takes it; null for all else and for JSON null.

    For where the built-in readers are too lenient: they take trailing text and single quotes.
    """

    def read(x: str | None) -> str | None:
        try:
            value = json.loads(x)
            return None if value is None else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError, RecursionError):
            return None

    return text.map(read, na_action="ignore").astype(object).where(text.notna(), None)


def safe_parse(text: Column, schema: str) -> Column:
    """A struct from strict JSON, or null; objects only."""
    canonical = strict_json(text)
    return F.when(canonical.startswith("{"), F.from_json(canonical, schema))


def is_truthy(value: Column) -> Column:
    """Whether JSON text is of a value that counts as true: not null, {}, [], "", 0 or false. Null is not."""
    bare = F.trim(value)
    falsy = bare.isin("null", "false", '""') | bare.rlike(r"^\{\s*\}$|^\[\s*\]$|^-?0+(\.0*)?([eE][+-]?\d+)?$") | (bare == "")
    return F.coalesce(~falsy, F.lit(False))


def truthy_or_error(value: Column, message: str = "Invalid JSON response") -> Column:
    """struct(value, error): a falsy value is an error of its row instead of the job's."""
    good = is_truthy(value)
    return F.struct(F.when(good, value).alias("value"), F.when(~good, F.lit(message)).alias("error"))


def parsed_or_raw(parsed: Column, raw: Column) -> Column:
    """The parsed reply where it is truthy, else the reply as it came."""
    return F.when(is_truthy(parsed), parsed).otherwise(raw)


def parse_or_unsure(reply: Column) -> Column:
    """A ticket's classification from strict JSON without fences; what isn't an object is of the category "unsure"."""
    parsed = safe_parse(reply, CLASSIFICATION)
    none = F.from_json(F.lit('{"category":"unsure"}'), CLASSIFICATION)
    return F.coalesce(parsed, none)
