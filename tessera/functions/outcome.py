"""Outcomes as columns: a struct (ok, value, error). Values of failed rows and errors of good ones are null.

An outcome without a value, or without an error, has null there. Nothing raises but ``get``, ``expect`` and ``error``,
and those only for rows that call for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Of = Callable[[Column], Column]


def _outcome(ok: Column, value: Column, error: Column) -> Column:
    return F.struct(ok.alias("ok"), F.when(ok, value).alias("value"), F.when(~ok, error).alias("error"))


def ok(value: Column | None = None, error_type: str = "string") -> Column:
    """A good outcome; without a value it is void."""
    return _outcome(F.lit(True), F.lit(None).cast("boolean") if value is None else value, F.lit(None).cast(error_type))


def err(error: Column | None = None, value_type: str = "boolean") -> Column:
    """A failed outcome; without an error it says no more than that."""
    return _outcome(F.lit(False), F.lit(None).cast(value_type), F.lit(None).cast("string") if error is None else error)


def catch(tried: Column, error: Column) -> Column:
    """Of an expression that is null where it fails, as ``try_`` functions are: its value, or ``error``."""
    return _outcome(tried.isNotNull(), tried, error)


def from_error(value: Column, error: Column) -> Column:
    """Of a value and an error that is null where all went well, as decoded images have them."""
    return _outcome(error.isNull(), value, error)


def is_ok(r: Column) -> Column:
    return r["ok"]


def is_err(r: Column) -> Column:
    return ~r["ok"]


def map_value(r: Column, f: Of) -> Column:
    """``f`` of the value, or the error as it is."""
    return _outcome(r["ok"], f(r["value"]), r["error"])


def flat_map(r: Column, f: Of) -> Column:
    """The outcome that ``f`` makes of the value, or the error as it is."""
    made = f(r["value"])
    return _outcome(r["ok"] & made["ok"], made["value"], F.when(r["ok"], made["error"]).otherwise(r["error"]))


def map_error(r: Column, f: Of) -> Column:
    """The value as it is, or ``f`` of the error."""
    return _outcome(r["ok"], r["value"], f(r["error"]))


def convert(r: Column, to: str) -> Column:
    """The value as another type; what that type can't hold stops the query, as a plain cast does."""
    return map_value(r, lambda v: v.cast(to))


def drop_value(r: Column) -> Column:
    """The same outcome without a value."""
    return map_value(r, lambda _: F.lit(None).cast("boolean"))


def both(r: Column, other: Column) -> Column:
    """``other`` if ``r`` is good, else the error of ``r``."""
    return flat_map(r, lambda _: other)


def either(r: Column, other: Column) -> Column:
    """``r`` if it is good, else ``other``."""
    return _outcome(r["ok"] | other["ok"], F.when(r["ok"], r["value"]).otherwise(other["value"]), other["error"])


def equal(a: Column, b: Column) -> Column:
    """Both good with equal values, or both failed with equal errors; null equals null."""
    return a["ok"].eqNullSafe(b["ok"]) & F.when(a["ok"], a["value"].eqNullSafe(b["value"])).otherwise(a["error"].eqNullSafe(b["error"]))


def value_or(r: Column, otherwise: Column) -> Column:
    return F.when(r["ok"], r["value"]).otherwise(otherwise)


def unsafe_get(r: Column) -> Column:
    """The value, null where there is none."""
    return r["value"]


def get(r: Column, message: str = "an outcome has no value") -> Column:
    """The value; a failed row stops the query and tells its error."""
    told = F.concat(F.lit(message), F.coalesce(F.concat(F.lit(": "), r["error"].cast("string")), F.lit("")))
    return F.when(r["ok"], r["value"]).otherwise(F.raise_error(told))


expect = get


def error(r: Column) -> Column:
    """The error; a good row stops the query and tells its value."""
    told = F.concat(F.lit("an outcome has no error"), F.coalesce(F.concat(F.lit(": "), r["value"].cast("string")), F.lit("")))
    return F.when(~r["ok"], r["error"]).otherwise(F.raise_error(told))


def text(r: Column) -> Column:
    """Ok(value) or Err(error), with nothing between the brackets where there is nothing."""
    inside = F.when(r["ok"], r["value"].cast("string")).otherwise(r["error"].cast("string"))
    return F.concat(F.when(r["ok"], "Ok(").otherwise("Err("), F.coalesce(inside, F.lit("")), F.lit(")"))
