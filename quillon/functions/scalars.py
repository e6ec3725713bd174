"""Scalar rules of the record model."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

LATE_S, EARLY_S = 31_622_400, 86_400


def truthy(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string"))).isin("1", "true", "on", "yes")


def whole(c: Column) -> Column:
    """Text of a number as a whole one, its fraction cut; true is 1, false 0; null if it is none."""
    number = F.coalesce(c.try_cast("long"), F.when(F.abs(c.try_cast("double")) < 9e18, c.try_cast("double").cast("long")))
    return F.when(c == "true", F.lit(1).cast("long")).when(c == "false", F.lit(0).cast("long")).otherwise(number)


def hex32(c: Column) -> Column:
    """Lower-case 32-digit hashes as they are, anything else as its md5."""
    return F.when(c.rlike("^[0-9a-fA-F]{32}$"), F.lower(c)).otherwise(F.md5(c.cast("binary")))


def uuid(c: Column) -> Column:
    return F.when(c.rlike("^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lower(c))


def null_placeholder(c: Column) -> Column:
    return F.when(~c.isin("", "{}", "null", "[]"), c)


def clamped(c: Column, width: int = 255) -> Column:
    return F.substring(c, 1, width)


def event_seconds(timestamp: Column, now: Column) -> Column:
    """Whole seconds of a numeric timestamp within a year back and a day ahead, else now."""
    s = F.floor(timestamp.try_cast("double")).cast("long")
    return F.when(s.between(now - LATE_S, now + EARLY_S), s).otherwise(now)


def floor_to(seconds: Column, step: int) -> Column:
    return seconds - F.pmod(seconds, F.lit(step))


def host(url: Column) -> Column:
    return F.concat(F.split_part(url, F.lit("/"), F.lit(1)), F.lit("//"), F.split_part(url, F.lit("/"), F.lit(3)))


def route_name(methods_json: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.from_json(methods_json, "array<string>"), "|"), F.lit(" "), path)


def human_bytes(n: Column) -> Column:
    """KB, MB or GB to one decimal, halves away from zero and never an exponent; below a megabyte KB."""

    def shown(size, unit):
        tenths = F.abs(n / float(size)) * 10
        rounded = F.floor(tenths) + (tenths - F.floor(tenths) >= 0.5).cast("long")  # F.round goes by shortest digits
        return F.concat(F.when(n < 0, "-").otherwise(""), F.call_function("format_number", rounded / 10.0, F.lit("0.#")), F.lit(f" {unit}"))

    return F.when(n < 1 << 20, shown(1 << 10, "KB")).when(n < 1 << 30, shown(1 << 20, "MB")).otherwise(shown(1 << 30, "GB"))


def human_seconds(n: Column) -> Column:
    """Days from two of them, hours from two of them, else minutes, one at least."""
    parts = lambda size, unit: F.concat(F.floor(n / size).cast("string"), F.lit(f" {unit}"))
    return F.when(n >= 172_800, parts(86_400, "days")).when(n >= 7_200, parts(3_600, "hours")).otherwise(F.concat(F.greatest(F.floor(n / 60), F.lit(1)).cast("string"), F.lit(" minutes")))


def millis(us: Column) -> Column:
    """Microseconds as whole milliseconds, halves up."""
    return F.round(us / 1000.0).cast("long")


def busy_workers(us: Column) -> Column:
    """Worker time within a minute as workers busy on average."""
    return us / 60_000_000.0


def saturation_message(percent: int, workers: int, minutes: int, worst_us: Column) -> Column:
    """Busy workers to one decimal as C's %.1f rounds them: the double itself, ties to even; null if there are none."""
    worst = F.call_function("format_number", busy_workers(worst_us), F.lit("0.0"))  # format_string rounds shortest digits, halves up
    return F.concat(F.lit(f"Avg concurrency held at ≥{percent}% of {workers} workers for {minutes} consecutive minutes (worst minute: "), worst, F.lit(" busy)"))


def is_power_of_two(n: Column) -> Column:
    """1, 2, 4, ...: the repeats that are logged."""
    return (n > 0) & (n.bitwiseAND(n - 1) == 0)


@F.pandas_udf(T.BinaryType())
def deflate(text: pd.Series) -> pd.Series:
    def one(t):
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        return z.compress(t.encode()) + z.flush()

    return text.map(lambda t: None if t is None else one(t))


@F.pandas_udf(T.StringType())
def inflate(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else zlib.decompress(bytes(b), -15).decode())
