"""Scalar column functions: exact text forms, hashes, versions, time, intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_decimal(text: Column) -> Column:
    """``decimal(38,18)`` of plain decimal text; null for exponents, blanks, or more digits than fit."""
    return F.when(text.rlike(r"^-?(0|[1-9][0-9]{0,19})(\.[0-9]{1,18})?$"), text.try_cast("decimal(38,18)"))


def decimal_text(x: Column) -> Column:
    """Shortest plain text of a decimal: no exponent, no trailing zeros, no negative zero."""
    text = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,18)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(x == 0, "0").otherwise(text)


def quantized_return(exit_price: Column, entry_price: Column, digits: int = 6) -> Column:
    """``exit / entry - 1``, rounded half to even; null without an entry price."""
    return F.bround(exit_price.cast("double") / F.when(entry_price != 0, entry_price.cast("double")) - 1, digits)


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON of the fields in the order of their names; nulls are left out."""
    return F.to_json(F.struct(*[fields[n].alias(n) for n in sorted(fields)]))


def content_hash(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(fields), 256)


def semver(text: Column) -> Column:
    """``struct<major, minor, patch>`` of ``1.2.3``; null for anything else."""
    pattern = r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)$"
    parts = F.struct(*[F.regexp_extract(text, pattern, i).cast("int").alias(n) for i, n in ((1, "major"), (2, "minor"), (3, "patch"))])
    return F.when(text.rlike(pattern), parts)


def strict_int(text: Column) -> Column:
    return F.when(text.rlike(r"^(0|-?[1-9][0-9]{0,18})$"), text.try_cast("long"))


def strict_bool(text: Column) -> Column:
    return F.when(text.isin("true", "True"), True).when(text.isin("false", "False"), False)


def ticks_to_time(ticks: Column, day: Column, micros_from: str = "2025-01-01") -> Column:
    """Time of ticks whose unit depends on the day they are filed under: milliseconds before the date, microseconds from it on."""
    return F.when(day < F.lit(micros_from).cast("date"), F.timestamp_millis(ticks)).otherwise(F.timestamp_micros(ticks))


def scaled(raw: Column, factor: int) -> Column:
    return raw * F.lit(factor)


def midnight(t: Column) -> Column:
    return F.date_trunc("day", t)


def day_list(start: Column, end: Column) -> Column:
    """Midnights from the day of ``start`` to that of ``end``."""
    return F.sequence(midnight(start), midnight(end), F.expr("interval 1 day"))


def id_set(ids: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(ids)))


def method_text(name: str, params: dict[str, Column]) -> Column:
    """``{"method": name, "params": {...}}`` with the parameters in the order of their names."""
    return F.to_json(F.struct(F.lit(name).alias("method"), F.struct(*[params[k].alias(k) for k in sorted(params)]).alias("params")))


def method_params(text: Column, schema: str) -> Column:
    return F.from_json(text, f"method string, params struct<{schema}>")


def interval_array(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """An array of ``struct<start, end>`` without the empty ones, in order."""
    return F.array_sort(F.filter(F.array(*[F.struct(a.alias("start"), b.alias("end")) for a, b in pairs]), lambda s: s["end"] > s["start"]))


def lookup(table: dict[str, str], key: Column, fallback: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(fallback))


def round_trip_cost(fee: Column, slip: Column, multiplier: Column) -> Column:
    return 2 * (fee + slip) * multiplier


def observable_time(event_end: Column, event_time: Column) -> Column:
    return F.coalesce(event_end, event_time)


def gap_seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1_000_000.0)


def bucket_number(t: Column, width_us: int) -> Column:
    return F.floor(F.unix_micros(t) / F.lit(width_us)).cast("long")


def directional(high: Column, low: Column, high0: Column, low0: Column) -> Column:
    """``struct<plus, minus>`` directional movement of a bar against the one before."""
    up, down = high - high0, low0 - low
    return F.struct(F.when((up > down) & (up > 0), up).otherwise(0.0).alias("plus"), F.when((down > up) & (down > 0), down).otherwise(0.0).alias("minus"))
