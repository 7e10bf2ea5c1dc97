"""Columns over the envelope: headers, record types, sizes, markers, change-log entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the wire format.
TYPE_HEADER = "__grt__"
MARK_HEADER = "gkes__mark"


def header_value(name: str, headers: str = "headers") -> Column:
    """The value of the first header of that name; null if there is none."""
    return F.try_element_at(F.filter(headers, lambda h: h["key"] == name), F.lit(1))["value"]


def record_type(headers: str = "headers") -> Column:
    """The last type header as text; empty if there is none."""
    last = F.try_element_at(F.filter(headers, lambda h: h["key"] == TYPE_HEADER), F.lit(-1))["value"]
    return F.coalesce(F.decode(last, "UTF-8"), F.lit(""))


def header(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("key"), F.encode(value, "UTF-8").alias("value"))


def with_header(name: str, value: Column, headers: str = "headers") -> Column:
    """Headers append; a name may repeat."""
    return F.array_append(headers, header(name, value))


def stamp_type(kind: Column, headers: str = "headers") -> Column:
    """A type header is added unless the type is empty or a type header is there."""
    skip = (F.coalesce(kind, F.lit("")) == "") | F.exists(headers, lambda h: h["key"] == TYPE_HEADER)
    return F.when(skip, F.col(headers)).otherwise(with_header(TYPE_HEADER, kind, headers))


def joined_bytes(*parts: Column) -> Column:
    """What several writes to one key or value leave: their bytes in order."""
    return F.concat(*[F.coalesce(p.cast("binary"), F.lit(b"")) for p in parts])


def serialised(value: Column) -> Column:
    """An empty value is a deletion, which is null."""
    return F.when(F.octet_length(value) > 0, value)


def record_size(key: str = "key", value: str = "value", headers: str = "headers") -> Column:
    """Bytes of key, value, and header names and values."""
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    heads = F.aggregate(F.coalesce(headers, F.array().cast("array<struct<key:string,value:binary>>")), F.lit(0).cast("long"), lambda s, h: s + size(h["key"]) + size(h["value"]))
    return size(F.col(key)) + size(F.col(value)) + heads


def is_marker(headers: str = "headers") -> Column:
    """A synchronisation mark: exactly one header, of the mark's name."""
    return F.coalesce((F.size(headers) == 1) & (F.get(F.col(headers), F.lit(0))["key"] == MARK_HEADER), F.lit(False))


def json_value(*fields: str | Column) -> Column:
    """The JSON bytes of a change-log entry's item."""
    return F.encode(F.to_json(F.struct(*fields)), "UTF-8")
