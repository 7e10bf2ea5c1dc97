"""Codecs as pairs of column expressions: encode to bytes, decode from bytes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Codec:
    """decode gives null for bytes that are not of this codec; strict() tells such bytes from a null input."""

    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]

    def malformed(self, raw: Column) -> Column:
        return raw.isNotNull() & self.decode(raw).isNull()


def _big_endian(x: Column) -> Column:
    return F.unhex(F.lpad(F.hex(x.cast("long")), 16, "0"))


def _from_big_endian(raw: Column) -> Column:
    """Two halves, since conv() has no sign; the upper one carries it."""
    text = F.hex(raw)
    high, low = (F.conv(F.substring(text, a, 8), 16, 10).cast("long") for a in (1, 9))
    return F.shiftleft(high, 32) + low


def _swapped(raw: Column) -> Column:
    text = F.hex(raw)
    return F.unhex(F.concat(*[F.substring(text, a, 2) for a in range(15, 0, -2)]))


#: 8 bytes, least first. A 32-bit integer is written the same way.
INT = Codec(lambda x: _swapped(_big_endian(x)), lambda raw: F.when(F.octet_length(raw) == 8, _from_big_endian(_swapped(raw))))
INT32 = Codec(INT.encode, lambda raw: INT.decode(raw).cast("int"))

#: 9 bytes whose order as bytes is the order of the integers: 0 or 1 for the sign, then the value, greatest byte first.
LEXO = Codec(
    lambda x: F.concat(F.when(x < 0, F.lit(b"\0")).otherwise(F.lit(b"\1")), _big_endian(x)),
    lambda raw: F.when(F.octet_length(raw) == 9, _from_big_endian(F.substring(raw, 2, 8))),
)
STRING = Codec(lambda x: F.encode(x, "UTF-8"), lambda raw: F.decode(raw, "UTF-8"))
BYTES = Codec(lambda x: x, lambda raw: raw)


def json_codec(schema: T.StructType | str) -> Codec:
    """A malformed document decodes to null."""
    corrupt = "_malformed"
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    loose = T.StructType([*kind.fields, T.StructField(corrupt, T.StringType())])

    def decode(raw: Column) -> Column:
        found = F.from_json(raw.cast("string"), loose, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
        return F.when(found.isNotNull() & found[corrupt].isNull(), F.struct(*[found[f.name].alias(f.name) for f in kind.fields]))

    return Codec(lambda item: F.encode(F.to_json(item), "UTF-8"), decode)
