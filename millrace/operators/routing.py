"""Routing by record type: a chain of typed handlers, a default, and what becomes of records that do not decode."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.config import ErrorResponse

Handler = Callable[[DataFrame], DataFrame]


class DecodeError(RuntimeError):
    """A record did not decode, and the policy is to fail."""


@dataclass
class Router:
    """Handlers by type, in the order of registration; the first of a type is the one that counts.

    A handler takes the rows of its type, with the decoded value in `event`, and returns rows of the schema that all share.
    """

    on_decode_error: Callable[[Exception], ErrorResponse] = lambda e: ErrorResponse.CONTINUE
    chain: list[tuple[str, Callable[[Column], Column] | None, Handler]] = field(default_factory=list)
    default: Handler | None = None

    def register(self, kind: str, decode: Callable[[Column], Column] | None, handler: Handler) -> Router:
        self.chain.append((kind, decode, handler))
        return self

    def register_default(self, handler: Handler) -> Router:
        self.default = handler
        return self

    def types(self) -> list[str]:
        return list(dict.fromkeys(k for k, _, _ in self.chain))

    def label(self, kind: str = "record_type") -> Column:
        """The name of the handler that a row goes to."""
        return F.when(F.col(kind).isin(self.types()), F.col(kind)).otherwise(F.lit("default"))

    def split(self, rows: DataFrame, kind: str = "record_type", value: str = "value") -> tuple[DataFrame | None, DataFrame]:
        """(results, dead letters). Dead letters are rows that did not decode, and rows of a type without handler where
        there is no default; they count as done, and stay to be looked at. Under another policy they are an error, raised
        as soon as the results are computed."""
        out, dead, done = [], [], set()
        stop = self.on_decode_error(DecodeError("a record did not decode")) is not ErrorResponse.CONTINUE
        for k, decode, handler in self.chain:
            if k in done:
                continue
            done.add(k)
            own = rows.where(F.col(kind) == k)
            if decode is not None:
                own = own.withColumn("event", decode(F.col(value)))
                bad = F.col(value).isNotNull() & F.col("event").isNull()
                if stop:
                    own = own.where(F.when(bad, F.raise_error(F.lit(f"a record of type {k} did not decode")).cast("boolean")).otherwise(True))
                else:
                    dead.append(own.where(bad).drop("event"))
                    own = own.where(~bad)
            out.append(handler(own))
        rest = rows.where(~F.coalesce(F.col(kind).isin(self.types()), F.lit(False))) if done else rows
        if self.default is not None:
            out.append(self.default(rest))
        else:
            dead.append(rest)
        union = lambda x: reduce(DataFrame.unionByName, x)
        return (union(out) if out else None), (union(dead) if dead else rows.limit(0))
