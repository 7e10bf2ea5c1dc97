"""Where a record goes: a partition set by hand, a rule for its topic, or its key's hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.hashing import murmur2_partition

AUTO = -1


def target(manual: Column, n: int, key: Column | None = None, hashed: Column | None = None, topic: Column | None = None, by_topic: dict[str, Column] | None = None) -> Column:
    """The partition. manual: null or AUTO is unset. hashed: a partition of one's own choice, else the key's murmur2."""
    default = hashed if hashed is not None else murmur2_partition(key, n)
    if by_topic:
        rule = None
        for name, c in by_topic.items():
            rule = F.when(topic == name, c) if rule is None else rule.when(topic == name, c)
        default = rule.otherwise(default)
    return F.coalesce(F.when(manual != AUTO, manual), default)
