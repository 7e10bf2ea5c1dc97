"""What a source, a destination and a cluster are told, checked before anything starts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from enum import Enum


class ErrorResponse(Enum):
    """What a handler of errors asks for: skip the record, stop the query, or raise at once."""

    CONTINUE = "continue"
    FAIL_CONSUMER = "fail_consumer"
    FATALLY_EXIT = "fatally_exit"


class ExecutionState(Enum):
    """COMPLETE: done within its batch. INCOMPLETE: left pending in state for a timer. FATAL: a failure."""

    COMPLETE = 0
    INCOMPLETE = 1
    FATAL = 2


def _continue(error: Exception) -> ErrorResponse:
    return ErrorResponse.CONTINUE


def _fail(error: Exception) -> ErrorResponse:
    return ErrorResponse.FAIL_CONSUMER


@dataclass(frozen=True)
class EosConfig:
    """How much goes into one transaction, here one micro-batch. Delays are in milliseconds."""

    pool_size: int = 3
    pending_transactions: int = 1
    target_batch: int = 1_000
    max_batch: int = 10_000
    batch_delay_ms: int = 10

    def __post_init__(self):
        for bad, why in (
            (self.pool_size < 1, "pool_size must be 1 or more"),
            (not 1 <= self.pending_transactions < max(2, self.pool_size), "pending_transactions must be 1 or more and less than pool_size"),
            (self.target_batch < 1, "target_batch must be 1 or more"),
            (self.max_batch < self.target_batch, "max_batch must not be less than target_batch"),
            (self.batch_delay_ms < 1, "batch_delay_ms must be 1 or more"),
        ):
            if bad:
                raise ValueError(why)

    @property
    def in_flight(self) -> int:
        return self.max_batch * self.pool_size


@dataclass(frozen=True)
class Cluster:
    """Plain brokers, and any further options of the connector."""

    brokers: tuple[str, ...]
    options: dict[str, str] = field(default_factory=dict)

    def config(self) -> dict[str, str]:
        if not self.brokers:
            raise ValueError("a cluster needs brokers")
        return {"kafka.bootstrap.servers": ",".join(self.brokers), "kafka.isolation.level": "read_committed"} | {f"kafka.{k}": v for k, v in self.options.items()}


#: How each way of authentication is said to the connector, and which set of brokers serves it.
AUTH = {
    "none": ("plain", {}),
    "tls": ("tls", {"security.protocol": "SSL"}),
    "mutual_tls": ("tls", {"security.protocol": "SSL"}),
    "sasl_scram": ("sasl_scram", {"security.protocol": "SASL_SSL", "sasl.mechanism": "SCRAM-SHA-512"}),
    "sasl_iam": ("sasl_iam", {"security.protocol": "SASL_SSL", "sasl.mechanism": "AWS_MSK_IAM"}),
    "public_sasl_scram": ("public_sasl_scram", {"security.protocol": "SASL_SSL", "sasl.mechanism": "SCRAM-SHA-512"}),
    "public_sasl_iam": ("public_sasl_iam", {"security.protocol": "SASL_SSL", "sasl.mechanism": "AWS_MSK_IAM"}),
}


class ManagedCluster:
    """A cluster whose brokers a lookup gives, by the way of authentication; asked once, and again only after a failure."""

    def __init__(self, name: str, auth: str, lookup: Callable[[str], dict[str, str | None]]):
        if auth not in AUTH:
            raise ValueError(f"unknown authentication: {auth}")
        self.name, self.auth, self._lookup, self._known = name, auth, lookup, None

    def config(self) -> dict[str, str]:
        if self._known is None:
            kind, options = AUTH[self.auth]
            brokers = self._lookup(self.name).get(kind)
            if not brokers:
                raise LookupError(f"{self.name} has no brokers for {self.auth}")
            self._known = Cluster(tuple(brokers.split(",")), options).config()
        return dict(self._known)


#: The names that topics of state have unless they are given others.
CHANGE_LOG, COMMIT_LOG = "gkes_change_log_{topic}_{group}", "gkes_commit_log_{group}"


@dataclass(frozen=True)
class SourceConfig:
    group_id: str
    topic: str
    cluster: Cluster | ManagedCluster | None = None
    state_topic: str | None = None
    num_partitions: int = 1
    replication: int = 1
    min_in_sync: int = 1
    commit_log_partitions: int = 5
    commit_offsets: bool = False
    eos: EosConfig = EosConfig()
    balance: tuple[str, ...] = ("incremental",)
    on_decode_error: Callable[[Exception], ErrorResponse] = _continue
    on_txn_error: Callable[[Exception], ErrorResponse] = _fail
    on_assigned: Callable | None = None
    on_activated: Callable | None = None
    on_will_revoke: Callable | None = None
    on_revoked: Callable | None = None

    def __post_init__(self):
        if not self.group_id:
            raise ValueError("group_id is required")
        if not self.topic:
            raise ValueError("topic is required")
        if min(self.num_partitions, self.commit_log_partitions) < 1:
            raise ValueError("partition counts must be 1 or more")

    @property
    def changelog(self) -> str:
        return self.state_topic or CHANGE_LOG.format(topic=self.topic, group=self.group_id)

    @property
    def commit_log(self) -> str:
        return COMMIT_LOG.format(group=self.group_id)

    def resolved(self, existing: dict[str, int]) -> SourceConfig:
        """With the partition count that the topic has. existing: partition counts by topic. A change log of another
        count is an error, as its state would belong to other partitions."""
        n = existing.get(self.topic, self.num_partitions)
        if existing.get(self.changelog, n) != n:
            raise ValueError(f"{self.changelog} has {existing[self.changelog]} partitions, {self.topic} has {n}")
        return replace(self, num_partitions=n)

    def checkpoint(self, root: str) -> str:
        return f"{root.rstrip('/')}/{self.group_id}/{self.topic}"

    def kafka_options(self) -> dict[str, str]:
        """For the connector. A batch is limited by what may be in flight."""
        if self.cluster is None:
            raise ValueError("a cluster is required")
        return self.cluster.config() | {"subscribe": self.topic, "kafka.group.id": self.group_id, "startingOffsets": "earliest", "maxOffsetsPerTrigger": str(self.eos.in_flight), "kafka.session.timeout.ms": "6000", "kafka.fetch.max.wait.ms": "1000"}

    def as_destination(self) -> Destination:
        return Destination(self.topic, self.cluster, self.num_partitions)


@dataclass(frozen=True)
class Destination:
    default_topic: str
    cluster: Cluster | ManagedCluster | None = None
    num_partitions: int = 1
    replication: int = 1

    def kafka_options(self) -> dict[str, str]:
        if self.cluster is None:
            raise ValueError("a cluster is required")
        return self.cluster.config() | {"topic": self.default_topic, "kafka.linger.ms": "5", "kafka.compression.type": "none"}
