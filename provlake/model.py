"""Vocabularies and policy. Ordinals are semantic: the smallest truth state is the worst."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Names by number.
TRUTH = ("unknown", "unsupported", "conflicting", "stale", "incomplete", "known")
FRESHNESS = ("fresh", "aging", "stale")
AUTHORITY = ("none", "inferred", "reported", "corroborated", "authoritative")
KINDS = ("fabric", "site", "pod", "rack", "device", "port", "link", "path")
DOMAINS = (
    "identity", "topology", "link", "device", "port", "path", "capacity", "reachability", "authority", "failure", "partition", "congestion", "operational",
)
DISPOSITIONS = ("accepted", "duplicate", "fenced", "rejected")
#: Status codes, by number.
STATUS = (
    "Ok", "InvalidArgument", "OutOfRange", "NotFound", "AlreadyExists", "Unsupported", "NotPermittedByBoundary", "ResourceExhausted", "QueueFull", "TooLarge", "LimitExceeded",
    "DepthExceeded", "MalformedInput", "IntegrityFailure", "VersionMismatch", "Corrupt", "FencedSequence", "FencedIncarnation", "FencedStaleGeneration", "FencedStaleEpoch",
    "FencedAuthority", "FencedRevision", "FencedDuplicateContent", "ClockInconsistent", "FabricMismatch", "SourceUnknown", "IoError", "Cancelled", "ShuttingDown", "NotOpen", "Internal",
)
#: Well-known aspects with the least number of sources and the least authority that make them known.
ASPECTS = (
    ("identity.labels", 1, 0), ("topology.parent", 1, 0), ("link.state", 1, 2), ("device.model", 1, 0), ("port.state", 1, 2), ("path.state", 2, 2), ("capacity.bandwidth_bps", 1, 2),
    ("reachability.state", 2, 3), ("authority.owner", 1, 4), ("failure.state", 1, 2), ("partition.membership", 1, 2), ("congestion.level", 1, 2), ("operational.admin_state", 1, 2), ("operational.health", 1, 0),
)
SECOND = 1_000_000_000
CLAIMS_PER_ASPECT, CHANGES_PER_DIFF, DEPTH = 32, 8192, 16


@dataclass(frozen=True)
class Policy:
    """Windows in nanoseconds; coverage overrides by aspect: (sources, authority)."""

    fresh: int = 30 * SECOND
    aging: int = 120 * SECOND
    max_skew: int = 5 * SECOND
    recovered_may_be_fresh: bool = False
    default_coverage: tuple[int, int] = (1, 0)
    coverage: dict[str, tuple[int, int]] = field(default_factory=dict)
    name: str = "default"
    revision: int = 1

    def validated(self) -> Policy:
        """The policy itself, or a ValueError that says what is out of order."""
        wrong = [
            (not re.fullmatch("[a-z0-9._-]{1,64}", self.name), "a name has 1 to 64 of a-z, 0-9 and ._-"), (self.fresh < 0 or self.aging < 0 or self.max_skew < 0, "windows are not negative"),
            (self.aging < self.fresh, "the aging window is not shorter than the fresh one"), (any(s < 1 for s, _ in [self.default_coverage, *self.coverage.values()]), "coverage needs a source at least"),
            (any(not 0 <= a < len(AUTHORITY) for _, a in [self.default_coverage, *self.coverage.values()]), "coverage names an authority by its number"),
        ]
        for is_so, text in wrong:
            if is_so:
                raise ValueError(text)
        return self

    def digest(self) -> str:
        """SHA-256 of all that the policy says, whatever the order of its overrides."""
        said = [self.name, self.revision, self.fresh, self.aging, self.max_skew, int(self.recovered_may_be_fresh), *self.default_coverage]
        said += [f"{a}={s},{k}" for a, (s, k) in sorted(self.coverage.items())]
        return hashlib.sha256("|".join(map(str, said)).encode()).hexdigest()

    def text(self) -> str:
        """The policy in a line. Fixed text, but for the digest, which is this engine's own."""
        return f"policy {self.name} r{self.revision} fresh={self.fresh} aging={self.aging} skew={self.max_skew} recovered_as_fresh={'yes' if self.recovered_may_be_fresh else 'no'} digest={self.digest()[:12]}"

    def table(self, spark: SparkSession) -> DataFrame:
        """aspect, need_sources, need_authority: a table of fixed size."""
        rows = {a: (s, k) for a, s, k in ASPECTS} | self.coverage
        return spark.createDataFrame([(a, *v) for a, v in sorted(rows.items())], "aspect string, need_sources int, need_authority int")
