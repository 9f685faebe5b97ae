"""Checks of signal payloads, and the policy of an activity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.functions.scalars import col

#: The types that a signal may ask for, and the JSON types that satisfy them.
PAYLOAD_TYPES = {
    "any": None, "string": ("STRING",), "boolean": ("BOOLEAN",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"),
    "object": ("OBJECT",), "list": ("ARRAY",), "null": ("VOID",),
}


def payload_is(payload: str | Column, kind: str) -> Column:
    """Whether a JSON payload is of a kind; text that is no JSON is of none."""
    if kind not in PAYLOAD_TYPES:
        raise ValueError(f"unknown payload type {kind!r}")
    found = F.schema_of_variant(F.try_parse_json(col(payload)))
    there = F.try_parse_json(col(payload)).isNotNull()
    if PAYLOAD_TYPES[kind] is None:
        return there
    match = F.lit(False)
    for t in PAYLOAD_TYPES[kind]:
        match = match | found.startswith(t)
    return F.coalesce(there & match, F.lit(False))


@dataclass(frozen=True)
class ActivityPolicy:
    timeout_ms: int = 30_000
    max_attempts: int = 3
    backoff: str = "exponential"
    base_ms: int = 1_000
    max_backoff_ms: int = 60_000
    jitter_ms: int = 0
    max_retry_horizon_ms: int = 86_400_000

    def __post_init__(self) -> None:
        for name in ("timeout_ms", "max_attempts", "base_ms", "max_backoff_ms", "max_retry_horizon_ms"):
            if not isinstance(getattr(self, name), int) or getattr(self, name) < 1:
                raise ValueError(f"{name} must be a positive whole number")
        if self.backoff not in ("exponential", "constant"):
            raise ValueError(f"unknown backoff {self.backoff!r}")
        if self.jitter_ms < 0:
            raise ValueError("jitter_ms must not be negative")
        if self.horizon_ms() > self.max_retry_horizon_ms:
            raise ValueError(f"max_retry_horizon_ms is shorter than the worst case of {self.horizon_ms()} ms")

    def wait_ms(self, attempt: int) -> int:
        base = self.base_ms if self.backoff == "constant" else self.base_ms * 2 ** (attempt - 1)
        return min(base, self.max_backoff_ms)

    def horizon_ms(self) -> int:
        return self.timeout_ms * self.max_attempts + sum(min(self.wait_ms(k) + self.jitter_ms, self.max_backoff_ms) for k in range(1, self.max_attempts))
