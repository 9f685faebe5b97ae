"""Scalar expressions over workflow columns. Each takes and returns Columns unless its name says otherwise."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Milliseconds of the duration units.
UNIT_MS = {"milliseconds": 1, "seconds": 1_000, "minutes": 60_000, "hours": 3_600_000, "days": 86_400_000}


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def moment(as_of: str) -> Column:
    """A reference time as a literal without zone, as the tables' columns are."""
    return F.lit(as_of).cast("timestamp_ntz")


def after(when: Column, ms: int | Column) -> Column:
    """when + ms milliseconds."""
    ms = F.lit(ms) if isinstance(ms, int) else ms
    return when + F.make_dt_interval(secs=(ms / F.lit(1000)).cast("decimal(18,6)"))


def age_ms(since: str | Column, as_of: str | Column) -> Column:
    """Whole milliseconds from since to as_of, at least 0; null if since is."""
    until = moment(as_of) if isinstance(as_of, str) else as_of
    since = col(since)
    return F.when(since.isNotNull(), F.greatest(F.lit(0).cast("long"), F.timestamp_diff("MILLISECOND", since, until)))


def month_label(when: str | Column) -> Column:
    return F.date_format(col(when), "yyyy-MM")


def partition_name(when: str | Column, table: str = "events") -> Column:
    return F.format_string(f"{table}_y%04d_m%02d", F.year(col(when)), F.month(col(when)))


def month_start(when: str | Column, shift: int = 0) -> Column:
    return F.add_months(F.trunc(col(when), "month"), shift)


def base64url(data: Column) -> Column:
    """Base64 with the URL alphabet and without padding."""
    return F.rtrim(F.translate(F.base64(data), "+/", "-_"), F.lit("="))


def base16(data: Column) -> Column:
    return F.lower(F.hex(data))


def split_notification(payload: str | Column) -> Column:
    """struct(run_id, at) of a "run_id|timestamp" payload."""
    parts = F.split(col(payload), r"\|", 2)
    return F.struct(F.get(parts, 0).alias("run_id"), F.get(parts, 1).alias("at"))


def fingerprint(*parts: str | Column) -> Column:
    """SHA-256 of the parts as JSON; nulls count."""
    named = [col(p).alias(f"p{k}") for k, p in enumerate(parts)]
    return F.sha2(F.to_json(F.struct(*named), {"ignoreNullFields": "false"}), 256)


def derived_id(*parts: str | Column) -> Column:
    """An id in UUID form that follows from its parts: 32 hex digits of their SHA-256, with version 5 and the
    common variant."""
    h = fingerprint(*parts)
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def event_kind(event_type: str | Column) -> Column:
    """The group that a timeline shows an event in: the word before the first underscore, with a few exceptions."""
    e = col(event_type)
    return (
        F.when(e.isin("side_effect", "patched"), e).when(e == "workflow_log", "log").when(e == "run_continued_as_new", "continuation")
        .otherwise(F.substring_index(e, "_", 1))
    )


def capped(payload: str | Column, most: int) -> Column:
    """A payload of at most `most` bytes as it is, a larger one as a marker with its size."""
    p = col(payload)
    marker = F.to_json(F.struct(F.lit(True).alias("omitted"), F.octet_length(p).alias("encoded_bytes")))
    return F.when(F.octet_length(p) > most, marker).otherwise(p)


def prefix_bytes(text: str | Column, most: int) -> Column:
    """The longest prefix of whole characters within `most` bytes."""
    t = col(text)
    raw = F.substring(F.encode(t, "UTF-8"), 1, most)
    #: A cut character leaves at most three bytes behind that are not valid.
    tries = [F.try_validate_utf8(F.substring(F.encode(t, "UTF-8"), 1, most - k)) for k in range(4) if most >= k]
    return F.when(F.octet_length(t) <= most, t).otherwise(F.coalesce(*[x.cast("string") for x in tries], raw.cast("string")))


def public_error(error: str | Column) -> Column:
    """struct(error, stacktrace) of a JSON failure that may carry its stack trace."""
    e = col(error)
    inner = F.get_json_object(e, "$.error")
    return F.struct(F.coalesce(inner, e).alias("error"), F.get_json_object(e, "$.stacktrace").alias("stacktrace"))


def bounded_error(error: str | Column, most: int = 64 * 1024) -> Column:
    return prefix_bytes(error, most)


def bounded_text(text: str | Column, most: int = 4096) -> Column:
    """A text of at most `most` bytes as it is, a longer one cut there with three dots behind."""
    return F.when(F.octet_length(col(text)) <= most, col(text)).otherwise(F.concat(prefix_bytes(text, most), F.lit("...")))


def bounded_frames(frames: str | Column, most: int = 20, most_bytes: int = 4096) -> Column:
    """The first frames of a stack trace (an array of texts), each bounded."""
    return F.transform(F.slice(col(frames), 1, most), lambda x: bounded_text(x, most_bytes))


def backoff_ms(attempt: str | Column, base_ms: int = 1000, cap_ms: int = 60_000, strategy: str = "exponential") -> Column:
    """Wait before the next attempt, without jitter."""
    if strategy == "constant":
        return F.lit(min(base_ms, cap_ms)).cast("long")
    if strategy != "exponential":
        raise ValueError(f"unknown strategy {strategy}")
    doubled = F.lit(float(base_ms)) * F.pow(F.lit(2.0), F.least(col(attempt) - 1, F.lit(62)))
    return F.least(doubled, F.lit(float(cap_ms))).cast("long")


def retry_horizon_ms(attempts: str | Column, timeout_ms: int, base_ms: int = 1000, cap_ms: int = 60_000, jitter_ms: int = 0) -> Column:
    """Worst case from the first start to the last end: every attempt times out, every wait is the longest."""
    n = col(attempts)
    wait = lambda k: F.least(backoff_ms(k, base_ms, cap_ms) + jitter_ms, F.lit(cap_ms).cast("long"))
    waits = F.when(n > 1, F.aggregate(F.sequence(F.lit(1), (n - 1).cast("int")), F.lit(0).cast("long"), lambda a, k: a + wait(k))).otherwise(F.lit(0).cast("long"))
    return n.cast("long") * timeout_ms + waits


def duration_ms(amount: int, unit: str) -> int:
    if unit not in UNIT_MS:
        raise ValueError(f"unknown unit {unit}")
    return amount * UNIT_MS[unit]


def days_of(text: str) -> int:
    """The days of an age such as "30d"."""
    if not (m := re.fullmatch(r"\s*(\d+)\s*d\s*", text)):
        raise ValueError(f"not an age in days: {text!r}")
    return int(m[1])


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
