"""Sessions and token caches over a stream of model responses.

The responses of a session carry their ``position`` in it, 0, 1, 2 ..., and may arrive in any
order, within a batch and from batch to batch: those ahead of a gap wait in the state until
it closes. Bound a batch with the source's ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``.

What stays open is closed by the clock: a time column with a watermark. A session that the
watermark has left behind by ``idle`` ends as it is, without the responses that never came.
``run.mark_end`` moves the watermark past everything, which ends all sessions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlake.functions.calls import parse_calls
from agentlake.operators.sessions import MAX_ITERATIONS
from agentlake.streaming.buckets import BucketProcessor, bucket, columns
from agentlake.streaming.gaps import GapBuffer, MapOfKey
from agentlake.streaming.run import before_end, milliseconds

SESSION_OUT = (
    "session_id bigint, iterations bigint, tool_calls string, total_tokens bigint, total_time double, "
    "final_output string, success boolean"
)
ALERT_OUT = "session_id bigint, seq bigint, cached_tokens bigint"
#: Rows of a session that may wait beside those of others.
MOST_WAITING = 1 << 10


class _Timed(BucketProcessor):
    """Sessions in buckets, each due a while after its newest row: by event time, by processing time, or never."""

    def __init__(self, idle_ms: int | None = None, ttl_ms: int | None = None):
        self.idle_ms, self.ttl_ms = idle_ms, ttl_ms

    def now(self, timerValues) -> int:
        return timerValues.getCurrentWatermarkInMs() if self.idle_ms is not None else timerValues.getCurrentProcessingTimeInMs()

    def due_at(self, due: int | None, clock: int | None, timerValues) -> int | None:
        """When a session is due that was due at ``due`` and got a row of time ``clock``."""
        if self.idle_ms is not None:
            at = None if clock is None else clock + self.idle_ms
            return due if at is None or (due is not None and due >= at) else at
        return None if self.ttl_ms is None else timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms


class SessionProcessor(_Timed):
    """Counts a session's responses in order until it ends; later ones are ignored.

    Responses ahead of a gap wait; there are less than ``cap`` of them, as later ones are left out before.
    """

    name, out = "session", [c.split()[0] for c in SESSION_OUT.split(", ")]

    def __init__(self, cap: int, idle_ms: int | None, ttl_ms: int | None):
        super().__init__(idle_ms, ttl_ms)
        self.cap = cap

    def _count(self, row, sums):
        """The session after a row: its sums ``(n, calls, tokens, seconds, text)``, whether it ended, and by success."""
        n, calls, tokens, seconds, text = sums
        size, elapsed, is_error, n_calls, names, content = row
        n, seconds = n + 1, seconds + elapsed
        if not is_error:
            tokens, text = tokens + size, content
            if n_calls:
                calls = f"{calls},{names}" if calls else names
        success = not is_error and n_calls == 0
        return (n, calls, tokens, seconds, text), success or n >= self.cap, success

    @staticmethod
    def _row(session, sums, success):
        n, calls, tokens, seconds, text = sums
        return session, n, calls, int(tokens), float(seconds), text, bool(success)

    def take(self, held, pdf, timerValues):
        names = ["session_id", "position", "clock", "tokens", "elapsed", "is_error", "n_calls", "call_names", "content"]
        for session, position, clock, *row in columns(pdf, names):
            due, expected, sums, ended, waiting = held.get(session) or (None, 0, (0, "", 0, 0.0, ""), False, {})
            due = self.due_at(due, clock, timerValues)
            if not ended and position >= expected:
                waiting.setdefault(position, row)
                while not ended and expected in waiting:
                    sums, ended, success = self._count(waiting.pop(expected), sums)
                    expected += 1
                if ended:
                    yield self._row(session, sums, success)
                    sums, waiting = None, None
            held[session] = [due, expected, sums, ended, waiting]

    def expire(self, session, kept):
        _, _, sums, ended, waiting = kept
        if ended:
            return
        success = False
        for position in sorted(waiting):
            sums, ended, success = self._count(waiting[position], sums)
            if ended:
                break
        yield self._row(session, sums, success)


def _clocked(df: DataFrame, clock: str | None, late: str):
    """The rows with ``clock`` in milliseconds, watermarked, without the mark that ends the input."""
    if clock is None:
        return df, F.lit(None).cast("bigint").alias("clock")
    marked = before_end(df.withWatermark(clock, late), clock)
    return marked, F.unix_millis(F.col(clock)).alias("clock")


def stream_sessions(
    responses: DataFrame,
    cap: int = MAX_ITERATIONS,
    position: str = "position",
    clock: str | None = None,
    late: str = "1 hour",
    idle: str = "1 hour",
    ttl_ms: int | None = None,
) -> DataFrame:
    """One row per session, as ``sessions.session_summary`` gives for the batch.

    A session is reported when it ends, by success or after ``cap`` responses. With
    ``clock`` (a timestamp column) open sessions are reported once the watermark, ``late``
    behind the newest response, is ``idle`` behind their own newest one; state goes with
    them. With ``ttl_ms`` instead, after that much processing time. With neither, open
    sessions wait for ever.

    No session uses positions from ``cap`` on, so these are left out before the shuffle.
    Call parsing stays in the JVM; the state holds counters and what waits for a gap.
    """
    timed, millis = _clocked(responses, clock, late)
    # The mark has no position, and this filter may be moved below the watermark.
    slim = timed.where(F.coalesce(F.col(position) < cap, F.lit(True))).select(
        F.col("session_id").cast("bigint").alias("session_id"),
        F.col(position).cast("bigint").alias("position"),
        F.col("tokens").cast("bigint").alias("tokens"),
        F.col("elapsed").cast("double").alias("elapsed"),
        "is_error",
        "content",
        millis,
        *([F.col(clock).alias("event_time")] if clock else []),
    )
    calls = parse_calls(F.col("content"))
    parsed = slim.withColumn("calls", F.when(~F.col("is_error"), calls)).select(
        "session_id",
        "position",
        "tokens",
        "elapsed",
        "is_error",
        F.coalesce(F.size("calls"), F.lit(0)).alias("n_calls"),
        F.coalesce(F.array_join(F.transform("calls", lambda c: c["name"]), ","), F.lit("")).alias("call_names"),
        "content",
        "clock",
        *(["event_time"] if clock else []),
    )
    mode = "EventTime" if clock else "ProcessingTime" if ttl_ms is not None else "None"
    processor = SessionProcessor(cap, milliseconds(idle) if clock else None, None if clock else ttl_ms)
    return parsed.select(bucket("session_id"), "*").groupBy("bucket").transformWithStateInPandas(processor, SESSION_OUT, "append", mode)


class CacheProcessor(_Timed):
    """Running tokens per session since the last reset, in order of position.

    Rows ahead of a gap wait with their session while they are at most ``MOST_WAITING``; beyond
    that the session's go to a ``GapBuffer``, which reads only the span that is under work.
    """

    name, out = "cached", [c.split()[0] for c in ALERT_OUT.split(", ")]

    def __init__(self, limit: int, idle_ms: int | None):
        super().__init__(idle_ms)
        self.limit = limit

    def init(self, handle):
        super().init(handle)
        kinds = {"position": "bigint", "seq": "bigint", "tokens": "bigint", "reset": "boolean"}
        spans = ", ".join(f"{c} array<{t}>" for c, t in kinds.items())
        self.spans = handle.getMapState("waiting", "session_id bigint, span bigint", spans)
        self.columns = list(kinds)

    def _buffer(self, session) -> GapBuffer:
        return GapBuffer.over(MapOfKey(self.spans, session), self.columns)

    def _sum(self, session, carry, row):
        """Tokens held after a row, and the alert it raises, if any."""
        seq, tokens, reset = row
        carry = tokens if reset else carry + tokens
        return carry, ((session, seq, carry) if carry > self.limit else None)

    def _run(self, session, rows, carry, alerts):
        for row in rows[["seq", "tokens", "reset"]].itertuples(index=False):
            carry, alert = self._sum(session, carry, (int(row.seq), int(row.tokens), bool(row.reset)))
            if alert:
                alerts.append(alert)
        return carry

    def take(self, held, pdf, timerValues):
        alerts, large = [], {}
        for session, position, clock, *row in columns(pdf, ["session_id", "position", "clock", "seq", "tokens", "reset"]):
            due, expected, carry, first, waiting = held.get(session) or (None, 0, 0, None, {})
            due = self.due_at(due, clock, timerValues)
            if waiting is None:
                large.setdefault(session, []).append((position, *row))
            elif position >= expected:
                waiting.setdefault(position, row)
                while expected in waiting:
                    carry, alert = self._sum(session, carry, waiting.pop(expected))
                    expected += 1
                    if alert:
                        alerts.append(alert)
                if len(waiting) > MOST_WAITING:
                    large[session], waiting = [(at, *r) for at, r in waiting.items()], None
            held[session] = [due, expected, carry, first, waiting]
        for session, rows in large.items():
            due, expected, carry, first, _ = held[session]
            for run, expected, first in self._buffer(session).pass_on(pd.DataFrame(rows, columns=self.columns), expected, first):
                carry = self._run(session, run, carry, alerts)
            held[session] = [due, int(expected), carry, first, None if first is not None else {}]
        return alerts

    def expire(self, session, kept):
        _, _, carry, _, waiting = kept
        alerts = []
        if waiting is None:
            buffer = self._buffer(session)
            for rows in buffer.remaining():
                carry = self._run(session, rows, carry, alerts)
            buffer.clear()
        for position in sorted(waiting or ()):
            carry, alert = self._sum(session, carry, waiting[position])
            if alert:
                alerts.append(alert)
        return alerts


def stream_cache_growth(
    usage: DataFrame, limit: int, reset: str, position: str = "position", clock: str | None = None, late: str = "1 hour", idle: str = "1 hour"
) -> DataFrame:
    """Alert rows ``(session_id, seq, cached_tokens)`` while a cache is over ``limit``.

    ``reset`` names the boolean column that marks an independent request. Sums and resets
    are taken in order of ``position``: a row ahead of a gap raises its alert once the gap
    has closed, or, with ``clock``, when its session has been idle as in ``stream_sessions``.
    """
    timed, millis = _clocked(usage, clock, late)
    slim = timed.select(
        F.col("session_id").cast("bigint").alias("session_id"),
        F.col(position).cast("bigint").alias("position"),
        F.col("seq").cast("bigint").alias("seq"),
        F.col("tokens").cast("bigint").alias("tokens"),
        F.coalesce(F.col(reset), F.lit(False)).alias("reset"),
        millis,
        *([F.col(clock).alias("event_time")] if clock else []),
    )
    processor = CacheProcessor(limit, milliseconds(idle) if clock else None)
    return slim.select(bucket("session_id"), "*").groupBy("bucket").transformWithStateInPandas(processor, ALERT_OUT, "append", "EventTime" if clock else "None")
