"""Time-driven rules as batch jobs: rate limits, attempt lifecycles, stale work, cooldowns.

Keys may be arbitrarily hot, so nothing collects a key into one group: counting
works per (key, time slice), attempt states take a bounded number of partial
aggregates, and the one truly sequential rule (accepted-only rate limiting) is
cut at quiet gaps and then folded with constant memory.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
SECOND = 1_000_000

# --- fixed values: limits and codes ------------------------------------------
MAX_ATTEMPTS, COOLDOWN_SECONDS, STALE_MINUTES = 3, 10, 5
RATE_WINDOW_SECONDS, RATE_LIMIT = 60, 10
TIMEOUT_CODE, STALE_CODE, RESTART_CODE = "EXTRACTION_TIMEOUT", "STALE_PROCESSING_TIMEOUT", "SERVER_RESTARTED"
NOT_RETRYABLE = ("TEXT_LIMIT_EXCEEDED", "DECOMPRESSION_LIMIT_EXCEEDED", "ARCHIVE_SIZE_LIMIT_EXCEEDED",
                 "UNSAFE_XML_DECLARATION")


def micros(ts: str) -> Column:
    """Microseconds since the epoch of a zone-less timestamp, whatever the session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, `{ts}`)")


def cooldown_seconds(completed_us: Column, now_us: Column, seconds: int = COOLDOWN_SECONDS) -> Column:
    """Whole seconds left before a retry is allowed; 0 when never completed."""
    elapsed = F.greatest(F.lit(0), now_us - completed_us)
    left = F.greatest(F.lit(0), F.lit(seconds * SECOND) - elapsed)
    return F.coalesce(F.ceil(left / SECOND), F.lit(0)).cast("long")


def can_retry(status: Column, attempts: Column) -> Column:
    return (attempts < MAX_ATTEMPTS) & (status != "COMPLETED")


# --- rate limiting -----------------------------------------------------------

def request_key(user: Column, ip: Column) -> Column:
    return F.coalesce(F.nullif(user, F.lit("")), F.nullif(ip, F.lit("")), F.lit("anonymous"))


def range_counts(events: DataFrame, key: str, ts: str, order: str, window_seconds: int) -> DataFrame:
    """Requests of the same key within the window ending at each request (itself included).

    A window touches at most two slices of its own length, so each row is placed
    in its slice and, as context only, in the next one; the window function then
    runs per (key, slice) instead of per key.
    """
    us = window_seconds * SECOND
    d = events.select(key, ts, order, micros(ts).alias("_us")).withColumn("_slice", F.floor(F.col("_us") / us))
    placed = d.select("*", F.explode(F.array(F.struct(F.col("_slice").alias("at"), F.lit(True).alias("own")),
                                             F.struct((F.col("_slice") + 1).alias("at"), F.lit(False).alias("own")))).alias("_p"))
    w = Window.partitionBy(key, "_p.at").orderBy("_us").rangeBetween(-(us - 1), 0)
    return placed.withColumn("requests", F.count("*").over(w)).filter("_p.own").select(key, ts, order, "requests")


def quiet_sessions(events: DataFrame, key: str, us: str, gap_us: int, slice_us: int) -> DataFrame:
    """Add ``_session``: start of the run of events without a gap of ``gap_us``.

    Done per (key, slice); only one row per slice is compared across slices.
    """
    d = events.withColumn("_slice", F.floor(F.col(us) / slice_us))
    inside = Window.partitionBy(key, "_slice").orderBy(us)
    d = d.withColumn("_prev", F.lag(us).over(inside))
    d = d.withColumn("_start", F.when(F.col(us) - F.col("_prev") >= gap_us, F.col(us)))
    per_slice = d.groupBy(key, "_slice").agg(F.min(us).alias("_lo"), F.max(us).alias("_hi"), F.max("_start").alias("_last"))
    across = Window.partitionBy(key).orderBy("_slice")
    first_starts = F.coalesce(F.col("_lo") - F.lag("_hi").over(across) >= gap_us, F.lit(True))
    per_slice = per_slice.withColumn("_first", F.when(first_starts, F.col("_lo")))
    running = F.last(F.coalesce("_last", "_first"), ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    per_slice = per_slice.withColumn("_open", F.coalesce("_first", running)).select(key, "_slice", "_open")
    d = d.withColumn("_own", F.max("_start").over(inside.rangeBetween(Window.unboundedPreceding, 0)))
    return d.join(per_slice, [key, "_slice"]).withColumn("_session", F.coalesce("_own", "_open")).drop(
        "_slice", "_prev", "_start", "_own", "_open")


def rate_limit_decisions(events: DataFrame, key: str, ts: str, order: str, window_seconds: int = RATE_WINDOW_SECONDS,
                         limit: int = RATE_LIMIT) -> DataFrame:
    """Sliding log where only *accepted* requests count: key, ts, order, accepted, retry_after_seconds.

    Rows without a key (null or empty) share one.  Acceptance depends on earlier acceptances, so it needs order.  A quiet gap
    of one window empties the log, which makes sessions independent; they are
    spread over tasks and each is folded from a sorted stream holding at most
    ``limit`` timestamps.
    """
    us = window_seconds * SECOND
    who = request_key(F.col(key).cast("string"), F.lit(None).cast("string"))  # no key at all is one key, as for requests
    d = events.select(key, ts, order).withColumn("_us", micros(ts)).withColumn("_who", who)
    d = quiet_sessions(d, "_who", "_us", us, 64 * us)
    d = d.repartition("_who", "_session").sortWithinPartitions("_who", "_session", "_us", order)
    schema = T.StructType([*[d.schema[c] for c in (key, ts, order)], T.StructField("accepted", T.BooleanType()),
                           T.StructField("retry_after_seconds", T.LongType())])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, log = None, deque()
        for pdf in batches:
            accepted, retry = [], []
            for who, session, now in zip(pdf["_who"], pdf["_session"], pdf["_us"]):
                if (who, session) != current:
                    current, log = (who, session), deque()
                while log and now - log[0] >= us:
                    log.popleft()
                ok = len(log) < limit
                if ok:
                    log.append(now)
                accepted.append(ok)
                retry.append(None if ok else max(1, -(-(log[0] + us - now) // 1_000_000)))
            out = pdf[[key, ts, order]].copy()
            out["accepted"], out["retry_after_seconds"] = accepted, pd.array(retry, dtype="Int64")
            yield out

    return d.mapInPandas(fold, schema)


# --- attempt lifecycle -------------------------------------------------------

#: Sorts behind every event of its time: the limit itself still belongs to the attempt.
_LAST = 2**63 - 1
ATTEMPT_COLUMNS = ("status", "attempts", "error_code", "started_us", "finished_us")


def attempt_states(events: DataFrame, key: str = "doc_id", stale_minutes: int | None = None, as_of_us: int | None = None) -> DataFrame:
    """Final state per document from upload / claim / complete / fail events.

    Events: key, kind, us (time), seq (tiebreak), token (attempt number an
    outcome belongs to), error_code.  A claim is honoured when the document is
    waiting or failed, fewer than three attempts were made and a timeout's
    cooldown is over; an outcome only when its token is the running attempt's.
    With ``stale_minutes`` an outcome must also come within that time, else the
    attempt has failed with the stale code when it is over.  ``as_of_us`` takes
    the state at a time (later events do not count); without it, time is up for
    every attempt that has no outcome.
    With at most three attempts, six partial aggregates settle every document,
    however many events it has.
    """
    if as_of_us is not None:
        events = events.filter(F.col("us") <= as_of_us)
    state = events.filter(F.col("kind") == "upload").groupBy(key).agg(F.min(F.struct("us", "seq")).alias("at")).select(
        key, F.struct(F.col("at"), F.lit("PENDING").alias("status"), F.lit(0).alias("attempts"),
                      F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("long").alias("started_us"),
                      F.lit(None).cast("long").alias("finished_us")).alias("s"))
    order = F.struct("us", "seq")
    later, s = order > F.col("s.at"), lambda f: F.col(f"s.{f}")

    def settle(kinds: tuple[str, ...], wanted: Column, event: Column) -> DataFrame:
        # Uploads ride along so that every document keeps a row through the
        # inner join, the form whose hot keys can be split at run time; the
        # state appears once per step, so the plan grows linearly.
        rows = events.filter(F.col("kind").isin("upload", *kinds))
        hit = F.when((F.col("kind") != "upload") & later & wanted, event)
        return rows.join(state, key).groupBy(key).agg(F.min(hit).alias("e"), F.any_value("s").alias("s"))

    for attempt in range(1, MAX_ATTEMPTS + 1):
        cool = F.when(s("error_code") == TIMEOUT_CODE, s("finished_us") + COOLDOWN_SECONDS * SECOND).otherwise(0)
        may_claim = s("status").isin("PENDING", "FAILED") & (s("attempts") == attempt - 1) & (F.col("us") >= cool)
        d, hit = settle(("claim",), may_claim, order), F.col("e").isNotNull()
        state = d.select(key, F.struct(
            F.coalesce("e", "s.at").alias("at"), F.when(hit, "PROCESSING").otherwise(s("status")).alias("status"),
            F.when(hit, attempt).otherwise(s("attempts")).alias("attempts"), F.when(~hit, s("error_code")).alias("error_code"),
            F.coalesce("e.us", "s.started_us").alias("started_us"), F.when(~hit, s("finished_us")).alias("finished_us")).alias("s"))
        open_now = (s("status") == "PROCESSING") & (s("attempts") == attempt)
        running, over, end = open_now & (F.col("token") == attempt), F.lit(False), F.lit(None).cast("long")
        if stale_minutes is not None:
            end = s("started_us") + stale_minutes * 60 * SECOND
            running &= F.col("us") <= end
            over = F.col("e").isNull() & open_now & (F.lit(True) if as_of_us is None else end < as_of_us)
        d = settle(("complete", "fail"), running, F.struct("us", "seq", "kind", "error_code"))
        state = d.select(key, F.struct(
            F.when(hit, F.struct("e.us", "e.seq")).when(over, F.struct(end.alias("us"), F.lit(_LAST).alias("seq"))).otherwise(s("at")).alias("at"),
            F.when(F.col("e.kind") == "complete", "COMPLETED").when(hit | over, "FAILED").otherwise(s("status")).alias("status"),
            s("attempts").alias("attempts"),
            F.when(F.col("e.kind") == "fail", F.col("e.error_code")).when(over, STALE_CODE).otherwise(s("error_code")).alias("error_code"),
            s("started_us").alias("started_us"), F.when(hit, F.col("e.us")).when(over, end).otherwise(s("finished_us")).alias("finished_us")).alias("s"))
    return state.select(key, *[s(c).alias(c) for c in ATTEMPT_COLUMNS])


def sweep_stale(states: DataFrame, now_us: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    """Running longer than the limit -> FAILED with the stale code."""
    stale = (F.col("status") == "PROCESSING") & (F.col("started_us") < now_us - minutes * 60 * SECOND)
    return _fail(states, stale, STALE_CODE, now_us)


def reset_orphans(states: DataFrame, now_us: Column) -> DataFrame:
    """Every running attempt -> FAILED with the restart code."""
    return _fail(states, F.col("status") == "PROCESSING", RESTART_CODE, now_us)


def _fail(states: DataFrame, which: Column, code: str, now_us: Column) -> DataFrame:
    return states.withColumns({"error_code": F.when(which, code).otherwise(F.col("error_code")),
                               "finished_us": F.when(which, now_us).otherwise(F.col("finished_us")),
                               "status": F.when(which, "FAILED").otherwise(F.col("status"))})
