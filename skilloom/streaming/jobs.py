"""Structured Streaming versions of the time-driven rules.

Each job keeps one small state per key.  Events are held back until the
watermark passes them and then applied in (time, sequence) order, so late rows
cannot reorder a decision that was already made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skilloom.operators import lifecycle as lc
from skilloom.operators.requirements import with_requirements
from skilloom.operators.skills import with_skills
from skilloom.sources import store

STATE = T.StructType([T.StructField("blob", T.StringType())])


def _ordered_fold(events: DataFrame, key: str, ts: str, seq: str, fields: tuple[str, ...], output: T.StructType, delay: str,
                  initial: Callable[[], dict], step: Callable[[dict, dict], dict | None], on_time: Callable[[dict, int], list[dict]] | None = None,
                  wake: Callable[[dict], int | None] | None = None, spent: Callable[[dict], int | None] | None = None) -> DataFrame:
    """Fold events per key in order behind the watermark.

    ``step(state, event)`` mutates the state and may return an output row;
    ``on_time(state, watermark_us)`` fires timers; ``wake(state)`` says when.
    Waiting events are bounded by the watermark delay.  ``spent(state)`` says
    from when on a key's state is of no more use (None: never); it is removed
    once the watermark has passed that time and nothing waits.
    """
    zoneless = isinstance(events.schema[ts].dataType, T.TimestampNTZType)
    # Zone-less times become instants as UTC, whatever the session zone and its clock changes.
    instant = F.timestamp_micros(lc.micros(ts)) if zoneless else F.col(ts)
    d = (events.withColumn("_ts", instant).withWatermark("_ts", delay)
         .withColumn("_us", F.unix_micros("_ts")))
    cols = [key, "_us", seq, *fields]

    def run(key_tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import json
        kept = json.loads(state.get[0]) if state.exists else {"wait": [], "fold": initial()}
        mark = state.getCurrentWatermarkMs() * 1000
        rows: list[dict] = []
        if not state.hasTimedOut:
            for pdf in batches:
                kept["wait"] += json.loads(pdf[cols].to_json(orient="records"))
        kept["wait"].sort(key=lambda e: (e["_us"], e[seq]))
        ready = [e for e in kept["wait"] if e["_us"] <= mark]
        kept["wait"] = kept["wait"][len(ready):]
        for e in ready:
            if on_time:
                rows += on_time(kept["fold"], e["_us"])
            row = step(kept["fold"], e)
            if row is not None:
                rows.append(row)
        if on_time:
            rows += on_time(kept["fold"], mark)
        due = [e["_us"] for e in kept["wait"][:1]]
        ends = spent(kept["fold"]) if spent and not due else None
        later = wake(kept["fold"]) if wake else None
        due += [t for t in (later, ends) if t is not None]
        if ends is not None and ends <= mark:
            state.remove()
        else:
            state.update((json.dumps(kept),))
        if due and state.exists:
            state.setTimeoutTimestamp(max(min(due) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        names = output.fieldNames()
        if rows:
            yield pd.DataFrame([{n: (key_tuple[0] if n == key else r.get(n)) for n in names} for r in rows], columns=names)

    return d.select(*cols, "_ts").groupBy(key).applyInPandasWithState(
        run, output, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def rate_limit_stream(events: DataFrame, key: str, ts: str, seq: str, window_seconds: int = lc.RATE_WINDOW_SECONDS,
                      limit: int = lc.RATE_LIMIT, delay: str = "1 minute") -> DataFrame:
    """key, seq, accepted, retry_after_seconds for every request."""
    us = window_seconds * lc.SECOND
    out = T.StructType([events.schema[key], T.StructField(seq, T.LongType()), T.StructField("accepted", T.BooleanType()),
                        T.StructField("retry_after_seconds", T.LongType())])

    def step(s: dict, e: dict) -> dict:
        s["log"] = [t for t in s["log"] if e["_us"] - t < us]
        ok = len(s["log"]) < limit
        wait = None if ok else max(1, -(-(s["log"][0] + us - e["_us"]) // 1_000_000))
        if ok:
            s["log"].append(e["_us"])
        return {seq: e[seq], "accepted": ok, "retry_after_seconds": wait}

    def spent(s: dict) -> int:
        return s["log"][-1] + us if s["log"] else 0

    return _ordered_fold(events, key, ts, seq, (), out, delay, lambda: {"log": []}, step, spent=spent)


ATTEMPT_OUTPUT = [T.StructField("seq", T.LongType()), T.StructField("at_us", T.LongType()), T.StructField("status", T.StringType()),
                  T.StructField("attempts", T.LongType()), T.StructField("error_code", T.StringType())]


def attempt_stream(events: DataFrame, key: str = "doc_id", ts: str = "ts", seq: str = "seq", delay: str = "1 minute",
                   stale_minutes: int | None = None, forget_minutes: int | None = None) -> DataFrame:
    """Every applied status change per document; with ``stale_minutes`` also the stale sweep.

    With ``forget_minutes`` the state of a document that can change no more is
    removed so long after its end; an upload that comes later begins anew.
    """
    out = T.StructType([events.schema[key], *ATTEMPT_OUTPUT])
    limit, cool, timeout_code, stale_code = lc.MAX_ATTEMPTS, lc.COOLDOWN_SECONDS * lc.SECOND, lc.TIMEOUT_CODE, lc.STALE_CODE
    stale_us = None if stale_minutes is None else stale_minutes * 60 * lc.SECOND

    def change(s: dict, e_seq, at: int, **to) -> dict:
        s.update(to)
        return {"seq": e_seq, "at_us": at, "status": s["status"], "attempts": s["attempts"], "error_code": s["error"]}

    def step(s: dict, e: dict) -> dict | None:
        kind, now = e["kind"], e["_us"]
        if kind == "upload" and s["status"] is None:
            return change(s, e[seq], now, status="PENDING")
        if kind == "claim" and s["status"] in ("PENDING", "FAILED") and s["attempts"] < limit:
            if s["error"] == timeout_code and now < s["end"] + cool:
                return None
            return change(s, e[seq], now, status="PROCESSING", attempts=s["attempts"] + 1, error=None, start=now)
        if kind in ("complete", "fail") and s["status"] == "PROCESSING" and e["token"] == s["attempts"]:
            done = kind == "complete"
            return change(s, e[seq], now, status="COMPLETED" if done else "FAILED", error=None if done else e["error_code"], end=now)
        return None

    def on_time(s: dict, mark: int) -> list[dict]:
        if stale_us is None or s["status"] != "PROCESSING" or mark <= s["start"] + stale_us:
            return []
        at = s["start"] + stale_us
        return [change(s, None, at, status="FAILED", error=stale_code, end=at)]

    def wake(s: dict) -> int | None:
        return s["start"] + stale_us + 1000 if stale_us is not None and s["status"] == "PROCESSING" else None

    def spent(s: dict) -> int | None:
        if s["status"] is None:
            return 0
        final = s["status"] == "COMPLETED" or (s["status"] == "FAILED" and s["attempts"] >= limit)
        return s["end"] + forget_minutes * 60 * lc.SECOND if final and forget_minutes is not None else None

    return _ordered_fold(events, key, ts, seq, ("kind", "token", "error_code"), out, delay,
                         lambda: {"status": None, "attempts": 0, "error": None, "start": 0, "end": 0}, step, on_time, wake, spent)


def score_documents(resumes: DataFrame) -> DataFrame:
    """Stateless: new resume rows get their skills."""
    return with_skills(resumes, "extracted_text")


def score_jobs(jobs: DataFrame) -> DataFrame:
    """Stateless: new job rows get their requirements."""
    return with_requirements(jobs, "description")


def into_store(rows: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, name: str, checkpoint: str) -> DataStreamWriter:
    """Writer that scores every micro-batch and commits it to the store at ``path`` as batch ``name/<batch id>``.

    The checkpoint gives a replayed micro-batch the same id and rows, and the
    store takes an id once, so a run that dies between the two commits neither
    loses nor repeats anything.  Streams of several sides may share a store under
    names of their own.
    """
    def commit(batch: DataFrame, batch_id: int) -> None:
        store.write_analyses(score(batch), path, f"{name}/{batch_id}")

    return rows.writeStream.queryName(name).foreachBatch(commit).option("checkpointLocation", checkpoint)
