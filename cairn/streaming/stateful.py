"""Streams: staging parts, touches and breakers as stateful operators; windows and watermarks as extensions.

States end: keys that see no event for a while, measured by the watermark, are forgotten, and events later than the watermark
allows are passed over. Within a batch a key's events are taken in order of time; an event that comes in a later batch
than one after it, but within the watermark, is taken when it comes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shared import shared_folder

LATE, IDLE = "1 hour", 7 * 86400


def file_stream(spark, path: str, schema, most_files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def run_once(df: DataFrame, what: str, mode: str) -> DataFrame:
    """All that is there now, as Parquet in the shared folder, a folder for each batch; a batch that is run again replaces its own."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/cairn-{what}-{uuid.uuid4().hex}"
    spark.createDataFrame([], df.schema).write.parquet(f"{folder}/rows/batch=-1")

    def put(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")

    q = df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/rows").select(*df.columns)


def _walked(log: DataFrame, key: str, at: str, fields: str, state: str, step: Callable, late: str, idle: int) -> DataFrame:
    """step(key, rows in order of time, state or None) gives a row of fields and the new state; states idle for so many seconds go."""
    stamped = log.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    names = [key, *(x.split()[0] for x in fields.split(", "))]

    def run(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(batches)).sort_values("_at", kind="stable")
        row, new = step(k[0], rows, held.get if held.exists else None)
        held.update(new)
        last = int(rows["_at"].max().timestamp() * 1000)
        held.setTimeoutTimestamp(max(last + idle * 1000, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({n: [v] for n, v in zip(names, (k[0], *row))})

    kind = log.schema[key].dataType.simpleString()
    return stamped.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {fields}", state, "update", GroupStateTimeout.EventTimeTimeout)


def touches(log: DataFrame, key: str, at: str, seconds: int = 300, late: str = LATE, idle: int = IDLE) -> DataFrame:
    """key, accepted, last so far, as each batch changes them: an access counts if more than so many seconds after the last
    accepted one."""

    def step(k, rows: pd.DataFrame, state: tuple | None) -> tuple[tuple, tuple]:
        n, last = state or (0, None)
        for t in rows[at]:
            now = t.value // 1000
            if last is None or now - last > seconds * 1_000_000:
                n, last = n + 1, now
        return (n, pd.Timestamp(last, unit="us")), (n, last)

    return _walked(log, key, at, "accepted long, last timestamp_ntz", "n long, last long", step, late, idle)


def staging(events: DataFrame, key: str, status: str, at: str, late: str = LATE, idle: int = IDLE, buckets: int = 4096) -> DataFrame:
    """key, status after each batch: requested, staging, complete, never backwards. A state holds the keys of one bucket, each with
    its own end, as there are many keys of few events: a call and a state a key would take most of the time."""
    order = ["requested", "staging", "complete"]
    ranks = {x: n for n, x in enumerate(order)}

    def run(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        known = {x: (n, end) for x, n, end in zip(*held.get)} if held.exists else {}
        now, seen = held.getCurrentWatermarkMs(), {}
        for b in [] if held.hasTimedOut else batches:
            keys = [None] * len(b) if k[0] is None else b[key].tolist()
            for x, s, t in zip(keys, b[status].tolist(), b["_ms"].tolist()):
                n, last = seen.get(x, (-1, 0))
                seen[x] = max(n, ranks.get(s, -1)), max(last, t)
        seen = {x: (max(n, known[x][0]) if x in known else n, max(last + idle * 1000, now + 1)) for x, (n, last) in seen.items()}
        known = {x: v for x, v in known.items() if v[1] >= now} | seen
        if known:
            held.update(tuple(map(list, zip(*((x, *v) for x, v in known.items())))))
            held.setTimeoutTimestamp(min(end for _, end in known.values()))
        else:
            held.remove()
        if seen:
            yield pd.DataFrame({key: list(seen), status: [order[n] if n >= 0 else None for n, _ in seen.values()]})

    kind = events.schema[key].dataType.simpleString()
    bucket = F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(buckets)))
    stamped = events.select(key, status, F.col(at).cast("timestamp").alias("_at")).withWatermark("_at", late)
    marked = stamped.select("*", F.unix_millis("_at").alias("_ms"), bucket.alias("_bucket"))
    return marked.groupBy("_bucket").applyInPandasWithState(run, f"{key} {kind}, {status} string", f"keys array<{kind}>, ranks array<int>, ends array<long>", "update", GroupStateTimeout.EventTimeTimeout)


def breakers(log: DataFrame, key: str, at: str, failed: str, threshold: int = 5, late: str = LATE, idle: int = IDLE, then: str | None = None) -> DataFrame:
    """key, failures in a row and open after each batch. then: what orders events of one time."""

    def step(k, rows: pd.DataFrame, state: tuple | None) -> tuple[tuple, tuple]:
        n = state[0] if state else 0
        for bad in rows.sort_values(["_at", *([then] if then else [])], kind="stable")[failed]:
            n = n + 1 if bad else 0
        return (n, n >= threshold), (n,)

    return _walked(log, key, at, "failures long, open boolean", "n long", step, late, idle)


def progressive(chunks: DataFrame, key: str = "nar_file_id", at: str | None = None, stall: int = 30, late: str = LATE) -> DataFrame:
    """key, ready, stalled: how many chunks from the first on are there without a gap, after each batch. With at, the time of a
    chunk, a key is stalled once the watermark is so many seconds past its last one, and then forgotten; without it every key is
    kept, for runs over what is there."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ready, ahead = (state.get[0], set(state.get[1])) if state.exists else (0, set())
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [k[0]], "ready": [ready], "stalled": [True]})
            return
        last = 0
        for b in batches:
            ahead |= {int(x) for x in b["chunk_index"] if x >= ready}
            if at:
                last = max(last, int(b["_at"].max().timestamp() * 1000))
        while ready in ahead:
            ahead.discard(ready)
            ready += 1
        state.update((ready, sorted(ahead)))
        if at:
            state.setTimeoutTimestamp(max(last + stall * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "ready": [ready], "stalled": [False]})

    kind = chunks.schema[key].dataType.simpleString()
    if at:
        chunks = chunks.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    limit = GroupStateTimeout.EventTimeTimeout if at else GroupStateTimeout.NoTimeout
    return chunks.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ready long, stalled boolean", "ready long, ahead array<long>", "update", limit)


def windowed(log: DataFrame, at: str, width: str, late: str, *keys: str) -> DataFrame:
    """Extension: counts in event-time windows, closed by a watermark."""
    stamped = log.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return stamped.groupBy(F.window("_at", width), *keys).agg(F.count(F.lit(1)).alias("n"))
