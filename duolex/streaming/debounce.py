"""Debounce: a change fires after `gap` of quiet with the latest value; an empty one is silent."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from duolex.operators.joins import join_null_safe

GAP_SECONDS = 1
# A time bucket spans this many gaps, so a busy key becomes many small windows.
BUCKET_GAPS = 4096
# A stream's keys share so many rows of state. A running stream's checkpoint depends on it.
KEY_GROUPS = 1024


def _silent(value: str, empty: str):
    return F.col(value).isNotNull() & (F.col(value) != empty)


def settle(pending: list, gap: int, passed: int) -> tuple[list, list]:
    """Split (micros, order, value) into what fires and what stays, once no event up to `passed` can come.

    An event within the gap of a later one never fires; it stays only as long as an event still to
    come could be older. Of the others those whose quiet has passed leave.
    """
    pending = sorted(pending, key=lambda e: (e[0], (e[1] is not None, e[1])))
    fires, stays = [], []
    for event, later in zip(pending, [*pending[1:], None]):
        replaced = later is not None and later[0] - event[0] <= gap
        if event[0] + (0 if replaced else gap) > passed:
            stays.append(event)
        elif not replaced:
            fires.append(event)
    return fires, stays


def _plain(cell):
    """Null for what pandas puts in a column in its place."""
    return None if cell is None or cell != cell else cell


def _timers(value: str, gap: int, empty: str):
    """Keeps the open events of each of a group's keys, with one timer for the first that may fire;
    a row for each key lists what fires."""

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending = dict(json.loads(state.get[0])) if state.exists else {}
        for batch in batches:
            # Plain lists: frames of a few rows for each key cost far more than those rows.
            columns = [batch[c].tolist() for c in ("_key", "_at", "_order", value)]
            for k, at, order, told in zip(*columns):
                pending.setdefault(_plain(k), []).append((int(at), _plain(order), _plain(told)))
        # Before the first watermark nothing has passed.
        passed = max(state.getCurrentWatermarkMs(), 0) * 1000
        open_events, due, fired = [], [], {"_key": [], "_fired": []}
        for k, events in pending.items():
            fires, stays = settle(events, gap, passed)
            if stays:
                open_events.append((k, stays))
                due += [-(-(e[0] + gap) // 1000) for e in settle(stays, gap, 1 << 62)[0]]
            told = [{"_at": e[0], value: e[2]} for e in fires if e[2] is not None and e[2] != empty]
            if told:
                fired["_key"].append(k)
                fired["_fired"].append(told)
        if open_events:
            state.update((json.dumps(open_events),))
            # The earliest time at which one of them has seen its quiet; a later event of the key
            # moves it, an empty one leaves nothing to fire at it.
            state.setTimeoutTimestamp(min(due))
        elif state.exists:
            state.remove()
        if fired["_key"]:
            yield pd.DataFrame(fired, dtype=object)

    return run


def debounce_stream(
    events: DataFrame,
    key: str,
    ts: str,
    value: str,
    order: str,
    gap_seconds: int = GAP_SECONDS,
    watermark_seconds: int | None = None,
    empty: str = "",
) -> DataFrame:
    """(key, fired_at, value) over a stream of (key, ts TIMESTAMP, value, order).

    Each key has its open events as state, carried from batch to batch, and a time at which they
    fire that every new event sets anew; an empty value cancels what was waiting. Keys of equal hash
    share a row of state and its timer, as a call costs far more than the events of a key. `order`
    breaks equal times. Events later than the watermark are dropped. The watermark is never shorter than the gap.
    """
    delay = max(gap_seconds, watermark_seconds or 0)
    gap = gap_seconds * 1_000_000
    typed = events.withWatermark(ts, f"{delay} seconds").filter(F.col(ts).isNotNull())
    held = typed.schema[key].dataType
    # As text a key is itself again, whatever the other keys of its group: a null makes no number a fraction.
    text = F.hex(key) if isinstance(held, T.BinaryType) else F.col(key).cast("string")
    typed = typed.select(text.alias("_key"), ts, F.unix_micros(ts).alias("_at"), F.col(order).alias("_order"), value)
    typed = typed.withColumn("_group", F.pmod(F.xxhash64("_key"), F.lit(KEY_GROUPS)))
    fires = T.ArrayType(T.StructType([T.StructField("_at", T.LongType()), typed.schema[value]]))
    out = T.StructType([T.StructField("_key", T.StringType()), T.StructField("_fired", fires)])
    fired = typed.groupBy("_group").applyInPandasWithState(
        _timers(value, gap, empty), out, "pending string", "append", GroupStateTimeout.EventTimeTimeout
    )
    again = F.unhex("_key") if isinstance(held, T.BinaryType) else F.col("_key").cast(held)
    each = fired.select(again.alias(key), F.inline("_fired"))
    return each.select(key, F.timestamp_micros(F.col("_at") + gap).alias("fired_at"), value)


def debounce(
    events: DataFrame,
    key: str,
    ts: str,
    value: str,
    order: str,
    gap_seconds: int = GAP_SECONDS,
    empty: str = "",
) -> DataFrame:
    """The same over a bounded table, however many events one key has.

    An event fires when the key's next event is more than a gap away. The next event is looked
    for inside a time bucket; the last one of a bucket finds it in the key's next non-empty
    bucket, from a table with one row per key and bucket.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = gap_seconds * 1_000_000
    # An event without a time has no place in the order, here as in the stream.
    timed = events.filter(F.col(ts).isNotNull()).select(key, value, order, micros.alias("_at"))
    timed = timed.withColumn("_bucket", F.floor(F.col("_at") / F.lit(gap * BUCKET_GAPS)))
    inside = Window.partitionBy(key, "_bucket").orderBy("_at", order)
    following = timed.withColumn("_next", F.lead("_at").over(inside))
    firsts = timed.groupBy(key, "_bucket").agg(F.min("_at").alias("_first"))
    ahead = firsts.select(
        key, "_bucket", F.lead("_first").over(Window.partitionBy(key).orderBy("_bucket")).alias("_later")
    )
    linked = join_null_safe(following, ahead, [key, "_bucket"])
    after = F.coalesce("_next", "_later")
    fires = after.isNull() | (after - F.col("_at") > gap)
    fired_at = F.timestamp_micros(F.col("_at") + gap)
    return linked.filter(fires & _silent(value, empty)).select(key, fired_at.alias("fired_at"), value)
