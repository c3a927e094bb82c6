"""Event logs: bursts, debounce, rate limits, buffers, counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairoscope.operators.retrieval import small


#: Stretches of time, in windows, that the rows of one key are dealt to.
STRETCH = 64


def _interval(micros: int) -> str:
    return f"{micros // 1_000_000} seconds {micros % 1_000_000} microseconds"


def latest_burst(events: DataFrame, key: str, ts: str, idle_seconds: float) -> DataFrame:
    """Of each key the newest events whose gaps are at most ``idle_seconds``; events without a time are in none.

    Session windows merge bursts in partial aggregates, so that a key's events need not meet in one sort.
    """
    longer = _interval(int(idle_seconds * 1e6) + 1)  # a gap of exactly the idle time still joins
    bursts = events.groupBy(key, F.session_window(F.col(ts), longer).alias("__burst")).agg(F.count("*").alias("__n"))
    # The count is used, as an aggregation without functions below another one is taken for redundant, windows or not.
    last = small(bursts.groupBy(key).agg(F.max(F.struct(F.col("__burst.start").alias("start"), "__n")).alias("__last")).select(key, F.col("__last.start").alias("__start")))
    return events.join(last, key).where(F.col(ts) >= F.col("__start")).drop("__start").select(*events.columns)


def debounce(events: DataFrame, keys: list[str], ts: str, wait_seconds: float) -> DataFrame:
    """The events that are ``wait_seconds`` or more after the last accepted one of their key.

    A gap of that length makes the next event accepted whatever came before, so each key splits into
    runs between such gaps. Session windows find the runs in partial aggregates; events are joined with them by
    stretches of time, and runs are dealt out one by one: a hot key is one task's only while it never pauses.
    A task reads its sorted runs as a stream and remembers one moment. Events without a time are not accepted.
    """
    wait = max(1, int(wait_seconds * 1e6))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    stretch = STRETCH * wait
    runs = events.groupBy(*keys, F.session_window(F.col(ts), _interval(wait)).alias("w")).agg(F.count("*").alias("n"))
    runs = runs.select(*keys, micros("w.start").alias("__run"), (micros("w.end") - wait).alias("__last"))
    place = lambda c: F.floor(F.col(c) / F.lit(stretch)).cast("long")
    runs = runs.withColumn("__stretch", F.explode(F.sequence(place("__run"), place("__last"))))
    rows = events.withColumn("__us", micros(ts)).withColumn("__stretch", place("__us"))
    rows = rows.join(runs, [*keys, "__stretch"]).where("__us BETWEEN __run AND __last").select(*events.columns, "__us", "__run")
    rows = rows.repartition(*keys, "__run").sortWithinPartitions(*keys, "__run", "__us", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, last = None, 0
        for batch in batches:
            keep = []
            for *key, us in zip(*(batch[c].tolist() for c in [*keys, "__run", "__us"]), strict=True):
                ok = key != of or us - last >= wait
                of, last = key, us if ok else last
                keep.append(ok)
            yield batch[keep]

    return rows.mapInPandas(run, rows.schema).drop("__us", "__run")


def _in_stretches(events: DataFrame, key: str, ts: str, seconds: int, sums: dict[str, Column]) -> DataFrame:
    """``events`` with windowed ``sums`` over the events of their key in the seconds up to and with them.

    A key's events are dealt to stretches of time; those whose window reaches into the stretch after theirs are
    copied to it, to be counted and left out.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    reach, stretch = seconds * 1_000_000, STRETCH * seconds * 1_000_000
    own = F.floor(us / F.lit(stretch)).cast("long")
    both = F.array(F.struct(own.alias("at"), F.lit(True).alias("own")), F.struct((own + 1).alias("at"), F.lit(False).alias("own")))
    near = F.when(us + reach >= (own + 1) * stretch, both).otherwise(F.slice(both, 1, 1))
    rows = events.withColumn("__us", us).withColumn("__p", F.explode(near))
    window = Window.partitionBy(key, "__p.at").orderBy("__us").rangeBetween(-reach, 0)
    return rows.withColumns({name: of.over(window) for name, of in sums.items()}).where("__p.own").drop("__us", "__p")


def calls_in_window(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """``events`` with the number of events of their key in the seconds up to and with them."""
    return _in_stretches(events, key, ts, seconds, {"calls": F.count("*")})


def trailing_debounce(events: DataFrame, keys: list[str], ts: str, gap: str, event_id: str) -> DataFrame:
    """keys, event_id, merged: of each run of events whose gaps stay below ``gap``, the last one and how many there were.

    Session windows merge runs in partial aggregates, so that a key's events need not meet in one sort.
    """
    rows = events.groupBy(*keys, F.session_window(F.col(ts), gap).alias("run")).agg(F.max_by(event_id, F.struct(ts, event_id)).alias(event_id), F.count("*").alias("merged"))
    return rows.drop("run")


def quota(events: DataFrame, key: str, ts: str, tokens: str, seconds: int, most_requests: int, most_tokens: float) -> DataFrame:
    """``events`` with the requests and tokens of their key in the seconds up to and with them, and whether both stay within the quota."""
    rows = _in_stretches(events, key, ts, seconds, {"requests": F.count("*"), "__tokens": F.sum(tokens)})
    rows = rows.withColumn("tokens", F.round("__tokens", 6)).drop("__tokens")
    return rows.withColumn("admitted", (F.col("requests") <= most_requests) & (F.col("tokens") <= most_tokens))


def ready_bursts(events: DataFrame, key: str, ts: str, now: DataFrame, idle_seconds: int, recent_seconds: int) -> DataFrame:
    """key, newest: keys whose newest event is at least ``idle_seconds`` and at most ``recent_seconds`` before the one row of ``now``."""
    last = events.groupBy(key).agg(F.max(ts).alias("newest")).crossJoin(F.broadcast(now))  # one row
    seconds = lambda c: F.col(c).cast("timestamp").cast("double")
    return last.where((seconds("now") - seconds("newest")).between(idle_seconds, recent_seconds)).drop("now")


def newest(events: DataFrame, order: list, keep: int) -> DataFrame:
    """The newest rows, as a buffer of fixed size keeps them."""
    return events.orderBy(*order).limit(keep)


def counters(events: DataFrame, keys: list[str], amount: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.sum(amount), 4).alias("total"))


def nearest_rank_p95(events: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean and p95 (the value at place ceil(0.95 n) of the sorted values)."""
    return events.groupBy(*keys).agg(F.round(F.avg(value), 6).alias("mean"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"))


def dedupe_changes(changes: DataFrame, scope: str, key: list[str], payload: list[str], order: str) -> DataFrame:
    """Of replayed change rows, the first of each scope, key and content."""
    signature = F.sha2(F.to_json(F.struct(*payload)).cast("binary"), 256)
    rows = changes.withColumn("__signature", signature)
    first = Window.partitionBy(scope, *key, "__signature").orderBy(order)
    return rows.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r", "__signature")
