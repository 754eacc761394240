"""Keyed event rules in batch form: throttling, cooldown, surges, hits, references, latest state, sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def admitted(events: DataFrame, keys: list[str], ts: str, seconds: float, order: str) -> DataFrame:
    """The events that a key's clock admits: the first, and each at least `seconds` after the last admitted one.

    A suppressed event does not move the clock, so this is a recurrence along
    each key. It runs over Arrow batches of the sorted partition and carries one
    time a key, so a key of any length is streamed, never gathered; Spark deals
    keys to tasks. Equal times are taken by `order`.
    """
    schema = events.schema
    columns = events.columns
    rows = events.repartition(*keys).sortWithinPartitions(*keys, ts, order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now_key, last = None, None
        for batch in batches:
            take = []
            for key, at in zip(batch[keys].itertuples(index=False, name=None), batch[ts], strict=True):
                if key != now_key:
                    now_key, last = key, None
                ok = last is None or (at - last).total_seconds() >= seconds
                take.append(ok)
                if ok:
                    last = at
            yield batch[take][columns]

    return rows.mapInPandas(run, schema)


def latest_state(events: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Upsert: the last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return events.withColumn("r__", F.row_number().over(w)).where("r__ = 1").drop("r__")


def hits_in_window(events: DataFrame, key: str, order: list[str], hit: Column, frames: int = 6, least: int = 2) -> DataFrame:
    """Adds `hits`, the hits of the last frames, and `active`."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(frames - 1), 0)
    return events.withColumn("hits", F.sum(hit.cast("long")).over(w)).withColumn("active", F.col("hits") >= least)


def reference_sample(events: DataFrame, key: str, ts: str, value: str, youngest: float, oldest: float) -> DataFrame:
    """Adds `ref`: the newest earlier value of the key whose age in seconds lies in [youngest, oldest]."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(micros).rangeBetween(-int(oldest * 1e6), -int(youngest * 1e6))
    return events.withColumn("ref", F.last(value).over(w))


def pulse(events: DataFrame, key: str, order: list[str], value: str, frames: int = 8, least: int = 4) -> DataFrame:
    """Adds `pulse`: population deviation over mean of the last frames, null under `least` of them."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(frames - 1), 0)
    enough = F.count(value).over(w) >= least
    return events.withColumn("pulse", F.when(enough, F.try_divide(F.stddev_pop(value).over(w), F.avg(value).over(w))))


def growth(events: DataFrame, key: str, order: list[str], value: str, frames: int = 8, least: int = 4) -> DataFrame:
    """Adds `growth`: mean of the last two less mean of the first two of the last frames."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(frames - 1), 0)
    held = F.collect_list(value).over(w)
    out = events.withColumn("h__", held)
    n = F.size("h__")
    return out.withColumn("growth", F.when(n >= least, F.expr("(h__[size(h__) - 1] + h__[size(h__) - 2]) / 2 - (h__[0] + h__[1]) / 2"))).drop("h__")


def adaptive_baseline(events: DataFrame, key: str, order: list[str], value: str, *, alpha: float = 0.10, slow: float = 0.02, obscured: float = 0.5, ready: int = 15) -> DataFrame:
    """Adds `baseline`: a running mean that follows slowly while a value falls under `obscured` of it; null until it is ready.

    Like admitted(), this streams each key's sorted rows and carries two numbers a key.
    """
    rows = events.repartition(key).sortWithinPartitions(key, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now_key, base, n = None, 0.0, 0
        for batch in batches:
            out = []
            for k, v in zip(batch[key], batch[value].astype(float), strict=True):
                if n == 0 or k != now_key:
                    now_key, base, n = k, v, 1
                else:
                    base += (slow if n >= ready and v < obscured * base else alpha) * (v - base)
                    n += 1
                out.append(base if n >= ready else None)
            yield batch.assign(baseline=pd.array(out, dtype="Float64"))

    return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + ", baseline double")
