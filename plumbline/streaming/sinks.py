"""Writers that may see a batch twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def idempotent(path: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, partition: str = "batch_id") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch replaces its own partition, so a repeated batch leaves one copy."""

    def write(df: DataFrame, batch_id: int) -> None:
        transform(df).write.mode("overwrite").parquet(f"{path}/{partition}={batch_id}")

    return write


def reports_of_events(path: str, narrative: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: events become narratives, narratives assessed reports; both tables are written by batch."""
    from ..operators.reports import assessed

    events, reports = idempotent(f"{path}/events"), idempotent(f"{path}/reports", lambda df: assessed(narrative(df)))

    def write(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        try:
            events(df, batch_id)
            reports(df, batch_id)
        finally:
            df.unpersist()

    return write
