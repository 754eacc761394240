"""From raw rows to frames: fallbacks between columns, names resolved to sites, filters and joins of the report desk."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags that say nothing.
NO_TAG = ("N/A", "NA", "NONE", "UNKNOWN", "")
SOURCES = ("synthetic", "manual", "voice", "vision")


def said(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*(F.when(c != "", c) for c in columns))


def from_json(column: str, name: str) -> Column:
    """A field of a JSON cell: its label, else its text, else the plain value."""
    plain = F.get_json_object(column, f"$.{name}")
    return said(F.get_json_object(column, f"$.{name}.label"), F.get_json_object(column, f"$.{name}.text"), F.when(~plain.startswith("{"), plain))


def projected(rows: DataFrame, fields: Sequence[str], cell: str, truth: str | None = None) -> DataFrame:
    """Each field as ground truth has it, else its own column, else the JSON cell; other columns stay.

    truth names a struct column whose fields win; a field that it, or the rows, lack is taken from what is there.
    """
    own = set(rows.columns)
    known = set(rows.schema[truth].dataType.names) if truth else set()

    def value(f: str) -> Column:
        parts = [F.col(f"{truth}.{f}").cast("string")] if f in known else []
        parts += [F.col(f).cast("string")] if f in own else []
        return said(*parts, from_json(cell, f))

    return rows.withColumns({f: value(f) for f in fields})


def first_real_tag(*columns: str) -> Column:
    """The first tag that says something, else N/A."""
    return F.coalesce(*(F.when(~F.upper(F.trim(c)).isin(*NO_TAG), F.col(c)) for c in columns), F.lit("N/A"))


def known_source(column: str) -> Column:
    """One of SOURCES; anything else counts as synthetic."""
    return F.when(F.col(column).isin(*SOURCES), F.col(column)).otherwise("synthetic")


def resolved_sites(rows: DataFrame, name: str, aliases: DataFrame, default: str) -> DataFrame:
    """Adds `site`: what an alias of the trimmed name stands for, whatever its case, else the trimmed name, else the default for a blank.

    aliases: (alias, site), a canonical name being an alias of itself; an alias given twice stands for the first site by name.
    """
    known = aliases.groupBy(F.lower(F.trim("alias")).alias("alias__")).agg(F.min("site").alias("site"))
    trimmed = F.trim(F.coalesce(F.col(name), F.lit("")))
    out = rows.withColumn("alias__", F.lower(trimmed)).join(known, "alias__", "left")
    return out.withColumn("site", F.when(trimmed == "", default).otherwise(F.coalesce("site", trimmed))).drop("alias__")


def audit_page(log: DataFrame, limit: int, *, since: str | None = None, until: str | None = None, **equal) -> DataFrame:
    """Entries that equal all given values and lie in the given time, both ends included, newest first; a time that is none is ignored."""
    tests = [F.col(c) == v for c, v in equal.items() if v is not None]
    for moment, ok in ((since, lambda t: F.col("ts") >= t), (until, lambda t: F.col("ts") <= t)):
        if moment is not None:
            at = F.try_to_timestamp(F.lit(moment)).cast("timestamp_ntz")
            tests.append(F.coalesce(ok(at), at.isNull()))
    rows = log.where(reduce(lambda a, b: a & b, tests)) if tests else log
    return rows.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(limit)


def matching(rows: DataFrame, term: str, columns: Sequence[str]) -> DataFrame:
    """Rows of which a column holds the term, whatever its case; all rows for a blank term."""
    wanted = term.strip().lower()
    return rows.where(reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(wanted)) for c in columns)))


def with_actions(reports: DataFrame, actions: DataFrame, key: str, order: Sequence[str], said: str) -> DataFrame:
    """Reports with all their actions, in order: n_actions and an array; reports without any keep none. A report's actions are few: one row holds them all."""
    own = actions.groupBy(key).agg(F.count("*").alias("n_actions"), F.array_sort(F.collect_list(F.struct(*order, said))).alias("a__"))
    out = reports.join(own, key, "left")
    return out.withColumn("n_actions", F.coalesce("n_actions", F.lit(0).cast("long"))).withColumn("actions", F.transform(F.coalesce("a__", F.array()), lambda x: x[said])).drop("a__")
