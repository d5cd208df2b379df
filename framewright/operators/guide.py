"""Listings and schedules: interval search, coalescing, repeats, slots, device conflicts, lookups with fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Seconds that a search reaches over its window, and into what starts after it.
SLACK, AHEAD, SLOT = 1, 1801, 1800


def seconds(c: str) -> Column:
    """A TIMESTAMP_NTZ as whole seconds since 1970."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{c}`)")


def overlap_search(df: DataFrame, start: Column, stop: Column, t0: int, t1: int) -> DataFrame:
    """Listings on the air in [t0, t1] or starting up to half an hour after. Plain comparisons, so that they push down."""
    on_air = (start < t0 + SLACK) & (stop > t0 - SLACK)
    begins = (start > t0 - SLACK) & (start < t1 + AHEAD)
    return df.filter(on_air | begins)


def next_listing(df: DataFrame, key: str, start: Column, stop: Column, t: int, tie: str) -> DataFrame:
    """Each key's first listing that starts within half an hour of t or is running at t."""
    cols = df.columns
    near = df.filter((start < t + SLOT) & (stop > t)).withColumn("__s", start)
    return near.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct("__s", tie)).alias("__r")).select("__r.*")


def coalesce_listings(df: DataFrame, key: list[str], start: str, stop: str) -> DataFrame:
    """Listings of one key that touch end to start become one: key, start, stop, n. Exact repeats count once."""
    w = Window.partitionBy(*key).orderBy(start, stop)
    d = df.select(*key, start, stop).distinct()
    fresh = F.coalesce(F.col(start) != F.lag(stop).over(w), F.lit(True)).cast("long")
    d = d.withColumn("__new", fresh).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*key, "__run").agg(F.min(start).alias(start), F.max(stop).alias(stop), F.count("*").alias("n")).drop("__run")


def repeats(df: DataFrame, rule: Column, start: str, steps: int) -> DataFrame:
    """The next `steps` starts by rule: daily and weekdays a day on, weekly a week on; once has none."""
    gap = F.when(rule.isin("daily", "weekdays"), 1).when(rule == "weekly", 7)
    on = df.withColumn("__gap", gap).filter("__gap IS NOT NULL").withColumn("step", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(steps).cast("long"))))
    return on.withColumn(start, F.col(start) + F.expr("make_dt_interval(CAST(__gap * step AS INT))")).drop("__gap")


def slot_grid(df: DataFrame, start: Column, stop: Column, slot: int = SLOT) -> DataFrame:
    """One row for each slot that a listing touches: slot (start second of the slot)."""
    lo, hi = F.floor(start / slot), F.floor((F.greatest(stop, start + 1) - 1) / slot)
    return df.withColumn("slot", F.explode(F.transform(F.sequence(lo, hi), lambda k: k * slot)))


def due(df: DataFrame, start: Column, stop: Column, now: int, lead: int = 30) -> DataFrame:
    """Jobs with their state at a time: expired if over, due from `lead` seconds before the start, else waiting."""
    return df.withColumn("state", F.when(stop <= now, "expired").when(start - lead <= now, "due").otherwise("waiting"))


def device_conflicts(df: DataFrame, device: str, start: str, stop: str, tie: str) -> DataFrame:
    """Jobs that begin while an earlier one of their device runs: conflict boolean."""
    w = Window.partitionBy(device).orderBy(start, tie).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("conflict", F.coalesce(F.col(start) < F.max(stop).over(w), F.lit(False)))


def with_fallback(df: DataFrame, key: str, lookups: list[tuple[DataFrame, str, str]], out: str) -> DataFrame:
    """Looks key up in (table, column, value) after (table, column, value); the key itself where all miss. Each lookup
    column must be unique; Catalyst broadcasts a table where its size is known to be small."""
    found = []
    for i, (t, column, value) in enumerate(lookups):
        t = t.select(F.col(column).cast("string").alias(f"__k{i}"), F.col(value).cast("string").alias(f"__v{i}"))
        df = df.join(t, F.col(key).cast("string") == F.col(f"__k{i}"), "left")
        found.append(F.col(f"__v{i}"))
    return df.withColumn(out, F.coalesce(*found, F.col(key).cast("string"))).drop(*[f"__{c}{i}" for i in range(len(lookups)) for c in "kv"])


def append_entries(old: DataFrame, new: DataFrame, key: list[str], start: str, stop: str, length: str, title: str) -> DataFrame:
    """New listings join old ones of their key (station and title id): key, start, stop, length, title.

    A new one with the start or the stop of an old one, or of a new one before it (by the other end, then title), is a
    repeat and goes; of new ones equal in all columns one stays. One that starts where the listing before it (by start,
    stop, title) stops extends it: lengths add up, and a title with ".." past its beginning gives way to the next. Old
    listings are not joined with each other."""
    columns = [*key, start, stop, length, title]
    for end in (start, stop):
        new = new.join(old.select(*key, end).distinct(), [*key, end], "left_anti")
    # Equal ones share a rank: two sorts may number them differently, and then each would be a repeat of the other.
    first = lambda end, other: F.rank().over(Window.partitionBy(*key, end).orderBy(other, title, length))
    new = new.withColumn("__a", first(start, stop)).withColumn("__z", first(stop, start)).filter("__a = 1 AND __z = 1").select(*columns).distinct()
    w = Window.partitionBy(*key).orderBy(start, stop, "__new", title, length)
    d = old.select(*columns, F.lit(False).alias("__new")).unionByName(new.withColumn("__new", F.lit(True)))
    joins = F.coalesce(F.col("__new") & (F.col(start) == F.lag(stop).over(w)), F.lit(False))
    d = d.withColumn("__n", F.row_number().over(w)).withColumn("__fresh", (~joins).cast("long"))
    d = d.withColumn("__run", F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.when(F.instr(title, "..") <= 1, F.col("__n"))
    named = F.coalesce(F.min_by(title, whole), F.max_by(title, "__n"))
    return d.groupBy(*key, "__run").agg(F.min(start).alias(start), F.max(stop).alias(stop), F.sum(length).alias(length), named.alias(title)).drop("__run")


def put_rows(table: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """The table with rows put in: those of a known key take the place of the old ones, others are new. A null in a key
    is a value like others."""
    known = rows.select(*[F.col(k).alias(f"__{k}") for k in key])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    return table.join(known, same, "left_anti").unionByName(rows.select(*table.columns))


def drop_rows(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def minutes(start: Column, stop: Column) -> Column:
    """Whole minutes of a listing."""
    return F.call_function("div", stop - start, F.lit(60))
