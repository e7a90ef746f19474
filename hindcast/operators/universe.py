"""The scan universe: verified listings, the last good snapshot, and what retention keeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.functions.text import merge_universe

MEMBER = "array<struct<symbol:string,name:string,sector:string,list:string>>"


def universe(listings: list[tuple[DataFrame, int, bool]], snapshots: DataFrame, source: str) -> DataFrame:
    """One row: id, source, constituents, constituent_count, stale, missing.

    ``listings`` holds (rows of symbol, name, sector, list; least number of rows; required).
    A required listing under its least number leaves the last good snapshot in place (stale);
    an optional one is left out and named in ``missing`` by its number.  Sizes are counted in
    the plan, so a listing is read once for its size and once for its rows.  With nothing
    verified and no snapshot there is no row.
    """
    sizes = reduce(lambda a, b: a.unionByName(b), [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(i).alias("o"), "rows", F.lit(least).alias("least"), F.lit(needed).alias("needed")) for i, (df, least, needed) in enumerate(listings)])
    gate = sizes.agg(
        F.bool_and(~F.col("needed") | (F.col("rows") >= F.col("least"))).alias("good"), F.array_sort(F.collect_list(F.when(F.col("rows") >= F.col("least"), F.col("o")))).alias("used"),
        F.array_sort(F.collect_list(F.when((F.col("rows") < F.col("least")) & ~F.col("needed"), F.col("o")))).alias("missing"),
    ).first()  # one row of at most a number a listing
    last = snapshots.agg(F.max("id").alias("last"), F.max_by(F.struct(*sorted(snapshots.columns)), "id").alias("s"))
    if gate.good and gate.used:
        members = merge_universe([listings[i][0] for i in gate.used]).select("symbol", "name", "sector", "list")
        # a snapshot is a row by contract: some thousand names
        row = members.agg(F.array_sort(F.collect_list(F.struct("symbol", "name", "sector", "list"))).cast(MEMBER).alias("constituents"))
        row = row.where(F.size("constituents") > 0)
        number = last.select((F.coalesce("last", F.lit(0)) + 1).cast("long").alias("id"))
        return row.join(F.broadcast(number), F.lit(True)).select(
            "id", F.lit(source).alias("source"), "constituents", F.size("constituents").alias("constituent_count"), F.lit(False).alias("stale"), F.lit(list(gate.missing)).cast("array<int>").alias("missing")
        )
    held = last.where("last is not null").select("s.id", "s.source", F.col("s.constituents").cast(MEMBER).alias("constituents"))
    return held.select(F.col("id").cast("long").alias("id"), "source", "constituents", F.size("constituents").alias("constituent_count"), F.lit(True).alias("stale"), F.array().cast("array<int>").alias("missing"))


def retained_runs(runs: DataFrame, most: int) -> DataFrame:
    """The latest ``most`` runs by session, then id; a run is a row, so the sort is a top-k."""
    return runs.orderBy(F.col("session_date").desc(), F.col("id").desc()).limit(most)


def retained_universes(universes: DataFrame, *references: DataFrame) -> DataFrame:
    """Universes that a run, a forecast or a report still names; the others go."""
    named = reduce(lambda a, b: a.unionByName(b), [r.select("universe_id").where("universe_id is not null").distinct() for r in references]).distinct()
    return universes.join(named, universes["id"] == named["universe_id"], "left_semi")
