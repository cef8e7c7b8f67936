"""The ledger of units as tables: merges, deletion with what stays reachable, and its files by session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.operators import units as _units
from pagestrata.session import written

TABLES = ("observations", "canonical_units", "evidence_blocks", "evidence_blobs", "versions", "version_observations", "version_evidence")


def classes(links: DataFrame) -> DataFrame:
    """(id, root): connected classes of links(x, y), each named by its least id. Each round a member takes the least name among its
    own and its neighbours' and then that name's name, so that chains halve; it ends when a round changes nothing."""
    both = written(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "class-links")
    state = written(both.groupBy(F.col("x").alias("id")).agg(F.least(F.col("x"), F.min("y")).alias("root")), "class-state")
    while True:
        near = both.join(state.select(F.col("id").alias("y"), "root"), "y").groupBy(F.col("x").alias("id")).agg(F.min("root").alias("near"))
        step = state.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        far = step.select(F.col("id").alias("root"), F.col("root").alias("far"))
        step = written(step.join(far, "root").select("id", "old", F.least("root", "far").alias("root")), "class-state")
        state = step.select("id", "root")
        if step.where("root != old").isEmpty():
            return state


def merge(canonical: DataFrame, pairs: DataFrame) -> DataFrame:
    """canonical units(id, created_at, merged_into) after all pairs(first_id, second_id) are merged: the roots of a class of pairs point to its
    root that was created first (of equals the least id). Pairs with unknown or unresolved units are left out; a second merge of
    the same pairs changes nothing."""
    own = _units.once(canonical).select("id", "created_at", "merged_into")
    roots = written(_units.resolved(canonical).where("root is not null"), "merge-roots")
    side = lambda c, n: roots.select(F.col("id").alias(c), F.col("root").alias(n))
    links = pairs.select("first_id", "second_id").join(side("first_id", "x"), "first_id").join(side("second_id", "y"), "second_id").where("x != y").select("x", "y").distinct()
    of = classes(links).join(own.select("id", "created_at"), "id")
    oldest = of.groupBy("root").agg(F.min_by("id", F.struct("created_at", "id")).alias("target"))
    moved = of.join(oldest, "root").where("id != target").select("id", "target")
    return own.join(moved, "id", "left").select("id", "created_at", F.coalesce("target", "merged_into").alias("merged_into"))


def delete_observations(observations: DataFrame, canonical: DataFrame, blobs: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """The ledger's tables after the observations gone(id) are deleted: units without an observation of their own, blocks of deleted
    observations and texts that no block names go with them; versions are made anew from what is left."""
    left = _units.once(observations).join(gone.select("id"), "id", "left_anti")
    live = _units.once(canonical).join(left.select(F.col("canonical_unit_id").alias("id")).distinct(), "id", "left_semi")
    blocks = _units.evidence(left)
    return {
        "observations": left,
        "canonical_units": live,
        "evidence_blocks": blocks,
        "evidence_blobs": _units.once(blobs).join(blocks.select(F.col("evidence_blob_id").alias("id")).distinct(), "id", "left_semi"),
        "versions": _units.versions(left, live),
        "version_observations": _units.version_observations(left, live),
        "version_evidence": _units.version_links(left, live),
    }


def write(tables: dict[str, DataFrame], path: str) -> None:
    """Tables as folders; observations by session, so that a session can be pruned."""
    for name, rows in tables.items():
        out = rows.write.mode("overwrite")
        (out.partitionBy("session_id") if name == "observations" else out).parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """The ledger's tables; none of them if there is no ledger, ValueError if part of them is missing."""
    out = {}
    for name in names:
        try:
            out[name] = spark.read.parquet(f"{path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    if out and len(out) < len(names):
        raise ValueError(f"the ledger lacks {sorted(set(names) - set(out))}")
    return out


def prune_sessions(observations: DataFrame, keep: DataFrame) -> DataFrame:
    """Observations of the sessions keep(session_id) alone."""
    return observations.join(keep.select("session_id").distinct(), "session_id", "left_semi")
