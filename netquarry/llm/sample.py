"""Samples that match target category proportions (problem 3).

Every unit has a fixed pseudo-random priority. One pass keeps, for each stratum,
a reservoir: its count and its units by slice of priority. Reservoirs are
mergeable (counts add up, the units of a slice are put together), so each task
makes one for every ROWS_AT_ONCE of its units and nothing is merged that is not
needed: the final counts, a bounded table, give each plan's quota and the slice in
which it ends. A reservoir is then trimmed to the quota: the slices before that
one are taken whole where they stand, and only the slice itself is merged over
all tasks and cut at the lowest priorities. A quota is a share of all units and so
has no bound that is known beforehand; that is why slices, and not a fixed number
of units, bound what one task merges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.functions.columns import trimmed
from netquarry.session import cut, small

#: Slices of a stratum's reservoir; one task merges at most one of them, about 1/SLICES of a stratum.
SLICES = 4096
#: Units that one reservoir covers at most, besides the batch that fills it.
ROWS_AT_ONCE = 262_144
#: Bits of a priority.
PRIORITY_BITS = 48
STRATUM = ["unit_type", "gold_label"]


def category(c: Column) -> Column:
    """Trimmed of white space, lower case, blanks and hyphens as underscores; an empty one is null."""
    t = F.translate(F.lower(trimmed(c)), " -", "__")
    return F.when(t != "", t)


def stratified_units(units: DataFrame, seed: int) -> DataFrame:
    """(eval_unit_id, unit_type, gold_label, priority), once per id; units with a null category or id are in no stratum. The priority is the first 48 bits of MD5 over seed and id."""
    u = units.where("eval_unit_id is not null").select(F.col("eval_unit_id").cast("string").alias("eval_unit_id"), category(F.col("unit_type")).alias("unit_type"), category(F.col("gold_label")).alias("gold_label"))
    u = u.groupBy("eval_unit_id").agg(F.min(F.struct(*STRATUM)).alias("c")).select("eval_unit_id", "c.unit_type", "c.gold_label").where("unit_type is not null and gold_label is not null")
    drawn = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("eval_unit_id").cast("string"))), 1, PRIORITY_BITS // 4)
    return u.withColumn("priority", F.conv(drawn, 16, 10).cast("long"))


_RESERVOIR = "unit_type string, gold_label string, slice int, n long, ids array<string>, priorities array<long>"


def _fill(batches: Iterator[pa.RecordBatch], slices: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Reservoirs of a task's units: rows (stratum, slice, n, ids, priorities) with each slice in order of priority and id."""
    held: list[pa.RecordBatch] = []

    def reservoirs() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).sort_by([("unit_type", "ascending"), ("gold_label", "ascending"), ("priority", "ascending"), ("eval_unit_id", "ascending")]).combine_chunks()
        kind, label, ids = (t.column(c).chunk(0) for c in ("unit_type", "gold_label", "eval_unit_id"))
        priority = t.column("priority").to_numpy()
        where = (priority * slices) >> PRIORITY_BITS if slices < 1 << 14 else np.array([int(p) * slices >> PRIORITY_BITS for p in priority])
        a, b = (c.dictionary_encode().indices.to_numpy() for c in (kind, label))
        new = np.ones(len(where), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (where[1:] != where[:-1])
        first = np.flatnonzero(new)
        bounds = pa.array(np.append(first, len(where)), pa.int32())
        at = pa.array(first)
        lists = [pa.ListArray.from_arrays(bounds, x) for x in (ids, pa.array(priority))]
        return pa.RecordBatch.from_arrays([kind.take(at), label.take(at), pa.array(where[first], pa.int32()), pa.array(np.diff(bounds.to_numpy()), pa.int64()), *lists], ["unit_type", "gold_label", "slice", "n", "ids", "priorities"])

    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield reservoirs()
            held = []
    if held:
        yield reservoirs()


def reservoirs(units: DataFrame, seed: int = 0, slices: int = SLICES) -> DataFrame:
    """The reservoirs of all strata, written once: what counts, quotas and draws are read from."""
    rows = ROWS_AT_ONCE
    return cut(stratified_units(units, seed).select("eval_unit_id", *STRATUM, "priority").mapInArrow(lambda it: _fill(it, slices, rows), _RESERVOIR))


def slice_counts(held: DataFrame) -> DataFrame:
    """Merged counts: at most strata x slices rows."""
    return held.groupBy(*STRATUM, "slice").agg(F.sum("n").alias("n"))


def quotas(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """Per plan and stratum: available units, units wanted (the greater of min_units and target_share x sample_share x N, exactly), whether too few exist, and the quota drawn.

    A repeated target counts once, with its greatest min_units and shares; null
    shares and minima are 0. The quota is the want, rounded up, or all there are.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("decimal(18,0)")).scalar()
    there = counts.groupBy("unit_type", "gold_label").agg(F.sum("n").alias("available"))
    dec = lambda c: F.coalesce(F.col(c).cast("string").cast("decimal(12,9)"), F.lit(0))
    t = (
        targets.where("plan_id is not null")
        .select(
            F.col("plan_id").cast("long"),
            F.col("unit_type").alias("shown_type"),
            F.col("gold_label").alias("shown_label"),
            category(F.col("unit_type")).alias("unit_type"),
            category(F.col("gold_label")).alias("gold_label"),
            dec("target_share").alias("target_share"),
            dec("sample_share").alias("sample_share"),
            F.coalesce(F.col("min_units").cast("long"), F.lit(0)).alias("min_units"),
        )
        .where("unit_type is not null and gold_label is not null")
        .groupBy("plan_id", "unit_type", "gold_label")
        .agg(*[F.min(c).alias(c) for c in ("shown_type", "shown_label")], *[F.max(c).alias(c) for c in ("target_share", "sample_share", "min_units")])
    )
    q = t.join(there, ["unit_type", "gold_label"], "left").withColumn("available", F.coalesce("available", F.lit(0)))
    share = (F.col("target_share") * F.col("sample_share")).cast("decimal(20,18)") * total
    q = q.withColumn("wanted", F.greatest(share, F.col("min_units").cast("decimal(38,18)")))
    return q.withColumn("exhausted", F.col("available") < F.col("wanted")).withColumn("quota", F.least(F.col("available"), F.ceil("wanted").cast("long")))


def exhausted_strata(units: DataFrame, targets: DataFrame, seed: int = 0, slices: int = SLICES) -> DataFrame:
    """(plan_id, unit_type, gold_label) of each plan's stratum whose merged reservoir holds fewer units than the plan wants, written as in the targets."""
    q = quotas(slice_counts(reservoirs(units, seed, slices)), targets)
    return q.where("exhausted").select("plan_id", F.col("shown_type").alias("unit_type"), F.col("shown_label").alias("gold_label"))


def _merged(t: pa.Table) -> pa.Table:
    """One slice of a stratum from all its reservoirs: its units with their ranks by priority and id."""
    flat = pa.table({c: pa.concat_arrays([x.flatten() for x in t.column(c).chunks]) for c in ("ids", "priorities")}).sort_by([("priorities", "ascending"), ("ids", "ascending")])
    n = flat.num_rows
    same = lambda c: pa.array([t.column(c)[0].as_py()] * n, t.schema.field(c).type)
    return pa.table({"unit_type": same("unit_type"), "gold_label": same("gold_label"), "slice": same("slice"), "eval_unit_id": flat.column("ids"), "rank": np.arange(1, n + 1)})


def draw(units: DataFrame, targets: DataFrame, seed: int = 0, slices: int = SLICES) -> DataFrame:
    """The samples: (plan_id, unit_type, gold_label, eval_unit_id). Each stratum gives its units of lowest priority, a uniform draw; ties go by id. One plan's strata are disjoint; plans share units."""
    held = reservoirs(units, seed, slices)
    counts = cut(slice_counts(held))
    before = Window.partitionBy(*STRATUM).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # One row a plan and stratum: the slice its quota ends in, and how many units of that slice it takes.
    wanted = quotas(counts, targets).where("quota > 0").select("plan_id", *STRATUM, "quota")
    ends = placed.join(small(wanted), STRATUM).where("below < quota and quota <= below + n").select("plan_id", *STRATUM, F.col("slice").alias("end"), (F.col("quota") - F.col("below")).alias("take"))
    ends = cut(ends)
    whole = held.join(small(ends), STRATUM).where("slice < end").select("plan_id", *STRATUM, F.explode("ids").alias("eval_unit_id"))
    last = ends.select(*STRATUM, F.col("end").alias("slice")).distinct()
    ranked = held.join(small(last), [*STRATUM, "slice"]).groupBy(*STRATUM, "slice").applyInArrow(_merged, "unit_type string, gold_label string, slice int, eval_unit_id string, rank long")
    part = ranked.join(small(ends.withColumnRenamed("end", "slice")), [*STRATUM, "slice"]).where("rank <= take").select("plan_id", *STRATUM, "eval_unit_id")
    return whole.unionByName(part)


def report(units: DataFrame, targets: DataFrame, seed: int = 0, slices: int = SLICES) -> DataFrame:
    """One row a plan: total_selected, per_stratum_available, per_stratum_selected (maps of type:label) and the strata that ran out."""
    q = quotas(slice_counts(reservoirs(units, seed, slices)), targets).withColumn("stratum", F.concat_ws(":", *STRATUM))
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("stratum", c))))
    return q.groupBy("plan_id").agg(
        F.sum("quota").alias("total_selected"),
        entries("available").alias("per_stratum_available"),
        entries("quota").alias("per_stratum_selected"),
        F.array_sort(F.collect_list(F.when(F.col("exhausted"), F.col("stratum")))).alias("undersampled_strata"),
    )
