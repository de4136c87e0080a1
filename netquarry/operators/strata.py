"""Fixed-size stratified selection of units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The strata in their order.
STRATA = [(t, g) for t in ("pair_timeline", "host_egress") for g in ("benign", "malicious", "mixed")]


def order_of(seed: int, id_col: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col)))


def stratum_index() -> Column:
    out = None
    for i, (t, g) in enumerate(STRATA):
        cond = (F.col("unit_type") == t) & (F.col("gold_label") == g)
        out = F.when(cond, i) if out is None else out.when(cond, i)
    return out


def available(units: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Available and selected units of each of the six strata, zeros included."""
    dense = units.sparkSession.createDataFrame(STRATA, "unit_type string, gold_label string")
    count = lambda df, name: df.groupBy("unit_type", "gold_label").agg(F.count(F.lit(1)).alias(name))
    out = dense.join(count(units, "available"), ["unit_type", "gold_label"], "left")
    if selected is not None:
        out = out.join(count(selected, "selected"), ["unit_type", "gold_label"], "left")
    return out.na.fill(0)


def select(units: DataFrame, seed: int, per_stratum: int, min_total: int | None = None, cap: int | None = None) -> DataFrame:
    """units(eval_unit_id, unit_type, gold_label) selected in hash order, with `rank` in their stratum.

    The first per_stratum of each stratum; topped up from the rest to min_total;
    cut to cap in hash order. The row numbers with a bound become top-n filters
    before the shuffle.
    """
    u = units.where(stratum_index().isNotNull()).withColumn("_h", order_of(seed, "eval_unit_id"))
    picked = u.withColumn("rank", F.row_number().over(Window.partitionBy("unit_type", "gold_label").orderBy("_h", "eval_unit_id"))).where(F.col("rank") <= per_stratum)
    if min_total is not None:
        n = picked.count()
        if n < min_total:
            rest = u.join(picked.select("eval_unit_id"), "eval_unit_id", "left_anti").orderBy("_h", "eval_unit_id").limit(min_total - n)
            picked = picked.unionByName(rest.withColumn("rank", F.lit(None).cast("int")))
    if cap is not None:
        picked = picked.orderBy("_h", "eval_unit_id").limit(cap)
    return picked


def rotation(selected: DataFrame) -> DataFrame:
    """The selected units with their place in round-robin order over the strata: any prefix stays balanced. Bounded by the selection's size."""
    w = Window.partitionBy("unit_type", "gold_label").orderBy("_h", "eval_unit_id")
    s = selected.withColumn("_i", F.row_number().over(w)).withColumn("_s", stratum_index())
    return s.withColumn("place", F.row_number().over(Window.orderBy("_i", "_s"))).drop("_i", "_s")


def report(units: DataFrame, selected: DataFrame, per_stratum: int, capped: bool | Column = False) -> DataFrame:
    """One row: total_selected, per_stratum_available and per_stratum_selected (maps of type:label over all six strata), undersampled_strata in the strata's order, capped.

    A stratum is undersampled if it holds fewer units than per_stratum. Units of
    no stratum are not counted; no units give zeros.
    """
    counts = available(units, selected).withColumn("_i", stratum_index()).withColumn("_s", F.concat_ws(":", "unit_type", "gold_label"))
    by_order = lambda c: F.array_sort(F.collect_list(c))
    entries = lambda c: F.map_from_entries(F.transform(by_order(F.struct("_i", "_s", c)), lambda x: F.struct(x["_s"], x[c])))
    short = by_order(F.when(F.col("available") < per_stratum, F.struct("_i", "_s")))
    return counts.agg(
        F.sum("selected").alias("total_selected"),
        entries("available").alias("per_stratum_available"),
        entries("selected").alias("per_stratum_selected"),
        F.transform(short, lambda x: x["_s"]).alias("undersampled_strata"),
    ).withColumn("capped", capped if isinstance(capped, Column) else F.lit(capped))


def class_balanced(rows: DataFrame, bad: Column, total: int, share: float, seed: int, id_col: str) -> DataFrame:
    """`total` rows of which the whole part of `share` is bad, or all there are of a class that has fewer; each class in hash order of its ids. The first n of an order are kept in each partition, so no class meets in one task."""
    n = int(total * share)
    ranked = rows.withColumns({"_bad": bad, "_h": F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))})
    pick = lambda cond, k: ranked.where(cond).orderBy("_h", id_col).limit(k)
    return pick(F.col("_bad"), n).unionByName(pick(~F.col("_bad"), total - n)).drop("_bad", "_h")
