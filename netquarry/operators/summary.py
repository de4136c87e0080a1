"""Rollups of scored renderings, run deltas, and the runner's running totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.operators.scan import numbered
from netquarry.session import shuffle_partitions, small

GROUP = ["provider", "persona"]
LENSES = ["per_flow_f1", "per_pair_f1", "per_host_f1", "per_flow_precision", "per_flow_recall"]
#: The tags of runs that are compared, the first with each of the others.
TAGS = ("main", "tools_off", "playbooks_off", "single_shot_baseline")


def six(c: Column) -> Column:
    """Rounded to six places, halves to even; null stays null."""
    return F.bround(c.cast("double"), 6)


def latency(calls: DataFrame, value: str = "wall_time_ms") -> DataFrame:
    """count, mean cut to whole, p50, p95 by nearest rank, max. Equal latencies are counted first, so a group is its distinct values."""
    v = calls.where(F.col(value).isNotNull()).groupBy(*GROUP, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*GROUP).orderBy(value)
    v = v.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy(*GROUP)))
    rank = lambda p: F.least(F.col("all"), F.greatest(F.lit(1), F.bround(F.lit(p / 100.0) * F.col("all")).cast("long")))
    return v.groupBy(*GROUP).agg(
        F.sum("n").alias("count"),
        F.floor(F.sum(F.col(value) * F.col("n")) / F.sum("n")).cast("long").alias("mean"),
        F.min(F.when(F.col("upto") >= rank(50), F.col(value))).alias("p50"),
        F.min(F.when(F.col("upto") >= rank(95), F.col(value))).alias("p95"),
        F.max(value).alias("max"),
    )


def cost_rollup(scored: DataFrame) -> DataFrame:
    """Renderings, cost to six places, wall time and valid renderings; cost_usd comes from costs.priced."""
    return scored.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("renderings"), six(F.coalesce(F.sum("cost_usd"), F.lit(0.0))).alias("cost_usd"), F.sum("wall_time_ms").alias("wall_time_ms"), F.count_if("valid").alias("valid")
    )


def score_entry(scored: DataFrame) -> DataFrame:
    """Macro averages over valid renderings, again over their malicious-bearing units, the native lens, and reliability over all, each to six places; the effective scores are rounded products of rounded factors."""
    ok, mal = F.col("valid"), F.col("valid") & F.col("gold_label").isin("malicious", "mixed")
    mean = lambda cond, c: six(F.coalesce(F.avg(F.when(cond, c)), F.lit(0.0)))
    native = F.when(F.col("unit_type") == "host_egress", F.col("per_host_f1")).otherwise(F.col("per_flow_f1"))
    return (
        scored.groupBy(*GROUP)
        .agg(
            F.count(F.lit(1)).alias("units"),
            F.count_if(ok).alias("units_scored"),
            *[mean(ok, F.col(c)).alias(f"{c}_macro") for c in LENSES],
            *[mean(mal, F.col(c)).alias(f"{c}_macro_malicious") for c in LENSES[:3]],
            F.count_if(mal).alias("malicious_units_scored"),
            mean(ok, native).alias("native_lens_f1"),
            six(F.avg(F.when(ok, 1.0).otherwise(0.0))).alias("first_pass_valid_rate"),
            F.count("defect").alias("defect_count"),
        )
        .withColumn("effective_per_flow_f1", six(F.col("per_flow_f1_macro") * F.col("first_pass_valid_rate")))
        .withColumn("effective_native_lens_f1", six(F.col("native_lens_f1") * F.col("first_pass_valid_rate")))
    )


def verdict_confusion(scored: DataFrame) -> DataFrame:
    """Confusion of the verdict over valid renderings, ratios to six places and F1 from the rounded ones; undefined ratios are null. coverage_adjusted_recall counts invalid renderings of malicious-bearing units as misses."""
    gold, ok = F.col("gold_label").isin("malicious", "mixed"), F.col("valid")
    says = lambda v: F.col("verdict") == v
    c = scored.groupBy(*GROUP).agg(
        F.count_if(ok & gold & says("malicious")).alias("tp"),
        F.count_if(ok & ~gold & says("malicious")).alias("fp"),
        F.count_if(ok & ~gold & says("benign")).alias("tn"),
        F.count_if(ok & gold & says("benign")).alias("fn"),
        F.count_if(gold).alias("malicious_units_total"),
    )
    div = lambda a, b: six(F.try_divide(a.cast("double"), b.cast("double")))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    c = c.withColumn("accuracy", div(tp + tn, tp + fp + tn + fn)).withColumn("precision", div(tp, tp + fp)).withColumn("recall", div(tp, tp + fn))
    f1 = F.when(F.col("precision").isNull() | F.col("recall").isNull(), None).when(F.col("precision") + F.col("recall") == 0, 0.0)
    f1 = f1.otherwise(six(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))
    return c.withColumn("f1", f1).withColumn("coverage_adjusted_recall", div(tp, F.col("malicious_units_total")))


def confidence(scored: DataFrame) -> DataFrame:
    rows = scored.where(F.col("valid") & F.col("confidence").isNotNull() & F.col("verdict").isNotNull())
    right = F.col("gold_label").isin("malicious", "mixed") == (F.col("verdict") == "malicious")
    mean = lambda c: six(F.coalesce(F.avg(c), F.lit(0.0)))
    return rows.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n"), mean(F.col("confidence")).alias("mean"), mean(F.when(right, F.col("confidence"))).alias("mean_correct"), mean(F.when(~right, F.col("confidence"))).alias("mean_incorrect")
    )


def stratum_breakdown(scored: DataFrame) -> DataFrame:
    return scored.groupBy(F.concat_ws("/", "unit_type", "gold_label").alias("stratum"), *GROUP).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in LENSES[:3]], F.avg(F.when(F.col("valid"), 1.0).otherwise(0.0)).alias("valid_rate"), F.count("defect").alias("defects")
    )


def token_totals(calls: DataFrame, savings_rate: DataFrame | None = None) -> DataFrame:
    """Cached and prompt tokens, cache hit rate and what the cache saved (usd) per provider, and over all (provider null).

    savings_rate(provider, per_million) is what a million cached tokens save; a
    provider without one saves 0. The total's savings are the sum of the rounded
    savings, its hit rate comes from the total tokens.
    """
    t = calls.groupBy("provider").agg(F.sum("cached_tokens").alias("cached_tokens"), F.sum("prompt_tokens").alias("prompt_tokens"))
    t = t.join(small(savings_rate), "provider", "left") if savings_rate is not None else t.withColumn("per_million", F.lit(None).cast("double"))
    t = t.withColumn("savings_usd", six(F.coalesce(F.col("cached_tokens") / F.lit(1e6) * F.col("per_million"), F.lit(0.0))))
    t = t.rollup("provider").agg(*[F.sum(c).alias(c) for c in ("cached_tokens", "prompt_tokens")], six(F.sum("savings_usd")).alias("savings_usd"))
    rate = F.try_divide(F.col("cached_tokens").cast("double"), (F.col("cached_tokens") + F.col("prompt_tokens")).cast("double"))
    return t.withColumn("hit_rate", six(F.coalesce(rate, F.lit(0.0))))


def compute_summary(scored: DataFrame, calls: DataFrame) -> DataFrame:
    """One row a provider and persona: cost, scores, verdict and confidence blocks, latency of units and of calls. A group without a block has nulls there."""
    boxed = lambda df, name: df.select(*GROUP, F.struct(*[c for c in df.columns if c not in GROUP]).alias(name))
    blocks = [
        boxed(cost_rollup(scored), "cost"), boxed(score_entry(scored), "scoring"), boxed(verdict_confusion(scored), "verdict"), boxed(confidence(scored), "confidence"),
        boxed(latency(scored), "latency_per_unit_ms"), boxed(latency(calls), "latency_per_call_ms"),
    ]
    return reduce(lambda a, b: a.join(b, GROUP, "full"), blocks)


def comparable_runs(metadata: DataFrame, summaries: DataFrame, dataset_hash: str, sample_seed: int) -> DataFrame:
    """Runs that have metadata and a summary, over this dataset and seed, under a known tag: (ablation, run_id), the lexically last of each tag."""
    m = metadata.where((F.col("dataset_hash") == dataset_hash) & (F.col("sample_seed").cast("long") == sample_seed) & F.col("ablation").isin(*TAGS))
    both = m.join(summaries.select("run_id").distinct(), "run_id", "left_semi")
    return both.groupBy("ablation").agg(F.max("run_id").alias("run_id"))


def ablation_delta(scores: DataFrame, metrics: list[str], main: str = TAGS[0]) -> DataFrame:
    """(ablation, provider, persona, metric, delta): main minus other to six places for keys in both, null metrics left out. No rows of main are an error: deltas mean nothing without it."""
    if scores.where(F.col("ablation") == main).isEmpty():
        raise LookupError(f"no run of {main}")
    long = scores.unpivot(["ablation", *GROUP], metrics, "metric", "value").where("value is not null")
    a = long.where(F.col("ablation") == main).select(*GROUP, "metric", F.col("value").alias("m"))
    return long.where(F.col("ablation") != main).join(a, [*GROUP, "metric"]).select("ablation", *GROUP, "metric", six(F.col("m") - F.col("value")).alias("delta"))


def missing_keys(scores: DataFrame, main: str = TAGS[0]) -> DataFrame:
    """(ablation, provider, persona) that main has and the ablation lacks."""
    tags = scores.where(F.col("ablation") != main).agg(F.collect_set("ablation"))
    want = scores.where(F.col("ablation") == main).select(*GROUP).distinct().withColumn("ablation", F.explode(tags.scalar()))
    return want.join(scores.select("ablation", *GROUP), ["ablation", *GROUP], "left_anti").select("ablation", *GROUP)


def missing_tags(runs: DataFrame) -> DataFrame:
    """(ablation) of each tag but main that has no run."""
    tags = runs.sparkSession.createDataFrame([(t,) for t in TAGS[1:]], "ablation string")
    return tags.join(runs.select("ablation"), "ablation", "left_anti")


def ended(turns: DataFrame, key: list[str], order: str, caps: dict[str, float], done: str, partitions: int | None = None) -> DataFrame:
    """How each scripted rendering ends: (key, ended_at, reason). A cap is checked before its turn, by the totals of the turns before; a turn marked `done` that is reached ends it as submitted. One that does neither is exhausted, at its last turn."""
    capped = running_caps(turns, key, order, caps, partitions, before=True)
    t = turns.groupBy(*key).agg(F.min(F.when(F.col(done), F.col(order))).alias("_done"), F.max(order).alias("_last"))
    t = t.join(capped, key, "left")
    first = F.col("_done").isNotNull() & (F.col("stopped_at").isNull() | (F.col("_done") < F.col("stopped_at")))
    return t.select(*key, F.when(first, F.col("_done")).otherwise(F.coalesce("stopped_at", "_last")).alias("ended_at"), F.when(first, "submitted").otherwise(F.coalesce("reason", F.lit("exhausted"))).alias("reason"))


def running_caps(turns: DataFrame, key: list[str], order: str, caps: dict[str, float], partitions: int | None = None, before: bool = False) -> DataFrame:
    """The first turn of each rendering at which a running total reaches its cap, and the cap's name; caps are tried in the order given, and all use >=. With `before`, a turn's own amounts do not count at it.

    Totals run over range partitions, so a rendering of any length is spread.
    """
    joined = turns.select(*key, order, *caps, F.to_json(F.struct(*key), {"ignoreNullFields": "false"}).alias("_rendering"))
    t = numbered(joined, "_rendering", [order], partitions or shuffle_partitions(turns.sparkSession), tuple(caps))
    reason = None
    for c, cap in caps.items():
        hit = F.col(f"_sum_{c}") - (F.coalesce(F.col(c), F.lit(0)) if before else F.lit(0)) >= F.lit(cap)
        reason = F.when(hit, c) if reason is None else reason.when(hit, c)
    t = t.withColumn("reason", reason).where("reason is not null")
    return t.groupBy(*key).agg(F.min(F.struct(order, "reason")).alias("s")).select(*key, F.col(f"s.{order}").alias("stopped_at"), F.col("s.reason").alias("reason"))


def streaks(events: DataFrame, key: str, order: str, ok: str, threshold: int, partitions: int | None = None) -> DataFrame:
    """(key, tripped_at): the first row of a key at which `threshold` rows in a row were not ok; a success resets the run; 0 disables.

    The rows after a key's n-th success form an island. Its length and first place
    are counts that combine before the shuffle, whatever its length.
    """
    if threshold <= 0:
        return events.select(key, F.col(order).alias("tripped_at")).limit(0)
    e = events.select(key, order, F.when(F.col(ok), 1).otherwise(0).alias("_ok"))
    placed = numbered(e, key, [order], partitions or shuffle_partitions(events.sparkSession), ("_ok",))
    islands = placed.where("_ok = 0").groupBy(key, "_sum__ok").agg(F.count(F.lit(1)).alias("n"), F.min("_pos").alias("at"))
    trips = islands.where(F.col("n") >= threshold).groupBy(key).agg((F.min("at") + threshold - 1).alias("_pos"))
    return placed.join(trips, [key, "_pos"]).select(key, F.col(order).alias("tripped_at"))


def budget_stop(costs: DataFrame, order: str, cost: str, budget: float, partitions: int | None = None) -> DataFrame:
    """The rows in order until the total before a row reaches the budget; the row that crosses it is kept."""
    t = numbered(costs, None, [order], partitions or shuffle_partitions(costs.sparkSession), (cost,))
    return t.where(F.col(f"_sum_{cost}") - F.coalesce(F.col(cost), F.lit(0)) < budget).select(*costs.columns)
