"""Tokens and what they cost. Rates are a table: provider, model and a price a million tokens of each class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.operators.summary import six
from netquarry.session import small

#: Classes of tokens and the rates they are charged at. Prompt tokens are those not taken from the cache.
CLASSES = {"prompt_tokens": "input", "cached_tokens": "cached_input", "output_tokens": "output", "reasoning_tokens": "reasoning"}
#: What a provider's counts include and the canonical ones do not: column -> column that is subtracted.
INCLUDED = {"openai": {"prompt_tokens": "cached_tokens", "output_tokens": "reasoning_tokens"}, "gemini": {"prompt_tokens": "cached_tokens"}}


def normalized_tokens(calls: DataFrame) -> DataFrame:
    """calls with each provider's token counts as disjoint classes, none below 0; null counts are 0, other providers' pass as they are."""
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))

    def clean(c: str) -> Column:
        out = zero(c)
        for provider, parts in INCLUDED.items():
            if c in parts:
                out = F.when(F.col("provider") == provider, F.greatest(F.lit(0).cast("long"), zero(c) - zero(parts[c]))).otherwise(out)
        return out

    return calls.withColumns({c: clean(c) for c in CLASSES})


def rate_card(rates: DataFrame) -> DataFrame:
    """rates once per provider and model; of repeats the highest of each rate holds."""
    return rates.where("provider is not null and model is not null").groupBy("provider", "model").agg(*[F.max(F.col(r).cast("double")).alias(r) for r in CLASSES.values()])


def priced(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """calls with cost_usd: the tokens of each class by the rate of their provider and model. A model without rates costs 0; null counts and rates count 0."""
    card = rate_card(rates).select(F.col("provider").alias("_p"), F.col("model").alias("_m"), *[F.col(r).alias(f"_{r}") for r in CLASSES.values()])
    joined = calls.join(small(card), (F.col("provider") == F.col("_p")) & (F.col("model") == F.col("_m")), "left")
    cost = None
    for tokens, rate in CLASSES.items():
        part = F.coalesce(F.col(tokens) / F.lit(1e6) * F.col(f"_{rate}"), F.lit(0.0))
        cost = part if cost is None else cost + part
    return joined.select(*calls.columns, cost.alias("cost_usd"))


def cache_rates(rates: DataFrame, models: DataFrame) -> DataFrame:
    """(provider, per_million): what a million cached tokens save with the provider's model; models(provider, model) has one row a provider."""
    return rate_card(rates).join(models, ["provider", "model"]).select("provider", (F.col("input") - F.col("cached_input")).alias("per_million"))


def cost_per_alert(rollup: DataFrame) -> DataFrame:
    """(provider, persona, cost_per_alert): cost a rendering of each persona, and over all of a provider's (persona null); nothing rendered has null."""
    per = rollup.groupingSets([["provider", "persona"], ["provider"]], "provider", "persona").agg(F.sum("cost_usd").alias("c"), F.sum("renderings").alias("n"))
    return per.select("provider", "persona", six(F.try_divide(F.col("c"), F.col("n").cast("double"))).alias("cost_per_alert"))


def scaled_budgets(policies: DataFrame, multipliers: dict[str, float], limits: tuple[str, ...], cap: str) -> DataFrame:
    """policies(persona, limits..., cap) for each provider of `multipliers`: whole limits are scaled, rounded half to even and at least 1; the cap is scaled."""
    by = policies.withColumn("_m", F.explode(F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(float(m)).alias("m")) for p, m in multipliers.items()]))).withColumn("provider", F.col("_m.provider"))
    m = F.col("_m.m")
    return by.select("provider", "persona", *[F.greatest(F.lit(1).cast("long"), F.bround(F.col(c) * m, 0).cast("long")).alias(c) for c in limits], (F.col(cap) * m).alias(cap))
