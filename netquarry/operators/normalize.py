"""Normalisation of raw flow tables into the canonical columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Canonical columns by type, and where labels and millisecond starts come from.
TEXT = ("src_ip", "dst_ip", "protocol", "tcp_flags")
WHOLE = ("src_port", "dst_port", "sampling_rate")
REAL = ("ts_start", "bytes_in", "bytes_out", "pkts_in", "pkts_out", "flow_duration_ms")
CANONICAL = ("src_ip", "dst_ip", "ts_start", "protocol", "src_port", "dst_port", "bytes_in", "bytes_out", "pkts_in", "pkts_out", "tcp_flags", "flow_duration_ms", "sampling_rate")
OPTIONAL = {"tcp_flags": ""}
ATTACK_COLUMNS = ("Attack", "attack")
LABEL_COLUMNS = ("Label", "label")


@dataclass(frozen=True)
class Config:
    aliases: dict[str, tuple[str, ...]]
    millisecond_aliases: tuple[str, ...] = ("FLOW_START_MILLISECONDS", "timestamp")
    attack_columns: tuple[str, ...] = ATTACK_COLUMNS
    label_columns: tuple[str, ...] = LABEL_COLUMNS
    optional: dict[str, str] = field(default_factory=lambda: dict(OPTIONAL))


def resolve(columns: list[str], wanted: tuple[str, ...]) -> int | None:
    """Place of the first wanted name that is present, without regard to case; of columns that differ in case only, the last."""
    by_lower = {c.lower(): i for i, c in enumerate(columns)}
    return next((by_lower[w.lower()] for w in wanted if w.lower() in by_lower), None)


def resolution(columns: list[str], config: Config) -> dict[str, int | None]:
    found = {c: resolve(columns, config.aliases.get(c, (c,))) for c in CANONICAL}
    missing = [c for c, i in found.items() if i is None and c not in config.optional]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    return found


def whole_number(c: Column, kind: T.DataType) -> Column:
    """To a long; fractions round half to even."""
    return (F.bround(c, 0) if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)) else c).cast("long")


def median_above(df: DataFrame, value: Column, bound: float) -> bool:
    """Whether the exact median (the mean of the middle two of an even count) exceeds the bound, from counts and the two values beside the bound; NaN and null do not count."""
    v = df.select(value.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    r = v.agg(F.count_if(F.col("v") > bound).alias("above"), F.count_if(F.col("v") <= bound).alias("below"), F.max(F.when(F.col("v") <= bound, F.col("v"))).alias("low"), F.min(F.when(F.col("v") > bound, F.col("v"))).alias("high")).first()
    return r.above > r.below or r.above == r.below > 0 and (r.low + r.high) / 2 > bound


def exact_median(df: DataFrame, value: Column, accuracy: int = 100_000, at_once: int = 1_000_000) -> DataFrame:
    """One row with the exact interpolated median (null over nothing).

    A sketch brackets the middle ranks to about 1/accuracy of the rows, then again
    within the bracket until at most at_once rows, or one value, are left; only
    those are ordered.
    """
    v = df.select(value.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    n = v.count()
    if not n:
        return v.agg(F.max("v").alias("median"))
    ranks = [(n - 1) // 2, n // 2]
    band, below, held, bounds = v, 0, n, None
    while held > at_once or bounds is None:
        share = [max(0.0, (ranks[0] - below) / held - 2 / accuracy), min(1.0, (ranks[1] - below) / held + 2 / accuracy)]
        low, high = band.agg(F.percentile_approx("v", share, accuracy).alias("q")).first().q
        if (low, high) == bounds:
            break
        bounds = low, high
        r = v.agg(F.count_if(F.col("v") < low).alias("below"), F.count_if(F.col("v").between(low, high)).alias("held")).first()
        below, held, band = r.below, r.held, v.where(F.col("v").between(low, high))
    few = band.groupBy("v").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(Window.orderBy("v")) + below)
    middle = [F.min(F.when(F.col("upto") > r, F.col("v"))) for r in ranks]
    return few.agg(((middle[0] + middle[1]) / 2).alias("median"))


def in_milliseconds(df: DataFrame, col: str, source: str, config: Config) -> bool:
    """A listed alias is in milliseconds; otherwise the exact median decides."""
    if source.lower() in {a.lower() for a in config.millisecond_aliases}:
        return True
    return median_above(df, F.col(col), 1e12)


def attack_label(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.isNull() | (t == ""), "benign").otherwise(t)


def attack_flag(c: Column) -> Column:
    """Not trimmed: a label of blanks is malicious though its text reads benign."""
    return ~F.lower(F.coalesce(c, F.lit(""))).isin("", "benign")


def normalize(raw: DataFrame, config: Config) -> DataFrame:
    """Canonical columns with _attack_label, _is_malicious, _numeric_label.

    Each canonical column takes the first alias present; all but the optional ones
    must be there. Null sampling rates become 1 and null flags ''. An attack
    column decides the label, else a numeric one (above 0 is malicious), else all
    is benign. Other columns are dropped; columns that differ in case only do not
    clash. Unparsable values are errors.
    """
    names = raw.columns
    df = raw.toDF(*[f"c{i}" for i in range(len(names))])
    kinds = [f.dataType for f in df.schema.fields]
    at = resolution(names, config)
    out = []
    for c in CANONICAL:
        i = at[c]
        if i is None:
            out.append(F.lit(config.optional[c]).alias(c))
            continue
        col = F.col(f"c{i}")
        if c == "ts_start":
            real = F.unix_micros(col.cast("timestamp")) / F.lit(1e6) if isinstance(kinds[i], (T.TimestampType, T.TimestampNTZType)) else col.cast("double")
            ms = not isinstance(kinds[i], (T.TimestampType, T.TimestampNTZType)) and in_milliseconds(df, f"c{i}", names[i], config)
            out.append((real / F.lit(1000.0) if ms else real).alias(c))
        elif c in TEXT:
            v = col.cast("string")
            out.append((F.coalesce(v, F.lit("")) if c == "tcp_flags" else v).alias(c))
        elif c in WHOLE:
            v = whole_number(col, kinds[i])
            out.append((F.coalesce(v, F.lit(1)) if c == "sampling_rate" else v).alias(c))
        else:
            out.append(col.cast("double").alias(c))
    attack, label = resolve(names, config.attack_columns), resolve(names, config.label_columns)
    number = whole_number(F.col(f"c{label}"), kinds[label]) if label is not None else F.lit(None).cast("long")
    if attack is not None:
        text = F.col(f"c{attack}").cast("string")
        out += [attack_label(text).alias("_attack_label"), attack_flag(text).alias("_is_malicious")]
    else:
        bad = F.coalesce(number > 0, F.lit(False))
        out += [F.when(bad, "malicious").otherwise("benign").alias("_attack_label"), bad.alias("_is_malicious")]
    return df.select(*out, number.alias("_numeric_label"))
