"""Column expressions shared by the plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n\f\x0b"
#: IANA protocol numbers and their names.
PROTOCOL_NUMBERS = {"1": "ICMP", "6": "TCP", "17": "UDP", "47": "GRE", "50": "ESP", "51": "AH", "58": "IPV6-ICMP", "132": "SCTP"}


def trimmed(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def source_id(c: Column) -> Column:
    """Identity of a source: lower case, without outer blanks; an empty one is none."""
    t = F.lower(trimmed(c))
    return F.when(t != "", t)


def protocol_name(c: Column) -> Column:
    """Upper-case name of a protocol given by name or number."""
    t = F.upper(trimmed(c))
    named = F.create_map(*[F.lit(x) for kv in PROTOCOL_NUMBERS.items() for x in kv])
    return F.coalesce(F.try_element_at(named, t), t)


def finite(c: Column) -> Column:
    """c, or null where it is NaN or too large for microseconds in 64 bits."""
    return F.when(F.abs(c) < 9e12, c)


def epoch_us(seconds: Column) -> Column:
    """Epoch seconds (double) as whole microseconds; exact for ticks of 1/64 s."""
    return F.round(finite(seconds) * F.lit(1e6)).cast("long")


def whole(c: Column) -> Column:
    """A double as a long, fractions cut; null and NaN are 0."""
    return F.coalesce(F.when(F.abs(c) < 9e18, c).cast("long"), F.lit(0).cast("long"))


def n_unique(c: Column) -> Column:
    """Distinct values where null is a value."""
    return (F.count_distinct(c) + F.coalesce(F.max(F.when(c.isNull(), 1).otherwise(0)), F.lit(0))).cast("long")


def sum0(c: Column) -> Column:
    """Sum that is 0 over nothing but nulls."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def gold_label(malicious: Column, total: Column) -> Column:
    """benign: none malicious; malicious: at least 0.8 of all, compared in double; otherwise mixed."""
    return F.when(malicious == 0, "benign").when(malicious.cast("double") >= F.lit(0.8) * total.cast("double"), "malicious").otherwise("mixed")


def ratio_f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 with the set conventions: nothing predicted and nothing to find is 1/1/1, no prediction has precision 1, nothing to find has recall 1, F1 is 0 where both are 0."""
    p = F.when(tp + fp == 0, 1.0).otherwise(F.try_divide(tp.cast("double"), (tp + fp).cast("double")))
    r = F.when(tp + fn == 0, 1.0).otherwise(F.try_divide(tp.cast("double"), (tp + fn).cast("double")))
    f = F.when(p + r == 0, 0.0).otherwise(F.try_divide(2 * p * r, p + r))
    return p, r, f
