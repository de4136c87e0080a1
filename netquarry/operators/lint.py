"""Scan of texts for tokens that must not appear in prompts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.operators.tools import GROUND_TRUTH

#: The patterns, in the order in which the first match counts.
PATTERNS = [
    ("ipv4_literal", r"\b(?:\d{1,3}\.){3}\d{1,3}(?:/\d{1,2})?\b"),
    ("ipv6_literal", r"\b(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}\b"),
    ("hex_hash", r"\b(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})\b"),
]
#: Raw label columns.
LABELS = ("Attack", "attack", "Label", "label")
#: Configured names of attack families, matched without regard to case.
FAMILIES = [
    "Bot", "Botnet", "DDoS", "DoS", "Brute Force", "Brute-Force", "Infiltration", "PortScan", "Port Scan", "SSH-Bruteforce", "FTP-BruteForce", "Web Attack", "SQL Injection", "XSS", "Heartbleed",
    "Mirai",
]


def patterns(columns: list[str], families: list[str]) -> list[tuple[str, str]]:
    """(name, regular expression) of each rule in order. Words are literal whatever they hold; the rule of an empty list is left out."""
    words = [("label_column", "", columns), ("attack_family", "(?i)", families)]
    return [*PATTERNS, *((name, flag + r"\b(?:" + "|".join(map(re.escape, sorted(set(w)))) + r")\b") for name, flag, w in words if w)]


def forbidden(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", families: list[str] = ()) -> DataFrame:
    """(id, pattern, matched, at): the first rule that a text breaks, the match itself and its 0-based place; null and clean texts give no row."""
    rules = patterns([*GROUND_TRUTH, *LABELS], list(families))
    text = F.col(text_col)
    which = F.coalesce(*[F.when(text.rlike(p), i) for i, (_, p) in enumerate(rules)])
    pick = lambda f: F.coalesce(*[F.when(F.col("_i") == i, f(n, p)) for i, (n, p) in enumerate(rules)])
    hit = texts.select(id_col, text_col, which.alias("_i")).where("_i is not null")
    return hit.select(id_col, pick(lambda n, p: F.lit(n)).alias("pattern"), pick(lambda n, p: F.regexp_substr(text, F.lit(p))).alias("matched"), pick(lambda n, p: F.char_length(F.regexp_extract(text, f"(?s)^(.*?)(?:{p})", 1))).alias("at"))
