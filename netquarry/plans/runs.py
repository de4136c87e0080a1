"""Runs: strict configuration, scripted renderings, their summaries and the comparison of runs."""

from __future__ import annotations

import dataclasses
import json
import logging
from typing import Any, get_args, get_type_hints

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.operators import summary
from netquarry.sources import artifacts, tables


@dataclasses.dataclass(frozen=True)
class Persona:
    max_turns: int
    max_tool_calls: int
    wall_clock_seconds: int
    tools: list[str] = dataclasses.field(default_factory=list)


@dataclasses.dataclass(frozen=True)
class RunConfig:
    personas: dict[str, Persona]
    provider_models: dict[str, str]
    units_per_stratum: int = 1
    min_total_units: int | None = None
    unit_cap: int | None = None
    cost_cap: float = 1.0
    schema_path: str | None = None


def built(kind: type, value: Any, at: str = "$") -> Any:
    """A value of plain JSON as the type a configuration declares. Unknown and missing keys and wrong types are errors that name their place."""
    options = get_args(kind)
    origin = getattr(kind, "__origin__", None)
    if dataclasses.is_dataclass(kind):
        if not isinstance(value, dict):
            raise ValueError(f"{at}: an object is expected")
        hints = get_type_hints(kind)
        if unknown := sorted(set(value) - set(hints)):
            raise ValueError(f"{at}: unknown {unknown}")
        need = {f.name for f in dataclasses.fields(kind) if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING}
        if missing := sorted(need - set(value)):
            raise ValueError(f"{at}: missing {missing}")
        return kind(**{k: built(hints[k], v, f"{at}.{k}") for k, v in value.items()})
    if origin is dict and isinstance(value, dict):
        return {k: built(options[1], v, f"{at}.{k}") for k, v in value.items()}
    if origin is list and isinstance(value, list):
        return [built(options[0], v, f"{at}[{i}]") for i, v in enumerate(value)]
    plain = [t for t in (options or (kind,)) if isinstance(t, type)]
    if origin is None and any(isinstance(value, t) and not (isinstance(value, bool) and t is not bool) for t in plain):
        return value
    if float in plain and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    raise ValueError(f"{at}: {value!r} is not {kind}")


def load_config(spark: SparkSession, path: str, kind: type = RunConfig) -> Any:
    """A JSON configuration, strictly read; a relative *_path in it is taken from the file's own folder."""
    raw = json.loads(artifacts.read_text(spark, path))
    folder = path.rpartition("/")[0]
    if isinstance(raw, dict):
        raw = {k: f"{folder}/{v}" if k.endswith("_path") and isinstance(v, str) and "://" not in v and not v.startswith("/") else v for k, v in raw.items()}
    return built(kind, raw)


def scripted(units: DataFrame, provider: str, personas: list[str]) -> DataFrame:
    """A source of renderings without any model: each persona looks at five pairs and submits benign at 0.3. Two calls of 200 prompt and 40 output tokens each."""
    none = lambda t: F.array().cast(f"array<{t}>")
    who = F.explode(F.array(*[F.lit(p) for p in personas]))
    s = units.select(F.lit(provider).alias("provider"), who.alias("persona"), "unit", "unit_type", "gold_label")
    return s.select(
        "*", F.lit("benign").alias("verdict"), F.lit(0.3).alias("confidence"), none("bigint").alias("indices"), none("string").alias("destinations"), none("bigint").alias("observed_ids"), none("string").alias("observed_dsts"),
        F.lit(True).alias("valid"), F.lit(2).alias("calls"), F.lit(400).alias("prompt_tokens"), F.lit(0).alias("cached_tokens"), F.lit(80).alias("output_tokens"), F.lit(0).alias("reasoning_tokens"),
    )


def finished_runs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(metadata, scores) of the runs in a folder whose run_metadata.json and summary.json can both be read. scores has a row a metric: run_id, provider, persona, metric, value."""
    root = root.rstrip("/")
    run = F.element_at(F.split("path", "/"), -2).alias("run_id")
    ids = artifacts.folders(spark, root)
    there = lambda name: any(artifacts.exists(spark, f"{root}/{i}/{name}") for i in ids)
    none = spark.createDataFrame([], "run_id string, value string")
    doc = lambda name: tables.json_documents(spark, f"{root}/*/{name}").select(run, "value") if there(name) else none
    meta = doc("run_metadata.json").select("run_id", F.from_json("value", "dataset_hash string, sample_seed long, ablation string").alias("m")).select("run_id", "m.*")
    said = doc("summary.json").select("run_id", F.from_json("value", "scoring map<string, map<string, string>>, per_provider_persona map<string, map<string, string>>").alias("s"))
    both = meta.join(said, "run_id")
    block = lambda field: both.select("run_id", F.explode(f"s.{field}").alias("who", "metrics")).select("run_id", "who", F.explode("metrics").alias("metric", "text"))
    verdict = block("scoring").where("metric = 'verdict'").select("run_id", "who", F.explode(F.from_json("text", "map<string, string>")).alias("metric", "text")).withColumn("metric", F.concat(F.lit("verdict_"), "metric"))
    flat = block("scoring").where(f"metric in ({', '.join(map(repr, METRICS))})").withColumn("metric", F.regexp_replace("metric", "_macro$", ""))
    cost = block("per_provider_persona").where("metric = 'cost_usd'")
    scores = flat.unionByName(verdict.where(f"metric in ({', '.join(map(repr, VERDICTS))})")).unionByName(cost)
    who = F.split("who", "/", 2)
    return both.select("run_id", "dataset_hash", "sample_seed", "ablation"), scores.select("run_id", who[0].alias("provider"), who[1].alias("persona"), "metric", F.expr("try_cast(text as double)").alias("value"))


#: Scores that are compared between runs.
METRICS = ("per_flow_f1_macro", "per_pair_f1_macro", "per_host_f1_macro", "first_pass_valid_rate")
VERDICTS = ("verdict_accuracy", "verdict_f1", "verdict_coverage_adjusted_recall")


def compare_runs(spark: SparkSession, runs_root: str, out_root: str, dataset_hash: str, sample_seed: int) -> str:
    """Writes which run stands for each tag and what main differs by from the others, and returns the summary's path. The pointers are written even where main is missing, which is an error."""
    meta, scores = finished_runs(spark, runs_root)
    chosen = summary.comparable_runs(meta, scores, dataset_hash, sample_seed)
    runs = {r.ablation: r.run_id for r in chosen.collect()}  # at most one a tag
    out = f"{out_root.rstrip('/')}/{dataset_hash}/{sample_seed}"
    for tag, run in runs.items():
        artifacts.write_text(spark, f"{out}/{tag}_run_id.txt", run + "\n")
    if summary.TAGS[0] not in runs:
        raise FileNotFoundError(f"no run of {summary.TAGS[0]} over {dataset_hash} with seed {sample_seed}; there are {sorted(runs)}")
    long = scores.join(F.broadcast(chosen), "run_id")
    keys = ["provider", "persona", "metric"]
    main = long.where(F.col("ablation") == summary.TAGS[0]).select(*keys, F.col("value").alias("m"))
    other = long.where(F.col("ablation") != summary.TAGS[0])
    deltas: dict[str, dict[str, dict[str, float]]] = {f"{t}_to_main": {} for t in summary.TAGS[1:] if t in runs}
    for r in other.join(main, keys).select("ablation", *keys, summary.six(F.col("m") - F.col("value")).alias("delta")).where("delta is not null").collect():  # a row a persona and metric
        deltas[f"{r.ablation}_to_main"].setdefault(f"{r.provider}/{r.persona}", {})[r.metric] = r.delta
    told = {"dataset_hash": dataset_hash, "sample_seed": sample_seed, "runs": runs, "deltas": deltas, "missing_ablations": [t for t in summary.TAGS[1:] if t not in runs]}
    artifacts.write_json(spark, f"{out}/ablation_summary.json", told)
    return f"{out}/ablation_summary.json"


class JsonLines(logging.Formatter):
    """Log records as JSON, one a line, with whatever was passed as extra."""

    _usual = set(vars(logging.makeLogRecord({}))) | {"message", "asctime"}

    def format(self, record: logging.LogRecord) -> str:
        told = {"ts": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        told |= {k: v for k, v in vars(record).items() if k not in self._usual}
        if record.exc_info:
            told["exc_info"] = self.formatException(record.exc_info)
        return json.dumps(told, default=str)
