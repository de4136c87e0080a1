"""Small files beside the tables: run folders, pretty JSON, samples with their provenance. Paths are any that the session's file systems know."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What a run leaves, by name, under its folder.
RUN_FILES = {
    "run_metadata": "run_metadata.json", "predictions_raw_jsonl": "predictions_raw.jsonl", "predictions_raw_parquet": "predictions_raw.parquet", "predictions_per_flow_parquet": "predictions_per_flow.parquet",
    "renderings_jsonl": "renderings.jsonl", "eval_units_summary_jsonl": "eval_units_summary.jsonl", "tool_calls_jsonl": "tool_calls.jsonl", "summary_json": "summary.json", "prompts_used_dir": "prompts_used",
    "index_manifest_link": "index_manifest_link.json",
}
#: Rows in a row group of a sample.
SAMPLE_GROUP = 1024


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, in order; none where it does not exist."""
    p, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def read_bytes(spark: SparkSession, path: str) -> bytes:
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    return read_bytes(spark, path).decode()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file under another name and then renames it, so that readers see all of it or none."""
    p, fs = _path(spark, path)
    part, _ = _path(spark, f"{path}.{uuid.uuid4().hex}.part")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    fs.delete(p, True)
    if not fs.rename(part, p):
        raise OSError(f"{path} could not be written")


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """A value as JSON to be read by people: sorted keys, two blanks a level."""
    write_text(spark, path, json.dumps(value, indent=2, sort_keys=True))


def append_jsonl(df: DataFrame, path: str) -> None:
    """Rows added to a folder of JSON lines, one file a task; what is there stays."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def run_files(root: str, run_id: str) -> dict[str, str]:
    """Paths of a run's artifacts, all under its folder."""
    if not run_id or run_id.startswith(".") or "/" in run_id:
        raise ValueError(f"{run_id!r} is no name of a run")
    base = f"{root.rstrip('/')}/{run_id}"
    return {"root": base} | {name: f"{base}/{file}" for name, file in RUN_FILES.items()}


def prepare_run(spark: SparkSession, root: str, run_id: str) -> dict[str, str]:
    """Makes a run's folders and returns its paths."""
    paths = run_files(root, run_id)
    p, fs = _path(spark, paths["prompts_used_dir"])
    fs.mkdirs(p)
    return paths


def write_sample(sample: DataFrame, path: str, about: dict[str, object], most_bytes: int | None = None) -> dict[str, object]:
    """A sample as one parquet file in the order of its first column, with a provenance file beside it: what was asked for, size and SHA-256. A sample above most_bytes is an error. For samples that fit one task."""
    spark = sample.sparkSession
    work = f"{path}.{uuid.uuid4().hex}"
    sample.orderBy(sample.columns[0]).coalesce(1).write.option("compression", "zstd").option("parquet.block.row.count.limit", SAMPLE_GROUP).parquet(work)
    p, fs = _path(spark, work)
    (only,) = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-")]
    to, _ = _path(spark, path)
    fs.delete(to, True)
    fs.rename(only, to)
    fs.delete(p, True)
    data = read_bytes(spark, path)
    if most_bytes is not None and len(data) > most_bytes:
        raise ValueError(f"the sample has {len(data)} bytes, more than {most_bytes}")
    told = about | {"bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}
    write_text(spark, f"{path}.provenance.json", json.dumps(told, indent=2, sort_keys=True, default=str))
    return told
