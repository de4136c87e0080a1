"""Building of a content-addressed index from raw flow tables."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.functions.hashing import canonical_json, digest, hash_obj
from netquarry.operators import index, normalize, tools
from netquarry.session import cut
from netquarry.sources import tables

#: Rows that one digest covers.
SLICE = 10_000
PARTS = ("flows", "pair_stats", "pairs", "hosts", "hosts_rollup", "unit_bridge", "eval_units")


@dataclass(frozen=True)
class Args:
    dataset: str
    k: int = 10
    window_min: float = 5
    max_flows: int = 1000

    def told(self) -> dict[str, object]:
        """The arguments under the names by which they enter the hash."""
        return {"dataset_name": self.dataset, "host_egress_fanout_K": self.k, "host_egress_window_minutes": self.window_min, "max_flows_per_unit": self.max_flows}


def payload_hash(flows: DataFrame) -> str:
    """Digest of the rows in flow_id order, whatever their partitions: of slices of SLICE rows, then of SLICE digests, until one is left."""
    cols = [c for c in flows.columns if c not in ("flow_id", "_numeric_label")]

    def rows(t):
        import pyarrow as pa

        t = t.sort_by("at")
        text = "\n".join(t.column("text").to_pylist())
        return pa.table({"at": pa.array([t.column("slice")[0].as_py()], pa.int64()), "text": pa.array([digest(text.encode())])})

    def lines(batches):
        import pyarrow as pa

        for b in batches:
            at = b.column(0)
            text = [canonical_json(r) for r in b.select(cols).to_pylist()]
            yield pa.RecordBatch.from_pydict({"at": at, "text": pa.array(text, pa.string())})

    level = flows.select("flow_id", *cols).mapInArrow(lines, "at long, text string")
    while True:
        level = cut(level.withColumn("slice", F.expr(f"at div {SLICE}")).groupBy("slice").applyInArrow(rows, "at long, text string"))
        if level.limit(SLICE + 1).count() <= SLICE:
            return hash_obj([r.text for r in level.orderBy("at").collect()])


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether every part of an index was written to its end; the manifest comes last."""
    return all(_exists(spark, f"{path}/{p}/_SUCCESS") for p in (*PARTS, "manifest"))


def build_index(spark: SparkSession, raw_paths: list[str], out_dir: str, config: normalize.Config, args: Args, rebuild: bool = False) -> str:
    """Writes the index of the raw tables under a folder named by its content, and returns the folder. A complete one is left as it is unless rebuild is asked for."""
    flows = cut(index.assign_flow_ids(normalize.normalize(tables.parquet_files(spark, raw_paths), config)))
    schema_hash = hash_obj([[f.name, f.dataType.simpleString()] for f in flows.schema.fields])
    dataset_hash = hash_obj({"schema_hash": schema_hash, "build_args": args.told(), "payload_hash": payload_hash(flows)})
    path = f"{out_dir.rstrip('/')}/{dataset_hash}"
    if not rebuild and complete(spark, path):
        return path
    f = flows.withColumn("is_malicious", F.col("_is_malicious"))
    stats = cut(index.pair_stats(f))
    bridge = cut(index.unit_bridge(f, args.k, args.window_min, args.max_flows))
    units = index.with_unit_ids(index.units(bridge))
    parts = {"flows": flows, "pair_stats": stats, "pairs": index.with_pair_ids(index.pairs(stats)), "hosts": index.hosts(f), "hosts_rollup": index.hosts_rollup(f), "unit_bridge": bridge}
    for name, df in parts.items():
        tables.write_parquet(df, f"{path}/{name}", "overwrite")
    tables.write_jsonl(units, f"{path}/eval_units", "overwrite")
    counts = {name: spark.read.parquet(f"{path}/{name}").count() for name in ("flows", "pairs", "hosts")} | {"eval_units": spark.read.text(f"{path}/eval_units").count()}
    manifest = canonical_json({"dataset_hash": dataset_hash, "args": args.told(), "counts": counts})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return path


def manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first().value)


def open_index(spark: SparkSession, path: str) -> tools.Index:
    """The tools' view of a written index."""
    if not complete(spark, path):
        raise FileNotFoundError(f"no complete index at {path}")
    flows = spark.read.parquet(f"{path}/flows").withColumnRenamed("_is_malicious", "is_malicious")
    return tools.Index(flows, spark.read.parquet(f"{path}/pair_stats"), spark.read.parquet(f"{path}/hosts_rollup"))
