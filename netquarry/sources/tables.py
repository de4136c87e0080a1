"""Reading and writing of the tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, least_bytes: int = 1 << 20) -> DataFrame:
    """df with its rows dealt over all cores if its files give fewer splits than there are cores, as a few small files or one row group do; what is large or has many files is read as it is split. For tables whose rows cost more to work on than to move."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) < least_bytes or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def parquet_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several parquet files as one table, matched by column name. A file that lacks a column of the first is an error."""
    if not paths:
        raise ValueError("no paths")
    names = [set(spark.read.parquet(p).columns) for p in paths]
    wanted = set().union(*names)
    for path, have in zip(paths, names):
        if wanted - have:
            raise ValueError(f"{path} lacks {sorted(wanted - have)}")
    frames = [spark.read.parquet(p) for p in paths]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def jsonl(spark: SparkSession, path: str, schema, order: str | None = None, needed: Sequence[str] = ()) -> DataFrame:
    """One JSON object a line under a given schema, in the order of a column if one is named; a line that breaks the schema or has null in a needed column is an error."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    for c in needed:
        df = df.withColumn(c, F.coalesce(c, F.raise_error(F.lit(f"null in {c}")).cast(df.schema[c].dataType)))
    return df.orderBy(order) if order else df


def json_documents(spark: SparkSession, glob: str) -> DataFrame:
    """One JSON document a file, with the file's name; unreadable ones are left out."""
    text = spark.read.text(glob, wholetext=True).withColumn("path", F.input_file_name())
    return text.where(F.try_parse_json("value").isNotNull())


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Canonical JSON lines: keys sorted, no blanks between tokens, nulls kept, ASCII only."""
    df.mapInArrow(_canonical_lines, "value string").write.mode(mode).text(path)


def _canonical_lines(batches):
    import pyarrow as pa

    from netquarry.functions.hashing import canonical_json

    for b in batches:
        yield pa.RecordBatch.from_pydict({"value": pa.array([canonical_json(r) for r in b.to_pylist()], pa.string())})


def mirror_parquet(spark: SparkSession, jsonl_path: str, parquet_path: str) -> None:
    """A parquet copy of JSON lines."""
    write_parquet(spark.read.json(jsonl_path), parquet_path, "overwrite")
