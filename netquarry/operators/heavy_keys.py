"""Per-key results where a few keys hold most rows (problem 5).

Tree aggregation: rows are dealt by _flow_id into chunks of equal size, combined
within each chunk, and the chunk states are merged fan_in at a time. No task
receives more than fan_in states of a key, whatever share of the rows it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions.columns import epoch_us, source_id, whole
from netquarry.session import cut, shuffle_partitions

#: How two states of each kind become one.
MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def tree_aggregate(rows: DataFrame, key: list[str], measures: dict[str, tuple[str, Column]], id_col: str, chunks: int | None = None, fan_in: int = 8) -> DataFrame:
    """One row a key: measures are name -> (count | sum | min | max, expression).

    Rows with the same id are repeats of one row, agree in key and measures and
    count once; rows without id count each.
    Null keys form a key of their own. An empty table gives no rows.
    """
    chunks = chunks or shuffle_partitions(rows.sparkSession)
    if fan_in < 2 or chunks < 1:
        raise ValueError("fan_in must be at least 2 and chunks at least 1")
    names, keys = list(measures), [f"_k{i}" for i in range(len(key))]
    for name, (kind, _) in measures.items():
        if kind not in MERGE:
            raise ValueError(f"{name}: no merge for {kind}")
    state = rows.select(
        F.col(id_col).alias("_id"),
        F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()).alias("_own"),
        *[F.col(f"`{k}`").alias(a) for k, a in zip(key, keys)],
        *[(F.when(e.isNotNull(), 1).otherwise(0).cast("long") if kind == "count" else e).alias(n) for n, (kind, e) in measures.items()],
    )
    # The only exchange of raw rows: dealt by id, so chunks are even whatever the keys, and repeats meet.
    state = state.repartition(chunks, "_id", "_own").groupBy("_id", "_own", *keys).agg(*[F.first(n).alias(n) for n in names])
    merge = [MERGE[kind](n).alias(n) for n, (kind, _) in measures.items()]
    # A chunk is a partition. Its states combine before they leave it, and at most fan_in states of a key meet at a node.
    nodes, state = chunks, state.withColumn("_node", F.spark_partition_id())
    while True:
        nodes = -(-nodes // fan_in)
        state = state.withColumn("_node", F.expr(f"_node div {fan_in}")).groupBy("_node", *keys).agg(*merge)
        if nodes <= 1:
            break
    return state.select(*[F.col(a).alias(k) for k, a in zip(key, keys)], *names)


def host_states(flows: DataFrame, chunks: int | None = None, fan_in: int = 8) -> DataFrame:
    """Per source (null for flows without one): flow_count, malicious_flow_count, bytes_out_total, bytes_in_total, first_us, last_us."""
    rows = flows.select("_flow_id", source_id(F.col("src_ip")).alias("src_ip"), F.col("_is_malicious"), "bytes_out", "bytes_in", "ts_start")
    return tree_aggregate(
        rows,
        ["src_ip"],
        {
            "flow_count": ("count", F.lit(1)),
            "malicious_flow_count": ("sum", F.coalesce(F.col("_is_malicious"), F.lit(False)).cast("long")),
            "bytes_out_total": ("sum", whole(F.col("bytes_out"))),
            "bytes_in_total": ("sum", whole(F.col("bytes_in"))),
            "first_us": ("min", epoch_us(F.col("ts_start"))),
            "last_us": ("max", epoch_us(F.col("ts_start"))),
        },
        "_flow_id",
        chunks,
        fan_in,
    )


def heavy_sources(flows: DataFrame, share: float = 0.02, chunks: int | None = None, fan_in: int = 8) -> DataFrame:
    """Sources (src_ip, flow_count) that hold at least `share` of all flows, those without source counted in the whole."""
    rows = flows.select("_flow_id", source_id(F.col("src_ip")).alias("src_ip"))
    state = cut(tree_aggregate(rows, ["src_ip"], {"flow_count": ("count", F.lit(1))}, "_flow_id", chunks, fan_in))
    total = state.agg(F.coalesce(F.sum("flow_count"), F.lit(0)).cast("decimal(18,0)")).scalar()
    return state.where(F.col("src_ip").isNotNull() & (F.col("flow_count") >= F.lit(str(share)).cast("decimal(18,12)") * total)).select("src_ip", "flow_count")
