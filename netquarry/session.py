"""Session settings and the few things every plan needs from a session."""

from __future__ import annotations

import atexit
import logging
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Widest table, in rows, that a plan may broadcast after counting it.
BROADCAST_ROWS = 200_000


def build(app: str = "netquarry", master: str = "local[*]", **conf: str) -> SparkSession:
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.master(master).appName(app).config(map=base | conf).getOrCreate()


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Only a session whose executor is the driver itself may do without: it gets a temporary folder, removed when the driver ends."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        found = _own_dir.get(spark.sparkContext.applicationId)
        if not found:
            own = tempfile.mkdtemp(prefix="netquarry-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            found = _own_dir[spark.sparkContext.applicationId] = "file://" + own
    return found.rstrip("/")


_own_dir: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []
_log = logging.getLogger(__name__)


def cut(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: its lineage ends there, so a lost executor costs one re-read."""
    spark = df.sparkSession
    path = work_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def work_folder(spark: SparkSession) -> str:
    """A new folder's name in the shared folder; it is removed with what cut() writes."""
    if not _written:
        atexit.register(_remove_written)
    _written.append((spark, f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"))
    return _written[-1][1]


@contextmanager
def scratch() -> Iterator[None]:
    """What cut() writes within the block is removed at its end; results must be written or collected by then."""
    before = len(_written)
    try:
        yield
    finally:
        _remove_written(before)


def _remove_written(keep: int = 0) -> None:
    """Removes the tables written after the first `keep`; one that cannot be removed is named in the log."""
    while len(_written) > keep:
        _remove(*_written.pop())


def _remove(spark: SparkSession, path: str) -> None:
    if path.startswith("file:"):  # needs no session, which may have ended
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
        return
    try:
        if spark.sparkContext._jsc is None:  # its file systems are gone with it
            raise RuntimeError("the session has ended")
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception as e:
        _log.warning("intermediate table %s is left behind: %s", path, e)


def stored(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table of the shared folder that is made once a session, by the first who asks for it, and removed when the driver ends."""
    path = f"{shared_dir(spark)}/stored-{spark.sparkContext.applicationId}-{name}"
    if path not in _stored:
        df = make()
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        _stored[path] = (spark, df.schema)
        if len(_stored) == 1:
            atexit.register(lambda: [_remove(s, p) for p, (s, _) in _stored.items()])
    return spark.read.schema(_stored[path][1]).parquet(path)


_stored: dict[str, tuple[SparkSession, StructType]] = {}


def looked_up(facts: DataFrame, dimension: DataFrame, keys: list[str], deal: str, salts: int = 32) -> DataFrame:
    """facts left-joined with a dimension that has one row a key. One that is counted small is broadcast; else hot keys of the facts are dealt over `salts` tasks by the column `deal` and the dimension is repeated that often."""
    if dimension.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return facts.join(F.broadcast(dimension), keys, "left")
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(deal), F.lit(salts)).cast("int"))
    return salted.join(dimension.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*keys, "_salt"], "left").drop("_salt")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it holds at most `rows` rows; otherwise df as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
