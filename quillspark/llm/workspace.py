"""Materialised intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a side of a join may take in memory to be broadcast: its rows' fields and lengths of strings, as measured.
BROADCAST_BYTES = 32 << 20
#: Keys of more than one in so many rows (and of ``HOT_ROWS`` rows) are hot; so there are fewer than that.
HOT_KEYS, HOT_ROWS = 100_000, 100
SETTING = "spark.checkpoint.dir"
#: Deletes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``. Where it is unset on a single machine (tests), a folder of our own; a cluster
    has to name one, as its executors do not see each other's disks."""
    found = spark.conf.get(SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{SETTING} must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set(SETTING, found)
    return found


class Workspace:
    """One run's own folder under the shared one. Tables written there survive the loss of executors and cut lineage."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
        self.kept: set[str] = set()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` once and returns it as read back. Its shuffle files go when it is written."""
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(self.path(name))
            self.kept.add(name)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more; without names, the whole workspace."""
        jvm = self.spark._jvm
        self.kept -= set(names) if names else self.kept
        for place in map(self.path, names) if names else [self.root]:
            path = jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


    def drop_but(self, *names: str) -> None:
        """Deletes all tables that nothing reads any more: all but ``names``, which a result that is not yet written still needs."""
        gone = sorted(self.kept - set(names))
        if gone:
            self.drop(*gone)


def hot_rows(rows: int) -> int:
    """From how many rows on a key is hot in a table of ``rows``."""
    return max(HOT_ROWS, -(-rows // HOT_KEYS))


def join_by(rows: DataFrame, table: DataFrame, key: str | list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """Rows joined (inner or left) with a table of one row for each key. Those of hot keys (of which there are ``HOT_KEYS`` at most) stay where
    they are, so that no task gets all rows of one."""
    if hot is None:
        return rows.join(table, key, how)
    own = rows.join(F.broadcast(hot.join(table, key, how)), key)
    return own.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key, how))


def small_side(kept: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``kept`` (materialised, so that measuring is cheap) as the smaller side of a join: broadcast if its measured size is below ``limit``,
    else shuffled and hashed, so that the larger side is dealt by key once and never sorted."""
    strings = [F.octet_length(F.col(f"`{c}`")) for c, t in kept.dtypes if t in ("string", "binary")]
    rows, held = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(map(lambda s: F.coalesce(s, F.lit(0)), strings), F.lit(0))), F.lit(0))).first()
    size = rows * (16 + 8 * len(kept.columns)) + held
    return F.broadcast(kept) if size <= limit else kept.hint("shuffle_hash")
