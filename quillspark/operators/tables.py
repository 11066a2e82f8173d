"""Tables of state: schemas that grew, keys, versions with optimistic commits, and merging by key."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def migrated(former: DataFrame, latter: DataFrame, defaults: dict[str, object] | None = None) -> DataFrame:
    """Rows of two versions of a table. Columns that one lacks are null there, or what ``defaults`` says."""
    for name, value in (defaults or {}).items():
        former = former if name in former.columns else former.withColumn(name, F.lit(value))
    return latter.unionByName(former, allowMissingColumns=True)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in ``order``."""
    ranked = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_nth = 1").drop("_nth")


def own_place(spark: SparkSession, name: str) -> str:
    """A new path for a table under the folder that the cluster shares (``spark.checkpoint.dir``); on one machine a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="quillspark-tables-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table that is computed and written once, however often a plan reads it."""
    place = own_place(rows.sparkSession, name)
    rows.write.parquet(place)
    return rows.sparkSession.read.schema(rows.schema).parquet(place)


class Conflict(Exception):
    """409: another writer has committed a version since the one that was read."""


class UnknownKeys(Exception):
    """404: keys that the table does not have."""


def _system(spark: SparkSession, place: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def current_version(spark: SparkSession, place: str) -> int:
    """The number of the table's last commit, 0 if there is none."""
    system, log = _system(spark, f"{place}/_commits")
    if not system.exists(log):
        return 0
    names = [f.getPath().getName() for f in system.listStatus(log)]
    return max((int(n) for n in names if n.isdigit()), default=0)


def commit(rows: DataFrame, place: str, read: int) -> int:
    """Writes ``rows`` as the version after ``read``, and returns its number. The rows are written beside the older ones; the version is theirs with the last step, the
    creation of the commit's file, which only one writer can do. Where another one has, this one fails with ``Conflict`` and changes nothing; a writer that
    dies before leaves the table as it was. (The folder's file system must create files exclusively, as HDFS does.)"""
    spark = rows.sparkSession
    if current_version(spark, place) != read:
        raise Conflict(f"version {read} was read, {current_version(spark, place)} is there")
    part = uuid.uuid4().hex
    rows.write.parquet(f"{place}/{part}")
    system, entry = _system(spark, f"{place}/_commits/{read + 1:020d}")
    try:
        out = system.create(entry, False)
    except Py4JJavaError as problem:
        system.delete(_system(spark, f"{place}/{part}")[1], True)
        raise Conflict(f"version {read + 1} is another writer's") from problem
    out.writeBytes(part)
    out.close()
    return read + 1


def replace_table(rows: DataFrame, place: str) -> int:
    """Writes ``rows`` as the table's new version, whichever is there now. Readers find the former version whole until the new one is."""
    while True:
        try:
            return commit(rows, place, current_version(rows.sparkSession, place))
        except Conflict:
            continue


def read_table(spark: SparkSession, place: str, version: int | None = None) -> DataFrame:
    """The table's current version, or an older one."""
    system, entry = _system(spark, f"{place}/_commits/{version or current_version(spark, place):020d}")
    source = system.open(entry)
    part = source.readLine()
    source.close()
    return spark.read.parquet(f"{place}/{part}")


def merged(rows: DataFrame, updates: DataFrame, keys: list[str], known_only: bool = False) -> DataFrame:
    """``rows`` with those of ``updates`` in place of the rows of the same keys (null is a key like any other), and new ones beside them. Columns that updates lack keep
    their values. ``updates`` has a row a key. ``known_only``: updates of keys that the table lacks raise ``UnknownKeys``. One join by key."""
    own = [c for c in updates.columns if c not in keys]
    put = updates.select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.struct(F.lit(True).alias("_here"), *own).alias("_new"))
    match = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys))
    if known_only:
        lost = put.join(rows.select(*keys), match, "left_anti")
        first = lost.limit(10).collect()
        if first:
            raise UnknownKeys(", ".join(str(tuple(r[f"_key_{k}"] for k in keys)) for r in first))
    held = rows.select(*rows.columns, F.lit(True).alias("_old")).join(put, match, "full")
    there = F.col("_new._here").isNotNull()

    def value(c: str) -> Column:
        if c in keys:
            return F.when(F.col("_old").isNull(), F.col(f"_key_{c}")).otherwise(F.col(c)).alias(c)
        return (F.when(there, F.col(f"_new.{c}")).otherwise(F.col(c)) if c in own else F.col(c)).alias(c)

    return held.select(*map(value, rows.columns))


def upsert(spark: SparkSession, place: str, updates: DataFrame, keys: list[str], read: int | None = None, known_only: bool = False) -> int:
    """Merges ``updates`` into the table and commits. With ``read``, the version that the updates were made for, a newer one is a ``Conflict``; without it the merge is tried
    again on what is there. Returns the new version."""
    while True:
        base = current_version(spark, place) if read is None else read
        if read is not None and current_version(spark, place) != read:
            raise Conflict(f"version {read} was read, {current_version(spark, place)} is there")
        try:
            return commit(merged(read_table(spark, place, base), updates, keys, known_only), place, base)
        except Conflict:
            if read is not None:
                raise


def glossary_import(mine: DataFrame, theirs: DataFrame, most: int = 5000, field: int = 300) -> DataFrame:
    """(term, use, outcome) of a glossary (term, use) after an import of (place, term, use): its first ``most`` rows by place, fields cut to ``field`` characters, blank terms and uses
    aside, the first row of a term. New terms come, equal ones are, and in a conflict mine stays."""
    cut = lambda c: F.trim(F.substring(F.trim(F.coalesce(c, F.lit(""))), 1, field))
    taken = theirs.orderBy("place").limit(most).select("place", cut("term").alias("term"), cut("use").alias("_use")).where("term <> '' AND _use <> ''")
    taken = taken.groupBy("term").agg(F.min_by("_use", "place").alias("_use"))
    both = mine.select("term", "use").join(taken, "term", "full")
    outcome = F.when(F.col("_use").isNull(), "mine").when(F.col("use").isNull(), "new").when(F.col("use") == F.col("_use"), "equal").otherwise("conflict")
    return both.select("term", F.coalesce("use", "_use").alias("use"), outcome.alias("outcome"))
