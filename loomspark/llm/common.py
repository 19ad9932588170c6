"""What the operators of this subpackage share: tables in the cluster's shared folder, row keys, prefix sums."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Used only where the session names no ``spark.checkpoint.dir``, as in tests on one machine.
OWN_FOLDER = "/tmp/checkpoints/loomspark"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir`` of the session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = OWN_FOLDER
    return f"{found.rstrip('/')}/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: lineage is cut, and a lost executor loses nothing.

    The folder stays until :func:`forget` or until the owner of the shared folder clears it, since the frames read
    from it are lazy.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like :func:`stored`, as an external table bucketed by ``key``: joins on the key read it without a shuffle.

    There are as many buckets as shuffle partitions; where ``df`` is partitioned by the key already, as after an aggregate
    by it, each bucket is one file.
    """
    spark = df.sparkSession
    own = f"loom_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("path", f"{shared_folder(spark)}/{own}").bucketBy(buckets, key).saveAsTable(own)
    return spark.table(own)


def forget(spark: SparkSession) -> None:
    """Delete what :func:`stored` wrote in this application."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_HELD: dict = {}


def worker_tables(name, make):
    """What a Python worker keeps between tasks, made once: the tables of one operator at a time.

    Spark uses workers again for later stages; asking for another operator's tables lets go of those held so far, so
    that a worker never holds the sum of all.
    """
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def release() -> None:
    """Let go of a Python worker's tables and give memory that it no longer uses back to the machine.

    Workers stay when their stage has ended, beside whatever the executor does next.
    """
    _HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def prefix_sums(rows: DataFrame, group: list[str], order: list[str], amount: str, bucket: Column, out: str) -> DataFrame:
    """``out``: the sum of ``amount`` over the rows before this one in its ``group``, in order of ``bucket``, then ``order``.

    Two levels, so that no task sorts a whole group: sums by (group, bucket) are added up first, and rows are
    ordered only within their bucket. ``rows`` are read twice; give a stored table.
    """
    rows = rows.withColumn("__bucket", bucket)
    sums = rows.groupBy(*group, "__bucket").agg(F.sum(amount).alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
        F.col("__bucket").alias("__b"),
        F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"),
    )
    within = Window.partitionBy(*group, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    on = F.col("__bucket").eqNullSafe(F.col("__b"))
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return (
        rows.withColumn("__before", F.coalesce(F.sum(amount).over(within), F.lit(0)))
        .join(starts, on)
        .withColumn(out, F.col("__start") + F.col("__before"))
        .drop("__bucket", "__b", "__start", "__before", *[f"__g{i}" for i in range(len(group))])
    )


#: Keys that a join spreads, at most; rows of a key from which it may be spread; tasks that it is spread over.
HOT_KEYS, HOT_ROWS, SALTS = 1024, 1000, 64


def spread_join(rows: DataFrame, once: DataFrame, key: str, by: list[str], how: str = "inner", sizes: DataFrame | None = None) -> DataFrame:
    """``rows`` joined to ``once``, which has one row for each ``key``, without a task that holds a hot key.

    The ``HOT_KEYS`` keys with most rows are dealt over ``SALTS`` tasks by a hash of the columns ``by``; any other key has less
    than one in ``HOT_KEYS`` of all rows. Only the list of these keys is broadcast, which has at most ``HOT_KEYS`` rows. ``sizes``
    (key, n) saves counting. ``rows`` are read twice without it; give a stored table.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("n")) if sizes is None else sizes
    hot = sizes.where(F.col("n") >= HOT_ROWS).orderBy(F.col("n").desc(), key).limit(HOT_KEYS)
    hot = F.broadcast(stored(hot.select(F.col(key).alias("__key"), F.lit(True).alias("__hot")).where("__key is not null"), "hot-keys"))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = rows.join(hot, F.col(key) == F.col("__key"), "left").withColumn("__salt", salt).drop("__key", "__hot")
    copied = once.join(hot, F.col(key) == F.col("__key"), "left").withColumn("__salt", F.explode(salts)).drop("__key", "__hot")
    return dealt.join(copied, [key, "__salt"], how).drop("__salt")


def exploded_range(df: DataFrame, size: Column | int, out: str, at_once: int = 65_536) -> DataFrame:
    """``df`` with a row for each ``out`` from 0 to ``size`` - 1, in two steps, so that no row holds a long array."""
    size = F.lit(size).cast("long") if isinstance(size, int) else size
    df = df.withColumn("__end", size).where("__end > 0")
    df = df.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__end") - 1, F.lit(at_once).cast("long"))))
    upto = F.least(F.col("__from") + at_once, F.col("__end")) - 1
    return df.withColumn(out, F.explode(F.sequence(F.col("__from"), upto))).drop("__end", "__from")
