"""Reading and writing tables: Parquet by name, partition overwrite, step artefacts, JSON, and the checkpoint folder."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Used only on one machine, where the session names no folder.
OWN_FOLDER = "/tmp/checkpoints/loomspark"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def placed(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` of Parquet files with ``name``, a decimal that grows with the row's place: by path of the file, then row of the file."""
    paths = rows.select(F.col("_metadata.file_path").alias("__path")).distinct()
    files = paths.withColumn("__file", F.row_number().over(Window.orderBy("__path")))  # a row for each file
    place = (F.col("__file").cast("decimal(10,0)") * F.lit(2**40) + F.col("__row")).cast("decimal(38,0)")
    return rows.withColumns({"__path": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")}).join(F.broadcast(files), "__path").withColumn(name, place).drop("__path", "__file", "__row")


def register(spark: SparkSession, folder: str) -> None:
    """All tables of a folder as temporary views."""
    for name in NAMES:
        read(spark, folder, name).createOrReplaceTempView(name)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that the session names in ``spark.checkpoint.dir``, and read again."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = OWN_FOLDER
    path = f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition: list[str]) -> None:
    """Replace only the partitions that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it is missing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def content_key(**params: object) -> str:
    """A hash of all parameters, nested ones too."""
    return hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]


class Steps:
    """Artefacts of a run's steps, by (partition, label, step)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, partition: str, step: str, label: str = "default") -> str:
        return f"{self.root}/{partition}/{label}/{step}"

    def save(self, df: DataFrame, partition: str, step: str, label: str = "default") -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(partition, step, label))
        return self.load(partition, step, label)

    def load(self, partition: str, step: str, label: str = "default") -> DataFrame | None:
        """The artefact under its label, else under the default one, else None."""
        for name in dict.fromkeys((label, "default")):
            if exists(self.spark, self.path(partition, step, name)):
                return self.spark.read.parquet(self.path(partition, step, name))
        return None

    def available(self, partition: str, label: str = "default") -> list[str]:
        return listed(self.spark, f"{self.root}/{partition}/{label}")

    def copy(self, partition: str, source: str, target: str, steps: list[str]) -> dict[str, list[str]]:
        """Copy artefacts to another label: those there already are skipped, missing ones are counted."""
        out: dict[str, list[str]] = {"copied": [], "skipped": [], "failed": []}
        for step in steps:
            if exists(self.spark, self.path(partition, step, target)):
                out["skipped"].append(step)
            elif not exists(self.spark, self.path(partition, step, source)):
                out["failed"].append(step)
            else:
                self.spark.read.parquet(self.path(partition, step, source)).write.parquet(self.path(partition, step, target))
                out["copied"].append(step)
        return out


def read_calls(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of JSON call logs, without failures, by time."""
    rows = spark.read.json(folder, multiLine=True)
    bad = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in rows.columns else F.lit(False)
    return rows.where(~bad).orderBy("timestamp")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, kind (pdf by its first bytes, else by extension) and text of a folder's files; a PDF's text is null here."""
    rows = spark.read.format("binaryFile").load(folder)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(F.substring("content", 1, 4) == F.lit(b"%PDF"), "pdf").when(ext.isin("md", "markdown"), "markdown").when(ext == "txt", "text").otherwise("unknown")
    return rows.select("path", kind.alias("kind"), F.when(kind != "pdf", F.decode("content", "UTF-8")).alias("text"))
