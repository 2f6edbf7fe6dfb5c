"""Session, table and workspace helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_LOCAL_ROOT: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a relation whose size the planner knows, so that a small one is broadcast at once and what it is
    joined with stays where it is. A frame of a plain list has no known size; the other side is shuffled before it turns out to be small."""
    kinds = T.StructType.fromDDL(schema)
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(kinds.names, r)) for r in rows], to_arrow_schema(kinds)), kinds)


def local_session(app: str = "tilewright", cpus: str = "*", shuffle: int = 8) -> SparkSession:
    """A local session with the settings tests and benches use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TILEWRIGHT_DRIVER_MEMORY", "12g"))
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for written intermediate tables: ``spark.checkpoint.dir`` where the cluster names one.

    Only a session on one machine (``local[...]``) may do without; it then gets a temporary folder
    that is removed at exit. A cluster without the setting is refused, because executors would not
    share the folder and a lost executor would lose the tables.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return f"{root.rstrip('/')}/tilewright-{spark.sparkContext.applicationId}"
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOT:
        _LOCAL_ROOT[app] = tempfile.mkdtemp(prefix="tilewright-")
        atexit.register(shutil.rmtree, _LOCAL_ROOT[app], ignore_errors=True)
    return _LOCAL_ROOT[app]


class Cut:
    """A DataFrame written to the shared folder and read back: lineage ends here, and the table outlives executors."""

    def __init__(self, df: DataFrame, label: str = "cut"):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def count(self) -> int:
        """Row count, answered from Parquet footers."""
        return self.df.count()

    def drop(self) -> None:
        """Delete the table; only for tables no later plan reads."""
        remove(self.spark, self.path)


class Rounds:
    """Tables of the rounds of an iteration, all in one folder, so that one scan reads them together; ``_round`` counts from 0."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.count = spark, 0
        self.path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame) -> DataFrame:
        """Writes the next round and reads it back."""
        self.schema = df.schema
        at = f"{self.path}/_round={self.count}"
        df.write.parquet(at)
        self.count += 1
        return self.spark.read.schema(self.schema).parquet(at)

    def all(self) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("_round", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the tables; only when no later plan reads them."""
        remove(self.spark, self.path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
