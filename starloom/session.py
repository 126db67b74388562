"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "starloom", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Folders of local sessions that name none, by application.
LOCAL_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Every executor must see it. Only a local session may do without one; it
    then gets a fresh temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_ROOTS.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="starloom-"))


def _folder(spark: SparkSession, path: str):
    """A path and its file system, of whatever kind."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below a path."""
    place, files = _folder(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(place) if s.isDirectory())


def remove_folder(spark: SparkSession, path: str) -> None:
    place, files = _folder(spark, path)
    files.delete(place, True)


class Workspace:
    """A fresh folder below the shared root; tables written here cut lineage.

    A written table survives the loss of executors, is columnar, and gives the
    next plan exact sizes, which is why it is used in place of ``persist``.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_bucketed(self, df: DataFrame, name: str, *keys: str, dealt: bool = False) -> DataFrame:
        """A table dealt by keys into as many buckets as there are shuffle partitions.

        Joins and windows on these keys then need no exchange of it. ``dealt``: the rows come from such a table
        and are dealt that way already. The catalog's entry goes at once; the files stay.
        """
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"bucketed_{uuid.uuid4().hex}"
        rows = df if dealt else df.repartition(buckets, *keys)
        rows.write.bucketBy(buckets, *keys).option("path", f"{self.path}/{name}").mode("overwrite").saveAsTable(table)
        stored = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")
        return stored

    def load(self, schema, *names: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])
