"""Folders that driver and executors share, and exclusive creation of small files in them."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where none is set on one machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("a cluster needs a shared folder: set spark.checkpoint.dir")
        import tempfile

        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidelog-"))
    return sc.getCheckpointDir().rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """The same rows as a table in the shared folder; cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidelog-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Buckets:
    """A table in the shared folder whose rows lie in buckets by the hash of some columns, so that a join on them reads
    it in place.  Spark knows buckets by tables only: one without a name of its own is registered until closed."""

    def __init__(self, spark: SparkSession, what: str, cols: list[str], n: int):
        self.spark, self.cols, self.n = spark, cols, n
        self.name = f"tidelog_{what}_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(spark)}/{self.name}"
        self.files: set[str] = set()
        self.schema = None

    def add(self, df: DataFrame) -> DataFrame:
        """Write more rows; they alone, as a DataFrame."""
        mode, self.schema = "append" if self.files else "error", df.schema
        df.write.format("parquet").bucketBy(self.n, *self.cols).option("path", self.path).mode(mode).saveAsTable(self.name)
        files = set(self.table().inputFiles())
        new, self.files = sorted(files - self.files), files
        return self.spark.read.schema(self.schema).parquet(*[unquote(f) for f in new]) if new else df.limit(0)

    def table(self) -> DataFrame:
        """All rows, in buckets; while open."""
        return self.spark.table(self.name)

    def rows(self) -> DataFrame:
        """All rows, also after closing."""
        return self.spark.read.schema(self.schema).parquet(self.path)

    def close(self) -> None:
        """Take the table off the catalogue; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


class Folder:
    """A folder of small files that are created once: of two writers of one name, one wins."""

    def __init__(self, path: str, spark: SparkSession | None = None):
        self.path = path
        self.hadoop = None
        if "://" in path and not path.startswith("file://"):
            jvm = spark.sparkContext._jvm
            self.hadoop = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            self._path = jvm.org.apache.hadoop.fs.Path
            self._io = jvm.org.apache.commons.io.IOUtils
            self.hadoop.mkdirs(self._path(path))
        else:
            self.local = path.removeprefix("file://")
            os.makedirs(self.local, exist_ok=True)

    def create(self, name: str, data: bytes) -> bool:
        """False if the name is taken."""
        if self.hadoop is not None:
            draft = self._path(f"{self.path}/.{name}.{uuid.uuid4().hex}")
            out = self.hadoop.create(draft, False)
            out.write(data)
            out.close()
            if self.hadoop.exists(self._path(f"{self.path}/{name}")) or not self.hadoop.rename(draft, self._path(f"{self.path}/{name}")):
                self.hadoop.delete(draft, False)
                return False
            return True
        draft = f"{self.local}/.{name}.{uuid.uuid4().hex}"
        with open(draft, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(draft, f"{self.local}/{name}")  # whole or not at all, and never over another
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)

    def names(self) -> list[str]:
        if self.hadoop is not None:
            return sorted(s.getPath().getName() for s in self.hadoop.listStatus(self._path(self.path)) if not s.getPath().getName().startswith("."))
        return sorted(n for n in os.listdir(self.local) if not n.startswith("."))

    def read(self, name: str) -> bytes:
        if self.hadoop is not None:
            stream = self.hadoop.open(self._path(f"{self.path}/{name}"))
            try:
                return bytes(self._io.toByteArray(stream))
            finally:
                stream.close()
        with open(f"{self.local}/{name}", "rb") as f:
            return f.read()

    def delete(self, name: str) -> None:
        if self.hadoop is not None:
            self.hadoop.delete(self._path(f"{self.path}/{name}"), False)
        else:
            os.unlink(f"{self.local}/{name}")
