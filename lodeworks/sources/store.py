"""Tables on shared storage: versions, manifests, flags, caches."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def scratch(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; in local mode one of our own where that is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lodeworks-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df, worked out once and kept in the shared folder: what a model said stays said, whatever executors are lost."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(scratch(spark))
    return df.checkpoint()


class Files:
    """Small files and renames through Spark's own file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path, name)

    def exists(self, name: str = ".") -> bool:
        return self.fs.exists(self.at(name) if name != "." else self.path)

    def read_bytes(self, name: str) -> bytes | None:
        if not self.exists(name):
            return None
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def read(self, name: str) -> str | None:
        data = self.read_bytes(name)
        return None if data is None else data.decode("utf-8", "replace")

    def list(self, folders: bool = False) -> list[tuple[str, int]]:
        """(name, size) of the files, or folders, right here, by name."""
        if not self.exists():
            return []
        found = [(x.getPath().getName(), x.getLen()) for x in self.fs.listStatus(self.path) if x.isDirectory() == folders]
        return sorted(found)

    def make(self) -> None:
        self.fs.mkdirs(self.path)

    def move(self, to: str) -> None:
        """The whole folder, if there is one."""
        if self.exists():
            self.fs.rename(self.path, self.jvm.org.apache.hadoop.fs.Path(to))

    def remove(self) -> None:
        if self.exists():
            self.fs.delete(self.path, True)

    def write(self, name: str, text: str | bytes) -> None:
        """Beside its place, then moved there."""
        spare = self.at(f".{name}.{uuid.uuid4().hex}")
        self.fs.mkdirs(self.path)
        out = self.fs.create(spare, True)
        out.write(bytearray(text if isinstance(text, bytes) else text.encode()))
        out.close()
        if self.exists(name):
            self.fs.delete(self.at(name), False)
        self.fs.rename(spare, self.at(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


class Table:
    """A Parquet table whose versions are folders; a pointer file names the one in force, so readers never see half a write."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema, self.files = spark, path.rstrip("/"), schema, Files(spark, path)

    def version(self) -> str | None:
        """The version in force; a table of another vector type is dropped."""
        state = self.files.read("current.json")
        try:
            now = json.loads(state) if state else None
        except ValueError:
            now = None
        if now and now["schema"] != self.schema.jsonValue():
            self.drop()
            return None
        return now and now["version"]

    def read(self) -> DataFrame:
        now = self.version()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{now}") if now else self.spark.createDataFrame([], self.schema)

    def replace(self, df: DataFrame) -> None:
        new, old = uuid.uuid4().hex, self.version()
        df.select(*self.schema.names).write.parquet(f"{self.path}/{new}")
        self.files.write("current.json", json.dumps({"version": new, "schema": self.schema.jsonValue()}))
        if old:
            self.files.delete(old)

    def append(self, df: DataFrame) -> None:
        now = self.version()
        if now is None:
            self.replace(df)
        else:
            df.select(*self.schema.names).write.mode("append").parquet(f"{self.path}/{now}")

    def drop(self) -> None:
        self.files.remove()


class State:
    """Manifest and flags of a collection, as small JSON files; missing or broken ones read as empty."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.files = spark, Files(spark, path)

    def _json(self, name: str) -> dict:
        try:
            value = json.loads(self.files.read(name) or "{}")
        except ValueError:
            return {}
        return value if isinstance(value, dict) else {}

    def flags(self) -> dict[str, bool]:
        return {"vector_indexed": False, "graph_indexed": False} | self._json("flags.json")

    def set_flags(self, **flags: bool | None) -> None:
        self.files.write("flags.json", json.dumps(self.flags() | {k: v for k, v in flags.items() if v is not None}))
