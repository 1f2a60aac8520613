"""Folders that driver and executors share: settled tables, and a keyed state that is written on change."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``; only local sessions may leave that unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a table that is read more than once, and read it back: its lineage ends, and lost executors lose nothing."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class KeyedState:
    """A keyed table in a folder, in numbered versions: each is written whole beside the others and then renamed into
    place, so a reader sees the last complete one. A version that can't be read is passed over for the one before; without
    any the state is empty, and every key has its defaults. A table equal to the last version is not written."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keep: int = 2):
        self.spark, self.path, self.schema, self.keep = spark, path.rstrip("/"), spark.createDataFrame([], schema).schema, keep
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))

    def _table(self, version: int) -> DataFrame | None:
        place = f"{self.path}/version={version}"
        if not self._fs.exists(self._path(f"{place}/_SUCCESS")):
            return None
        found = self.spark.read.schema(self.schema).parquet(place)
        try:
            found.write.format("noop").mode("overwrite").save()  # every column of every file can be read
        except Exception as error:  # noqa: BLE001  # whatever is wrong with the files, the version before is taken
            print(f"state {place} can't be read and is passed over: {type(error).__name__}")
            return None
        return found

    def load(self) -> DataFrame:
        """The last version that can be read, else an empty table."""
        for version in reversed(self.versions()):
            found = self._table(version)
            if found is not None:
                return found
        return self.spark.createDataFrame([], self.schema)

    def save(self, table: DataFrame) -> bool:
        """Write a new version, unless it equals the last; whether it was written."""
        table = settle(table.select(*[table[f"`{f.name}`"].cast(f.dataType) for f in self.schema]), "state")
        before, versions = self.load(), self.versions()
        if versions and before.exceptAll(table).isEmpty() and table.exceptAll(before).isEmpty():
            return False
        number = (versions[-1] if versions else 0) + 1
        draft = f"{self.path}/draft-{uuid.uuid4().hex}"
        table.write.parquet(draft)
        if not self._fs.rename(self._path(draft), self._path(f"{self.path}/version={number}")):
            raise RuntimeError(f"version {number} of {self.path} was not put in place")
        for old in versions[: max(0, len(versions) + 1 - self.keep)]:
            self._fs.delete(self._path(f"{self.path}/version={old}"), True)
        return True


def updated(state: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The state with each key's last change in its place; keys without a change stay."""
    from pyspark.sql import functions as F

    fields = [c for c in state.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("_last"))
    return state.withColumn("_old", F.struct(*fields)).select(key, "_old").join(last, key, "full").select(key, F.coalesce("_last", "_old").alias("_now")).select(key, "_now.*")
