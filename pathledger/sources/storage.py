"""Files and folders of a catalog through Hadoop's FileSystem, on any store Spark can reach."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Stores on which renaming a directory is one metadata operation.
_CHEAP_RENAME = {"file", "hdfs", "viewfs"}

# Characters that Spark writes as %XX in partition directory names.
_ESCAPED = set("\"#%'*/:=?\\{[]^\x7f") | {chr(c) for c in range(1, 32)}


def partition_dir(column: str, value: str) -> str:
    """Directory name of a partition value, as a partitioned write spells it."""
    text = "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in value)
    return f"{column}={text}"


def escaped(value: Column) -> Column:
    """The same spelling for a column of values."""
    codes = F.create_map(*[x for c in sorted(_ESCAPED) for x in (F.lit(c), F.lit(f"%{ord(c):02X}"))])
    letters = F.filter(F.split(value, ""), lambda c: c != "")
    return F.array_join(F.transform(letters, lambda c: F.coalesce(F.try_element_at(codes, c), c)), "")


class Storage:
    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def delete(self, path: str) -> bool:
        return self._fs(path).delete(self._path(path), True)

    def children(self, path: str) -> list[tuple[str, bool]]:
        """(name, is_directory) of everything directly in a directory."""
        if not self.exists(path):
            return []
        listed = self._fs(path).listStatus(self._path(path))
        return sorted((s.getPath().getName(), s.isDirectory()) for s in listed)

    def sizes(self, path: str, suffix: str) -> list[int]:
        """Sizes of the files directly in a directory whose names end so."""
        if not self.exists(path):
            return []
        listed = self._fs(path).listStatus(self._path(path))
        return [s.getLen() for s in listed if s.isFile() and s.getPath().getName().endswith(suffix)]

    def can_move(self, source: str, target: str) -> bool:
        here, there = self._fs(source).getUri(), self._fs(target).getUri()
        return here.equals(there) and here.getScheme() in _CHEAP_RENAME

    def move(self, source: str, target: str) -> None:
        fs = self._fs(target)
        destination = self._path(target)
        fs.mkdirs(destination.getParent())
        if not fs.rename(self._path(source), destination):
            raise OSError(f"cannot move {source} to {target}")


class Staging:
    """A shared folder for tables between the steps of one job, deleted at the end.

    It lies in ``spark.checkpoint.dir`` where the cluster names one, else in
    ``fallback``, which callers put on the store that holds their catalog. A
    written table cuts lineage, so a lost executor never repeats a directory walk.
    """

    def __init__(self, spark: SparkSession, fallback: str):
        parent = spark.conf.get("spark.checkpoint.dir", None) or fallback
        self.path = f"{parent.rstrip('/')}/pathledger-{uuid.uuid4().hex}"
        self._spark = spark

    def write(self, frame: DataFrame, name: str) -> DataFrame:
        target = f"{self.path}/{name}"
        frame.write.mode("overwrite").parquet(target)
        return self._spark.read.schema(frame.schema).parquet(target)

    def __enter__(self) -> "Staging":
        return self

    def __exit__(self, *_exc) -> None:
        Storage(self._spark).delete(self.path)
