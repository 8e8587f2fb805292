"""Read-only access to a flat catalog: ``<root>/<experiment>/{base,delta}_<ts>.parquet``."""

import re
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import FILE_SCHEMA, LOG_SCHEMA
from .local import local_frame
from .log import LiveLog, split_live

_NAME = r"([^/]+)/(base|delta)_([^/]*)\.parquet$"


class FlatFile(NamedTuple):
    exp_dir: str
    kind: str
    snapshot_ts: str
    path: str


class FlatLog:
    """Files are read where they are; nothing is converted or written.

    File names, one per snapshot, are listed on the driver, as a Parquet reader
    must do anyway; rows never are.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _read(self, paths: list[str], with_file: bool = False) -> DataFrame:
        if not paths:
            about = [T.StructField("file", T.StringType()), T.StructField("size_bytes", T.LongType())]
            schema = T.StructType(LOG_SCHEMA.fields + (about if with_file else []))
            return local_frame(self.spark, [], schema)
        # Metadata paths are URI-encoded; "+" is literal there but not to url_decode.
        where = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
        frame = (
            self.spark.read.schema(FILE_SCHEMA)
            .option("pathGlobFilter", "*.parquet")
            .parquet(*[_glob_literal(p) for p in paths])
            .select("*", where.alias("_where"), F.col("_metadata.file_size").alias("_size"))
        )
        about = [F.col("_where").alias("file"), F.col("_size").alias("size_bytes")]
        return frame.select(
            *FILE_SCHEMA.names,
            F.regexp_extract("_where", _NAME, 3).alias("snapshot_ts"),
            F.regexp_extract("_where", _NAME, 2).alias("kind"),
            F.regexp_extract("_where", _NAME, 1).alias("exp_dir"),
            *(about if with_file else []),
        )

    def _files(self) -> list[FlatFile]:
        """Every snapshot file, from one listing."""
        try:
            reader = self.spark.read.schema(FILE_SCHEMA).option("pathGlobFilter", "*.parquet")
            uris = reader.parquet(f"{self.root}/*/").inputFiles()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        paths = [unquote(uri) for uri in uris]
        found = [(re.search(_NAME, path), path) for path in paths]
        return sorted(FlatFile(*match.groups(), path) for match, path in found if match)

    def read_log(self) -> DataFrame:
        """All rows of all snapshot files."""
        return self._read([f.path for f in self._files()])

    def list_snapshots(self, exp_dir: str | None = None) -> DataFrame:
        """One row per snapshot file, counted from file metadata and footers."""
        files = [f for f in self._files() if exp_dir is None or f.exp_dir == exp_dir]
        rows = self._read([f.path for f in files], with_file=True)
        return (
            rows.groupBy("exp_dir", "kind", "snapshot_ts", "file", "size_bytes")
            .agg(F.count("*").alias("record_count"))
            .select(
                F.col("exp_dir").alias("experiment"),
                F.col("kind").alias("type"),
                F.col("snapshot_ts").alias("timestamp"),
                "file",
                "size_bytes",
                "record_count",
            )
            .orderBy("experiment", "type", "timestamp")
        )

    def live(
        self, exp_dirs=None, under: str | None = None, experiment: str | None = None, direct: bool = False
    ) -> LiveLog:
        """Live rows; this layout records no roots, so ``under`` leaves nothing out."""
        wanted = None if exp_dirs is None else set(exp_dirs)
        parts = split_live(f for f in self._files() if wanted is None or f.exp_dir in wanted)
        # Nothing here tells how large the delta keys are, so they are not broadcast.
        return LiveLog(
            *[self._read([f.path for f in files]) for files in parts],
            False,
            {f.exp_dir for f in parts.settled + parts.bases},
            0,
        )


def _glob_literal(path: str) -> str:
    """A path in which glob characters stand for themselves."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)
