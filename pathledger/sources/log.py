"""The snapshot log: partitioned Parquet, made visible by a commit table.

Layout below the catalog root::

    log/write=<time>-<id>/snapshot_ts=<ts>/kind=<base|delta>/exp_dir=<name>/part-*.parquet
    zones/write=<time>-<id>/part-*.parquet
    commits/<time>-<id>/part-*.parquet

Every write has a folder of its own, named by when it began, so no two writers share
one whatever snapshot time they choose. A batch of any number of experiments is one
Spark write per kind followed by one commit file. A write that fails half-way leaves
files no commit names, and no reader looks at them. Consolidation adds the new base and
retires the old snapshots in the same commit file, so readers see either all of it or
nothing.

Zones name the first and last entry of every file of a base. A listing opens only files
whose zone meets its directory, and consolidation rewrites only files that a delta meets;
the others stay where they are and become part of the new base.
"""

import uuid
from collections.abc import Iterable
from datetime import UTC, datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import directory_prefix
from ..operators.views import files_view_base_only
from ..operators.versions import merge_on_read, replay
from ..schema import BASE, COMMIT_SCHEMA, DELTA, FILE_SCHEMA, KEY, LOG_SCHEMA, SNAPSHOT_KEY, ZONE_SCHEMA
from .local import local_frame, strings
from .storage import Staging, Storage, partition_dir

# The format in which text order is time order.
TIMESTAMP = "%Y-%m-%dT%H%M%S.%f"
# Largest total of delta keys that a query broadcasts.
BROADCAST_BYTES = 64 * 1024 * 1024
# What a broadcast key costs beside its text.
KEY_OVERHEAD = 64
# Experiments whose counts a write observes on the way; a larger batch is read back for them.
OBSERVED = 32
# Rows that one task shuffles, sorts or writes as one file.
ROWS_PER_TASK = 1_000_000


class Snapshot(NamedTuple):
    exp_dir: str
    kind: str
    snapshot_ts: str
    write: str
    shared: bool = False  # some of its files lie in folders of earlier writes
    n_files: int | None = None


class Zone(NamedTuple):
    """Sort keys from ``low`` to below ``high``."""

    low: str
    high: str


def sort_key(parent_path: Column, filename: Column) -> Column:
    """Text that orders as (parent_path, filename), the order of rows within a base."""
    return F.concat(F.coalesce(parent_path, F.lit("")), F.lit("\0"), F.coalesce(filename, F.lit("")))


def directory_zone(path: str, direct: bool = False) -> Zone:
    """Where entries of a directory lie, or all entries below it."""
    if direct:
        return Zone(path + "\0", path + "\1")
    prefix = directory_prefix(path)
    # What begins with the prefix sorts below the prefix with its last character raised by one.
    return Zone(prefix.rstrip("/") + "\0", prefix[:-1] + chr(ord(prefix[-1]) + 1))


def new_write() -> str:
    """Name of the folder of a write that begins now."""
    return f"{timestamp_now()}-{uuid.uuid4().hex}"


def timestamp_now() -> str:
    """UTC, so that text order is time order all year round."""
    return datetime.now(UTC).strftime(TIMESTAMP)


class LiveLog(NamedTuple):
    """Live rows, split by what reading them costs."""

    settled: DataFrame  # bases of experiments without deltas: current as they are
    bases: DataFrame  # bases of experiments with deltas
    deltas: DataFrame
    keys_fit: bool  # the delta keys are small enough to broadcast
    exp_dirs: set[str]  # experiments that have a state
    n_rows: int  # of all three; 0 where it is not known

    def state(self, strategy: str = "auto") -> DataFrame:
        """Current state with ``exp_dir``, removed entries included, without ``status``.

        ``merge`` drops replaced base rows by an anti join, ``replay`` shuffles the
        changing experiments by key; ``auto`` merges while the keys fit a broadcast.
        """
        if strategy == "auto":
            strategy = "merge" if self.keys_fit else "replay"
        settled = files_view_base_only(self.settled)
        if strategy == "merge":
            changing = merge_on_read(self.bases, self.deltas, broadcast_keys=self.keys_fit)
        elif strategy == "replay":
            changing = replay(spread(self.bases.unionByName(self.deltas), self.n_rows))
        else:
            raise ValueError(f"unknown strategy: {strategy!r}")
        return settled.unionByName(changing)

    def state_by_key(self, tasks_for: int) -> DataFrame:
        """Current state hash-partitioned by key for a join with ``tasks_for`` rows in all.

        Where versions must be shuffled by key anyway, everything takes that one
        shuffle, and the join needs no other.
        """
        if self.keys_fit:
            return spread(self.state("merge"), tasks_for)
        rows = self.settled.unionByName(self.bases).unionByName(self.deltas)
        return replay(spread(rows, tasks_for))


def spread(rows: DataFrame, n_rows: int) -> DataFrame:
    """Rows in as many hash partitions of the key as ``n_rows`` need.

    Left alone where the session's shuffle partitions are enough, which adaptive
    execution then reduces; joins and windows on the key reuse the partitioning.
    """
    tasks = -(-n_rows // ROWS_PER_TASK)
    if tasks <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return rows
    return rows.repartition(tasks, *KEY)


def _related(root: Column, path: str) -> Column:
    """True where a root may share entries with a directory; unknown roots may."""
    here = F.lit(directory_prefix(path))
    there = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return root.isNull() | here.startswith(there) | there.startswith(here)


class LiveParts(NamedTuple):
    settled: list
    bases: list
    deltas: list


def split_live(snapshots: Iterable) -> LiveParts:
    """Live ones among listed snapshots: of each experiment its newest base and later deltas."""
    snapshots = list(snapshots)
    newest: dict[str, str] = {}
    for s in snapshots:
        if s.kind == BASE:
            newest[s.exp_dir] = max(s.snapshot_ts, newest.get(s.exp_dir, ""))
    known = [s for s in snapshots if s.exp_dir in newest]
    bases = [s for s in known if s.kind == BASE and s.snapshot_ts == newest[s.exp_dir]]
    deltas = [s for s in known if s.kind == DELTA and s.snapshot_ts > newest[s.exp_dir]]
    changing = {s.exp_dir for s in deltas}
    return LiveParts(
        [s for s in bases if s.exp_dir not in changing],
        [s for s in bases if s.exp_dir in changing],
        deltas,
    )


class LogStore:
    """Reads, appends to and retires snapshots of one catalog root."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        broadcast_bytes: int = BROADCAST_BYTES,
    ):
        self.spark = spark
        self.root = root.rstrip("/")
        self.storage = Storage(spark)
        self.broadcast_bytes = broadcast_bytes

    @property
    def log_dir(self) -> str:
        return f"{self.root}/log"

    @property
    def commits_dir(self) -> str:
        return f"{self.root}/commits"

    def staging(self) -> Staging:
        return Staging(self.spark, f"{self.root}/_staging")

    @property
    def zones_dir(self) -> str:
        return f"{self.root}/zones"

    def folder(self, write: str) -> str:
        return f"{self.log_dir}/{partition_dir('write', write)}"

    def write_dir(self, write: str, snapshot_ts: str, kind: str) -> str:
        return "/".join(
            [self.folder(write), partition_dir("snapshot_ts", snapshot_ts), partition_dir("kind", kind)]
        )

    def snapshot_dir(self, snapshot: Snapshot) -> str:
        parent = self.write_dir(snapshot.write, snapshot.snapshot_ts, snapshot.kind)
        return f"{parent}/{partition_dir('exp_dir', snapshot.exp_dir)}"

    def zone_file(self, zone) -> str:
        """Path of a file that a row of zones names."""
        place = Snapshot(zone.exp_dir, BASE, zone.at_ts, zone.at_write)
        return f"{self.snapshot_dir(place)}/{zone.name}"

    # -- commits ---------------------------------------------------------------

    def commits(self) -> DataFrame:
        """Everything ever committed, one row per snapshot and action."""
        if not self.storage.exists(self.commits_dir):
            return local_frame(self.spark, [], COMMIT_SCHEMA)
        return (
            self.spark.read.schema(COMMIT_SCHEMA)
            .option("pathGlobFilter", "*.parquet")
            .option("recursiveFileLookup", "true")
            .parquet(self.commits_dir)
        )

    def snapshots(self) -> DataFrame:
        """Snapshots added and not retired, one row each."""
        place = SNAPSHOT_KEY
        # Only the row that adds a snapshot carries its root and counts.
        facts = [c for c in COMMIT_SCHEMA.names if c not in (*place, "action", "committed_at")]
        return (
            self.commits()
            .groupBy(*place)
            .agg(
                F.bool_or(F.col("action") == "retire").alias("_retired"),
                *[F.max(c).alias(c) for c in facts],
            )
            .filter("NOT _retired")
            .drop("_retired")
        )

    def commit(self, rows: DataFrame) -> None:
        """Publishes actions as one file, whose rename is the moment they take effect.

        Every commit has a folder of its own, so that writers of different experiments
        never share a temporary folder and none loses what another publishes.
        """
        now = timestamp_now()
        self._publish(rows.withColumn("committed_at", F.lit(now)), now)

    def _publish(self, rows: DataFrame, now: str) -> None:
        folder = f"{self.commits_dir}/{now}-{uuid.uuid4().hex}"
        rows.select(*COMMIT_SCHEMA.names).coalesce(1).write.parquet(folder)

    def fold_commits(self) -> int:
        """Rewrites the commit files as one and drops what no reader needs: snapshots that
        are gone with their files. Run it while nothing else writes; returns the files replaced.

        Rows twice, as a reader sees them between writing and deleting, mean the same as once.
        """
        old = [name for name, _ in self.storage.children(self.commits_dir) if name[:1] not in "._"]
        if len(old) < 2:
            return 0
        place = SNAPSHOT_KEY
        commits = self.commits()
        gone = commits.filter("action = 'purge'").select(*place).distinct()
        self._publish(commits.join(gone, place, "left_anti"), timestamp_now())
        for name in old:
            self.storage.delete(f"{self.commits_dir}/{name}")
        return len(old)

    def newest(self, exp_dirs: Iterable[str]) -> str | None:
        """Newest time among all snapshots ever committed of some experiments."""
        wanted = local_frame(self.spark, [(e,) for e in exp_dirs], strings("exp_dir"))
        known = self.commits().filter("action = 'add'").join(wanted, "exp_dir", "left_semi")
        return known.agg(F.max("snapshot_ts")).first()[0]

    # -- reading ---------------------------------------------------------------

    def _scan(self, paths: list[str]) -> DataFrame:
        if not paths:
            return local_frame(self.spark, [], LOG_SCHEMA)
        return (
            self.spark.read.schema(LOG_SCHEMA)
            .option("basePath", self.log_dir)
            .option("pathGlobFilter", "*.parquet")
            .parquet(*paths)
            .select(*LOG_SCHEMA.names)
        )

    def read(self, snapshots: Iterable[Snapshot], zone: Zone | list[Zone] | None = None) -> DataFrame:
        """Rows of the given snapshots; only their directories are listed.

        With a zone, files of bases that hold nothing of it are left out. Zones are asked
        only about bases of several files, and of such that share files with earlier ones.
        Rows of shared files carry the time of the snapshot that wrote them.
        """
        snapshots = list(snapshots)
        several = [
            s for s in snapshots
            if s.shared or (zone is not None and s.kind == BASE and (s.n_files or 0) > 1)
        ]
        others = set(snapshots) - set(several)
        files = [self.zone_file(z) for z in self.zones(several, zone).collect()] if several else []
        return self._scan([self.snapshot_dir(s) for s in snapshots if s in others] + files)

    def zones(self, bases: Iterable[Snapshot], zone: Zone | list[Zone] | None = None) -> DataFrame:
        """Files of some bases, those that can hold entries of a zone or any of several; one row per file."""
        wanted = sorted({(s.write, s.exp_dir) for s in bases})
        folders = sorted({f"{self.zones_dir}/{partition_dir('write', w)}" for w, _ in wanted})
        names = local_frame(self.spark, wanted, strings("write", "exp_dir"))
        known = (
            self.spark.read.schema(T.StructType(ZONE_SCHEMA.fields + strings("write").fields))
            .option("basePath", self.zones_dir)
            .parquet(*folders)
            .join(names, ["write", "exp_dir"], "left_semi")
        )
        if isinstance(zone, Zone):
            known = known.filter((F.col("greatest") >= zone.low) & (F.col("least") < zone.high))
        elif zone is not None:
            ranges = local_frame(self.spark, [tuple(z) for z in zone], strings("low", "high"))
            met = (F.col("greatest") >= F.col("low")) & (F.col("least") < F.col("high"))
            known = known.join(F.broadcast(ranges), met, "left_semi")
        return known

    def read_written(self, write: str, snapshot_ts: str, kind: str) -> DataFrame:
        """Rows one write left behind, committed or not."""
        path = self.write_dir(write, snapshot_ts, kind)
        return self._scan([path] if self.storage.exists(path) else [])

    def read_log(self) -> DataFrame:
        """All visible rows, older versions included."""
        chosen = self.snapshots().select(*Snapshot._fields).collect()
        return self.read(Snapshot(*row) for row in chosen)

    def live(
        self,
        exp_dirs: Iterable[str] | None = None,
        under: str | None = None,
        experiment: str | None = None,
        direct: bool = False,
    ) -> LiveLog:
        """The log rows that make up the current state, optionally of some experiments.

        ``under`` leaves out experiments whose scanned roots neither hold nor lie in
        that directory, and files of bases whose zones don't meet it; with ``direct``,
        those that hold no entry of the directory itself.
        ``experiment`` leaves out those of which every snapshot is known to hold
        another experiment's entries only.

        The names of live snapshots come to the driver, whatever their number: the plan
        of a scan holds every file below them anyway. A state is three scans.
        """
        zone = None if under is None else directory_zone(under, direct)
        return self.live_of(self.live_listing(exp_dirs, under, experiment), zone)

    def live_listing(
        self, exp_dirs: Iterable[str] | None = None, under: str | None = None, experiment: str | None = None
    ) -> list:
        """Snapshots that :meth:`live` reads, as rows of :meth:`listed`."""
        snapshots = self.snapshots()
        if exp_dirs is not None:
            wanted = local_frame(self.spark, [(e,) for e in exp_dirs], strings("exp_dir"))
            snapshots = snapshots.join(wanted, "exp_dir", "left_semi")
        if under is not None:
            near = snapshots.filter(_related(F.col("root"), under)).select("exp_dir").distinct()
            snapshots = snapshots.join(near, "exp_dir", "left_semi")
        if experiment is not None:
            may = F.col("experiment").isNull() | (F.col("experiment") == experiment)
            holds = snapshots.filter(may).select("exp_dir").distinct()
            snapshots = snapshots.join(holds, "exp_dir", "left_semi")
        return self.listed(snapshots)

    def listed(self, snapshots: DataFrame) -> list:
        """Snapshots as rows that begin with the fields of :class:`Snapshot`."""
        return snapshots.select(
            *Snapshot._fields, "root", "key_bytes", "n_records", "n_bytes", "experiment"
        ).collect()

    def _fits(self, key_bytes: int | None, n_records: int | None) -> bool:
        return (key_bytes or 0) + KEY_OVERHEAD * (n_records or 0) <= self.broadcast_bytes

    def keys_fit(self, deltas) -> bool:
        """Whether the keys of listed deltas may be broadcast."""
        return self._fits(sum(r.key_bytes for r in deltas), sum(r.n_records for r in deltas))

    def live_of(self, listed, zone: Zone | list[Zone] | None = None) -> LiveLog:
        """The live ones of listed snapshots, less the files of bases that hold nothing of the zones."""
        parts = split_live(listed)
        return LiveLog(
            *[self.read((as_snapshot(row) for row in rows), zone) for rows in parts],
            self.keys_fit(parts.deltas),
            {r.exp_dir for r in parts.settled + parts.bases},
            sum(r.n_records for rows in parts for r in rows),
        )

    # -- writing ---------------------------------------------------------------

    def write_base(self, rows: DataFrame, write: str, snapshot_ts: str, n_rows: int, at_least: int = 1) -> None:
        """Writes full snapshots of about ``n_rows`` rows, laid out by path.

        Range partitioning gives every file a contiguous run of paths however
        large one experiment is, so a listing later touches few files and pages.
        """
        tasks = max(at_least, -(-n_rows // ROWS_PER_TASK))
        clustered = rows.repartitionByRange(tasks, "exp_dir", "parent_path", "filename")
        self._write(self._sorted(clustered), write, snapshot_ts, BASE)

    def write_delta(self, rows: DataFrame, write: str, snapshot_ts: str, exp_dirs: Iterable[str] | None = None) -> list:
        """Writes changes and returns their commit columns. Rebalancing splits a large experiment
        and packs small ones, without the sampling pass over the diff that a range partitioning needs.

        For the few ``exp_dirs`` of a usual batch, the write itself counts. It does so in its
        last stage, after the shuffle, where a task that is repeated counts once.
        """
        laid_out = self._sorted(rows.hint("rebalance", "exp_dir"))
        named = sorted(exp_dirs or [])
        if not 0 < len(named) <= OBSERVED:
            self._write(laid_out, write, snapshot_ts, DELTA)
            return self.measure_delta(write, snapshot_ts)
        seen = Observation()
        metrics = [m.alias(f"{c}_{i}") for i, e in enumerate(named) for c, m in _delta_metrics(F.col("exp_dir") == e).items()]
        self._write(laid_out.observe(seen, *metrics), write, snapshot_ts, DELTA)
        measured = []
        for i, exp_dir in enumerate(named):
            counts = {c: seen.get[f"{c}_{i}"] for c in _delta_metrics(F.lit(True))}
            if not counts["n_records"]:
                continue
            least, most, known = (counts.pop(c) for c in ("least", "most", "known"))
            one = least if least == most and known == counts["n_records"] else None
            place = Snapshot(exp_dir, DELTA, snapshot_ts, write)
            files = self.storage.sizes(self.snapshot_dir(place), ".parquet")
            measured.append(Row(**place._asdict() | counts | {"experiment": one, "n_files": len(files), "n_bytes": sum(files)}))
        return measured

    @staticmethod
    def _sorted(rows: DataFrame) -> DataFrame:
        columns = rows.select("exp_dir", *FILE_SCHEMA.names)
        return columns.sortWithinPartitions("exp_dir", "parent_path", "filename")

    def _write(self, rows: DataFrame, write: str, snapshot_ts: str, kind: str) -> None:
        # The folder is this write's own; one that is there already is an error.
        (
            rows.write.option("compression", "zstd")
            .partitionBy("exp_dir")
            .parquet(self.write_dir(write, snapshot_ts, kind))
        )

    def discard(self, write: str) -> None:
        """Deletes what a write left that is not to be committed."""
        self.storage.delete(self.folder(write))
        self.storage.delete(f"{self.zones_dir}/{partition_dir('write', write)}")

    def add_zones(self, zones: DataFrame, write: str) -> None:
        folder = f"{self.zones_dir}/{partition_dir('write', write)}"
        zones.select(*ZONE_SCHEMA.names).coalesce(1).write.mode("append").parquet(folder)

    def measure_base(self, write: str, snapshot_ts: str) -> list:
        """Commit columns of the bases of one write, whose zones are recorded on the way."""
        rows = self.read_written(write, snapshot_ts, BASE)
        key = sort_key(F.col("parent_path"), F.col("filename"))
        per_file = rows.groupBy("exp_dir", F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("n_bytes")).agg(
            F.min(key).alias("least"), F.max(key).alias("greatest"), F.count("*").alias("n_records"),
            _one_experiment("experiment", F.count("*")).alias("experiment"),
        )
        self.add_zones(per_file.withColumns({"at_write": F.lit(write), "at_ts": F.lit(snapshot_ts)}), write)
        return self.sum_zones(self.spark.read.schema(ZONE_SCHEMA).parquet(f"{self.zones_dir}/{partition_dir('write', write)}"), write, snapshot_ts)

    def sum_zones(self, zones: DataFrame, write: str, snapshot_ts: str) -> list:
        """Commit columns of bases made of the given files; one row per experiment."""
        zero = F.lit(0).cast("long")
        summed = zones.groupBy("exp_dir").agg(
            F.sum("n_records").alias("n_added"), zero.alias("n_modified"), zero.alias("n_removed"),
            F.sum("n_records").alias("n_records"), F.sum("n_bytes").alias("n_bytes"), zero.alias("key_bytes"),
            _one_experiment("experiment", F.count("*")).alias("experiment"),
            F.count("*").alias("n_files"), F.bool_or(F.col("at_write") != write).alias("shared"),
        )
        return self._named(summed, write, snapshot_ts, BASE).collect()

    def measure_delta(self, write: str, snapshot_ts: str) -> list:
        """Commit columns of the deltas of one write, from file metadata, the status and paths."""
        status = F.col("status")
        per_file = (
            self.read_written(write, snapshot_ts, DELTA)
            .groupBy("exp_dir", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("n_bytes"))
            .agg(
                F.count_if(status == "added").alias("n_added"),
                F.count_if(status == "modified").alias("n_modified"),
                F.count_if(status == "removed").alias("n_removed"),
                F.count("*").alias("n_records"),
                F.sum(F.octet_length("path")).alias("key_bytes"),
                _one_experiment("experiment", F.count("*")).alias("experiment"),
            )
        )
        sums = ("n_added", "n_modified", "n_removed", "n_records", "n_bytes", "key_bytes")
        summed = per_file.groupBy("exp_dir").agg(
            *[F.sum(c).alias(c) for c in sums],
            _one_experiment("experiment", F.count("*")).alias("experiment"),
            F.count("*").alias("n_files"), F.lit(False).alias("shared"),
        )
        return self._named(summed, write, snapshot_ts, DELTA).collect()

    @staticmethod
    def _named(rows: DataFrame, write: str, snapshot_ts: str, kind: str) -> DataFrame:
        return rows.withColumns({"kind": F.lit(kind), "snapshot_ts": F.lit(snapshot_ts), "write": F.lit(write)})


def as_snapshot(row) -> Snapshot:
    return Snapshot(*row[: len(Snapshot._fields)])


def commit_rows(action: str, rows: Iterable, **given) -> list[tuple]:
    """Rows of the commit table from rows that hold some of its columns."""
    dicts = [{**(r._asdict() if hasattr(r, "_asdict") else r.asDict()), "action": action, **given} for r in rows]
    return [tuple(d.get(c) for c in COMMIT_SCHEMA.names) for d in dicts]


def _delta_metrics(mine: Column) -> dict[str, Column]:
    """What a commit says of the changes of one experiment."""
    status, experiment = F.col("status"), F.when(mine, F.col("experiment"))
    return {
        "n_added": F.count_if(mine & (status == "added")),
        "n_modified": F.count_if(mine & (status == "modified")),
        "n_removed": F.count_if(mine & (status == "removed")),
        "n_records": F.count_if(mine),
        "key_bytes": F.sum(F.when(mine, F.octet_length("path"))),
        "least": F.min(experiment), "most": F.max(experiment), "known": F.count(experiment),
    }


def _one_experiment(column: str, rows: Column) -> Column:
    """The one value that all rows of a group have; NULL if there are several or none."""
    same = (F.min(column) == F.max(column)) & (F.count(column) == rows)
    return F.when(same, F.max(column))
