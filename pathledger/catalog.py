"""The catalog: one object per root, lazy DataFrames out."""

from collections.abc import Iterable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as ops
from . import plans
from .functions import directory_prefix
from .operators.rollup import directory_level
from .operators.search import as_entries
from .plans import Change
from .schema import ENTRY_COLUMNS, VIEW_COLUMNS
from .sources import DirectorySums, FlatLog, LogStore
from .sources.log import directory_zone
from .sources.storage import escaped


# Directories of a drawn tree whose files are looked up by zone; beyond, all below its root.
TREE_ZONES = 1_000


def _within(totals: DataFrame, under: str | None) -> DataFrame:
    if under is None:
        return totals
    return totals.filter((F.col("directory") == (under.rstrip("/") or "/")) | F.col("directory").startswith(directory_prefix(under)))


class CatalogReader:
    """Browsing, searching and SQL over a log; shared by both layouts.

    Methods that return relations are lazy. ``strategy`` says how versions merge
    (see ``LiveLog.state``).
    """

    def __init__(self, spark: SparkSession, log: LogStore | FlatLog, strategy: str = "auto"):
        self.spark = spark
        self.log = log
        self.strategy = strategy

    def current_state(
        self,
        exp_dirs: Iterable[str] | None = None,
        under: str | None = None,
        experiment: str | None = None,
        direct: bool = False,
    ) -> DataFrame:
        """Newest record of every (exp_dir, path), removed ones included."""
        return self.log.live(exp_dirs, under, experiment, direct).state(self.strategy)

    def files(self, experiment: str | None = None, under: str | None = None, direct: bool = False) -> DataFrame:
        """The ``files`` relation.

        Given an experiment or a directory, only the parts of the log are read that can
        hold its entries (with ``direct``, those in the directory itself); rows of other
        experiments or directories may still appear, in part.
        """
        return self.current_state(None, under, experiment, direct).select(*VIEW_COLUMNS)

    # -- browsing and searching --------------------------------------------------

    def ls(self, path: str, on_disk_only: bool = False) -> DataFrame:
        listed = ops.list_directory(self.files(under=path, direct=True), path, on_disk_only)
        return as_entries(listed, ENTRY_COLUMNS)

    def ls_dirs(self, path: str, on_disk_only: bool = False) -> DataFrame:
        return ops.list_directories(self.files(under=path), path, on_disk_only)

    def find(self, pattern: str = "%", experiment: str | None = None, **conditions) -> DataFrame:
        """Entries meeting all conditions; see :func:`pathledger.operators.find`."""
        found = ops.find(self.files(experiment), pattern, experiment=experiment, **conditions)
        return as_entries(found, ENTRY_COLUMNS)

    def tree_nodes(self, path: str, depth: int = 2) -> DataFrame:
        return ops.tree_nodes(self.files(under=path), path, depth)

    def tree(self, path: str, depth: int = 2) -> DataFrame:
        """The drawn tree, one ``line`` per row from top to bottom, of any size."""
        return ops.tree_lines(self.tree_nodes(path, depth), path)

    def query(self, sql: str) -> DataFrame:
        """Runs any Spark SQL over the temporary view ``files``."""
        self.files().createOrReplaceTempView("files")
        return self.spark.sql(sql)

    # -- totals ------------------------------------------------------------------

    def count(self, on_disk_only: bool = False) -> int:
        return ops.count_files(self.files(), on_disk_only).first()[0]

    def total_size(self, on_disk_only: bool = False) -> int:
        return ops.total_size(self.files(), on_disk_only).first()[0]

    def stats(self) -> DataFrame:
        """Numbers and sizes of all entries and of those on disk, in one row."""
        return ops.catalog_stats(self.files())

    def get_stats(self) -> dict[str, int]:
        return self.stats().first().asDict()

    def directory_totals(self, under: str | None = None) -> DataFrame:
        """Number and size of the entries directly in each directory: (exp_dir, directory) and
        total_count, total_size, on_disk_count, on_disk_size; of all, or of one directory and those below it."""
        return _within(ops.directory_totals(self.current_state(under=under)), under)

    # -- archive -----------------------------------------------------------------

    def restore_manifest(self, manifest: DataFrame, pattern: str = "%", **conditions) -> DataFrame:
        """What to ask back from the archive for the removed entries that ``find`` selects."""
        found = self.find(pattern, removed_only=True, ordered=False, **conditions)
        return ops.restore_manifest(found, manifest)

    def purge_dates(self) -> DataFrame:
        return ops.purge_dates(self.files())

    # -- snapshots ---------------------------------------------------------------

    def list_snapshots(self, exp_dir: str | None = None) -> DataFrame:
        raise NotImplementedError


class FlatCatalog(CatalogReader):
    """Reads a catalog of ``<experiment>/{base,delta}_<ts>.parquet`` files in place."""

    def __init__(self, spark: SparkSession, root: str, strategy: str = "auto"):
        super().__init__(spark, FlatLog(spark, root), strategy)

    def list_snapshots(self, exp_dir: str | None = None) -> DataFrame:
        return self.log.list_snapshots(exp_dir)


class Catalog(CatalogReader):
    """A catalog in this library's layout: also records and consolidates.

    Writers of different experiments may run at once, those of one experiment one after
    the other. Readers are disturbed by neither commits nor consolidation; only ``purge``
    deletes files.
    """

    def __init__(
        self, spark: SparkSession, root: str, strategy: str = "auto", directory_sums: bool = False, **store_options
    ):
        super().__init__(spark, LogStore(spark, root, **store_options), strategy)
        self.sums = DirectorySums(self.log)
        self._keep_sums = directory_sums

    # -- directory totals --------------------------------------------------------

    def sum_directories(self) -> int:
        """Adds up the directories of live snapshots that have no totals yet; returns their number.

        A new delta costs its own rows and a scan of the keys of its base. ``ls_dirs``, ``tree``
        and ``get_stats`` then read totals for every experiment that has all of them, and files
        for the others, so their results don't depend on when this ran. A catalog opened with
        ``directory_sums=True`` does it after each write of its own.
        """
        return self.sums.build()

    def _written(self) -> None:
        if self._keep_sums:
            self.sums.build()

    def _totals(self, listed: list, under: str | None = None) -> DataFrame | None:
        """Totals of the listed experiments, NULL if all of them would have to be scanned."""
        summed, rest = self.sums.read(listed)
        if summed is None:
            return None
        if rest:
            zone = None if under is None else directory_zone(under)
            scanned = self.log.live_of(rest, zone).state(self.strategy)
            summed = summed.unionByName(ops.directory_totals(scanned))
        return _within(summed, under)

    def directory_totals(self, under: str | None = None) -> DataFrame:
        totals = self._totals(self.log.live_listing(under=under), under)
        return super().directory_totals(under) if totals is None else totals

    def stats(self) -> DataFrame:
        totals = self._totals(self.log.live_listing())
        return super().stats() if totals is None else ops.rolled_stats(totals)

    def ls_dirs(self, path: str, on_disk_only: bool = False) -> DataFrame:
        totals = self._totals(self.log.live_listing(under=path), path)
        return super().ls_dirs(path, on_disk_only) if totals is None else ops.rolled_directories(totals, path, on_disk_only)

    def tree_nodes(self, path: str, depth: int = 2) -> DataFrame:
        """As of the reader; with totals, only files in directories that are drawn are read."""
        listed = self.log.live_listing(under=path)
        totals = self._totals(listed, path)
        if totals is None:
            return super().tree_nodes(path, depth)
        level = directory_level(F.col("directory"), path)
        shown = totals.filter((F.col("on_disk_count") > 0) & (level < depth)).select("directory").distinct()
        names = [r.directory for r in shown.limit(TREE_ZONES + 1).collect()]
        few = len(names) <= TREE_ZONES
        zone = [directory_zone(name, True) for name in names] if few else directory_zone(path)
        files = self.log.live_of(listed, zone).state(self.strategy)
        if few:
            # A zone can hold a part of other directories too.
            files = files.filter(F.col("parent_path").isin(names)) if names else files.limit(0)
        return ops.rolled_nodes(totals, files, path, depth)

    def snapshot(
        self,
        root: str,
        experiment: str | None = None,
        compute_checksum: bool = False,
        workers: int | None = None,
        batch_size: int = 10_000,
        **options,
    ) -> tuple[int, int, int]:
        """Scans a tree and records it; returns numbers of added, modified, removed."""
        change = plans.snapshot_tree(
            self.log, root, experiment, compute_checksum, workers, batch_size, **options
        )
        if change.error:
            raise RuntimeError(change.error)
        self._written()
        return change.added, change.modified, change.removed

    def snapshot_table(self, inventory: DataFrame, **options) -> list[Change]:
        """Records an inventory table (see ``sources.from_table``) of many experiments."""
        changes = plans.record_snapshot(self.log, inventory, **options)
        self._written()
        return changes

    def index(self, data_root: str, hutches: list[str], **options) -> DataFrame:
        """Scans and records every experiment of the hutches; one report row each."""
        report = plans.index_experiments(self.log, data_root, hutches, **options)
        self._written()
        return report

    def dry_run(self, data_root: str, hutches: list[str], **options) -> DataFrame:
        return plans.dry_run(self.log, data_root, hutches, **options)

    def consolidate(self, archive_dir: str | None = None, **options) -> dict[str, int]:
        """Merges snapshots to one base each; the files of the old ones go with :meth:`purge`."""
        merged = plans.consolidate(self.log, archive_dir, **options)
        self._written()
        return merged

    def purge(self, older_than: timedelta = timedelta(days=1)) -> int:
        """Deletes files of snapshots retired so long ago, and folders of writes that old which
        were never committed. Queries planned before a snapshot was retired may run until then."""
        return plans.purge(self.log, older_than)

    def fold_commits(self) -> int:
        """Makes one file of all commits; for a time when nothing else writes."""
        return self.log.fold_commits()

    def list_snapshots(self, exp_dir: str | None = None) -> DataFrame:
        """Visible snapshots from the commit table, without touching the log."""
        snapshots = self.log.snapshots()
        if exp_dir is not None:
            snapshots = snapshots.filter(F.col("exp_dir") == exp_dir)
        folder = F.concat(
            F.lit(f"{self.log.log_dir}/write="), escaped(F.col("write")),
            F.lit("/snapshot_ts="), escaped(F.col("snapshot_ts")),
            F.lit("/kind="), "kind", F.lit("/exp_dir="), escaped(F.col("exp_dir")),
        )
        return snapshots.select(
            F.col("exp_dir").alias("experiment"),
            F.col("kind").alias("type"),
            F.col("snapshot_ts").alias("timestamp"),
            folder.alias("file"),
            F.col("n_bytes").alias("size_bytes"),
            F.col("n_records").alias("record_count"),
        ).orderBy("experiment", "type", "timestamp")


def write_tsv(result: DataFrame, path: str) -> None:
    """Writes a result as tab-separated text, NULL as empty; in parallel, at any size."""
    result.write.option("sep", "\t").option("nullValue", "").option("emptyValue", "").csv(path)
