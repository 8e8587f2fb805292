"""Directory totals beside the log, snapshot by snapshot.

Layout below the catalog root::

    sums/data/<build>/part-*.parquet     signed totals of the snapshots of one build
    sums/index/<build>/part-*.parquet    which snapshots those are

A build becomes visible when its index file is renamed into place. A reader uses totals of an
experiment only if every one of its live snapshots has them and adds up the others' files, so
totals are never out of date, whoever writes or consolidates. Snapshots never change, and so
neither do their totals.
"""

from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rollup import DIRECTORY, directory_totals, signed_totals
from ..schema import BASE, DELTA, KEY, SNAPSHOT_KEY, SUM_SCHEMA, TOTALS
from .local import local_frame, strings
from .log import LogStore, as_snapshot, new_write, split_live, spread


def _key(row) -> tuple:
    return tuple(row[c] for c in SNAPSHOT_KEY)


class DirectorySums:
    """Builds, reads and deletes the totals of one log."""

    def __init__(self, store: LogStore):
        self.store = store
        self.spark = store.spark
        self.data_dir = f"{store.root}/sums/data"
        self.index_dir = f"{store.root}/sums/index"

    def _index(self) -> DataFrame | None:
        if not self.store.storage.children(self.index_dir):
            return None
        return (
            self.spark.read.schema(strings(*SNAPSHOT_KEY, "build"))
            .option("pathGlobFilter", "*.parquet")
            .option("recursiveFileLookup", "true")
            .parquet(self.index_dir)
        )

    def _builds(self, rows: Iterable) -> dict[tuple, str]:
        """Of each of some snapshots that have totals, the build that holds them."""
        rows, index = list(rows), self._index()
        if index is None or not rows:
            return {}
        wanted = local_frame(self.spark, [_key(r) for r in rows], strings(*SNAPSHOT_KEY))
        # Two builders at once may both have added a snapshot: one of them counts.
        found = index.join(wanted, SNAPSHOT_KEY, "left_semi").groupBy(*SNAPSHOT_KEY).agg(F.min("build").alias("build"))
        return {_key(r): r.build for r in found.collect()}

    def build(self) -> int:
        """Adds the totals of live snapshots that lack them; returns their number.

        Bases are added up in one pass. For deltas, the rows of their experiments' live
        deltas are read again with the base rows of the same keys: a broadcast semi join
        within the store's bound on keys, a shuffled one beyond.
        """
        store = self.store
        parts = split_live(store.listed(store.snapshots()))
        live = [r for rows in parts for r in rows]
        # Two snapshots of one experiment and time can't be told apart by their rows: never summed.
        times = Counter((r.exp_dir, r.kind, r.snapshot_ts) for r in live)
        twice = {e for (e, _, _), n in times.items() if n > 1}
        done = self._builds(live)
        missing = [r for r in live if r.exp_dir not in twice and r.write is not None and _key(r) not in done]
        if not missing:
            return 0
        found = []
        bases = [r for r in missing if r.kind == BASE]
        if bases:
            names = [(r.exp_dir, r.snapshot_ts, r.write) for r in bases]
            rows = directory_totals(store.read(as_snapshot(r) for r in bases))
            # Rows of shared files name the time of the snapshot that wrote them, so the listing says it.
            found.append(self._named(rows, names, ["exp_dir"], BASE))
        changed = {r.exp_dir for r in missing if r.kind == DELTA}
        if changed:
            deltas = [r for r in parts.deltas if r.exp_dir in changed]
            names = [(r.exp_dir, r.snapshot_ts, r.write) for r in missing if r.kind == DELTA]
            changes = store.read(as_snapshot(r) for r in deltas)
            before = store.read(as_snapshot(r) for r in parts.bases if r.exp_dir in changed)
            keys = changes.select(*KEY)
            met = before.join(F.broadcast(keys) if store.keys_fit(deltas) else keys, KEY, "left_semi")
            history = spread(met.unionByName(changes), 2 * sum(r.n_records for r in deltas))
            found.append(self._named(signed_totals(history), names, ["exp_dir", "snapshot_ts"], DELTA))
        name = new_write()
        with store.staging() as staging:
            # Staged, as range bounds would evaluate it twice.
            rows = staging.write(found[0] if len(found) == 1 else found[0].unionByName(found[1]), "sums")
            laid_out = rows.repartitionByRange("directory").sortWithinPartitions("directory")
            laid_out.write.option("compression", "zstd").parquet(f"{self.data_dir}/{name}")
        index = local_frame(self.spark, [(*_key(r), name) for r in missing], strings(*SNAPSHOT_KEY, "build"))
        index.coalesce(1).write.parquet(f"{self.index_dir}/{name}")
        return len(missing)

    def _named(self, rows: DataFrame, names: list[tuple], by: list[str], kind: str) -> DataFrame:
        """Totals of the named snapshots alone, with what tells those apart."""
        listing = local_frame(self.spark, names, strings("exp_dir", "snapshot_ts", "write"))
        return rows.join(listing, by).withColumn("kind", F.lit(kind)).select(*SUM_SCHEMA.names)

    def read(self, listed: Iterable) -> tuple[DataFrame | None, list]:
        """Current totals of the listed experiments that have them all, and the snapshots of the others.

        Totals lie sorted by directory, so a condition on a prefix reaches their scan.
        """
        parts = split_live(listed)
        live = [r for rows in parts for r in rows]
        builds = self._builds(live)
        lacking = {r.exp_dir for r in live if _key(r) not in builds}
        rest = [r for r in live if r.exp_dir in lacking]
        chosen = [(*_key(r), builds[_key(r)]) for r in live if r.exp_dir not in lacking]
        if not chosen:
            return None, rest
        wanted = local_frame(self.spark, chosen, strings(*SNAPSHOT_KEY, "build"))
        folders = sorted({f"{self.data_dir}/{c[-1]}" for c in chosen})
        build = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("build")
        rows = self.spark.read.schema(SUM_SCHEMA).parquet(*folders).select("*", build)
        rows = rows.join(wanted, [*SNAPSHOT_KEY, "build"], "left_semi")
        summed = rows.groupBy(*DIRECTORY).agg(*[F.sum(c).alias(c) for c in TOTALS])
        return summed.filter("total_count <> 0"), rest

    def drop(self, kept: Iterable, limit: str) -> None:
        """Deletes builds begun before ``limit`` of which no snapshot in ``kept`` is left, or that no index names."""
        held = set(self._builds(kept).values())
        storage = self.store.storage
        for parent in (self.index_dir, self.data_dir):
            for name, _ in storage.children(parent):
                if name <= limit and name not in held:
                    storage.delete(f"{parent}/{name}")
