"""One DataFrame per operator, each over whole relations derived from the given tables."""

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathledger import Catalog, write_tsv
from pathledger import functions as fn
from pathledger import operators as ops
from pathledger.plans.batch import REPORT
from pathledger.schema import LOG_SCHEMA
from pathledger.sources import scan_roots
from pathledger.sources.local import local_frame
from pathledger.sources.storage import Staging

from . import relations as rel
from .relations import FILE, LOG, VIEW

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# What the browsing and searching queries ask for.
LS_PATH = "/ds/cxi/cxi00004/results"
DIRS_PATH = "/ds/cxi"
DEEP_DIRS_PATH = "/ds/mfx/mfx00003/"
TREE_PATH = "/ds/mfx"
EXPERIMENT = "mfx00007"
LARGE, SMALL = 2_000_000_000, 500_000_000
SINCE, UNTIL = 1_700_010_000, 1_700_040_000
FUZZY = "f_1000.h5"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# -- sources and sinks -------------------------------------------------------------


@query
def read_log(spark, sf_dir):
    catalog, _ = rel.recorded(spark, sf_dir)
    return catalog.log.read_log().select(*LOG)


@query
def write_base(spark, sf_dir):
    catalog, _ = rel.recorded(spark, sf_dir)
    return (
        catalog.log.commits()
        .filter("kind = 'base' AND action = 'add'")
        .select("exp_dir", "snapshot_ts", "n_added", "n_modified", "n_removed")
    )


@query
def write_delta(spark, sf_dir):
    catalog, _ = rel.recorded(spark, sf_dir)
    return (
        catalog.log.commits()
        .filter("kind = 'delta' AND action = 'add'")
        .select("exp_dir", "snapshot_ts", "n_added", "n_modified", "n_removed", "key_bytes")
    )


@query
def list_snapshots(spark, sf_dir):
    catalog, _ = rel.recorded(spark, sf_dir)
    listed = catalog.list_snapshots()
    return listed.select("experiment", "type", "timestamp", "record_count")


@query
def snapshot_summary(spark, sf_dir):
    return ops.snapshot_summary(rel.snapshot_log(spark, sf_dir))


@query
def checksum_sha256(spark, sf_dir):
    documents = rel.table(spark, sf_dir, "documents")
    return documents.select("doc_id", F.sha2("text", 256).alias("checksum"))


@query
def archive_snapshots(spark, sf_dir):
    """Snapshots found in the archive after a consolidation."""
    catalog, _ = rel.record_scans(spark, sf_dir)
    archive = rel.scratch(spark) + "/archive"
    catalog.consolidate(archive, snapshot_ts="t3")
    archived = spark.read.schema(LOG_SCHEMA).parquet(archive)
    return archived.groupBy("exp_dir", "kind", "snapshot_ts").agg(
        F.count("*").alias("record_count")
    )


# -- scalar derivations ------------------------------------------------------------


@query
def path_parts(spark, sf_dir):
    url = F.col("url")
    return rel.table(spark, sf_dir, "pages").select(
        "page_id", fn.parent_path(url).alias("parent_path"), fn.filename(url).alias("filename")
    )


@query
def run_extract(spark, sf_dir):
    k = F.col("o_orderkey")
    text = k.cast("string")
    path = (
        F.when(k % 5 == 0, F.concat(F.lit("/brun"), text, F.lit("/run0003/f")))
        .when(k % 5 == 1, F.concat(F.lit("/scratch/run"), F.lpad(text, 9, "0"), F.lit("/f")))
        .when(k % 5 == 2, F.concat(F.lit("/results/f_"), text))
        .when(k % 5 == 3, F.concat(F.lit("/xtc/run"), (k * 1000003).cast("string")))
        .otherwise(F.concat(F.lit("/runs/RUN/run"), text, F.lit("/run1")))
    )
    orders = rel.table(spark, sf_dir, "orders").select("o_orderkey", path.alias("path"))
    return orders.select("o_orderkey", fn.run_number(F.col("path")).alias("run"))


@query
def exp_dir_name(spark, sf_dir):
    k = F.col("o_orderkey")
    experiment = F.when(k % 3 == 1, "").when(k % 3 == 2, F.concat(F.lit("exp"), k.cast("string")))
    root = F.concat(F.lit("/ds/"), k.cast("string"))
    orders = rel.table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", fn.exp_dir_name(experiment, root).alias("exp_dir"))


@query
def parse_size(spark, sf_dir):
    k = F.col("o_orderkey")
    text, rest = k.cast("string"), (k % 100).cast("string")
    written = (
        F.when(k % 8 == 0, text)
        .when(k % 8 == 1, F.concat(text, F.lit("kb")))
        .when(k % 8 == 2, F.concat(text, F.lit("."), rest, F.lit("MB")))
        .when(k % 8 == 3, F.concat(F.lit("  "), text, F.lit(" Gb ")))
        .when(k % 8 == 4, F.concat((k % 1000).cast("string"), F.lit(".5TB")))
        .when(k % 8 == 5, F.concat((k % 1000).cast("string"), F.lit("PB")))
        .when(k % 8 == 6, F.concat(text, F.lit("."), rest))
        .otherwise(F.concat(text, F.lit(".25B")))
    )
    orders = rel.table(spark, sf_dir, "orders").select("o_orderkey", written.alias("written"))
    return orders.select("o_orderkey", fn.parse_size_column(F.col("written")).alias("size"))


@query
def size_human(spark, sf_dir):
    k = F.col("o_orderkey")
    size = (
        F.when(k % 6 == 0, k % 2048)
        .when(k % 6 == 1, k * 64)
        .when(k % 6 == 2, (k * 7919123) % 3000000000)
        .when(k % 6 == 3, k * 1048576 + 524288)
        .when(k % 6 == 4, k * 68719476736)
    )
    orders = rel.table(spark, sf_dir, "orders").select("o_orderkey", size.alias("size"))
    return orders.select("o_orderkey", "size", fn.size_human(F.col("size")).alias("size_human"))


# -- change log --------------------------------------------------------------------


def _scans(spark, sf_dir):
    """State before the last scan, and that scan."""
    return rel.state_before_last_scan(spark, sf_dir), rel.scan_rows(spark, sf_dir, 2)


@query
def snapshot_diff(spark, sf_dir):
    return ops.snapshot_diff(*_scans(spark, sf_dir)).select(*FILE, "status")


@query
def diff_added(spark, sf_dir):
    return ops.added_entries(*_scans(spark, sf_dir)).select(*FILE)


@query
def diff_removed(spark, sf_dir):
    return ops.removed_entries(*_scans(spark, sf_dir)).select(*FILE)


@query
def diff_modified(spark, sf_dir):
    return ops.modified_entries(*_scans(spark, sf_dir)).select(*FILE)


@query
def diff_restored(spark, sf_dir):
    return ops.restored_entries(*_scans(spark, sf_dir)).select(*FILE)


@query
def diff_counts(spark, sf_dir):
    changes = ops.snapshot_diff(*_scans(spark, sf_dir))
    return ops.change_counts(changes, ["experiment"])


@query
def latest_base(spark, sf_dir):
    return ops.latest_base(ops.snapshot_summary(rel.snapshot_log(spark, sf_dir)))


@query
def deltas_after_base(spark, sf_dir):
    return ops.deltas_after_base(ops.snapshot_summary(rel.snapshot_log(spark, sf_dir)))


@query
def current_state(spark, sf_dir):
    return ops.replay(rel.snapshot_log(spark, sf_dir)).select(*VIEW)


@query
def files_view(spark, sf_dir):
    return rel.files(spark, sf_dir).select(*VIEW)


@query
def files_view_base_only(spark, sf_dir):
    return ops.files_view_base_only(rel.base_log(spark, sf_dir)).select(*VIEW)


@query
def files_view_selective(spark, sf_dir):
    catalog, _ = rel.recorded(spark, sf_dir)
    # One row per experiment, from the commits.
    changing = catalog.log.snapshots().filter("kind = 'delta'").select("exp_dir").distinct().collect()
    log = rel.snapshot_log(spark, sf_dir)
    return ops.files_view_selective(log, [r.exp_dir for r in changing]).select(*VIEW)


@query
def files_view_by_path(spark, sf_dir):
    """One row per path across experiments."""
    return ops.files_view(rel.snapshot_log(spark, sf_dir), ["path"]).select(*VIEW)


@query
def files_view_merged(spark, sf_dir):
    """Base rows that no delta mentions, and the newest delta rows."""
    merged = ops.merge_on_read(rel.base_log(spark, sf_dir), rel.delta_log(spark, sf_dir))
    return merged.select(*VIEW)


@query
def files_view_stored(spark, sf_dir):
    """The view of a catalog on storage."""
    catalog, _ = rel.recorded(spark, sf_dir)
    return catalog.files().select(*VIEW)


@query
def consolidate(spark, sf_dir):
    """The view after compaction, which must be the view before."""
    catalog, _ = rel.record_scans(spark, sf_dir)
    catalog.consolidate(snapshot_ts="t3")
    return catalog.files().select(*VIEW)


@query
def index_report(spark, sf_dir):
    """What the batch index of the last scan reports per experiment."""
    _, changes = rel.recorded(spark, sf_dir)
    rows = [
        (c.exp_dir[:3], c.exp_dir, c.added, c.modified, c.removed, c.error) for c in changes
    ]
    return local_frame(spark, rows, REPORT).drop("error")


def _document_files(spark, sf_dir):
    """A directory tree with one file per document below its language and source."""
    root = rel.scratch(spark).removeprefix("file:") + "/documents"

    def write(frames):
        for frame in frames:
            for row in frame.itertuples():
                folder = f"{root}/{row.lang}/{row.source}"
                os.makedirs(folder, exist_ok=True)
                with open(f"{folder}/{row.doc_id}.txt", "w", encoding="utf-8", newline="") as file:
                    file.write(row.text)
            yield frame[["doc_id"]]

    documents = rel.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    written = documents.mapInPandas(write, "doc_id long").count()
    return root, written


@query
def scan_tree(spark, sf_dir):
    """Files and bytes of every directory of that tree, as the walk finds them."""
    root, _ = _document_files(spark, sf_dir)
    # The staged walk stays, since the result is lazy.
    scan = scan_roots(spark, [("tree", "tree", root)], Staging(spark, rel.scratch(spark)))
    directory = F.substring_index("parent_path", "/", -2).alias("directory")
    return scan.files.groupBy(directory).agg(F.count("*").alias("file_count"), F.sum("size").alias("total_size"))


@query
def checksum_files(spark, sf_dir):
    """Every document as a file of its own, scanned with sizes and checksums."""
    root, _ = _document_files(spark, sf_dir)
    scan = scan_roots(spark, [("d", "d", root)], Staging(spark, rel.scratch(spark)), compute_checksum=True)
    doc_id = F.substring_index("filename", ".", 1).cast("long")
    return scan.files.select(doc_id.alias("doc_id"), "checksum", "size")


@query
def index_tree(spark, sf_dir):
    """The batch index over that tree: languages as hutches, which share the sources' names."""
    root, _ = _document_files(spark, sf_dir)
    hutches = sorted(r.lang for r in rel.table(spark, sf_dir, "documents").select("lang").distinct().collect())
    catalog = Catalog(spark, rel.scratch(spark) + "/catalog")
    return catalog.index(root, hutches).drop("error")


@query
def base_or_delta(spark, sf_dir):
    """What each scan of an experiment was recorded as."""
    catalog, _ = rel.recorded(spark, sf_dir)
    return catalog.log.commits().filter("action = 'add'").select("exp_dir", "snapshot_ts", "kind")


@query
def tsv_sink(spark, sf_dir):
    """Removed entries written as text and read again."""
    catalog, _ = rel.recorded(spark, sf_dir)
    path = rel.scratch(spark) + "/removed"
    write_tsv(catalog.find(removed_only=True).select("path", "size", "run"), path)
    return spark.read.option("sep", "\t").schema("path string, size long, run int").csv(path)


@query
def dry_run_counts(spark, sf_dir):
    return ops.dry_run_counts(rel.inventory(spark, sf_dir, 0))


# -- browsing, searching, totals ---------------------------------------------------


@query
def ls(spark, sf_dir):
    return ops.list_directory(rel.files(spark, sf_dir), LS_PATH).select(*VIEW)


@query
def ls_on_disk(spark, sf_dir):
    return ops.list_directory(rel.files(spark, sf_dir), LS_PATH, True).select(*VIEW)


@query
def ls_dirs(spark, sf_dir):
    return ops.list_directories(rel.files(spark, sf_dir), DIRS_PATH)


@query
def ls_dirs_on_disk(spark, sf_dir):
    return ops.list_directories(rel.files(spark, sf_dir), DEEP_DIRS_PATH, True)


def _find(spark, sf_dir, *args, **conditions):
    return ops.find(rel.files(spark, sf_dir), *args, **conditions).select(*VIEW)


@query
def find_like(spark, sf_dir):
    return _find(spark, sf_dir, "%/run000_/%.h5")


@query
def find_exclude(spark, sf_dir):
    return _find(spark, sf_dir, "%", exclude=["%.h5", "%/scratch/%"])


@query
def find_size_range(spark, sf_dir):
    return _find(spark, sf_dir, "%", size_gt=SMALL, size_lt=LARGE)


@query
def find_experiment(spark, sf_dir):
    return _find(spark, sf_dir, "%", experiment=EXPERIMENT)


@query
def find_removed(spark, sf_dir):
    return _find(spark, sf_dir, "%", removed_only=True)


@query
def find_on_disk(spark, sf_dir):
    return _find(spark, sf_dir, "%", on_disk_only=True)


@query
def find_no_symlinks(spark, sf_dir):
    return _find(spark, sf_dir, "%", skip_symlinks=True)


@query
def find_status(spark, sf_dir):
    found = ops.find(rel.files(spark, sf_dir), "%.txt")
    human = fn.size_human(F.col("size")).alias("size_human")
    return ops.with_status(found).select("path", human, "state")


@query
def find_combined(spark, sf_dir):
    return _find(
        spark, sf_dir, "/ds/%", size_gt=SMALL, exclude=["%.xtc2"], on_disk_only=True,
        skip_symlinks=True,
    )


@query
def tree_nodes(spark, sf_dir):
    nodes = ops.tree_nodes(rel.files(spark, sf_dir), TREE_PATH, 3)
    return nodes.select(
        F.array_join("parts", "/").alias("node"), "is_dir", "file_count", "total_size"
    )


@query
def tree_lines(spark, sf_dir):
    nodes = ops.tree_nodes(rel.files(spark, sf_dir), TREE_PATH, 2)
    nodes = Staging(spark, rel.scratch(spark)).write(nodes, "nodes")
    return ops.tree_lines(nodes, TREE_PATH)


# -- the same questions asked of a stored catalog ----------------------------------


@query
def catalog_ls(spark, sf_dir):
    return rel.recorded(spark, sf_dir)[0].ls(LS_PATH).select(*VIEW)


@query
def catalog_ls_dirs(spark, sf_dir):
    return rel.recorded(spark, sf_dir)[0].ls_dirs(DIRS_PATH)


@query
def catalog_find(spark, sf_dir):
    found = rel.recorded(spark, sf_dir)[0].find(
        "/ds/%", size_gt=SMALL, exclude=["%.xtc2"], on_disk_only=True, skip_symlinks=True
    )
    return found.select(*VIEW)


@query
def catalog_find_experiment(spark, sf_dir):
    return rel.recorded(spark, sf_dir)[0].find(experiment=EXPERIMENT).select(*VIEW)


@query
def catalog_tree(spark, sf_dir):
    return rel.recorded(spark, sf_dir)[0].tree(TREE_PATH, 2)


@query
def catalog_stats(spark, sf_dir):
    return ops.catalog_stats(rel.recorded(spark, sf_dir)[0].files())


def _summed(spark, sf_dir):
    """The recorded catalog, its directories summed up."""
    catalog, _ = rel.recorded(spark, sf_dir)
    catalog.sum_directories()
    return catalog


@query
def directory_totals(spark, sf_dir):
    """Totals of every directory, added up over the signed totals of all snapshots."""
    return _summed(spark, sf_dir).directory_totals()


@query
def summed_ls_dirs(spark, sf_dir):
    return _summed(spark, sf_dir).ls_dirs(DEEP_DIRS_PATH, True)


@query
def summed_tree(spark, sf_dir):
    return _summed(spark, sf_dir).tree(TREE_PATH, 2)


@query
def summed_stats(spark, sf_dir):
    return _summed(spark, sf_dir).stats()


@query
def catalog_sql(spark, sf_dir):
    return rel.recorded(spark, sf_dir)[0].query(SQL["sql_by_experiment"])


@query
def count_all(spark, sf_dir):
    return ops.count_files(rel.files(spark, sf_dir))


@query
def count_on_disk(spark, sf_dir):
    return ops.count_files(rel.files(spark, sf_dir), True)


@query
def total_size(spark, sf_dir):
    return ops.total_size(rel.files(spark, sf_dir))


@query
def total_size_on_disk(spark, sf_dir):
    return ops.total_size(rel.files(spark, sf_dir), True)


@query
def stats(spark, sf_dir):
    return ops.catalog_stats(rel.files(spark, sf_dir))


# -- documented SQL over the view --------------------------------------------------

# The documented statements.
SQL = {
    "sql_projection": "SELECT path, size FROM files ORDER BY path LIMIT 10",
    "sql_by_experiment": """
        SELECT experiment, COUNT(*) AS count, SUM(size)/1e9 AS gb FROM files
        GROUP BY experiment ORDER BY gb DESC, experiment LIMIT 20""",
    "sql_modified_since": """
        SELECT path, size/1e9 AS gb FROM files WHERE mtime >= 1700020000
        ORDER BY mtime DESC, path LIMIT 20""",
    "sql_largest": "SELECT path, size/1e9 AS gb FROM files ORDER BY size DESC, path LIMIT 20",
    "sql_on_disk_report": """
        SELECT experiment, COUNT(*) AS files, SUM(size)/1e12 AS tb,
               SUM(CASE WHEN on_disk THEN size ELSE 0 END)/1e12 AS tb_on_disk
        FROM files GROUP BY experiment ORDER BY tb DESC, experiment""",
}


def _sql(text: str) -> Query:
    def run(spark, sf_dir):
        rel.files(spark, sf_dir).createOrReplaceTempView("files")
        return spark.sql(text)

    return run


QUERIES.update({name: _sql(text) for name, text in SQL.items()})


# -- archive locations and further searches ----------------------------------------


def _manifest(spark, sf_dir):
    """Archive locations of every third file of the first scan."""
    k = F.col("k")
    uri = F.concat(F.lit("tape://"), (k % 100).cast("string"), F.lit("/"), k.cast("string"))
    scan = rel.inventory(spark, sf_dir, 0).filter(k % 3 == 0)
    return scan.select("path", uri.alias("archive_uri"))


@query
def archive_locations(spark, sf_dir):
    located = ops.archive_locations(rel.files(spark, sf_dir), _manifest(spark, sf_dir))
    return located.select(*VIEW, "archive_uri")


@query
def restore_manifest(spark, sf_dir):
    found = ops.find(rel.files(spark, sf_dir), "%", removed_only=True, ordered=False)
    return ops.restore_manifest(found, _manifest(spark, sf_dir))


@query
def find_extension(spark, sf_dir):
    return _find(spark, sf_dir, "%", extension=".npz")


@query
def find_regex(spark, sf_dir):
    return _find(spark, sf_dir, "%", regex=r"/run00(1[0-9]|2[0-4])/f_[0-9]*7\.")


@query
def find_fuzzy(spark, sf_dir):
    return _find(spark, sf_dir, "%", fuzzy=(FUZZY, 2))


@query
def find_mtime_range(spark, sf_dir):
    return _find(spark, sf_dir, "%", mtime_from=SINCE, mtime_to=UNTIL)


@query
def purge_dates(spark, sf_dir):
    return ops.purge_dates(rel.files(spark, sf_dir)).select("path", "size", "purge_date")
