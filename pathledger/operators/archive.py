"""Where purged files went, and what to ask back."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def archive_locations(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Attaches ``archive_uri`` from a manifest of (path, archive_uri).

    A URI already known stays where the manifest has none. Of several manifest
    rows for one path the greatest URI counts, so no file is doubled.
    """
    places = manifest.groupBy("path").agg(F.max("archive_uri").alias("_uri"))
    known = F.col("archive_uri") if "archive_uri" in files.columns else F.lit(None)
    return (
        files.join(places, "path", "left")
        .withColumn("archive_uri", F.coalesce("_uri", known.cast("string")))
        .drop("_uri")
    )


def restore_manifest(entries: DataFrame, manifest: DataFrame) -> DataFrame:
    """Path, size and URI of the removed entries that the archive holds."""
    return (
        archive_locations(entries.filter(~F.col("on_disk")), manifest)
        .filter("archive_uri IS NOT NULL")
        .select("path", "archive_uri", "size")
    )


def purge_dates(files: DataFrame) -> DataFrame:
    """Entries that are gone with the time of the scan that last missed them.

    The view dates a removed entry by its latest removal, so no look into the log
    is needed, and the date survives consolidation.
    """
    return files.filter(~F.col("on_disk")).withColumn("purge_date", F.col("indexed_at"))
