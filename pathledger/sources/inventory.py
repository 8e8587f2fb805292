"""Any table of paths as an inventory: listings made by storage systems, exports, other scans."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exp_dir_name, filename, parent_path, run_number
from ..schema import FILE_SCHEMA

# Columns a scan can know; the log adds the others.
SCANNED = [f for f in FILE_SCHEMA if f.name not in ("indexed_at", "on_disk", "status")]


def from_table(table: DataFrame, root: str | Column | None = None) -> DataFrame:
    """Brings a table with at least ``path``, ``size`` and ``mtime`` to inventory columns.

    Parent and name always come from the path, the run unless it is given; other
    missing columns are NULL. ``exp_dir`` comes from the column, else from
    ``experiment``, else from ``root``; one of the three must be there.
    """
    if root is None and not {"exp_dir", "experiment"} & set(table.columns):
        raise ValueError("an inventory needs exp_dir, experiment or root")
    path = F.col("path")
    values = {f.name: F.col(f.name) for f in SCANNED if f.name in table.columns}
    values.setdefault("run", run_number(path))
    values.update(parent_path=parent_path(path), filename=filename(path))

    def column(field):
        return values.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name)

    if "exp_dir" in table.columns:
        place = F.col("exp_dir")
    else:
        where = root if isinstance(root, Column) else F.lit(root)
        known = F.col("experiment") if "experiment" in table.columns else F.lit(None).cast("string")
        place = exp_dir_name(known, where)
    return table.select(place.alias("exp_dir"), *[column(f) for f in SCANNED])
