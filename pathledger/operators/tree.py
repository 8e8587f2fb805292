"""A directory tree as relations: its visible nodes, and its drawn lines."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import directory_prefix, size_human
from .browse import below

# The strokes of the drawing.
BRANCH, LAST_BRANCH, PIPE, BLANK = "├── ", "└── ", "│   ", "    "


def tree_nodes(files: DataFrame, path: str, depth: int = 2) -> DataFrame:
    """Directories and files on disk down to ``depth`` levels below ``path``.

    Columns: ``parts`` (components below ``path``), ``is_dir``, ``file_count`` and
    ``total_size``, both recursive for a directory. One scan: each file first
    counts for its deepest visible directory, which partial aggregation shrinks
    before the first exchange; only those sums are then spread to the ancestors.
    """
    if depth <= 0:
        files = files.limit(0)
    prefix = directory_prefix(path)
    parts = F.split(F.substring("path", F.lit(len(prefix) + 1), F.length("path")), "/")
    n = F.size("parts")
    deepest = F.slice("parts", F.lit(1), F.least(n - 1, F.lit(depth)))
    own = F.array_compact(
        F.array(
            F.when(n > 1, F.struct(deepest.alias("parts"), F.lit(True).alias("is_dir"))),
            F.when(n <= depth, F.struct(F.col("parts"), F.lit(False).alias("is_dir"))),
        )
    )
    direct = (
        files.filter(F.col("on_disk") & below(path))
        .select("size", parts.alias("parts"))
        .select("size", F.inline(own))
        .groupBy("parts", "is_dir")
        .agg(F.count("*").alias("_n"), F.sum("size").alias("_size"))
    )
    ancestors = F.transform(
        F.sequence(F.lit(1), F.size("parts")), lambda i: F.slice("parts", F.lit(1), i)
    )
    spread = F.when(F.col("is_dir"), ancestors).otherwise(F.array("parts"))
    return (
        direct.select("is_dir", "_n", "_size", F.explode(spread).alias("parts"))
        .groupBy("parts", "is_dir")
        .agg(F.sum("_n").alias("file_count"), F.sum("_size").alias("total_size"))
        .filter(F.try_element_at("parts", F.lit(-1)) != "")
    )


def _parent(parts: Column) -> Column:
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def tree_lines(nodes: DataFrame, path: str) -> DataFrame:
    """The drawing of ``tree_nodes`` as one ``line`` per row, top to bottom.

    ``nodes`` is read several times: hand in a persisted or written table.
    Whether a node is the last of its siblings comes from a partial maximum per
    directory, not from a window, so a directory of any width spreads over all
    tasks. What is joined back has one row per visible directory.
    """
    is_file = (~F.col("is_dir")).alias("is_file")
    nodes = nodes.select(
        "*", F.try_element_at("parts", F.lit(-1)).alias("name"), is_file, _parent(F.col("parts")).alias("parent")
    )
    lasts = nodes.groupBy("parent").agg(F.max(F.struct("name", "is_file")).alias("last"))
    is_last = F.struct("name", "is_file") == F.col("last")

    strokes = (
        nodes.filter("is_dir")
        .join(lasts, "parent")
        .select(
            F.col("parts").alias("ancestor"), F.when(is_last, BLANK).otherwise(PIPE).alias("stroke")
        )
    )
    # At most ``depth`` strokes meet in one indent.
    chains = nodes.filter("is_dir").select(
        F.col("parts").alias("parent"),
        F.posexplode(
            F.transform(
                F.sequence(F.lit(1), F.size("parts")), lambda i: F.slice("parts", F.lit(1), i)
            )
        ).alias("level", "ancestor"),
    )
    indents = (
        chains.join(strokes, "ancestor")
        .groupBy("parent")
        .agg(F.array_sort(F.collect_list(F.struct("level", "stroke"))).alias("strokes"))
        .select("parent", F.array_join(F.col("strokes.stroke"), "").alias("indent"))
    )
    directories = lasts.join(indents, "parent", "left")

    human = size_human(F.col("total_size"))
    label = F.when(
        F.col("is_dir"),
        F.concat("name", F.lit("/ ("), F.col("file_count"), F.lit(" files, "), human, F.lit(")")),
    ).otherwise(F.concat("name", F.lit(" ("), human, F.lit(")")))
    line = F.concat(
        F.coalesce("indent", F.lit("")),
        F.when(is_last, LAST_BRANCH).otherwise(BRANCH),
        label,
    )
    # Components compare by text; at equal names a directory precedes a file.
    order = F.transform(
        "parts",
        lambda part, i: F.struct(
            part.alias("name"), (F.col("is_file") & (i == F.size("parts") - 1)).alias("is_file")
        ),
    )
    drawn = nodes.join(directories, "parent").select(order.alias("order"), line.alias("line"))
    top = drawn.sparkSession.range(1).select(
        F.array().cast(drawn.schema["order"].dataType).alias("order"), F.lit(path).alias("line")
    )
    return top.unionByName(drawn).orderBy("order").select("line")
