"""Scans of text clouds: parsing, gates, quarantine, path columns and point order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.classes import classes
from ..functions.shared import written

FIELDS = ["x", "y", "z", "r", "g", "b"]
PATH = r"([^/]+)/([^/]+)/Annotations/([^_/]+)[^/]*$"


def number_lines(raw: DataFrame) -> DataFrame:
    """``(file_path, line_no, value)`` from lines with the start of their split, in file order.

    ``raw`` is a scan with ``value``, ``file_path``, ``_s`` (start of the split)
    and ``_m`` (monotonic ids taken directly above the scan).  The ids of a
    split are consecutive, so a line's number is its distance from the first
    line of its split plus the lines of the splits before it.  Windows run over
    the splits of a file, never over its lines.
    """
    splits = raw.groupBy("file_path", "_s").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file_path").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).drop("_first", "_n")
    return raw.join(splits, ["file_path", "_s"]).select("file_path", (F.col("_base") + F.col("_m")).alias("line_no"), "value")


def read_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``(file_path, line_no, value)`` of text files, in file order even across splits."""
    raw = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_m"))
    return number_lines(raw)


def annotated_tree(spark: SparkSession, root: str, areas: list[str]) -> DataFrame:
    """Lines of ``<root>/<area>/<room>/Annotations/*.txt`` for the listed areas.

    Rooms without annotations match nothing; see :func:`missing_areas`.
    """
    return read_lines(spark, f"{root}/{{{','.join(areas)}}}/*/Annotations/*.txt")


def missing_areas(lines: DataFrame, areas: list[str]) -> DataFrame:
    """The listed areas from which no line was read."""
    wanted = lines.sparkSession.createDataFrame([(a,) for a in areas], "area string")
    return wanted.join(with_path_columns(lines).select("area").distinct(), "area", "left_anti")


def tokens(value: Column) -> Column:
    """White-space separated tokens of a line without its comment; an empty array for blank lines."""
    return F.array_remove(F.split(F.substring_index(value, "#", 1), r"\s+"), "")


def parse(lines: DataFrame) -> DataFrame:
    """Add x, y, z, r, g, b and ``ok``; blank and comment lines are dropped.

    ``ok`` is false when a line does not hold exactly six numbers.  A line is
    cut once, into an array that the columns are taken from.
    """
    cut = lines.withColumn("_n", F.transform(tokens(F.col("value")), lambda t: t.try_cast("double"))).where(F.size("_n") > 0)
    ok = (F.size("_n") == 6) & (F.size(F.array_compact("_n")) == F.size("_n"))
    return cut.select("*", *[F.get("_n", F.lit(i)).alias(name) for i, name in enumerate(FIELDS)], ok.alias("ok")).drop("_n")


def file_report(parsed: DataFrame) -> DataFrame:
    """``(file_path, n_lines, n_bad, ok)``: a file needs two lines, all of them good."""
    out = parsed.groupBy("file_path").agg(F.count("*").alias("n_lines"), F.count_if(~F.col("ok")).alias("n_bad"))
    return out.withColumn("ok", (F.col("n_bad") == 0) & (F.col("n_lines") >= 2))


def gate_files(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of good files, and the quarantined lines of all others."""
    good = file_report(parsed).where("ok").select("file_path")
    return parsed.join(good, "file_path", "left_semi"), parsed.join(good, "file_path", "left_anti")


def with_path_columns(df: DataFrame, column: str = "file_path") -> DataFrame:
    """Add ``area``, ``room`` and ``class_name`` from an annotation path."""
    return df.withColumns({n: F.regexp_extract(column, PATH, i) for i, n in enumerate(("area", "room", "class_name"), 1)})


def with_labels(df: DataFrame) -> DataFrame:
    """Add ``label`` by class name; files of unknown classes go."""
    names = classes(df.sparkSession).select("class_name", F.col("class_id").alias("label"))
    return df.join(F.broadcast(names), "class_name")  # the class table has 13 rows


def dense_index(df: DataFrame, scope: list[str], order: list[str], name: str = "point_idx") -> DataFrame:
    """Number rows from 0 within each scope, in order; only for scopes with a proven bound on their size."""
    w = Window.partitionBy(*scope).orderBy(*order)
    return df.withColumn(name, (F.row_number().over(w) - 1).cast("long"))


def dense_index_ranged(df: DataFrame, scope: list[str], order: list[str], name: str = "point_idx") -> DataFrame:
    """Number rows from 0 within each scope, in order, whatever the size of a scope.

    Rows are range partitioned and sorted by scope and order and written with
    consecutive ids.  A row's number is its distance from the first row of its
    scope in its partition, plus the rows of the scope in earlier partitions.
    Windows run over the partitions of a scope, never over its rows.
    """
    keys = [*scope, *order]
    parts = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    parts = written(parts.withColumn("_part", F.shiftright("_id", 33)), "ranged")
    before = Window.partitionBy(*(scope or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.groupBy("_part", *scope).agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    shift = written(shift.withColumn("_base", F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).drop("_rows", "_first"), "shift")
    if shift.count() <= 100_000:  # so that the rows stay where they are
        shift = F.broadcast(shift)
    return parts.join(shift, ["_part", *scope]).withColumn(name, F.col("_base") + F.col("_id")).drop("_part", "_id", "_base")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """``df``, or an error that names what is missing when it has no rows."""
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


def or_empty(spark: SparkSession, df: DataFrame | None, schema: str) -> DataFrame:
    """``df``, or an empty table of the given schema in place of None."""
    return spark.createDataFrame([], schema) if df is None else df


def labelled_points(lines: DataFrame) -> DataFrame:
    """Room points with stable positions: gate, label, order by file and line."""
    good, _ = gate_files(parse(lines))
    named = with_labels(with_path_columns(good))
    out = dense_index_ranged(named, ["area", "room"], ["file_path", "line_no"])
    return out.select("area", "room", "point_idx", *FIELDS, "label")


def unlabelled_points(lines: DataFrame) -> DataFrame:
    """Points of clouds to score; ``cloud_id`` is the file name without its ending."""
    good, _ = gate_files(parse(lines))
    named = good.withColumn("cloud_id", F.regexp_extract("file_path", r"([^/]+?)(?:\.[^./]*)?$", 1))
    return dense_index_ranged(named, ["cloud_id"], ["file_path", "line_no"]).select("cloud_id", "point_idx", *FIELDS)
