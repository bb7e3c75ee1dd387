"""Line dedup by a suffix array over line ids, built by prefix doubling.

Lines get ids; a *suffix* starts at a line and runs to the end of its document.
Prefix doubling ranks all suffixes by their first 1, 2, 4, ... lines: the rank
for twice the length is the place, in a range-partitioned sort, of the pair
(rank here, rank half way on).  Suffixes whose prefix occurs once drop out, so
a round only touches what is still repeated.

The suffixes that agree in their first L lines are an interval of the suffix
array with a longest common prefix of at least L.  Two ranks name it: that of
the first 2**j lines, 2**j being the largest power of two up to L, and that of
the last 2**j.  The first place of an interval, in document order, is the
original run; all its other places are later copies.

A run counts when its lines hold ``min_chars`` characters together.  A maximal
repeated run is the union of those of its parts that hold enough and would not
without their last line, or without their first (:func:`sufficient_runs`): the
parts of the first kind reach from its beginning to some line, those of the
second kind from there to its end, and each of them is repeated where the whole
is.  So only these parts, two at most for each line, are looked up, and their
union is the union of the later copies of all maximal runs of enough
characters.  The doubling ends with the longest of them.

DataFrame operations only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import ROW, evenly, materialise, numbered, release

PLACE = ["row", "line"]


def lines_of(rows: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc, row, line, h, chars)``: every line with its digest and its length.

    ``rows`` comes from :func:`~pointloom.llm.store.numbered`.  Null texts have no lines.
    """
    cut = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.col(ROW).alias("row"), F.posexplode(F.split(text, "\n")).alias("line", "_s"))
    s = F.trim(F.col("_s"))
    return cut.select("doc", "row", F.col("line").cast("long"), F.unhex(F.md5(s.cast("binary"))).alias("h"), F.length(s).cast("long").alias("chars"))


def _ranked(suffixes: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Replace ``keys`` by the ``rank`` of their values; suffixes with keys that occur once drop out.

    The distinct keys are range partitioned and sorted; the row number of that
    order is the rank.
    """
    groups = suffixes.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    ordered = groups.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranks = materialise(ordered.withColumn("rank", F.monotonically_increasing_id()), f"{name}-ranks")
    out = materialise(suffixes.join(evenly(ranks), keys).drop(*keys), name)
    release(ranks)
    return out


def sufficient_runs(repeated: DataFrame, min_chars: int) -> DataFrame:
    """``(row, line, n)``: runs of repeated lines that just hold ``min_chars``.

    For every line the shortest run that begins there and holds enough, and the
    shortest that ends there.  ``repeated`` has row, line and chars of repeated
    lines; a run never steps over a line that is missing.
    """
    stretch = F.col("line") - F.row_number().over(Window.partitionBy("row").orderBy("line"))
    own = Window.partitionBy("row", "_i").orderBy("line")
    to = F.sum("chars").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = repeated.select(*PLACE, "chars", stretch.alias("_i")).withColumn("_to", to)
    # borders between lines, by the number of characters of the stretch before them
    before = cut.select("row", "_i", F.col("line").alias("b"), (F.col("_to") - F.col("chars")).alias("v"))
    ends = cut.groupBy("row", "_i").agg((F.max("line") + 1).alias("b"), F.max("_to").alias("v")).where(F.col("v") >= min_chars)
    borders = materialise(before.unionByName(ends), "borders")  # read four times below

    def nearest(shift: int, order: list[Column]) -> DataFrame:
        """Each border ``q`` with the border ``b`` next to ``shift`` characters from it."""
        asked = borders.select("row", "_i", F.lit(None).cast("long").alias("b"), (F.col("v") + shift).alias("v"), F.col("b").alias("q"))
        both = borders.withColumn("q", F.lit(None).cast("long")).unionByName(asked)
        seen = Window.partitionBy("row", "_i").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return both.withColumn("b", F.last("b", ignorenulls=True).over(seen)).where("q IS NOT NULL AND b IS NOT NULL")

    held = F.col("b").isNull().cast("int")  # at equal counts borders come before questions
    ends = nearest(min_chars, [F.desc("v"), held, F.desc("b")]).select("row", F.col("q").alias("line"), (F.col("b") - F.col("q")).alias("n"))
    begins = nearest(-min_chars, [F.asc("v"), held, F.asc("b")]).select("row", F.col("b").alias("line"), (F.col("q") - F.col("b")).alias("n"))
    return ends.unionByName(begins).distinct()


def suffix_ranks(first: DataFrame, levels: int) -> list[DataFrame]:
    """Tables (row, line, rank) of the suffixes whose first 2**j lines are repeated, j = 0 .. ``levels``.

    ``first`` is the table for single lines.  Fewer tables come back when
    nothing longer is repeated.
    """
    out = [first.select(*PLACE, "rank")]
    while len(out) <= levels:
        step = 1 << (len(out) - 1)
        here = out[-1].select(*PLACE, F.col("rank").alias("r1"))
        on = out[-1].select("row", (F.col("line") - step).alias("line"), F.col("rank").alias("r2"))
        nxt = _ranked(here.join(on, PLACE), ["r1", "r2"], "suffixes")
        if nxt.isEmpty():
            release(nxt)
            break
        out.append(nxt)
    return out


def repeated_runs(lines: DataFrame, min_chars: int = 20) -> DataFrame:
    """``(row, line, n_lines)``: the maximal stretches of lines that are later copies.

    ``lines`` comes from :func:`lines_of`.  ``min_chars`` is at least 1.
    """
    if min_chars < 1:
        raise ValueError("min_chars is at least 1")
    one = _ranked(lines.select("doc", *PLACE, "chars", "h"), ["h"], "lines")
    runs = materialise(sufficient_runs(one, min_chars).withColumn("j", F.length(F.bin("n")) - 1), "runs")
    most = runs.agg(F.max("j")).first()[0]
    levels = suffix_ranks(one, most or 0)
    every = reduce(DataFrame.unionByName, [t.withColumn("j", F.lit(j)) for j, t in enumerate(levels)])
    named = runs.withColumn("_tail", F.expr("line + n - shiftleft(1L, j)"))
    named = named.join(every.withColumnRenamed("rank", "r1"), [*PLACE, "j"])
    named = named.join(every.withColumnsRenamed({"rank": "r2", "line": "_tail"}), ["row", "_tail", "j"])
    named = materialise(named.join(one.select("doc", *PLACE), PLACE).select("doc", *PLACE, "n", "r1", "r2"), "named-runs")
    for t in [runs, one, *levels[1:]]:
        release(t)
    # an interval of the suffix array: its first place is the original
    interval = ["n", "r1", "r2"]
    origin = named.groupBy(*interval).agg(F.min(F.struct("doc", *PLACE)).alias("_first"), F.count("*").alias("_k")).where("_k > 1").drop("_k")
    copies = named.join(evenly(origin), interval).where("row <> _first.row OR line <> _first.line").select(*PLACE, (F.col("line") + F.col("n")).alias("_end"))
    # overlapping and adjacent copies become one stretch
    seen = Window.partitionBy("row").orderBy("line", "_end")
    reach = F.max("_end").over(seen.rowsBetween(Window.unboundedPreceding, -1))
    fresh = copies.withColumn("_new", F.coalesce(F.col("line") > reach, F.lit(True)).cast("int"))
    fresh = fresh.withColumn("_no", F.sum("_new").over(seen.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return fresh.groupBy("row", "_no").agg(F.min("line").alias("line"), (F.max("_end") - F.min("line")).alias("n_lines")).drop("_no")


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = 20) -> DataFrame:
    """Delete the lines of later copies; add ``n_lines`` and ``n_removed``.

    A line goes when it lies in a run of lines with ``min_chars`` characters or
    more that occurs at an earlier place: in a document with a smaller ``key``
    (null keys come first), in an earlier row of the same key, or further up in
    the same text.  Lines are compared without surrounding spaces.  Every row
    is a document of its own: rows with equal keys keep what only they hold,
    and the second of two equal rows loses its lines.  A null text stays null
    with zero lines; an empty text has one empty line; a document that loses
    all its lines has an empty text.  Columns named ``n_lines`` or
    ``n_removed`` are replaced, all others are kept.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = numbered(docs.select(*keep), "documents")
    gone = repeated_runs(lines_of(rows, text, key), min_chars)
    gone = gone.groupBy(F.col("row").alias(ROW)).agg(F.sort_array(F.collect_list(F.struct("line", (F.col("line") + F.col("n_lines")).alias("end")))).alias("__gone"))
    out = rows.join(evenly(gone), ROW, "left").withColumn("__lines", F.split(F.col(text), "\n"))
    # what lies between two deleted stretches stays
    size = F.size("__lines").cast("long")
    begin, end = F.concat(F.array(F.lit(0).cast("long")), F.col("__gone.end")), F.concat(F.col("__gone.line"), F.array(size))
    left = F.flatten(F.zip_with(begin, end, lambda a, b: F.slice(F.col("__lines"), (a + 1).cast("int"), (b - a).cast("int"))))
    cleaned = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    removed = F.aggregate("__gone", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["line"])
    n = F.when(F.col(text).isNull(), F.lit(0)).otherwise(size).cast("long")
    return out.select(*[cleaned.alias(c) if c == text else F.col(c) for c in keep], n.alias("n_lines"), F.coalesce(removed, F.lit(0).cast("long")).alias("n_removed"))
