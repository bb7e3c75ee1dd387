"""Mixing sources to target weights by budgets that flow down a tree.

The tree has one level per grouping column (for example domain, language,
source).  A budget of tokens enters at the root and is divided among children
in proportion to their weights; a child that cannot use its share (its texts,
taken ``max_epochs`` times, hold fewer tokens) passes the rest to its siblings,
and only what a whole subtree cannot use reaches the siblings of an ancestor.
That is water filling with subtree capacities, from the top down, and it has a
closed form: order siblings by capacity per weight; a sibling is full when the
level needed to fill it does not exceed what is left for it and those after it.

Each leaf then takes a prefix, by tokens, of its texts in seeded order, epoch
after epoch.  Whole epochs are counted, and only the cut inside the last epoch
needs an order.  It is found by digits of the seeded hash: the totals of 256
buckets per leaf tell which bucket holds the cut, then only the rows of that
bucket are summed by two digits more, until one hash value is left.  So no task
ever sorts the rows of a leaf, however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise, release, small


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space, tab and line ends."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\r\n\f]+")).cast("long")


def budgets(leaves: DataFrame, levels: list[str], total: int, max_epochs: int) -> DataFrame:
    """Budget of every leaf.

    ``leaves`` has the level columns, ``tokens long`` and per level a weight
    column ``w_<level> long`` (positive).  ``total`` is the budget at the root.
    Windows run over the children of one node: names, never rows of texts.
    """
    cur = leaves.withColumn("_cap", F.col("tokens") * F.lit(max_epochs)).withColumn("_b0", F.lit(total).cast("long"))
    for i, level in enumerate(levels):
        path, up = levels[: i + 1], levels[:i]
        nodes = cur.groupBy(*path).agg(F.sum("_cap").alias("_c"), F.first(f"w_{level}").alias("_w"), F.first(f"_b{i}").alias("_b"))
        over = Window.partitionBy(*up) if up else Window.partitionBy(F.lit(0))
        order = over.orderBy(F.col("_c") / F.col("_w"), *path)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        nodes = nodes.withColumn("_left", F.col("_b") - F.coalesce(F.sum("_c").over(before), F.lit(0))).withColumn("_ws", F.sum("_w").over(rest))
        # full: capacity is reached before the level that the rest would get
        full = (F.col("_c").cast("decimal(38,0)") * F.col("_ws") <= F.greatest("_left", F.lit(0)).cast("decimal(38,0)") * F.col("_w")).cast("int")
        nodes = nodes.withColumn("_full", F.min(full).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        nodes = nodes.withColumn("_used", F.sum(F.when(F.col("_full") == 1, F.col("_c")).otherwise(0)).over(over)).withColumn("_open", F.sum(F.when(F.col("_full") == 0, F.col("_w")).otherwise(0)).over(over))
        nodes = nodes.withColumn(f"_b{i + 1}", F.expr("CASE WHEN _full = 1 THEN _c ELSE CAST(greatest(_b - _used, 0) AS DECIMAL(38,0)) * _w DIV _open END"))
        cur = cur.join(nodes.select(*path, f"_b{i + 1}"), path)
    return cur.select(*levels, "tokens", F.col(f"_b{len(levels)}").alias("budget"))


def order_hash(key: Column, seed: int, epoch: Column) -> Column:
    """Seeded place of a row in an epoch: hexadecimal MD5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))))


def cuts(placed: DataFrame, names: list[str], digits: int = 2) -> DataFrame:
    """``(names, _stop)``: per leaf the first hash at which the running total of tokens passes ``_rest``.

    ``placed`` has the leaf's ``names``, ``_h`` (hexadecimal), ``_n`` tokens and
    ``_rest`` tokens to take.  Leaves whose rows all fit do not appear.
    """
    at, width = None, 0
    while True:
        width += digits
        part = placed.withColumn("_from", F.lit(0).cast("long"))
        if at is not None:
            part = placed.join(at.select(*names, "_x", "_from"), names).where(F.startswith("_h", F.col("_x")))
        sums = part.groupBy(*names, F.substring("_h", 1, width).alias("_x")).agg(F.sum("_n").alias("_s"), F.min("_h").alias("_lo"), F.max("_h").alias("_hi"), F.first("_rest").alias("_r"), F.first("_from").alias("_from"))
        # at most 16 ** digits buckets of a leaf, in order
        lists = sums.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("_x", "_s", "_lo", "_hi"))).alias("_l"), F.first("_r").alias("_r"), F.first("_from").alias("_from"))
        nothing = F.lit(None).cast("struct<_x:string,_from:bigint,_lo:string,_hi:string>")

        def step(s, x):
            passed = s["hit"].isNull() & (s["run"] + x["_s"] > s["r"])
            hit = F.struct(x["_x"].alias("_x"), s["run"].alias("_from"), x["_lo"].alias("_lo"), x["_hi"].alias("_hi"))
            return F.struct(s["r"].alias("r"), (s["run"] + x["_s"]).alias("run"), F.when(passed, hit).otherwise(s["hit"]).alias("hit"))

        start = F.struct(F.col("_r").cast("long").alias("r"), F.col("_from").alias("run"), nothing.alias("hit"))
        found = lists.select(*names, F.aggregate("_l", start, step)["hit"].alias("_c")).where("_c IS NOT NULL").select(*names, "_c.*")
        last, at = at, small(found, "cut")
        release(last)
        if at.where("_lo <> _hi").isEmpty():
            return at.select(*names, F.col("_lo").alias("_stop"))


def mix(rows: DataFrame, levels: list[str], weights: dict[str, Column], budget_share: tuple[int, int] = (1, 1), max_epochs: int = 2, seed: int = 9, key: str = "doc_id", tokens: str = "n_tokens") -> DataFrame:
    """Add ``copies int``: how many times each row enters the mixture.

    ``rows`` has the level columns (nulls form a child of their own), ``key``
    and a token count.  ``weights`` gives a positive whole weight per level,
    computed from the columns of the path so far.  The root budget is
    ``budget_share`` (numerator, denominator) of all tokens.  A leaf with
    budget B and T tokens takes B // T whole epochs and, in the next one, the
    rows in seeded order whose running total stays within the remainder; rows
    with equal keys, null keys among them, are taken together.  Rows without
    tokens follow the whole epochs and count as taken in the partial one when
    they come before the cut.  A column ``copies`` is replaced, all others are
    kept; an empty table gives an empty one.
    """
    cols = {f"__l{i}": F.coalesce(F.col(c).cast("string"), F.lit("")) for i, c in enumerate(levels)}
    names = list(cols)
    base = rows.withColumns(cols)
    # one pass over the rows; what follows reads leaf names, keys and token counts only
    slim = base.select(*names, F.col(key).alias("_k"), F.coalesce(F.col(tokens).cast("long"), F.lit(0)).alias("_n"), *[weights[c].cast("long").alias(f"w{n}") for n, c in zip(names, levels, strict=True)])
    slim = materialise(slim, "slim")
    leaves = slim.groupBy(*names).agg(F.sum("_n").alias("tokens"), *[F.max(f"w{n}").alias(f"w_{n}") for n in names])
    num, den = budget_share
    total = (leaves.agg(F.sum("tokens")).first()[0] or 0) * num // den
    plan = budgets(leaves, names, total, max_epochs)
    plan = plan.withColumn("__whole", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("__rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("__whole") * F.col("tokens")).otherwise(F.lit(0)))
    plan = small(plan.select(*names, "__whole", "__rest"), "plan")
    placed = slim.join(plan, names).where("__rest > 0").select(*names, "_n", order_hash(F.col("_k"), seed, F.col("__whole")).alias("_h"), F.col("__rest").alias("_rest"))
    stops = small(plan.join(cuts(placed, names), names, "left"), "stops")
    release(plan)
    release(slim)
    taken = base.join(stops, names)
    here = order_hash(F.col(key), seed, F.col("__whole"))
    partial = F.when(F.col("__rest") <= 0, 0).when(F.col("_stop").isNull() | (here < F.col("_stop")), 1).otherwise(0)
    out = taken.withColumn("copies", (F.col("__whole") + partial).cast("int"))
    return out.select(*[c for c in rows.columns if c != "copies"], "copies")


def repeated(mixed: DataFrame, copies: str = "copies") -> DataFrame:
    """The mixture itself: every row as often as its copies say, rows with none left out."""
    return mixed.where(F.col(copies) > 0).withColumn("_e", F.explode(F.sequence(F.lit(1), F.col(copies)))).drop("_e", copies)


__all__ = ["budgets", "cuts", "mix", "order_hash", "repeated", "word_count"]
