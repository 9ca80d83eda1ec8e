"""Rectangles on pages: overlap joins by cells, recursive cuts into columns and bands, ruled tables and their cells.

Rectangles are columns x0, y0, x1, y1 with y upward. A page may hold any number of marks: joins are by cells of a grid,
windows by regions of a page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions.text import looks_like_page_number
from folioframe.operators.layout import islands

BOX = ["x0", "y0", "x1", "y1"]
#: Sizes of cells: powers of two from the first to the second exponent. A rectangle's own size is the least that holds it.
FINEST, COARSEST = 6, 10


def _cells(rects: DataFrame, box: list[str], levels: Callable[[Column], Column]) -> DataFrame:
    """Each rectangle once for each cell that it touches at the levels that follow from its own."""
    x0, y0, x1, y1 = map(F.col, box)
    longest = F.greatest(x1 - x0, y1 - y0, F.lit(1.0))
    own = F.greatest(F.lit(FINEST), F.least(F.lit(COARSEST), F.ceil(F.log2(longest)).cast("int")))
    size = F.pow(F.lit(2.0), F.col("_level"))
    span = lambda a, b: F.sequence(F.floor(a / size), F.floor(b / size))
    out = rects.withColumn("_level", F.explode(levels(own)))
    return out.withColumn("_cx", F.explode(span(x0, x1))).withColumn("_cy", F.explode(span(y0, y1)))


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], touch: float = 0.0, prefix: str = "o_") -> DataFrame:
    """Pairs of a's and b's rectangles on the same page (``keys``) that overlap or come within ``touch`` of it.

    The columns of b bear ``prefix``. Pairs meet in cells of the larger one's size, of which either touches four at
    most (more only beyond the coarsest), so that small marks never meet all others of a page because a large one is
    there; a pair counts in the cell of the lower left corner of what they share.
    """
    wide = b.select(*keys, *(F.col(c).alias(prefix + c) for c in b.columns if c not in keys))
    theirs = [prefix + c for c in BOX]
    grown = wide.withColumns({f"_{c}": F.col(prefix + c) + (touch if c[1] == "1" else -touch) for c in BOX})
    at, box_b = [*keys, "_level", "_cx", "_cy"], [f"_{c}" for c in BOX]
    exact = lambda own: F.array(own)
    up = lambda own: F.sequence(own, F.lit(COARSEST))
    above = lambda own: F.when(own < COARSEST, F.sequence(own + 1, F.lit(COARSEST))).otherwise(F.array().cast("array<int>"))
    pairs = _cells(a, BOX, exact).join(_cells(grown, box_b, up), at).unionByName(_cells(a, BOX, above).join(_cells(grown, box_b, exact), at))
    meet = (F.col("x0") <= F.col("_x1")) & (F.col("_x0") <= F.col("x1")) & (F.col("y0") <= F.col("_y1")) & (F.col("_y0") <= F.col("y1"))
    size = F.pow(F.lit(2.0), F.col("_level"))
    here = (F.floor(F.greatest("x0", "_x0") / size) == F.col("_cx")) & (F.floor(F.greatest("y0", "_y0") / size) == F.col("_cy"))
    return pairs.where(meet & here).select(*a.columns, *theirs, *(prefix + c for c in b.columns if c not in (*keys, *BOX)))


def beside(a: DataFrame, b: DataFrame, keys: list[str], touch: float = 0.0, prefix: str = "o_", few: int = 16) -> DataFrame:
    """The same pairs as of ``overlapping``, by page where b has at most ``few`` rectangles there, and by cells elsewhere.

    Each of a's rectangles meets at most ``few`` others in the first case, in one shuffle by page.
    """
    crowded = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > few).select(*keys)
    some = not crowded.isEmpty()
    ours, theirs = (a.join(crowded, keys, "left_anti"), b.join(crowded, keys, "left_anti")) if some else (a, b)
    wide = theirs.select(*keys, *(F.col(c).alias(prefix + c) for c in [*BOX, *(c for c in b.columns if c not in (*keys, *BOX))]))
    o = {c: F.col(prefix + c) for c in BOX}
    meet = (F.col("x0") <= o["x1"] + touch) & (o["x0"] - touch <= F.col("x1")) & (F.col("y0") <= o["y1"] + touch) & (o["y0"] - touch <= F.col("y1"))
    out = ours.join(wide, keys).where(meet).select(*a.columns, *(c for c in wide.columns if c not in keys))
    if not some:
        return out
    return out.unionByName(overlapping(a.join(crowded, keys, "left_semi"), b.join(crowded, keys, "left_semi"), keys, touch, prefix))


def _cut(items: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """One round of cuts: each region's items with ``side`` 0 or 1 of its cut, or null where nothing cuts it.

    First the widest upright gap with two baselines or more on both sides, else the highest level gap. A table counts
    as two baselines.
    """
    region = Window.partitionBy(*keys, "path")
    by_x, by_y = region.orderBy("x0", "x1", "item"), region.orderBy(F.desc("y1"), F.desc("y0"), "item")
    from_right = region.orderBy(F.desc("x0"), F.desc("x1"), F.desc("item"))  # a frame that only ends at the last row costs its square
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    two = lambda w: ((F.max("base").over(w) - F.min("base").over(w)) > 1.0) | F.max("is_table").over(w)
    items = items.withColumn("_rank", F.row_number().over(region.orderBy("size", "item"))).withColumn("_n", F.count(F.lit(1)).over(region))
    size = F.greatest(F.max(F.when(F.col("_rank") == F.floor(F.col("_n") / 2) + 1, F.col("size"))).over(region), F.lit(1.0))
    out = items.withColumn("_size", size)
    out = out.withColumn("_left", F.max("x1").over(before(by_x))).withColumn("_bottom", F.min("y0").over(before(by_y)))
    wide, high = F.col("x0") - F.col("_left"), F.col("_bottom") - F.col("y1")
    valid = (wide >= F.greatest(0.8 * F.col("_size"), F.lit(5.0))) & two(before(by_x)) & two(upto(from_right))
    out = out.withColumn("_x", F.when(valid, F.struct(wide.alias("gap"), (-F.col("_left")).alias("at"))))
    out = out.withColumn("_y", F.when(high >= F.greatest(0.7 * F.col("_size"), F.lit(3.0)), F.struct(high.alias("gap"), ((F.col("_bottom") + F.col("y1")) / 2).alias("at"))))
    out = out.withColumn("_x", F.max("_x").over(region)).withColumn("_y", F.max("_y").over(region))
    more = (F.col("_n") > 1) & F.lit(depth <= 48)
    side = F.when(more & F.col("_x").isNotNull(), (F.col("x1") > -F.col("_x.at") + 1e-6).cast("int")).when(more & F.col("_y").isNotNull(), (F.col("y0") < F.col("_y.at")).cast("int"))
    out = out.withColumn("side", side).withColumn("upright", F.col("_x").isNotNull())
    return out.drop("_size", "_n", "_rank", "_left", "_bottom", "_x", "_y")


def columns(items: DataFrame, keys: list[str], written: Callable[[DataFrame, str], DataFrame], deal: Callable[[DataFrame, list[str]], DataFrame] = lambda rows, _: rows) -> DataFrame:
    """Items (keys, item, box, base, size, is_table) with ``leaf``, the number of their region in reading order, and its column's box.

    A page is cut at upright gaps (columns) and level gaps (bands) until no region can be cut: a round cuts every
    region of every page once, and what isn't cut any more is put aside. ``written`` writes a round's rows and gives
    them back, so that lineage and plans stay short; there are as many rounds as cuts lie within each other, at most 49.
    ``deal`` deals rows out by columns to as many tasks as they need; a round's windows go on from there.
    """
    page = Window.partitionBy(*keys)
    whole = F.struct(*((F.min if c[1] == "0" else F.max)(c).over(page).alias(c) for c in BOX))
    rest = deal(items, keys).select(*keys, "item", *BOX, "base", "size", "is_table", F.lit("").alias("path"), whole.alias("col"))
    done: DataFrame | None = None
    for depth in range(50):
        found = written(_cut(rest, keys, depth), f"cut-{depth}")
        leaves = found.where("side IS NULL").select(*keys, "item", "path", "col")
        done = leaves if done is None else done.unionByName(leaves)
        if found.where("side IS NOT NULL").isEmpty():
            break
        part = Window.partitionBy(*keys, "path", "side")
        own = F.struct(*((F.min if c[1] == "0" else F.max)(c).over(part).alias(c) for c in BOX))
        more = deal(found.where("side IS NOT NULL"), keys).withColumn("col", F.when(F.col("upright"), own).otherwise(F.col("col")))
        rest = more.withColumn("path", F.concat("path", F.col("side").cast("string"))).drop("side", "upright")
    leaf = F.dense_rank().over(Window.partitionBy(*keys).orderBy("path"))
    own = [*keys, "item"]
    ranked = deal(done, keys).select(*own, leaf.alias("leaf"), "col")
    return deal(deal(items, own).join(deal(ranked, own), own), keys)


def continued(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block): blocks in reading order whose first paragraph goes on with the last one of the block before.

    Blocks: (keys, block, x0, x1, tail, head, tail_size, head_size, tail_marked, head_marked, indent). They stand side
    by side, the tail ends no sentence, the head starts in lower case without marker or indent, and sizes are alike.
    """
    w = Window.partitionBy(*keys).orderBy("block")
    b = blocks.withColumns({f"_{c}": F.lag(c).over(w) for c in ("x0", "x1", "tail", "tail_size", "tail_marked")})
    half = 0.5 * F.col("head_size")
    beside = (F.col("x0") >= F.col("_x1") - half) | (F.col("_x0") >= F.col("x1") - half)
    open_end = ~F.coalesce(F.trim("_tail"), F.lit("")).rlike(r'(?:[.!?:;»”")]|^)$')
    alike = (F.col("head_size") / F.greatest("_tail_size", F.lit(0.1))).between(0.85, 1.18)
    lower = F.col("head").rlike(r"^\p{Ll}")
    return b.where(beside & open_end & lower & alike & ~F.col("_tail_marked") & ~F.col("head_marked") & (F.col("indent") <= half)).select(*keys, "block")


def collinear(rules: DataFrame, keys: list[str], level: bool, apart: float = 1.0, gap: float = 2.0) -> DataFrame:
    """Rules drawn piece by piece as whole ones: pieces on one line (within ``apart``) that touch within ``gap``.

    ``level`` rules lie along x, others along y.
    """
    along, across = ("x", "y") if level else ("y", "x")
    middle = (F.col(f"{across}0") + F.col(f"{across}1")) / 2
    lines = Window.partitionBy(*keys).orderBy("_middle", f"{along}0")
    on = islands(rules.withColumn("_middle", middle), F.coalesce(F.col("_middle") - F.lag("_middle").over(lines) > apart, F.lit(True)), lines, "_line")
    w = Window.partitionBy(*keys, "_line").orderBy(f"{along}0", f"{along}1")
    reach = F.max(f"{along}1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = islands(on, F.coalesce(F.col(f"{along}0") > reach + gap, F.lit(True)), w, "_run")
    return runs.groupBy(*keys, "_line", "_run").agg(*((F.min if c[1] == "0" else F.max)(c).alias(c) for c in BOX)).drop("_line", "_run")


def _means(rows: DataFrame, keys: list[str], value: str, tolerance: float, name: str, extent: list[str] = ()) -> DataFrame:
    """(keys, name): means of values that stand within the tolerance of the one before, ascending; and the ``extent``, of x0 and x1."""
    w = Window.partitionBy(*keys).orderBy(value)
    whole = [(F.min if c[1] == "0" else F.max)(c).alias(c) for c in extent]
    found = islands(rows.select(*keys, value, *extent), F.coalesce(F.col(value) - F.lag(value).over(w) > tolerance, F.lit(True)), w, "_c").groupBy(*keys, "_c").agg(F.avg(value).alias("_v"), *whole)
    return found.groupBy(*keys).agg(F.array_sort(F.collect_list("_v")).alias(name), *whole)


def grids(rules: DataFrame, words: DataFrame, keys: list[str], written: Callable[[DataFrame, str], DataFrame], em: float = 10.0) -> DataFrame:
    """(keys, grid, box, xs, ys): tables that rules draw; xs ascending, ys descending.

    Rules (box) come in pieces. Level ones of one extent (within 3 or 3 % of their width) make a band; upright ones that
    cross half of it cut its columns. Where fewer than two do, columns are told by the gaps of an em or more that all
    rows with words (box) have in common, if two rows have words. ``written`` writes what several steps read. All steps on
    rules and words go by page, so that rows dealt by ``keys`` are not shuffled again.
    """
    flat = F.col("x1") - F.col("x0") >= F.col("y1") - F.col("y0")
    level, upright = collinear(rules.where(flat), keys, True), collinear(rules.where(~flat), keys, False)
    extent = Window.partitionBy(*keys).orderBy("x0", "x1", "y0")
    tolerance = F.greatest(F.lit(3.0), 0.03 * (F.col("x1") - F.col("x0")))
    new = F.coalesce((F.col("x0") - F.lag("x0").over(extent) > tolerance) | (F.abs(F.col("x1") - F.lag("x1").over(extent)) > tolerance), F.lit(True))
    grouped = islands(level, new, extent, "grid").withColumn("y", (F.col("y0") + F.col("y1")) / 2)
    own = [*keys, "grid"]
    bands = _means(grouped, own, "y", 1.5, "up", ["x0", "x1"]).where("size(up) >= 2")
    bands = written(bands.select(*own, "x0", F.element_at("up", 1).alias("y0"), "x1", F.element_at("up", -1).alias("y1"), F.reverse("up").alias("ys")), "bands")
    met = beside(upright, bands.drop("ys"), keys, touch=2.0)
    middle, crosses = (F.col("x0") + F.col("x1")) / 2, F.least("y1", "o_y1") - F.greatest("y0", "o_y0") >= 0.5 * (F.col("o_y1") - F.col("o_y0"))
    drawn = met.where(crosses & middle.between(F.col("o_x0") - 2, F.col("o_x1") + 2)).select(*keys, F.col("o_grid").alias("grid"), middle.alias("x"))
    ruled = written(_means(drawn, own, "x", 1.5, "xs").where("size(xs) >= 2"), "ruled")
    told = bands.join(ruled, own, "left_anti")
    inside = _placed(words, told, keys)
    row = Window.partitionBy(*own, "row").orderBy("x0", "x1")
    reach = F.max("x1").over(row.rowsBetween(Window.unboundedPreceding, -1))
    spans = islands(inside, F.coalesce(F.col("x0") > reach + em, F.lit(True)), row, "_s").groupBy(*own, "row", "_s").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    band = Window.partitionBy(*own).orderBy("x0", "x1")
    gap = F.when(F.col("x0") - F.col("_reach") >= em, (F.col("x0") + F.col("_reach")) / 2)
    gaps = spans.withColumn("_reach", F.max("x1").over(band.rowsBetween(Window.unboundedPreceding, -1))).groupBy(*own)
    middles = gaps.agg(F.array_sort(F.collect_list(gap)).alias("_m"), (F.min("row") < F.max("row")).alias("_two")).where("_two")
    by_text = told.join(middles, own).select(*own, F.concat(F.array("x0"), "_m", F.array("x1")).alias("xs"))
    return written(bands.join(ruled.unionByName(by_text), own).select(*own, *BOX, "xs", "ys"), "grids")


def _placed(words: DataFrame, bands: DataFrame, keys: list[str], also: list[str] = ()) -> DataFrame:
    """Words with the grid and row (from the top, from 1) in which their middle lies, and columns ``also`` of the grid."""
    mid = [((F.col(f"{c}0") + F.col(f"{c}1")) / 2).alias(f"{c}{k}") for c in "xy" for k in "01"]
    rest = [c for c in words.columns if c not in keys]
    points = words.select(*keys, F.struct(*(F.col(c) for c in rest)).alias("_w"), *mid)
    met = beside(points, bands.select(*keys, "grid", *BOX, "ys", *also), keys)
    row = F.size(F.filter("o_ys", lambda y: y >= F.col("y0")))
    return met.where(F.col("y0") > F.element_at("o_ys", -1)).select(*keys, "_w.*", F.col("o_grid").alias("grid"), row.alias("row"), *(F.col("o_" + c).alias(c) for c in also))


def cells(words: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, grid, row, column, text): words (box, ord, text) by cell of the tables, joined in order.

    Tables of fewer than two rows or columns, or with fewer than two cells that hold words, are none.
    """
    grown = found.where("size(xs) >= 3 AND size(ys) >= 3")
    placed = _placed(words, grown, keys, ["xs"])
    middle = (F.col("x0") + F.col("x1")) / 2
    column = F.greatest(F.lit(1), F.least(F.size(F.filter("xs", lambda x: x <= middle)), F.size("xs") - 1))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda w: w["text"]), " ")
    out = placed.withColumn("column", column).groupBy(*keys, "grid", "row", "column").agg(text.alias("text"))
    return out.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "grid"))).where("_n >= 2").drop("_n")


def heading_level(n_lines: Column, n_words: Column, marked: Column, size: Column, median: Column) -> Column:
    """1 to 3 for paragraphs of at most two lines and 20 words, without a list marker, in type larger than the page's median; else 0."""
    ratio = size / median
    fits = (median > 0) & (n_lines <= 2) & ~marked & (n_words <= 20)
    return F.when(fits & (ratio >= 1.6), 1).when(fits & (ratio >= 1.3), 2).when(fits & (ratio >= 1.15), 3).otherwise(0)


def page_edges(blocks: DataFrame, keys: list[str], part: float = 0.1) -> DataFrame:
    """Blocks (keys, block, y0, y1, n_lines, size, text, page_y0, page_y1, median, pitch) with ``edge``: header, footer or null.

    From the head of a page on, a block is a header while it reaches into the uppermost ``part`` of the page, has one or two
    lines of ordinary size, and stands apart from the next by 1.5 of the pitch, or reads like a page number; footers likewise
    from the foot. The first block that isn't one ends the run. A page of a single block has none.
    """
    page = Window.partitionBy(*keys)
    down, up = page.orderBy("block"), page.orderBy(F.desc("block"))
    high = part * (F.col("page_y1") - F.col("page_y0"))
    plain = F.col("n_lines").between(1, 2) & (F.col("size") <= 1.1 * F.col("median"))
    number = looks_like_page_number(F.col("text"))
    below, above = F.lead("y1").over(down), F.lag("y0").over(down)
    apart_below = F.coalesce(F.col("y0") - below >= 1.5 * F.col("pitch"), F.lit(True))
    apart_above = F.coalesce(above - F.col("y1") >= 1.5 * F.col("pitch"), F.lit(True))
    rows = blocks.withColumn("_many", F.count(F.lit(1)).over(page) > 1)
    rows = rows.withColumn("_head", plain & (F.col("y1") >= F.col("page_y1") - high) & (apart_below | number)).withColumn("_foot", plain & (F.col("y0") <= F.col("page_y0") + high) & (apart_above | number))
    so_far = lambda c, w: F.min(F.col(c).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1
    rows = rows.withColumn("_is_head", F.col("_many") & so_far("_head", down))
    rows = rows.withColumn("_foot", F.col("_foot") & ~F.col("_is_head")).withColumn("_is_foot", F.col("_many") & so_far("_foot", up))
    return rows.withColumn("edge", F.when(F.col("_is_head"), "header").when(F.col("_is_foot"), "footer")).drop("_many", "_head", "_foot", "_is_head", "_is_foot")
