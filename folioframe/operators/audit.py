"""Audits of tagged documents: structure nodes, text runs, images, fields, and profiles of allowed features.

Every rule gives issues (doc, severity, rule, page, message) as in ``rules``. Nodes, runs, fills and images meet by document
and page, so that no step compares more than the marks of one page with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import numbers as N
from folioframe.operators import geometry, rules

ERROR, WARNING = 2, 1
#: The newest format version that each profile allows (none: any), times ten.
MAX_VERSION = {"archive-1b": 14, "archive-2b": 17, "archive-3b": 17, "print-1a": 14, "print-4": 16, "access-1": None}
#: Features that a profile forbids.
FORBIDDEN = {
    "archive-1b": "encryption fonts-embedded output-intent transparency javascript external-actions embedded-files multimedia external-streams interpolate xmp-metadata".split(),
    "archive-2b": "encryption fonts-embedded output-intent javascript external-actions embedded-files multimedia external-streams interpolate xmp-metadata".split(),
    "archive-3b": "encryption fonts-embedded output-intent javascript external-actions multimedia external-streams interpolate xmp-metadata".split(),
    "print-1a": "encryption fonts-embedded output-intent transparency javascript external-actions multimedia colorspaces trimbox overprint xmp-metadata".split(),
    "print-4": "encryption fonts-embedded output-intent javascript external-actions multimedia colorspaces trimbox xmp-metadata".split(),
    "access-1": "fonts-embedded xmp-metadata accessibility".split(),
}


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def tagged(roots: DataFrame) -> DataFrame:
    """Documents (doc, has_root, n_nodes, marked, suspect) that are not whole tagged documents, one issue for each reason."""
    reasons = [(~F.col("has_root"), ERROR, "no structure root"), (F.col("has_root") & (F.col("n_nodes") == 0), ERROR, "empty structure"), (~F.col("marked"), ERROR, "not marked"), (F.col("suspect"), WARNING, "suspect marks")]
    why = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(m).alias("message"))) for c, s, m in reasons)))
    found = roots.select("doc", F.explode(why).alias("w"))
    return found.select("doc", "w.severity", F.lit("document-tagged").alias("rule"), F.lit(None).cast("bigint").alias("page"), "w.message")


def figures(nodes: DataFrame) -> DataFrame:
    """Figures and formulas (doc, page, kind, alt, actual) with neither an alternative nor an actual text."""
    bare = F.col("kind").isin("Figure", "Formula") & blank(F.col("alt")) & blank(F.col("actual"))
    return rules.issues(nodes, bare, ERROR, "figure-alt", F.concat("kind", F.lit(" without alternative text")), page=F.col("page"))


def table_headers(cells: DataFrame) -> DataFrame:
    """Tables (doc, page, node) of cells (kind, scope, headers): no TH, or TH of no scope while cells name no headers."""
    head, cell = F.col("kind") == "TH", F.col("kind") == "TD"
    n = cells.groupBy("doc", "page", "node").agg(
        F.count_if(head).alias("n_th"), F.count_if(head & F.col("scope").isNull()).alias("n_bare"), F.count_if(cell).alias("n_td"), F.count_if(cell & F.col("headers").isNotNull()).alias("n_named")
    )
    none = rules.issues(n, F.col("n_th") == 0, ERROR, "table-headers", "table without TH", page=F.col("page"))
    unclear = (F.col("n_bare") > 0) & (F.col("n_named") < F.col("n_td"))
    return none.unionByName(rules.issues(n, unclear, WARNING, "table-headers", F.concat(F.col("n_bare").cast("string"), F.lit(" TH without scope")), page=F.col("page")))


def untagged(marks: DataFrame, roots: DataFrame) -> DataFrame:
    """Per page, marks (doc, page, image, mcid, artifact) outside the structure; images count only beside text."""
    loose = F.col("mcid").isNull() & ~F.col("artifact")
    n = marks.groupBy("doc", "page").agg(F.count_if(loose & ~F.col("image")).alias("texts"), F.count_if(loose & F.col("image")).alias("images"))
    n = n.where("texts > 0").join(roots.where("has_root").select("doc"), "doc", "left_semi")
    texts = rules.issues(n, F.col("texts") > 0, ERROR, "untagged-content", F.concat(F.col("texts").cast("string"), F.lit(" texts")), page=F.col("page"))
    return texts.unionByName(rules.issues(n, (F.col("texts") > 0) & (F.col("images") > 0), ERROR, "untagged-content", F.concat(F.col("images").cast("string"), F.lit(" images")), page=F.col("page")))


def contrast(runs: DataFrame, fills: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Runs (doc, page, ord, x0, y0, x1, y1, r, g, b, size, bold, artifact) too faint on what lies behind them.

    Behind a run lies the last earlier fill (same columns) that covers it, else white; each pair of colours once a page.
    """
    text = runs.where("NOT artifact")
    met = geometry.overlapping(text.select("doc", "page", "ord", *geometry.BOX), fills.select("doc", "page", "ord", *geometry.BOX, "r", "g", "b"), ["doc", "page"], touch=tolerance)
    covers = (F.col("o_ord") < F.col("ord")) & (F.col("o_x0") <= F.col("x0") + tolerance) & (F.col("o_y0") <= F.col("y0") + tolerance) & (F.col("o_x1") >= F.col("x1") - tolerance) & (F.col("o_y1") >= F.col("y1") - tolerance)
    behind = met.where(covers).groupBy("doc", "page", "ord").agg(F.max_by(F.struct(*(F.col("o_" + c).alias(c) for c in "rgb")), "o_ord").alias("back"))
    white = F.struct(*(F.lit(255).cast("bigint").alias(c) for c in "rgb"))
    both = text.join(behind, ["doc", "page", "ord"], "left").withColumn("back", F.coalesce("back", white))
    lum = lambda p: N.luminance(*(F.col(p + c) / 255 for c in "rgb"))
    a, b = lum(""), lum("back.")
    ratio = (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)
    least = F.when((F.col("size") >= 18) | (F.col("bold") & (F.col("size") >= 14)), 3.0).otherwise(4.5)
    pair = [N.color_hex(*(F.col(c) for c in "rgb")).alias("ink"), N.color_hex(*(F.col("back." + c) for c in "rgb")).alias("paper")]
    faint = both.where(ratio < least).select("doc", "page", *pair).distinct()
    return rules.issues(faint, F.lit(True), WARNING, "contrast", F.concat("ink", F.lit(" on "), "paper"), page=F.col("page"))


def image_only(pages: DataFrame, images: DataFrame, chars: int = 20, share: float = 0.4) -> DataFrame:
    """Pages (doc, page, n_chars, width, height) of little text whose largest image (x0, y0, x1, y1) covers much."""
    wide = F.greatest(F.least("x1", "width") - F.greatest("x0", F.lit(0)), F.lit(0))
    high = F.greatest(F.least("y1", "height") - F.greatest("y0", F.lit(0)), F.lit(0))
    n = pages.where(F.col("n_chars") < chars).join(images, ["doc", "page"]).groupBy("doc", "page").agg(F.max(wide * high / (F.col("width") * F.col("height"))).alias("part"))
    return rules.issues(n, F.col("part") >= share, ERROR, "image-only-text", F.concat(F.round(F.col("part") * 100).cast("bigint").cast("string"), F.lit(" %")), page=F.col("page"))


def unmapped_fonts(glyphs: DataFrame) -> DataFrame:
    """Fonts of a document (doc, page, font, shown, unmapped) with glyphs that stand for no character."""
    n = glyphs.groupBy("doc", "font").agg(F.sum("shown").alias("s"), F.sum("unmapped").alias("u"))
    return rules.issues(n, F.col("u") > 0, ERROR, "font-tounicode", F.concat(F.coalesce("font", F.lit("?")), F.lit(": "), F.col("u").cast("string"), F.lit(" of "), F.col("s").cast("string")))


def field_descriptions(fields: DataFrame, referenced: DataFrame) -> DataFrame:
    """Fields (doc, name, widget, alternate) without description, and those whose widget no node refers to (widget)."""
    bare = rules.issues(fields, blank(F.col("alternate")), ERROR, "field-tu", F.concat("name", F.lit(" without description")))
    lost = fields.join(referenced.select("widget").distinct(), "widget", "left_anti")
    return bare.unionByName(rules.issues(lost, F.lit(True), ERROR, "field-tu", F.concat("name", F.lit(" outside the structure"))))


def preflight(inventory: DataFrame, features: DataFrame) -> DataFrame:
    """(doc, profile, rule): features (doc, feature) that a profile forbids, and versions (doc, version) beyond its newest.

    The profiles are a table of fixed size that is broadcast; documents meet it by feature, not by pairing all.
    """
    spark = inventory.sparkSession
    banned = spark.createDataFrame([(p, f) for p, fs in FORBIDDEN.items() for f in fs], "profile string, feature string")
    limits = F.array(*(F.struct(F.lit(p).alias("profile"), F.lit(v).alias("most")) for p, v in MAX_VERSION.items() if v is not None))
    old = inventory.select("doc", "version", F.explode(F.filter(limits, lambda x: F.col("version") > x["most"])).alias("l")).select("doc", "l.profile", F.lit("version").alias("rule"))
    return features.distinct().join(F.broadcast(banned), "feature").select("doc", "profile", F.col("feature").alias("rule")).unionByName(old)


def metadata(packets: DataFrame) -> DataFrame:
    """Documents (doc, packet, part, needed, title, info_title): no packet and nothing else, or what differs in it."""
    has = F.col("packet")
    none = rules.issues(packets, ~has, ERROR, "xmp-metadata", "no packet")
    part = rules.issues(packets, has & ~F.col("part").eqNullSafe(F.col("needed")), ERROR, "xmp-metadata", "other profile")
    title = rules.issues(packets, has & ~blank(F.col("info_title")) & ~F.col("title").eqNullSafe(F.col("info_title")), ERROR, "xmp-metadata", "other title")
    return none.unionByName(part).unionByName(title)


def fix_plan(issues: DataFrame, allowed: list[str]) -> DataFrame:
    """(doc, profile, fixed, left, conforming): how many issues the allowed fixes mend, and how many stay."""
    can = F.col("rule").isin(allowed)
    n = issues.groupBy("doc", "profile").agg(F.count_if(can).alias("fixed"), F.count_if(~can).alias("left"))
    return n.withColumn("conforming", F.col("left") == 0)


def object_inventory(objects: DataFrame) -> DataFrame:
    """(doc, page, kind, n, n_clipped, deepest): objects (box x0..y1, clip cx0..cy1, depth) drawn on each page by kind."""
    inside = (F.col("x0") >= F.col("cx0")) & (F.col("y0") >= F.col("cy0")) & (F.col("x1") <= F.col("cx1")) & (F.col("y1") <= F.col("cy1"))
    return objects.groupBy("doc", "page", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(~inside).alias("n_clipped"), F.max("depth").alias("deepest"))


def combs(boxes: DataFrame, least: int = 3, align: float = 1.5, apart: float = 0.75) -> DataFrame:
    """(doc, page, run, kind, n, x0, x1): boxes of one row side by side as a comb, fewer square ones as check boxes.

    Boxes of a page in falling order of their upper edge are of one row while that edge and the lower one move by at most
    ``align``; a row is cut where the gap exceeds ``apart`` of the narrower width.
    """
    page = Window.partitionBy("doc", "page").orderBy(F.desc("y1"), F.desc("y0"), "x0")
    new = F.coalesce((F.lag("y1").over(page) - F.col("y1") > align) | (F.abs(F.lag("y0").over(page) - F.col("y0")) > align), F.lit(True))
    rows = boxes.withColumn("row", F.sum(new.cast("int")).over(page.rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy("doc", "page", "row").orderBy("x0", "x1")
    width = F.col("x1") - F.col("x0")
    gap = F.col("x0") - F.lag("x1").over(w) > apart * F.least(F.lag(width).over(w), width)
    runs = rows.withColumn("run", F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ratio = width / (F.col("y1") - F.col("y0"))
    square = (ratio > 0.75) & (ratio < 1.34)
    n = runs.groupBy("doc", "page", "row", "run").agg(F.count(F.lit(1)).alias("all"), F.count_if(square).alias("squares"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    comb = F.col("all") >= least
    out = n.where(comb | (F.col("squares") > 0))
    return out.select("doc", "page", "row", "run", F.when(comb, "comb").otherwise("check").alias("kind"), F.when(comb, F.col("all")).otherwise(F.col("squares")).alias("n"), "x0", "x1")


def ruled_grids(flat: DataFrame, upright: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """(doc, page, x0, x1, y0, y1, n_rows, n_columns): tables that rules draw.

    Horizontal rules (x0, x1, y) of equal extent make a band; upright ones (x, y0, y1) that cross half of it at least cut
    its columns, rules within ``tolerance`` of each other as one.
    """
    keys = ["doc", "page"]
    extent = Window.partitionBy(*keys).orderBy("x0", "x1")
    new = F.coalesce((F.col("x0") - F.lag("x0").over(extent) > tolerance) | (F.abs(F.col("x1") - F.lag("x1").over(extent)) > tolerance), F.lit(True))
    grouped = flat.withColumn("band", F.sum(new.cast("int")).over(extent.rowsBetween(Window.unboundedPreceding, 0)))
    lines = _apart(grouped, [*keys, "band"], "y", tolerance)
    bands = grouped.join(lines.select(*keys, "band", "lines"), [*keys, "band"]).groupBy(*keys, "band", "lines").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).where("lines >= 2")
    up = upright.select(*keys, F.col("x").alias("x0"), F.col("x").alias("x1"), "y0", "y1")
    met = geometry.overlapping(up, bands, keys, touch=tolerance)
    half = 2 * (F.least("y1", "o_y1") - F.greatest("y0", "o_y0")) >= F.col("o_y1") - F.col("o_y0")
    crossing = met.where(half & F.col("x0").between(F.col("o_x0") - tolerance, F.col("o_x1") + tolerance)).select(*keys, F.col("o_band").alias("band"), F.col("x0").alias("x"))
    columns = _apart(crossing, [*keys, "band"], "x", tolerance).select(*keys, "band", F.col("lines").alias("edges"))
    out = bands.join(columns, [*keys, "band"]).where("edges >= 2")
    return out.select(*keys, "x0", "x1", "y0", "y1", (F.col("lines") - 1).alias("n_rows"), (F.col("edges") - 1).alias("n_columns"))


def _apart(rows: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """(keys, lines): how many values stand more than the tolerance from the one before."""
    w = Window.partitionBy(*keys).orderBy(value)
    new = F.coalesce(F.col(value) - F.lag(value).over(w) > tolerance, F.lit(True))
    return rows.select(*keys, value, new.alias("_new")).groupBy(*keys).agg(F.count_if("_new").alias("lines"))


def gutters(boxes: DataFrame, least: float) -> DataFrame:
    """(doc, page, left, right): the widest upright gap of each page with two baselines (y0) or more on either side."""
    page = Window.partitionBy("doc", "page")
    left = page.orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1)
    right = page.orderBy(F.desc("x0")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    two = lambda w: F.min("y0").over(w) < F.max("y0").over(w)
    gaps = boxes.select("doc", "page", F.max("x1").over(left).alias("left"), F.col("x0").alias("right"), (two(left) & two(right)).alias("two"))
    wide = gaps.where((F.col("right") - F.col("left") >= least) & F.col("two"))
    best = F.max_by(F.struct("left", "right"), F.struct((F.col("right") - F.col("left")).alias("w"), (-F.col("left")).alias("l")))
    return wide.groupBy("doc", "page").agg(best.alias("g")).select("doc", "page", "g.left", "g.right")
