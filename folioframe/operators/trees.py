"""Trees and graphs as tables: structure of pages, outlines, threads, reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Elements of HTML without content.
VOID = ["br", "hr", "img", "input", "link", "meta", "area", "base", "col", "embed", "source", "track", "wbr"]


def tags(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, ord, tag, closing): the tags of each page in order, without void elements and scripts' insides."""
    plain = F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    found = F.regexp_extract_all(plain, F.lit(r"<(/?[a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))
    rows = pages.select(key, F.posexplode(found).alias("ord", "raw"))
    tag = F.lower(F.translate("raw", "/", ""))
    return rows.select(key, "ord", tag.alias("tag"), F.col("raw").startswith("/").alias("closing")).where(~F.col("tag").isin(VOID))


def nested(marks: DataFrame, keys: list[str]) -> DataFrame:
    """Marks (keys, ord, level) with ``parent``: the ord of the nearest earlier mark of a lower level, else null."""
    w = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    # a mark of level k hides earlier ones of k and more, so the latest lower one is the largest of the latest of each level
    latest = [F.max(F.when(F.col("level") == k, F.col("ord"))).over(w) for k in range(1, 6)]
    named = marks.select("*", *[c.alias(f"_l{k}") for k, c in enumerate(latest, 1)])
    parent = F.greatest(*[F.when(F.col("level") > k, F.col(f"_l{k}")).otherwise(F.lit(None)) for k in range(1, 6)])
    return named.withColumn("parent", parent).drop(*[f"_l{k}" for k in range(1, 6)])


def _jumped(rows: DataFrame, path: bool) -> DataFrame:
    """Rows (doc, idx, up, top, depth[, path]) whose ``up`` has come to be null, by doubling the steps in each round.

    After as many rounds as a chain of all rows needs, what is left runs in circles and has no root.
    """
    n, rounds = rows.count(), 0
    while 2**rounds <= 2 * n:
        above = rows.select("doc", F.col("idx").alias("up"), F.col("up").alias("_up"), F.col("top").alias("_top"), F.col("depth").alias("_depth"), *([F.col("path").alias("_path")] if path else []))
        joined = rows.join(above, ["doc", "up"], "left")
        named = [F.coalesce("_top", "top").alias("top"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")]
        if path:
            named.append(F.concat(F.coalesce(F.concat("_path", F.lit("/")), F.lit("")), F.col("path")).alias("path"))
        rows, rounds = joined.select("doc", "idx", F.col("_up").alias("up"), *named).checkpoint(), rounds + 1
        if rows.where("up IS NOT NULL").isEmpty():
            break
    return rows.where("up IS NULL")


def threads(replies: DataFrame) -> DataFrame:
    """(doc, idx, root, depth, path): comments (doc, idx, parent) in depth-first order; an absent parent makes a root.

    Threads may be of any depth: ancestors are met by doubling steps. Comments in a circle, and under one, are in none.
    """
    known = replies.select(F.col("doc"), F.col("idx").alias("parent"), F.lit(True).alias("_known"))
    up = F.when(F.col("_known"), F.col("parent"))
    rows = replies.join(known, ["doc", "parent"], "left").select("doc", "idx", up.alias("up"), F.col("idx").alias("top"), up.isNotNull().cast("int").alias("depth")).checkpoint()
    # paths are built only once it is known which comments have a root, as they would double in a circle
    rooted = _jumped(rows, path=False).select("doc", "idx")
    named = rows.join(rooted, ["doc", "idx"], "left_semi").withColumn("path", F.lpad(F.col("idx").cast("string"), 9, "0")).checkpoint()
    return _jumped(named, path=True).select("doc", "idx", F.col("top").alias("root"), "depth", "path")


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, hops): what ``roots`` (id) reach by ``edges`` (src, dst), with the fewest steps; each round ends in a checkpoint."""
    seen = roots.select("id").distinct().withColumn("hops", F.lit(0)).checkpoint()
    frontier, k = seen, 0
    while True:
        k += 1
        new = frontier.join(edges, frontier["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(k)).checkpoint()
        if new.isEmpty():
            return seen
        seen, frontier = seen.unionByName(new).checkpoint(), new


def latest(log: DataFrame, key: str, order: list[Column], deleted: Column | None = None) -> DataFrame:
    """The newest row of each key; keys whose newest row is deleted are gone."""
    top = log.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
    return top.where(~deleted) if deleted is not None else top


def regions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, region): the smallest id that each of ``nodes`` (id) reaches by ``edges`` (a, b), both ways."""
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct().checkpoint()
    labels = nodes.select("id", F.col("id").alias("region")).checkpoint()
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("region").alias("near"))
        new = labels.join(near, "id", "left").select("id", F.col("region").alias("before"), F.least("region", F.coalesce("near", "region")).alias("region")).checkpoint()
        labels = new.select("id", "region")
        if new.where("before <> region").isEmpty():
            return labels
