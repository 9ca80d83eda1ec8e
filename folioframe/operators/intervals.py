"""Trees as intervals: each node's places on a walk around the tree, at which it is entered and left.

A node lies under another if its interval lies in the other's; text in structure order is text by the entering places.
Labels hold two numbers a node, whatever the depth, and are found by pointer jumping over nodes that have children: each
knows its parent, and in each round the ancestor twice as far, so that rounds are the logarithm of the depth and a chain of
100 000 nodes takes 17 for the sizes of subtrees and 17 for the places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Written = Callable[[DataFrame, str], DataFrame]


def label(nodes: DataFrame, keys: list[str], written: Written) -> DataFrame:
    """Nodes (keys, node, parent, ord, ..) with ``first``, ``last`` and ``depth``: where the walk of their tree enters and leaves them.

    Children go by ord, then node. Nodes without a parent, or whose parent is missing, are roots, which follow one
    another; nodes on a circle are left out, with what hangs on them. Every node id stands once for its keys.
    """
    own = [*keys, "node"]
    known = nodes.select(*keys, F.col("node").alias("parent"), F.lit(True).alias("_known"))
    tree = nodes.select(*own, "parent", "ord").join(known, [*keys, "parent"], "left")
    tree = written(tree.select(*own, "ord", F.when(F.col("_known"), F.col("parent")).alias("up")), "tree")
    has = tree.where("up IS NOT NULL").select(*keys, F.col("up").alias("node")).distinct().withColumn("_inner", F.lit(True))
    rows = written(tree.join(has, own, "left").withColumn("_inner", F.coalesce("_inner", F.lit(False))), "rows")
    most = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).head()[0] or 0
    leaves = rows.where("NOT _inner AND up IS NOT NULL").groupBy(*keys, F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("_k"))
    inner = rows.where("_inner").select(*own, "up").join(leaves, own, "left").select(*own, "up", (F.coalesce("_k", F.lit(0)) + 1).alias("v"))

    def doubled(state: DataFrame, down: bool) -> DataFrame:
        """(keys, node, v, depth): sums of v over a node's subtree, or from its root down to it; nodes on circles go."""
        state = written(state.withColumn("depth", F.col("up").isNotNull().cast("bigint")), "doubled")
        for _ in range(most.bit_length()):
            if state.where("up IS NOT NULL").isEmpty():
                break
            ahead = state.select(*keys, F.col("node").alias("up"), F.col("up").alias("_up"), F.col("v").alias("_v"), F.col("depth").alias("_depth"))
            moved = state.join(ahead, [*keys, "up"], "left").withColumn("depth", F.col("depth") + F.coalesce("_depth", F.lit(0)))
            if down:
                moved = moved.withColumn("v", F.col("v") + F.coalesce("_v", F.lit(0)))
            else:
                more = state.where("up IS NOT NULL").groupBy(*keys, F.col("up").alias("node")).agg(F.sum("v").alias("_more"))
                moved = moved.join(more, own, "left").withColumn("v", F.col("v") + F.coalesce("_more", F.lit(0)))
            state = written(moved.select(*own, F.col("_up").alias("up"), "v", "depth"), "doubled")
        return state.where("up IS NULL").select(*own, "v", "depth")

    sized = rows.join(doubled(inner, False).select(*own, F.col("v").alias("size")), own, "left").withColumn("size", F.when(F.col("_inner"), F.col("size")).otherwise(F.lit(1).cast("bigint"))).where("size IS NOT NULL")
    among = Window.partitionBy(*keys, "up").orderBy("ord", "node").rowsBetween(Window.unboundedPreceding, -1)
    step = written(sized.select(*own, "up", "_inner", "size", (F.coalesce(F.sum("size").over(among), F.lit(0)) + F.col("up").isNotNull().cast("bigint")).alias("v")), "steps")
    tops = written(doubled(step.where("_inner").select(*own, "up", "v"), True), "tops")
    over = tops.select(*keys, F.col("node").alias("up"), F.col("v").alias("_v"), F.col("depth").alias("_depth"))
    ends = step.where("NOT _inner").join(over, [*keys, "up"], "left").where("up IS NULL OR _v IS NOT NULL")
    ends = ends.select(*own, "size", (F.col("v") + F.coalesce("_v", F.lit(0))).alias("pre"), F.coalesce(F.col("_depth") + 1, F.lit(0)).alias("depth"))
    all_ = ends.unionByName(tops.join(step.select(*own, "size"), own).select(*own, "size", F.col("v").alias("pre"), "depth"))
    first = 2 * F.col("pre") - F.col("depth")
    return nodes.join(all_.select(*own, first.alias("first"), (first + 2 * F.col("size") - 1).alias("last"), "depth"), own)


def preorder(first: Column, depth: Column) -> Column:
    """How many nodes the walk has entered before."""
    return ((first + depth) / 2).cast("bigint")


def size(first: Column, last: Column) -> Column:
    """Nodes in the subtree, its top included."""
    return ((last - first + 1) / 2).cast("bigint")


def under(labelled: DataFrame, tops: DataFrame, keys: list[str]) -> DataFrame:
    """The labelled nodes that are tops (keys, node) or lie under one.

    By entering place, a node lies under a top that came before if that is left later: a running maximum tells it.
    """
    chosen = tops.select(*keys, "node").distinct().withColumn("_top", F.lit(True))
    rows = labelled.join(chosen, [*keys, "node"], "left")
    reach = F.max(F.when(F.col("_top"), F.col("last"))).over(Window.partitionBy(*keys).orderBy("first").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_reach", reach).where(F.col("_reach") >= F.col("last")).drop("_top", "_reach")


def edited(labelled: DataFrame, keys: list[str], removed: DataFrame | None = None, moved: DataFrame | None = None, added: DataFrame | None = None, renamed: DataFrame | None = None) -> DataFrame:
    """Nodes (keys, node, parent, ord, kind) after edits, which all refer to the tree as it was; to be labelled anew.

    removed (keys, node): with all that lies under them. moved (keys, node, parent, ord): with what lies under them; moves
    under themselves, or under nodes that are gone or absent, do not happen. added (keys, node, parent, ord, kind): under nodes
    that are there (of that round or before). renamed (keys, node, kind).
    """
    columns = [*keys, "node", "parent", "ord", "kind"]
    own = [*keys, "node"]
    rows = labelled if removed is None else labelled.join(under(labelled, removed, keys).select(*own), own, "left_anti")
    if moved is not None:
        places = rows.select(*own, "first", "last")
        to = moved.select(*own, F.col("parent").alias("_to"), F.col("ord").alias("_ord")).join(places, own)
        target = places.select(*keys, F.col("node").alias("_to"), F.col("first").alias("_f"), F.col("last").alias("_l"))
        fits = to.join(target, [*keys, "_to"]).where(~((F.col("_f") >= F.col("first")) & (F.col("_l") <= F.col("last")))).select(*own, "_to", "_ord")
        rows = rows.join(fits, own, "left").withColumns({"parent": F.coalesce("_to", "parent"), "ord": F.coalesce("_ord", "ord")}).drop("_to", "_ord")
    rows = rows.select(*columns)
    if added is not None:
        there = rows.select(*keys, F.col("node").alias("parent")).unionByName(added.select(*keys, F.col("node").alias("parent"))).distinct()
        rows = rows.unionByName(added.select(*columns).join(there, [*keys, "parent"], "left_semi").select(*columns))
    if renamed is not None:
        rows = rows.join(renamed.select(*own, F.col("kind").alias("_kind")), own, "left").withColumn("kind", F.coalesce("_kind", "kind"))
    return rows.select(*columns)


def structure_text(labelled: DataFrame, content: DataFrame, keys: list[str], block: list[str]) -> DataFrame:
    """(keys, text): marked content (keys, page, mcid, text) in the order of the nodes that refer to it.

    Nodes have ``marks``, an array of (page, mcid). Content that no node refers to, as artifacts are, is left out. Content
    of one node is joined by a blank; a node of a kind in ``block`` begins a new line.
    """
    marks = labelled.select(*keys, "first", "kind", F.posexplode_outer("marks").alias("k", "m"))
    said = marks.select(*keys, "first", "kind", "k", "m.page", "m.mcid").join(content.select(*keys, "page", "mcid", "text"), [*keys, "page", "mcid"], "left")
    rows = said.where(F.col("text").isNotNull() | F.col("kind").isin(block))
    pieces = F.array_sort(F.collect_list(F.struct("first", "k", F.when(F.col("kind").isin(block) & (F.coalesce("k", F.lit(0)) == 0), "\n").otherwise(" ").alias("before"), F.coalesce("text", F.lit("")).alias("text"))))
    joined = F.array_join(F.transform(pieces, lambda p: F.concat(p["before"], p["text"])), "")
    return rows.groupBy(*keys).agg(F.trim(F.regexp_replace(joined, r"\s*\n\s*", "\n")).alias("text")).withColumn("text", F.regexp_replace("text", r"^\n|\n$", ""))


def inversions(order: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, longest, n_moved): how far the order of two sides differs, from (keys, structure, layout) of what both hold.

    ``longest`` is the longest run in order on both sides and ``n_moved`` what stands outside of it. Places are distinct.
    """
    import pandas as pd

    def run(batches):
        from bisect import bisect_left

        for batch in batches:
            out = []
            for values in batch["_order"]:
                tails: list[int] = []
                for v in values:
                    k = bisect_left(tails, v)
                    tails[k : k + 1] = [v]
                out.append((len(values), len(tails), len(values) - len(tails)))
            yield pd.concat([batch[keys].reset_index(drop=True), pd.DataFrame(out, columns=["n", "longest", "n_moved"], dtype="int64")], axis=1)

    seq = F.transform(F.array_sort(F.collect_list(F.struct("structure", "layout"))), lambda s: s["layout"].cast("bigint"))
    grouped = order.groupBy(*keys).agg(seq.alias("_order"))
    kinds = ", ".join(f"{k} {order.schema[k].dataType.simpleString()}" for k in keys)
    return grouped.mapInPandas(run, f"{kinds}, n bigint, longest bigint, n_moved bigint")
