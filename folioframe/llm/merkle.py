"""A Merkle manifest of a dataset: trees of hashes whose nodes are labelled by the interval of leaf ranks they cover.

Each row of a table is a leaf. The leaves of a source, by ascending id, make a tree; the roots of those trees, by
ascending source, make the tree above. H is the lower-case hex SHA-256 of its inputs one after another, digests as
hex text. Of a row the inputs are its fields, each ``-`` where null and else its count of UTF-8 bytes, ``:`` and the
value; of an inner node they are the digests of a run of ``FAN_OUT`` nodes (the last run: fewer, even one).

Nodes are rows (tree, lo, hi, digest): they cover the leaves lo .. hi - 1, so that a node of level k lies in the
bucket ``lo div FAN_OUT**k``. A node finds its parent by a join on tree and bucket of the level above, under the
condition that its interval lies in the parent's; its siblings are those children of the parent that lie in the
difference of the two intervals. Going down, each level takes over the siblings of the level above, so that the work
is that of about 1.5 rows for each leaf, however many levels there are. Ranks come from ranges (see ``ranks``), so
a source may hold any share of the rows.

Nulls: a null source is a source of its own and comes first; null ids come first in their source. Rows with one id
are ordered by their leaf digest; equal rows are leaves of their own, each with its own proof. Further columns are
not read. An empty table has no nodes, no root and no proofs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.ranks import sort_rows, with_ranks
from folioframe.llm.shared import Tables

FAN_OUT = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def field(value: Column) -> Column:
    """A field as a leaf's digest takes it in: what it is can be told from its bytes, also beside other fields."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    """The digest of a row of these fields."""
    return F.sha2(F.concat(*map(field, values)), 256)


def _siblings(children: str) -> Column:
    """(l, r): digests of the children in what the parent's interval has to the left and right of [lo, hi)."""
    left, right = F.filter(children, lambda c: c.hi <= F.col("lo")), F.filter(children, lambda c: c.lo >= F.col("hi"))
    return F.struct(*(F.array_join(F.transform(side, lambda c: c.digest), "").alias(name) for name, side in (("l", left), ("r", right))))


def _levels(leaves: DataFrame, own: Tables) -> list[DataFrame]:
    """Written nodes (tree, n, lo, hi, digest, children) by level, from leaves (tree, n, lo, hi, digest).

    A tree of n leaves has nodes up to the first level at which one node covers them all.
    """
    most = leaves.agg(F.max("n")).head()[0] or 0
    out, span = [leaves], 1
    while span < most:
        up = span * FAN_OUT
        run = F.array_sort(F.collect_list(F.struct("lo", "hi", "digest")))
        nodes = out[-1].where(F.col("n") > span).groupBy("tree", "n", F.expr(f"lo div {up}").alias("_bucket")).agg(run.alias("children"))
        digest = F.sha2(F.array_join(F.transform("children", lambda c: c.digest), ""), 256)
        out.append(own.stash(nodes.select("tree", "n", F.col("children")[0].lo.alias("lo"), F.element_at("children", -1).hi.alias("hi"), digest.alias("digest"), "children"), "level"))
        span = up
    return out


def _roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, n, digest) of the nodes that cover all leaves of their tree."""
    out = levels[0].where("n = 1").select("tree", "n", "digest")
    for nodes in levels[1:]:
        out = out.union(nodes.where("lo = 0 AND hi = n").select("tree", "n", "digest"))
    return out


def _descend(levels: list[DataFrame], tops: DataFrame, carry: list[str], own: Tables) -> DataFrame:
    """Level 0 with the columns ``carry`` of its tree's row in ``tops``, and the path from it to the top.

    A path is an array of (l, r): digests of the siblings to the left and to the right, one entry a level; ``tops``
    holds that of each tree's root.
    """
    path: DataFrame | None = None
    for k in range(len(levels) - 1, -1, -1):
        span = FAN_OUT**k
        nodes = levels[k]
        at_top = nodes.where(F.col("n") <= span).join(tops, "tree")
        if path is not None:
            up = path.select(F.col("tree").alias("_tree"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.expr(f"lo div {span * FAN_OUT}").alias("_bucket"), F.col("children").alias("_children"), "path", *carry)
            inside = (F.col("tree") == F.col("_tree")) & (F.expr(f"lo div {span * FAN_OUT}") == F.col("_bucket")) & (F.col("lo") >= F.col("_lo")) & (F.col("hi") <= F.col("_hi"))
            below = nodes.where(F.col("n") > span).join(up, inside)
            below = below.select(*nodes.columns, F.concat(F.array(_siblings("_children")), "path").alias("path"), *carry)
            at_top = below.unionByName(at_top.select(*below.columns))
        path = own.stash(at_top, "path") if k else at_top
    return path


def fold(leaf_digest: Column, path: Column) -> Column:
    """The root that a leaf digest gives with the siblings of a path."""
    return F.aggregate(path, leaf_digest, lambda have, at: F.sha2(F.concat(at["l"], have, at["r"]), 256))


def proofs(docs: DataFrame, fields: list[str] = FIELDS, tree: str = "source", key: str = "doc_id", also: dict[str, Column] | None = None, returned: list[Column] | None = None) -> DataFrame:
    """Each row's key, leaf, subroot, root and path, and what ``also`` makes from the row by name.

    Rows are read once; of each only its key, its tree, its digest and ``also`` go on. ``returned`` are columns made
    of those names (the key's is ``key``), where the paths themselves, of some kilobytes a row, need not be written.
    """
    names, also = fields, also or {}
    with Tables() as own:
        rows = own.stash(docs.select(F.col(key).alias("key"), F.col(tree).alias("of"), leaf([F.col(c) for c in names]).alias("digest"), *(v.alias(k) for k, v in also.items())), "leaves")
        rows, pieces = sort_rows(rows, ["of"], ["key", "digest"], own)
        trees = own.stash(pieces.groupBy("of").agg(F.max("n").alias("n")).withColumn("all", F.lit(0)), "trees")
        upper, upper_pieces = sort_rows(trees.select("of", "all"), ["all"], ["of"], own)
        numbered = own.stash(with_ranks(upper, upper_pieces, ["all"]).select(F.col("of").alias("_of"), F.col("rank").alias("tree"), F.col("n").alias("n_trees")), "numbered")
        pieces = own.stash(pieces.join(numbered, F.col("of").eqNullSafe(F.col("_of"))).drop("_of", "n_trees"), "numbered_pieces")
        leaves = own.stash(with_ranks(rows, pieces, ["of"]).select("tree", "n", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", "key", *also), "ranked")

        levels = _levels(leaves, own)
        subroots = _roots(levels).join(numbered, "tree")
        tops = own.stash(subroots.select(F.lit(0).alias("tree"), F.col("n_trees").alias("n"), F.col("tree").alias("lo"), (F.col("tree") + 1).alias("hi"), "digest"), "subroots")
        above = _levels(tops, own)
        root = _roots(above).head()
        nothing = F.expr("cast(array() AS array<struct<l: string, r: string>>)")
        start = docs.sparkSession.range(1).select(F.lit(0).alias("tree"), nothing.alias("path"))
        entries = own.stash(_descend(above, start, [], own).select(F.col("lo").alias("tree"), F.col("digest").alias("subroot"), "path"), "entries")
        paths = _descend(levels, entries, ["subroot"], own)
        paths = paths.select("key", F.col("digest").alias("leaf"), "subroot", F.lit(root["digest"] if root else None).cast("string").alias("root"), "path", *also)
        return own.keep(paths.select(*returned) if returned else paths.withColumnRenamed("key", key), "proofs")


def verify(docs: DataFrame) -> DataFrame:
    """The manifest's proof for each row of ``documents``, and whether the row as it is handed on still fits the root.

    Where 2 divides the crc32 of the decimal id the row is handed on with the line ends of its text deleted. A row
    without an id is handed on as it is.
    """
    bare = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0, F.translate("text", "\n", ""))
    handed_on = F.when(F.length(bare) < F.length("text"), leaf([F.col(c) if c != "text" else bare for c in FIELDS]))
    folded = fold(F.coalesce("changed", "leaf"), F.col("path"))
    proof = F.sha2(F.array_join(F.transform("path", lambda at: F.concat(at["l"], at["r"])), ""), 256)
    columns = [F.col("key").alias("doc_id"), F.col("leaf"), F.col("subroot"), F.col("root"), proof.alias("proof_sha256"), folded.alias("folded_root")]
    out = proofs(docs, also={"changed": handed_on}, returned=columns)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field_sql(column: str, text: str | None = None) -> str:
    value = text or f"{column}::VARCHAR"
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE concat(strlen({value})::VARCHAR, ':', {value}) END"


#: The unsigned crc32 of a decimal number in SQL: bit by bit over the bytes of its text.
CRC32_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({id}::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""


def _tree_sql(name: str, leaves: str) -> str:
    """Nodes (tree, n, level, idx, digest) over leaves (tree, n, idx, digest), and the paths of the leaves."""
    return f"""
{name}_nodes AS (
    SELECT tree, n, 0 AS level, 1::BIGINT AS span, idx, digest FROM {leaves}
    UNION ALL
    SELECT tree, n, any_value(level) + 1, any_value(span) * {FAN_OUT}, idx // {FAN_OUT}, sha256(string_agg(digest, '' ORDER BY idx)) FROM {name}_nodes WHERE n > span GROUP BY tree, n, idx // {FAN_OUT}
), {name}_sides AS (
    SELECT a.tree, a.n, a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
    FROM {name}_nodes a JOIN {name}_nodes b ON a.tree = b.tree AND a.level = b.level AND a.idx // {FAN_OUT} = b.idx // {FAN_OUT}
    WHERE a.n > a.span GROUP BY a.tree, a.n, a.level, a.idx
)"""


def _steps_sql(name: str, start: str, carry: str) -> str:
    """Folding each row of ``start`` (tree, n, idx, folded, proof) up its tree."""
    return f"""
{name}_steps AS (
    SELECT {carry}, tree, n, 0 AS level, 1::BIGINT AS span, idx, folded, proof FROM {start}
    UNION ALL
    SELECT {carry}, a.tree, a.n, a.level + 1, span * {FAN_OUT}, a.idx // {FAN_OUT}, sha256(concat(l, folded, r)), concat(proof, l, r)
    FROM {name}_steps a JOIN {name}_sides x ON a.tree = x.tree AND a.level = x.level AND a.idx = x.idx WHERE a.n > span
)"""


SQL = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, sha256(concat({_field_sql('doc_id')}, {_field_sql('source')}, {_field_sql('lang')}, {_field_sql('n_chars')}, {_field_sql('text')})) AS leaf,
        CASE WHEN {CRC32_SQL.format(id='doc_id')} % 2 = 0 THEN sha256(concat({_field_sql('doc_id')}, {_field_sql('source')}, {_field_sql('lang')}, {_field_sql('n_chars')}, {_field_sql('text', "replace(text, chr(10), '')")})) END AS changed
    FROM documents
), s AS (
    SELECT source, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree, count(*) AS n FROM d GROUP BY source
), leaves AS (
    SELECT tree, n, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, leaf AS digest, doc_id, changed FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
), {_tree_sql('low', 'leaves')}, tops AS (
    SELECT 0 AS tree, (SELECT count(*) FROM s) AS n, tree AS idx, digest FROM low_nodes WHERE n <= span
), {_tree_sql('top', 'tops')}, low_start AS (
    SELECT doc_id, digest AS leaf, tree, n, idx, coalesce(changed, digest) AS folded, '' AS proof FROM leaves
), {_steps_sql('low', 'low_start', 'doc_id, leaf')}, top_start AS (
    SELECT doc_id, leaf, tops.digest AS subroot, tops.tree, tops.n, tops.idx, folded, proof FROM low_steps JOIN tops ON low_steps.tree = tops.idx WHERE low_steps.n <= span
), {_steps_sql('top', 'top_start', 'doc_id, leaf, subroot')}
SELECT doc_id, leaf, subroot, t.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.digest AS verified
FROM top_steps JOIN (SELECT digest FROM top_nodes WHERE n <= span) t ON TRUE
WHERE top_steps.n <= span
"""
