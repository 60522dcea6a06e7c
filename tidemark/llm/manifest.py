"""Merkle manifest of a table: a hash tree per source and one over the sources.

A leaf is the hash of a row's fields, a node the hash of up to three consecutive
nodes.  Only every ``levels`` levels are kept, as rows that each hold one
aligned subtree's lowest nodes; the levels between are not written.  A proof is
taken by computing a subtree's missing levels again from its stored nodes,
emitting the siblings of each, and dropping them; the proof above a subtree
comes from the next kept level and meets its nodes as one row per subtree.

Places are dealt by a range partitioning of (source, row id, leaf), so one huge
source is spread over all tasks; a subtree holds ``3 ** levels`` digests, and
what is shuffled are digests, never texts.  Everything stays in DataFrame
functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.store import stored

ARITY = 3
#: Levels between two that are kept: a subtree is 3 ** 5 = 243 nodes.
LEVELS = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
IN_TASK = (1 << 33) - 1


def _hash(x: Column) -> Column:
    return F.sha2(x, 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the byte count of the value as text, ``:`` and the value."""
    body = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(body).cast("string"), F.lit(":"), body), F.lit("-"))


def leaf_hash(values: list[Column]) -> Column:
    return _hash(F.concat(*[encoded(v) for v in values]))


def ordered(df: DataFrame, tree: str, keys: list[str]) -> DataFrame:
    """``df`` with _pos, the place from 0 of each row within its ``tree`` by
    ``keys`` (nulls first), and _n, the tree's rows; written once.

    Rows are range-partitioned and sorted; a place is the row's number in its
    task plus the tree's rows in earlier tasks.  Rows with equal keys may be
    many: their place in the scan comes last, so they are split as well."""
    df = df.withColumn("_tie", F.monotonically_increasing_id())
    by = [F.asc(c) for c in (tree, *keys, "_tie")]
    df = df.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    df = stored(df.withColumn("_id", F.monotonically_increasing_id()), "places")
    df = df.withColumn("_task", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit(IN_TASK)))
    runs = df.groupBy(F.col(tree).alias("_tree"), F.col("_task").alias("_run")).agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    whole = Window.partitionBy("_tree")
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("_tree", "_run", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("_n"))
    there = df[tree].eqNullSafe(runs["_tree"]) & (df["_task"] == runs["_run"])
    return df.join(runs, there).withColumn("_pos", F.col("_at") + F.col("_shift")).drop("_tree", "_run", "_shift", "_id", "_task", "_at")


def subtrees(nodes: DataFrame, levels: int) -> DataFrame:
    """Aligned subtrees ``(tree, block, n, nodes)`` of rows ``(tree, pos, n, node)``,
    ``node`` a struct that begins with the digest; in order of pos."""
    width = ARITY ** levels
    placed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"])
    return nodes.groupBy("tree", F.expr(f"pos div {width}").alias("block")).agg(F.first("n").alias("n"), placed.alias("nodes"))


def _next_level(below: Column) -> Column:
    firsts = F.sequence(F.lit(1), F.size(below), F.lit(ARITY))
    return F.transform(firsts, lambda i: _hash(F.array_join(F.slice(below, i, ARITY), "")))


def _with_levels(blocks: DataFrame, levels: int) -> DataFrame:
    """``blocks`` with _l0 to _l``levels``, the digests of each level of the
    subtree, and _need, how many of them the tree has here."""
    out = blocks.withColumn("_l0", F.transform("nodes", lambda x: x["digest"]))
    for k in range(levels):
        out = out.withColumn(f"_l{k + 1}", _next_level(F.col(f"_l{k}")))
    return out.withColumn("_need", sum(((F.col("n") > ARITY ** k).cast("int") for k in range(levels)), F.lit(0)))


def heads(blocks: DataFrame, levels: int) -> DataFrame:
    """The next kept level ``(tree, pos, n, node)``: the top of each subtree.  A
    tree that is down to one node keeps it."""
    top = F.get(F.array(*[F.get(f"_l{k}", 0) for k in range(levels + 1)]), F.col("_need"))
    left = F.ceil(F.col("n") / (ARITY ** levels)).cast("long")
    return _with_levels(blocks, levels).select("tree", F.col("block").alias("pos"), left.alias("n"), F.struct(top.alias("digest")).alias("node"))


def _siblings(i: Column, k: int) -> Column:
    """Digests left and right of the ancestor ``k`` levels above the ``i``-th
    node, within its run."""
    p = F.floor(i / ARITY ** k).cast("int") if k else i
    inside = p % ARITY
    level = F.col(f"_l{k}")
    return F.struct(F.array_join(F.slice(level, p - inside + 1, inside), "").alias("left"),
                    F.array_join(F.slice(level, p + 2, ARITY - 1 - inside), "").alias("right"))


def proofs(blocks: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """Each node of the subtrees with the siblings on its way to the top:
    ``(tree, pos, node, proof, top)``; ``above`` holds those of the next kept
    level, from which what is known of the top is handed down."""
    above = above.select(F.col("tree").alias("_tree"), F.col("pos").alias("_block"), F.col("proof").alias("_above"), "top")
    met = blocks.join(above, blocks["tree"].eqNullSafe(above["_tree"]) & (blocks["block"] == above["_block"]))
    own = lambda i: F.slice(F.array(*[_siblings(i, k) for k in range(levels)]), F.lit(1), F.col("_need"))
    rows = F.transform("nodes", lambda x, i: F.struct(x.alias("node"), i.alias("i"), own(i).alias("own")))
    met = _with_levels(met, levels).select("tree", "block", F.explode(rows).alias("_x"), "_above", "top")
    return met.select("tree", (F.col("block") * ARITY ** levels + F.col("_x.i")).alias("pos"), F.col("_x.node").alias("node"),
                      F.concat("_x.own", "_above").alias("proof"), "top")


class Forest:
    """Kept levels of the trees of one table of nodes, lowest first, and the
    table's tops ``(tree, digest)``."""

    def __init__(self, nodes: DataFrame, levels: int, name: str):
        self.levels, self.kept = levels, []
        rows = nodes
        while True:
            self.kept.append(stored(subtrees(rows, levels), f"{name}-level"))
            rows = heads(self.kept[-1], levels)
            # Each kept level is 1/243 of the one below; the widest tree decides how many there are.
            if (self.kept[-1].agg(F.max("n")).first()[0] or 0) <= ARITY ** levels:
                break
        self.tops = stored(rows.select("tree", F.col("node.digest").alias("digest")), f"{name}-tops")

    def proofs(self, above: DataFrame) -> DataFrame:
        """Proofs of all lowest nodes, below those of the tops
        ``(tree, proof, top)``."""
        out = above.select("tree", F.lit(0).cast("long").alias("pos"), "proof", "top")
        for blocks in reversed(self.kept):
            out = proofs(blocks, out, self.levels)
        return out


NO_PROOF = "array<struct<left:string,right:string>>"


def manifest(docs: DataFrame, *, row: str = "doc_id", tree: str = "source", fields: tuple[str, ...] = FIELDS, text: str = "text",
             tampered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """A row for each row of ``docs``: its id, leaf, the digests of its source's
    tree (subroot) and of the whole table (root), and proof: the digests left
    and right of its ancestors, level by level, up to the root.

    ``tampered``, an expression on ``docs``, stands for ``text`` in a second
    leaf, presented.  Null fields are hashed as ``-``; an empty text has length
    0; a null source is a source of its own and the first, a null id is the
    first of its source.  Rows with one id are ordered by leaf, and identical
    rows are leaves of their own.  An empty table gives no rows.  Only the
    named columns are read, whatever others are called."""
    leaf = leaf_hash([F.col(c) for c in fields])
    shown = leaf if tampered is None else leaf_hash([tampered if c == text else F.col(c) for c in fields])
    leaves = docs.select(F.col(tree).alias("tree"), F.col(row).alias("id"), leaf.alias("digest"), shown.alias("presented"))
    placed = ordered(leaves, "tree", ["id", "digest"])
    node = F.struct("digest", "id", F.when(F.col("presented") != F.col("digest"), F.col("presented")).alias("presented"))
    below = Forest(placed.select("tree", F.col("_pos").alias("pos"), F.col("_n").alias("n"), node.alias("node")), levels, "leaves")
    tops = ordered(below.tops.select(F.lit(0).alias("all"), F.col("tree").alias("source"), "digest"), "all", ["source"])
    over = Forest(tops.select(F.col("all").alias("tree"), F.col("_pos").alias("pos"), F.col("_n").alias("n"), F.struct("digest", "source").alias("node")), levels, "sources")
    root = over.tops.select("tree", F.from_json(F.lit("[]"), NO_PROOF).alias("proof"), F.col("digest").alias("top"))
    subroots = over.proofs(root).select(F.col("node.source").alias("tree"), "proof", F.struct(F.col("node.digest").alias("subroot"), F.col("top").alias("root")).alias("top"))
    return below.proofs(stored(subroots, "subroots")).select(
        F.col("node.id").alias(row), F.col("node.digest").alias("leaf"), "top.subroot", "top.root", "proof", F.coalesce("node.presented", "node.digest").alias("presented"))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda a, s: _hash(F.concat(s["left"], a, s["right"])))


def digest(proved: DataFrame) -> DataFrame:
    """Hash of each proof, the root from the presented leaf, and whether it is the root."""
    flat = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    out = proved.withColumn("proof_sha256", _hash(flat)).withColumn("folded_root", fold(F.col("presented"), F.col("proof")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).drop("proof", "presented")
