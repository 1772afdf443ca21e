"""Merkle manifest of a dataset, with a proof for every row.

Every row is a leaf, the SHA-256 of its fields. The leaves of a source, ascending by key, are
reduced in runs of ``ARITY`` until one node remains, the source's subroot; the subroots, ordered
by source, are reduced likewise to the root. The proof of a row is the digest of all siblings on
its way to the root.

Positions: rows are range-partitioned by (source, key, leaf), which splits hot sources, and
written; a row's position is its place in its partition and source plus the rows of the source
in earlier partitions, from one count per partition and source.

Reduction: a superblock is ``ARITY ** LEVELS`` neighbouring nodes, the leaves of one subtree. It
is reduced in one group of bounded size to one node, whose own neighbours are superblocks of the
next tier, up to the root. Proofs come back down by cogrouped subtree exchange: the nodes of a
tier and the siblings that lie outside of their superblock (the ones of the tier above, at most
``ARITY - 1`` a level) are cogrouped by superblock, and one pass in ``applyInPandas`` finishes
the local reduction, joins local and outer siblings to paths and folds them. No level of the
tree costs a shuffle of its own, and no task sees more than a superblock.

Edge cases: null sources are one source, which comes first; null keys come first in their source;
rows of one key are ordered by their leaf, equal rows are equal leaves side by side; null fields
are ``-``, empty texts ``0:``; a source of one row has its leaf as subroot, a single source its
subroot as root; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listing_etl.llm.common import prepare, staged

ARITY = 3
#: Levels of a superblock: 2,187 nodes.
LEVELS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a range partition, about.
PARTITION_ROWS = 1 << 18


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)).cast("binary"), 256)


def _node(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_above(n: int) -> int:
    """Levels by which ``n`` neighbours become one node."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def reduction(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level, the given ones first."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([_node(below[i:i + ARITY]) for i in range(0, len(below), ARITY)])
    return out


def fold(node: str, place: int, runs: list[list[str]]) -> str:
    """The node that remains when ``node`` meets its siblings level by level; ``place``: its
    position, whose base-``ARITY`` digits say where in a run it stands."""
    for siblings in runs:
        at = place % ARITY
        node = _node([*siblings[:at], node, *siblings[at:]])
        place //= ARITY
    return node


def _siblings(tree: list[list[str]], i: int) -> list[list[str]]:
    out = []
    for level in tree[:-1]:
        run = i // ARITY * ARITY
        out.append(level[run:i] + level[i + 1:run + ARITY])
        i //= ARITY
    return out


def _local_levels(count: int, tier: int, levels: int) -> int:
    """Levels that a superblock of this tier has, if ``count`` nodes lie at the foot of the tree."""
    return max(0, min(levels, levels_above(count) - tier * levels))


def positions(rows: DataFrame, tree: str, order: list[str], partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """Rows with ``place`` (from 0, by ``order`` inside of ``tree``) and ``count``, the rows of the tree."""
    # a written number parts even equal rows, whose order among themselves does not matter
    rows = staged(rows.withColumn("salt", F.monotonically_increasing_id()), "unordered")
    order = [*order, "salt"]
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // partition_rows))
    rows = staged(rows.repartitionByRange(parts, tree, *order).withColumn("part", F.spark_partition_id()), "ordered")
    counts = rows.groupBy(tree, "part").agg(F.count("*").alias("here"))
    before = Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(tree)
    counts = staged(counts.select(tree, "part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"), F.sum("here").over(all_).alias("count")), "places")
    inside = Window.partitionBy(tree, "part").orderBy(*order)
    placed = rows.withColumn("nth", F.row_number().over(inside) - 1).join(counts, [tree, "part"])
    return staged(placed.withColumn("place", F.col("before") + F.col("nth")).drop("part", "nth", "before", "salt"), "placed")


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / ARITY ** levels).cast("long"))


def _reduced(nodes: DataFrame, tier: int, levels: int) -> DataFrame:
    """The tier above: (tree, place, count, node), one node for each superblock."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        count = int(group["count"].iloc[0])
        tops = reduction(group["node"].tolist(), _local_levels(count, tier, levels))[-1]
        return pd.DataFrame({"tree": group["tree"].iloc[:1], "place": group["block"].iloc[:1], "count": [count], "node": tops})

    return _blocks(nodes, levels).select("tree", "block", "place", "count", "node").groupBy("tree", "block").applyInPandas(run, "tree string, place long, count long, node string")


_OUTER = "tree string, block long, outer array<array<string>>, above string"


def _exchange(nodes: DataFrame, outer: DataFrame, tier: int, levels: int, finish: Callable, schema: str) -> DataFrame:
    """Cogroup the nodes of a tier with the siblings outside of their superblocks (``outer``: level by level,
    and ``above``: the tree's top); ``finish`` gets each group's rows with the siblings of each, level by level."""
    def run(key: tuple, group: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        tree = reduction(group["node"].tolist(), _local_levels(int(group["count"].iloc[0]), tier, levels))
        far = [[str(x) for x in level] for level in around["outer"].iloc[0]] if len(around) else []
        top = around["above"].iloc[0] if len(around) else tree[-1][0]
        return finish(group, [_siblings(tree, i) + far for i in range(len(group))], top)

    return _blocks(nodes, levels).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(run, schema)


def _as_outer(group: pd.DataFrame, paths: list, top: str) -> pd.DataFrame:
    """Siblings of a superblock's node are the outer ones of the nodes below it."""
    return pd.DataFrame({"tree": group["tree"], "block": group["place"], "outer": paths, "above": top})


def tiers(foot: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """All tiers of trees (tree, place, count, node), the foot first; the last has one node a tree."""
    out = [foot]
    most = foot.agg(F.max("count")).first()[0] or 0
    while most > 1:
        out.append(staged(_reduced(out[-1], len(out) - 1, levels), "tier"))
        most = -(-most // ARITY ** levels)
    return out


def paths_down(tiers_: list[DataFrame], levels: int = LEVELS) -> DataFrame:
    """Outer siblings of the superblocks at the foot."""
    outer = tiers_[0].sparkSession.createDataFrame([], _OUTER)
    for tier in range(len(tiers_) - 1, 0, -1):
        outer = staged(_exchange(tiers_[tier], outer, tier, levels, _as_outer, _OUTER), "outer")
    return outer


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", tree: str = "source",
             tampered: Callable[[dict[str, Column]], list[Column]] | None = None, levels: int = LEVELS, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """``key``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, and the check of a possibly changed row
    against its original siblings: ``folded_root`` and ``verified``. ``tampered``: maps the columns of a row
    to the fields as they are found at the check (none: as they are)."""
    prepare(docs.sparkSession)
    columns = {f: F.col(f) for f in fields}
    # an order of its own for the null source: it comes before the empty one
    name = F.when(F.col(tree).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(tree).cast("string")))
    rows = docs.select(F.col(key).alias("key"), name.alias("tree"), leaf(list(columns.values())).alias("node"),
                       (leaf(tampered(columns)) if tampered else F.lit(None).cast("string")).alias("found"))
    kind = rows.schema["key"].dataType
    foot = positions(rows.withColumn("found", F.nullif("found", "node")), "tree", ["key", "node"], partition_rows)
    foot = foot.withColumn("key", F.col("key").cast("string"))        # pandas has no null integers
    below = tiers(foot.select("tree", "place", "count", "node"), levels)
    subroots = below[-1].select("tree", "node") if len(below) > 1 else foot.select("tree", "node")
    upper = subroots.select(F.lit("").alias("all"), "tree", "node")
    upper = positions(upper, "all", ["tree"], partition_rows).select(F.col("all").alias("tree"), "place", "count", "node", F.col("tree").alias("source"))
    above = tiers(upper.select("tree", "place", "count", "node"), levels)

    def ends(group: pd.DataFrame, paths: list, top: str) -> pd.DataFrame:
        return pd.DataFrame({"tree": group["source"], "subroot": group["node"], "rank": group["place"], "root": top, "upper": paths})

    roots = _exchange(upper, paths_down(above, levels), 0, levels, ends, "tree string, subroot string, rank long, root string, upper array<array<string>>")
    roots = staged(roots, "subroots")
    # each superblock at the foot gets its outer siblings: inside of its source, then on the way to the root
    outer = paths_down(below, levels).select("tree", "block", "outer")
    blocks = _blocks(foot, levels).select("tree", "block").distinct()
    outer = blocks.join(outer, ["tree", "block"], "left").join(roots, "tree").select(
        "tree", "block", F.coalesce("outer", F.array().cast("array<array<string>>")).alias("outer"), "subroot", "rank", "root", "upper")
    outer = staged(outer, "outer")

    def run(key_: tuple, group: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        group, o = group.sort_values("place"), around.iloc[0]
        nodes = group["node"].tolist()
        tree_ = reduction(nodes, _local_levels(int(group["count"].iloc[0]), 0, levels))
        far, up = ([[str(x) for x in level] for level in o[c]] for c in ("outer", "upper"))
        proofs, folded = [], []
        for i, (place, node, found) in enumerate(zip(group["place"].tolist(), nodes, group["found"].tolist())):
            inside = _siblings(tree_, i) + far
            proofs.append(_node([s for level in inside + up for s in level]))
            folded.append(fold(fold(found if isinstance(found, str) else node, place, inside), int(o["rank"]), up))
        return pd.DataFrame({"key": group["key"], "leaf": nodes, "subroot": o["subroot"], "root": o["root"], "proof_sha256": proofs, "folded_root": folded})

    made = _blocks(foot, levels).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(
        run, "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return made.select(F.col("key").cast(kind).alias(key), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
