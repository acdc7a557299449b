"""Hash trees over corpora: which notes differ between two is found by walking down the branches that differ.

A row belongs to the leaf named by the first hexadecimal digits of its key's SHA-256, so leaves are of like sizes whatever the
keys. A leaf's hash folds its rows' hashes in order of their keys, a branch's the hashes of its children in order of their names.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Rows of a leaf, about.
LEAF_ROWS = 1000


def depth_for(rows: int) -> int:
    """The depth at which leaves have LEAF_ROWS rows or fewer on average."""
    return max(1, ceil(log(max(rows, 1) / LEAF_ROWS, 16))) if rows > LEAF_ROWS else 1


def leaf_name(key: Column, depth: int) -> Column:
    return F.substring(F.sha2(key.cast("string").cast("binary"), 256), 1, depth)


def hashed_rows(rows: DataFrame, key: str, text: str, depth: int) -> DataFrame:
    """key, its leaf, and the hash of the row's text; null and empty texts differ."""
    said = F.sha2(F.concat(F.when(F.col(text).isNull(), "n").otherwise("t"), F.coalesce(F.col(text), F.lit(""))).cast("binary"), 256)
    return rows.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), leaf_name(F.col(key), depth).alias("leaf"), said.alias("hash"))


def merkle_tree(rows: DataFrame, key: str = "doc_id", text: str = "text", depth: int | None = None) -> DataFrame:
    """Every node of the tree: depth (0 is the root), name, hash and rows.

    Rows without a key are left out, repeated keys all count; an empty table has no nodes. Trees of one depth can be
    compared; by default it follows from the number of rows. A task gathers one leaf's hashes, or one branch's 16.
    """
    depth = depth or depth_for(rows.count())
    said = F.concat_ws("\x00", "key", "hash")
    level = hashed_rows(rows, key, text, depth).groupBy(F.col("leaf").alias("name")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(said)), "\n").cast("binary"), 256).alias("hash"), F.count("*").alias("rows"))
    level = nodes = materialize(level.select(F.lit(depth).alias("depth"), "name", "hash", "rows"), "merkle")
    for d in range(depth - 1, -1, -1):
        child = F.array_sort(F.collect_list(F.concat_ws(":", "name", "hash")))
        level = level.groupBy(F.substring("name", 1, d).alias("up")).agg(F.sha2(F.array_join(child, "\n").cast("binary"), 256).alias("hash"), F.sum("rows").alias("rows")).select(F.lit(d).alias("depth"), F.col("up").alias("name"), "hash", "rows")
        nodes = nodes.union(level)
    return nodes


def differing_leaves(old: DataFrame, new: DataFrame) -> DataFrame:
    """Names of the leaves under branches that differ: trees are walked from the root, and what hangs under equal hashes is
    not looked at. Trees of different depths can't be compared."""
    depths = [t.agg(F.max("depth")).first()[0] for t in (old, new)]
    if None not in depths and depths[0] != depths[1]:
        raise ValueError(f"trees of depth {depths[0]} and {depths[1]}")
    open_ = None
    for d in range((depths[0] if depths[0] is not None else depths[1]) + 1 if depths != [None, None] else 0):
        a, b = (t.filter(F.col("depth") == d).select("name", F.col("hash").alias(h)) for t, h in ((old, "h0"), (new, "h1")))
        if open_ is not None:
            under = open_.select(F.col("name").alias("up"))
            a, b = (t.join(under, F.substring("name", 1, d - 1) == F.col("up"), "left_semi") for t in (a, b))
        open_ = materialize(a.join(b, "name", "full_outer").filter(~F.col("h0").eqNullSafe(F.col("h1"))).select("name"), "merkle-open")
    return open_ if open_ is not None else old.select("name").limit(0)


def changed_keys(old: DataFrame, new: DataFrame, key: str = "doc_id", text: str = "text", trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """key (as text) and change: added, removed or changed, of the keys whose texts differ between two corpora.

    Of the rows only those of leaves that differ are compared. trees: those of old and new, made by merkle_tree with one
    depth, if they are there already. Of repeated keys the texts are compared as sets with their counts.
    """
    if trees is None:
        depth = depth_for(max(old.count(), new.count()))
        trees = merkle_tree(old, key, text, depth), merkle_tree(new, key, text, depth)
    depth = next((n for n in (t.agg(F.max("depth")).first()[0] for t in trees) if n is not None), 1)
    open_ = differing_leaves(*trees).withColumnRenamed("name", "leaf")
    per = [hashed_rows(r, key, text, depth).join(open_, "leaf", "left_semi").groupBy("key").agg(F.array_sort(F.collect_list("hash")).alias(h)) for r, h in ((old, "h0"), (new, "h1"))]
    both = per[0].join(per[1], "key", "full_outer").filter(~F.col("h0").eqNullSafe(F.col("h1")))
    return both.select("key", F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").otherwise("changed").alias("change"))
