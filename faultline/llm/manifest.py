"""A Merkle manifest of a table, with nested-interval labels.

Rows become leaves: the digest of their fields.  The leaves of a group, in key
order, are numbered by one dense rank over the table, so a group is an interval
of ranks and every node above carries the interval ``[lo, hi)`` of the leaves
that it covers.  ``fanout`` consecutive nodes become one until a group has one
node left, its subroot; the subroots, in group order, become the root likewise.

* A node's parent is the node of the next level whose interval contains its
  own.  All intervals of a level but a group's last have the same width, so the
  start of the parent's interval is the bucket of an equi-join on that level,
  and containment is checked behind it.
* Siblings are what the parent's interval holds beside the node's own: parts
  that end at or before its start, and parts that start at or after its end.
* Paths are attached from the root down, one join a level; a level has an
  eighth of the rows of the one below, and leaves are joined once.

Ranks come from a range-partitioned sort of narrow rows (group, key, digests);
a run has at most ``fanout`` nodes, whatever the group's size, so a group with
a third of all rows is dealt out like any other.  One row per level (its
largest group) and the root reach the driver.

Edge cases: null groups come first and are one group, null keys come first in
their group; rows that repeat a key are ordered by digest, and rows equal in
all of that are alike; a null field counts as ``-``, an empty one as ``0:``; a
group of one row is its own subroot, a table of one group has its subroot as
root; an empty table has no rows and no root (None); columns that are not named
are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.sets import index_items
from faultline.session import join_small, measured_bytes

from .common import checkpointed

FANOUT = 8
_NO_PATH = "cast(array() as array<struct<left:string,right:string>>)"


def field(col: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = col.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*cols: Column) -> Column:
    """Lowercase hex sha256 of the strings, one after another."""
    return F.sha2(F.concat(*cols), 256)


def leaf_digest(*cols: Column) -> Column:
    return digest(*map(field, cols))


@dataclass
class Manifest:
    """``levels[l]``: the nodes of level ``l`` within their groups (``s, e`` the
    group's interval, ``lo, hi`` the node's, ``digest``; from level 1 on
    ``kids``; level 0 also ``group, key, claimed``).  ``top``: the same over
    the subroots, whose intervals count groups."""
    levels: list[DataFrame]
    top: list[DataFrame]
    root: str | None
    fanout: int

    def nodes(self) -> DataFrame:
        """``(tree, level, lo, hi, digest)`` of every node: ``groups`` over leaf ranks, ``top`` over group ranks."""
        out = None
        for tree, levels in (("groups", self.levels), ("top", self.top)):
            for i, level in enumerate(levels):
                rows = level.select(F.lit(tree).alias("tree"), F.lit(i).alias("level"), "lo", "hi", "digest")
                out = rows if out is None else out.unionByName(rows)
        return out

    def proofs(self) -> DataFrame:
        """``(group, key, leaf, claimed, subroot, path)`` of every leaf.  ``path``
        has, level by level up to the root, the digests of the siblings before
        and after the node, strung together (``left``, ``right``)."""
        top = self.top[0].withColumnRenamed("at", "start")
        above = _paths([top, *self.top[1:]], None, self.fanout).select("start", F.col("digest").alias("subroot"), "path")
        rows = _paths(self.levels, checkpointed(above), self.fanout)
        return rows.select("group", "key", F.col("digest").alias("leaf"), "claimed", "subroot", "path")


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf digest and its siblings lead to."""
    return F.aggregate(path, leaf, lambda h, p: digest(p["left"], h, p["right"]))


def _bucket(width: int) -> Column:
    """Start of the interval of ``width`` leaves that holds a node."""
    return F.expr(f"s + ((lo - s) DIV {width}L) * {width}L")


def _climb(leaves: DataFrame, fanout: int) -> list[DataFrame]:
    """The levels above ``leaves`` (``s, e, lo, hi, digest``), which are the first."""
    longest = leaves.agg(F.max(F.col("e") - F.col("s"))).first()[0] or 0
    levels, width = [leaves], 1
    while width < longest:
        nodes = levels[-1].where(F.col("e") - F.col("s") > width)
        width *= fanout
        runs = nodes.groupBy("s", "e", _bucket(width).alias("start")).agg(
            F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("kids"))
        levels.append(checkpointed(runs.select(
            "s", "e", F.col("start").alias("lo"), F.array_max("kids.hi").alias("hi"),
            F.sha2(F.array_join("kids.digest", ""), 256).alias("digest"), "kids")))
    return levels


def _paths(levels: list[DataFrame], above: DataFrame | None, fanout: int) -> DataFrame:
    """The leaves with ``path`` and ``subroot``.  ``above`` has what the node of
    a whole group continues with: ``(start, subroot, path)``; None: nothing."""
    parents = None
    for depth in range(len(levels) - 1, -1, -1):
        nodes, width = levels[depth], fanout ** depth
        whole = nodes.where(F.col("e") - F.col("s") <= width)
        if above is None:
            whole = whole.withColumns({"subroot": F.lit(None).cast("string"), "path": F.expr(_NO_PATH)})
        else:
            whole = whole.join(above.withColumnRenamed("start", "s"), "s")
        if parents is None:
            parents = whole
            continue
        up = parents.select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("kids").alias("_kids"), "subroot", F.col("path").alias("_path"))
        rest = nodes.where(F.col("e") - F.col("s") > width).withColumn("_lo", _bucket(width * fanout))
        rest = rest.join(up, "_lo").where("lo >= _lo AND hi <= _hi")
        digests = lambda keep: F.array_join(F.transform(F.filter("_kids", keep), lambda k: k["digest"]), "")
        beside = F.struct(digests(lambda k: k["hi"] <= F.col("lo")).alias("left"), digests(lambda k: k["lo"] >= F.col("hi")).alias("right"))
        rest = rest.withColumn("path", F.concat(F.array(beside), "_path"))
        parents = whole.unionByName(rest.select(*whole.columns))
    return parents


def build(rows: DataFrame, fields: list[str], group: str, key: str, claimed: Column | None = None, fanout: int = FANOUT) -> Manifest:
    """The manifest of ``rows``.  ``claimed`` is a digest of a row to be held
    against the manifest (see ``Manifest.proofs``); the leaf itself if None."""
    leaf = leaf_digest(*map(F.col, fields))
    # digests are computed in one pass; repeats of a row are told apart by their place, so that the sort can split them
    narrow = checkpointed(rows.select(F.col(group).alias("group"), F.col(key).alias("key"), leaf.alias("digest"),
                                      (leaf if claimed is None else claimed).alias("claimed"))
                          .withColumn("place", F.monotonically_increasing_id()))
    ranked = index_items(narrow, ["group", "key", "digest", "claimed", "place"]).frame.withColumn("g", F.struct("group"))
    groups = checkpointed(ranked.groupBy("g").agg(F.min("idx").alias("s"), (F.max("idx") + 1).alias("e")))
    leaves = join_small(ranked, groups, "g", "inner", measured_bytes(groups.select("g.*", "s", "e")))
    leaves = leaves.select("s", "e", F.col("idx").alias("lo"), (F.col("idx") + 1).alias("hi"), "digest", "group", "key", "claimed")
    levels = _climb(leaves, fanout)
    subroots = None
    for depth, nodes in enumerate(levels):
        some = nodes.where(F.col("e") - F.col("s") <= fanout ** depth).select("s", "digest")
        subroots = some if subroots is None else subroots.unionByName(some)
    ordered = index_items(checkpointed(subroots), ["s", "digest"])
    place = F.col("idx")
    first = ordered.frame.select(F.lit(0).cast("long").alias("_s"), F.lit(ordered.count).cast("long").alias("e"), place.alias("lo"),
                                 (place + 1).alias("hi"), "digest", F.col("s").alias("at")).withColumnRenamed("_s", "s")
    top = _climb(first, fanout)
    root = top[-1].where("lo = s AND hi = e").select("digest").first()
    return Manifest(levels, top, root[0] if root else None, fanout)
