"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

A tree has regions, regions have racks, racks have shards; the weight of a node is
the sum of its shards' weights.  A row descends from the root: at each level
every child draws ``-ln(u) / weight`` with ``u`` hashed from the row's key and the
child's name, and the smallest draw wins.  A child is chosen with a chance in
proportion to its weight.  Draws of nodes whose weights stay are unchanged, so a
change moves rows only into or out of the subtrees whose weights change.

``layout(n)`` has ``REGIONS x RACKS x SHARDS`` shards; each shard beyond those is a
region of its own.  So one more shard leaves all other weights as they are and
takes rows only into itself, at every ``n`` from the base layout up.

Defined results.  A null text has no bytes (size 8).  A null id is the smallest
id.  Rows with the same id share a shard and have slots of their own; slots of repeated rows are
numbered in blocks of bounded size too.  Ties of draws go to the first child.  Of a very long text only size and
checksum go on.  An empty table gives an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, lift, materialize, ranked, whole

REGIONS, RACKS, SHARDS = 2, 3, 4

#: Weight of each shard, by region and rack.
Tree = list[list[list[float]]]


def layout(n: int) -> Tree:
    """The tree for ``n`` shards of weight 1, which are numbered in its order."""
    tree: Tree = []
    left = min(n, REGIONS * RACKS * SHARDS)
    while left > 0:
        here = min(left, RACKS * SHARDS)
        left -= here
        tree.append([[1.0] * min(SHARDS, here - k) for k in range(0, here, SHARDS)])
    return tree + [[[1.0]] for _ in range(n - REGIONS * RACKS * SHARDS)]


def _draw(key: Column, name: list[Column | str], weight: Column) -> Column:
    h = F.xxhash64(*[F.lit(x) if isinstance(x, str) else x for x in name], key)
    u = (F.shiftrightunsigned(h, 11) + 1).cast("double") / F.lit(float(2**53 + 1))
    return F.when(weight > 0, -F.log(u) / weight)


def _choose(draws: list[Column]) -> Column:
    """Place of the smallest draw that isn't null; ties go to the first."""
    struct = F.array(*[F.struct(F.isnull(d).alias("none"), d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(draws)])
    return F.array_min(struct)["i"]


def assign(key: Column, tree: Tree) -> Column:
    """The number of the shard that ``key`` descends to."""
    racks, shards = max(len(r) for r in tree), max(len(k) for r in tree for k in r)
    pad = lambda xs, n: [*xs, *[0.0] * (n - len(xs))]
    rack_weights = [w for r in tree for w in pad([sum(k) for k in r], racks)]
    shard_weights = [w for r in tree for k in [*r, *[[]] * (racks - len(r))] for w in pad(k, shards)]
    first, at = [], 0
    for r in tree:
        for k in [*r, *[[]] * (racks - len(r))]:
            first.append(at)
            at += len(k)
    table = lambda xs, kind: F.array(*[F.lit(x).cast(kind) for x in xs])
    region = _choose([_draw(key, ["region", F.lit(i)], F.lit(float(sum(map(sum, r))))) for i, r in enumerate(tree)])
    rack = lambda reg: _choose([_draw(key, ["rack", reg, F.lit(j)], F.get(table(rack_weights, "double"), reg * racks + j)) for j in range(racks)])
    # region and rack are bound one after the other, so that each is drawn once
    leaf = lambda node: F.get(table(first, "int"), node) + _choose(
        [_draw(key, ["shard", node, F.lit(j)], F.get(table(shard_weights, "double"), node * shards + j)) for j in range(shards)]
    )
    nodes = F.transform(F.array(region), lambda reg: reg * racks + rack(reg))
    return F.get(F.transform(nodes, leaf), 0)


def shard_rows(docs: DataFrame, n: int = 24, id_col: str = "doc_id", text_col: str = "text", tree: Tree | None = None, grown: Tree | None = None) -> DataFrame:
    """``id, size, text_crc32, shard, grown_shard, slot`` of each row."""
    text = whole(text_col)
    size = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.octet_length(text)) + 8
    d = docs.select(lift(id_col).alias("id"), size.cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    d = d.withColumns({"shard": assign(F.col("id"), tree or layout(n)), "grown_shard": assign(F.col("id"), grown or layout(n + 1))})
    d = materialize(d)
    spread = F.xxhash64(F.lit("slot"), "id", "text_crc32", "size")
    out = ranked(d, ["shard"], spread, [F.col("id"), F.col("text_crc32"), F.col("size")], d.count(), n)
    return out.withColumnRenamed("rank", "slot")


def shard_report(docs: DataFrame, n: int = 24) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of each document."""
    s = shard_rows(docs, n)
    return s.select(
        give_back(F.col("id")).alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"),
        F.col("shard").cast("int").alias("shard"), "slot", F.col("grown_shard").cast("int").alias("grown_shard"),
    )
