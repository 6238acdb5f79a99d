"""Stored donors of the neighbour search (I4, S5): the values of a fitted
table in sorted blocks, with a tree of block bounds above them.

* ``blocks``: a row for each ``BLOCK`` donor values of a (target, ordinal), in order: the
  values, and for each the k smallest donor ids with their targets; a folder
  for each ``PART_BLOCKS`` of them.
* ``nodes``: level by level, the least value of each block (or node) below; a
  node has at most ``BLOCK`` of them.
* ``extras``: for each (target, ordinal) the k smallest ids of all donors and
  of those that lack the other coordinate.

New keys go down the tree by one equi-join a level (the number of levels is
log base ``BLOCK`` of the values) and then read their own block and, at its edges, a
neighbour, from the folders that hold them: the folders' numbers are known before
the blocks are read, and the others are pruned. Nothing of the stored table is
sorted or ranked for a lookup, and only distinct keys are looked up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firmscope.operators.stats import bounded_broadcast
from firmscope.session import cut_lineage

#: Values of a block, and children of a node.
BLOCK = 512
#: Blocks of a folder (about 200 MB); folders up to which a lookup names those it reads.
PART_BLOCKS, NAMED_PARTS = 4096, 5_000
#: Nodes of a level (4 kB each) up to which it is broadcast.
BROADCAST_NODES = 5_000

TABLES = ("blocks", "nodes", "extras")


@dataclass
class DonorIndex:
    blocks: DataFrame  # tgt, g, block, keys, donors, part
    nodes: DataFrame  # tgt, g, level, node, los
    extras: DataFrame  # tgt, g, lacking, donors
    depth: int


def build(ranked: DataFrame, extras: DataFrame) -> DonorIndex:
    """From donor values (tgt, g, vrank, key, donors), ranked from 1 within (tgt, g)."""
    at = F.floor((F.col("vrank") - 1) / BLOCK).cast("long")
    held = ranked.groupBy("tgt", "g", at.alias("block")).agg(F.array_sort(F.collect_list(F.struct("key", "vrank", "donors"))).alias("v"))
    rows = held.select("tgt", "g", "block", F.col("v.key").alias("keys"), F.col("v.donors").alias("donors"), part_of(F.col("block")).alias("part"))
    # each folder is written by few tasks
    blocks = cut_lineage(rows.repartition("part", "tgt", "g"), "donor-blocks", partition_by="part")
    last = blocks.agg(F.max("block")).first()[0] or 0
    below = blocks.select("tgt", "g", F.col("block").alias("node"), F.get("keys", F.lit(0)).alias("lo"))
    nodes, depth = None, 0
    while last > 0:
        depth, last = depth + 1, last // BLOCK
        above = below.groupBy("tgt", "g", F.floor(F.col("node") / BLOCK).cast("long").alias("node")).agg(F.array_sort(F.collect_list(F.struct("node", "lo"))).alias("v"))
        level = cut_lineage(above.select("tgt", "g", F.lit(depth).alias("level"), "node", F.col("v.lo").alias("los")), "donor-nodes")
        nodes = level if nodes is None else nodes.unionByName(level)
        below = level.select("tgt", "g", "node", F.get("los", F.lit(0)).alias("lo"))
    if nodes is None:
        nodes = blocks.sparkSession.createDataFrame([], "tgt string, g double, level int, node bigint, los array<double>")
    return DonorIndex(blocks, nodes, extras, depth)


def part_of(block):
    return F.floor(block / PART_BLOCKS).cast("long")


def _named_parts(index: DonorIndex, here: DataFrame) -> DataFrame:
    """The blocks in the folders of the keys' blocks and of the next ones."""
    near = F.explode(F.array(*[part_of(F.greatest(F.col("block") + d, F.lit(0))) for d in (-1, 0, 1)]))
    parts = [r["p"] for r in here.select(near.alias("p")).distinct().limit(NAMED_PARTS + 1).collect()]
    return index.blocks if len(parts) > NAMED_PARTS else index.blocks.filter(F.col("part").isin(parts))


def _upto(values, key):
    """How many of an ordered array (a column, of at most ``BLOCK`` values) are not greater, by halving."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(BLOCK.bit_length()))])
    # beyond the end there is no value, and no step is taken
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(values, n + step - 1) <= key, n + step).otherwise(n))


def near_values(index: DonorIndex, asked: DataFrame, k: int) -> DataFrame:
    """``asked`` (tgt, g, rkey and more) beside the stored values around each
    key: at least the k nearest on either side, as columns key and donors."""
    here = asked.withColumn("block", F.lit(0).cast("long"))
    for level in range(index.depth, 0, -1):
        nodes = bounded_broadcast(index.nodes.filter(F.col("level") == level).select("tgt", "g", F.col("node").alias("block"), "los"), BROADCAST_NODES)
        here = here.join(nodes, ["tgt", "g", "block"]).withColumn("block", F.col("block") * BLOCK + F.greatest(_upto(F.col("los"), F.col("rkey")) - 1, F.lit(0))).drop("los")
    here = cut_lineage(here, "donor-places")  # read for the folders, then for the blocks
    blocks = _named_parts(index, here).select("tgt", "g", "block", "keys", F.arrays_zip("keys", "donors").alias("v"))
    own = here.join(blocks, ["tgt", "g", "block"]).withColumn("at", _upto(F.col("keys"), F.col("rkey")))
    # the k values up to the key and the k after it, as far as the block goes
    around = F.slice("v", F.greatest(F.col("at") - (k - 1), F.lit(1)), F.lit(2 * k))
    cols = [c for c in asked.columns]
    inside = own.select(*cols, around.alias("v"))
    ends = F.array_compact(F.array(F.when(F.col("at") < k, F.struct((F.col("block") - 1).alias("block"), F.lit(True).alias("tail"))),
                                   F.when(F.size("v") - F.col("at") < k, F.struct((F.col("block") + 1).alias("block"), F.lit(False).alias("tail")))))
    beside = own.select(*cols, F.inline(ends)).join(blocks, ["tgt", "g", "block"]).select(
        *cols, F.when(F.col("tail"), F.slice("v", F.greatest(F.size("v") - (k - 1), F.lit(1)), F.lit(k))).otherwise(F.slice("v", 1, k)).alias("v"))
    return inside.unionByName(beside).select(*cols, F.inline("v")).withColumnRenamed("keys", "key")


def nearest(candidates: DataFrame, by: list, k: int) -> DataFrame:
    """The k candidates (id, t, d2) of each key by (d2, id), ranked in ``_rk``."""
    w = Window.partitionBy(*by).orderBy("d2", "id")
    return candidates.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= k)
