"""Merkle manifest of a dataset: a hash per row, a tree per group of rows, and a tree over the groups.

Rows of a group are put in order and numbered; every `fanout` consecutive nodes become their hash, until one
is left. Each level is a window over the nodes: `lag` and `lead` at fixed offsets, masked by a node's slot in
its run and by the run's length, supply its siblings, and the first child of each run hashes the parent.
Levels are computed inside blocks of `fanout ** levels` consecutive rows, then inside blocks of blocks, so no
window holds a group, and a group of any share of the rows is spread over the tasks.

Defined results: a null value of a hashed column counts as `-`, an empty one as `0:`. A null group is a group
of its own, before all others; rows with a null order column come first in their group. Rows equal in the order
columns are ordered by their hash; equal rows get places one after another, in no set order, and so different
proofs of the same root. A group of one row has that row's hash as its root, and an empty table gives no rows.
Only the columns named are read, so others may bear any name.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import kept

FANOUT = 2
#: A block has FANOUT ** LEVELS rows.
LEVELS = 10
#: One step of a proof: the hashes of a node's siblings before and after it, joined.
STEP = "array<struct<left:string,right:string>>"


def row_hash(*columns) -> Column:
    """sha256 of the columns, each `-` if null, else its length in bytes, `:` and its text."""
    def field(c) -> Column:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def fold(leaf, proof="proof") -> Column:
    """The root that a row's hash and its proof lead to."""
    up = lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256)
    return F.aggregate(proof, F.col(leaf) if isinstance(leaf, str) else leaf, up)


def proof_text(proof="proof") -> Column:
    """All siblings of a proof, level by level and left to right, joined."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(
    rows: DataFrame, columns: list[str], group: str, order: list[str], carry: dict[str, Column] | None = None,
    fanout: int = FANOUT, levels: int = LEVELS,
) -> DataFrame:
    """(order columns, carried columns, `leaf`, `subroot`, `root`, `proof`) of every row.

    `carry` names expressions over `rows` to be kept. `proof` leads from `leaf` over `subroot` to `root`.
    """
    carry = carry or {}
    named = rows.select(
        F.struct(F.col(group).alias("of")).alias("_of"), row_hash(*columns).alias("_node"),
        F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]).alias("_by"),
        F.struct(F.lit(0).alias("_"), *[e.alias(name) for name, e in carry.items()]).alias("_carry"),
    )
    by_order = [f"_by.o{i}" for i in range(len(order))]
    # Written before they are sorted: finding the ranges would read and hash the texts a second time.
    leaves, high = _numbered(kept(named, "rows"), ["_of.of"], [*by_order, "_node"])
    found, subroots = _climb(leaves, high, fanout, levels)
    # The groups' roots are the leaves of one more tree.
    tops = subroots.select(F.struct(F.lit(0).alias("of")).alias("_of"), "_node", F.col("_of").alias("_group"))
    tops, high = _numbered(tops, ["_of.of"], ["_group.of"])
    tops, _ = _climb(tops, high, fanout, levels)
    tops = kept(tops.select(F.col("_group").alias("_of"), F.col("_proof").alias("_more"), F.col("_root").alias("root")), "tops")
    return found.join(tops, "_of").select(
        *[F.col(f"_by.o{i}").alias(c) for i, c in enumerate(order)], *[F.col(f"_carry.{c}").alias(c) for c in carry],
        F.col("_node").alias("leaf"), F.col("_root").alias("subroot"), "root",
        F.concat("_proof", "_more").cast(STEP).alias("proof"),
    )


def _numbered(rows: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, int]:
    """Rows with their place in the group (`_at`) and the group's size (`_n`); the size of the largest group.

    The table is sorted in ranges and written with range and place, which fixes both; ranges are added up.
    """
    by = [F.asc_nulls_first(c) for c in (*group, *order)]
    sorted_rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = sorted_rows.withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})
    placed = kept(placed, "leaves")
    sizes = placed.groupBy("_of", "_range").agg(F.count("*").alias("_size"), F.min("_place").alias("_first"))
    of = Window.partitionBy("_of")  # one row per range that holds some of the group
    before = of.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_of", "_range", F.sum("_size").over(of).alias("_n"),
                         (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    sizes = kept(sizes, "sizes")
    out = placed.join(sizes, ["_of", "_range"]).withColumn("_at", F.col("_place") + F.col("_shift"))
    return out.drop("_range", "_place", "_shift"), sizes.agg(F.max("_n")).first()[0] or 0


def _div(c: str | Column, n: int) -> Column:
    return F.call_function("div", F.col(c) if isinstance(c, str) else c, F.lit(n))


def _climb(nodes: DataFrame, high: int, fanout: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """Nodes with `_proof` up to their group's root and the `_root`; and one row (`_of`, `_node`) per group.

    `high` is the largest group's number of nodes.
    """
    if high <= 1:
        none = F.array().cast(STEP)
        return nodes.withColumns({"_proof": none, "_root": F.col("_node")}), nodes.select("_of", "_node")
    here = 1
    while here < levels and fanout**here < high:
        here += 1
    size = fanout**here
    rows = nodes.withColumns({"_block": _div("_at", size), "_h": F.col("_node")})
    block = Window.partitionBy("_of", "_block").orderBy("_at")
    for level in range(here):
        rows = _level(rows, block, level, fanout)
    tops = rows.where(F.col("_at") % size == 0).select(
        "_of", F.col("_block").alias("_at"), _div(F.col("_n") + (size - 1), size).alias("_n"), F.col("_h").alias("_node"))
    tops, roots = _climb(kept(tops, "tops"), -(-high // size), fanout, levels)
    tops = tops.select("_of", F.col("_at").alias("_block"), F.col("_proof").alias("_above"), "_root")
    # A node's siblings stand at its first row; rows after it read them there.
    so_far = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = [F.last(f"_s{level}", ignorenulls=True).over(so_far) for level in range(here)]
    rows = rows.select(*nodes.columns, "_block", F.array(*steps).alias("_steps"))
    live = F.filter("_steps", lambda s: s["live"])
    own = F.transform(live, lambda s: F.struct(s["left"].alias("left"), s["right"].alias("right")))
    out = rows.join(kept(tops, "above"), ["_of", "_block"]).withColumn("_proof", F.concat(own, "_above").cast(STEP))
    return out.drop("_steps", "_above", "_block"), roots


def _level(rows: DataFrame, block, level: int, fanout: int) -> DataFrame:
    """One level: `_s{level}` at the first row of each node, and `_h` the parent's hash at its first row.

    A group that is down to one node is live no more and keeps its hash.
    """
    step = fanout**level
    number, count = _div("_at", step), _div(F.col("_n") + (step - 1), step)
    slot = number % fanout
    run = F.least(F.lit(fanout), count - number + slot)
    around = {f"_{way}{d}": fn("_h", d * step).over(block)
              for d in range(1, fanout) for way, fn in (("lag", F.lag), ("lead", F.lead))}
    rows = rows.withColumns(around)
    none = F.lit("")
    before = [F.when(slot >= d, F.col(f"_lag{d}")).otherwise(none) for d in range(fanout - 1, 0, -1)]
    after = [F.when(slot + d < run, F.col(f"_lead{d}")).otherwise(none) for d in range(1, fanout)]
    live, first = count > 1, F.col("_at") % step == 0
    sibling = F.struct(live.alias("live"), F.concat(*before).alias("left"), F.concat(*after).alias("right"))
    parent = F.when(live, F.sha2(F.concat("_h", *after), 256)).otherwise(F.col("_h"))
    rows = rows.withColumns({
        f"_s{level}": F.when(first, sibling), "_h": F.when(F.col("_at") % (step * fanout) == 0, parent),
    })
    return rows.drop(*around)

