"""Connected components and chained similarity transforms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framespan.functions import columns as C
from framespan.operators.joins import attach, shuffled
from framespan.operators.ranking import ranked
from framespan.session import cut


#: Edges of one node that one task joins; a node with more is a hub.
HUB_EDGES = 1_000_000


def _deal_hubs(edges: DataFrame, least: DataFrame, hub_edges: int) -> tuple[DataFrame, DataFrame]:
    """Deal the edges (u, v) of hubs over sub-keys ``_salt`` of about ``hub_edges`` edges; hubs of ``least`` are copied to theirs.

    There are at most edges / ``hub_edges`` hubs. Nodes that are none have the sub-key 0 only.
    """
    dealt = least.withColumn("_salts", F.ceil(F.col("_n") / hub_edges).cast("int"))
    hubs = dealt.where("_salts > 1").select("u", "_salts")
    marked = attach(edges, hubs, ["u"], how="left")
    own = F.coalesce(F.pmod(F.xxhash64("v"), F.col("_salts")), F.lit(0)).cast("int")
    copies = dealt.select("u", "_m", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    return marked.select("u", "v", own.alias("_salt")), copies


def _with_smallest(edges: DataFrame, hub_edges: int) -> DataFrame:
    """Attach to each row (u, v) the smallest neighbour ``_m`` of u."""
    least = cut(edges.groupBy("u").agg(F.min("v").alias("_m"), F.count(F.lit(1)).alias("_n")))
    if least.where(F.col("_n") > hub_edges).isEmpty():
        return edges.join(least.drop("_n"), "u")
    dealt, copies = _deal_hubs(edges, least, hub_edges)
    return dealt.join(shuffled(copies), ["u", "_salt"]).drop("_salt")


def _large_star(edges: DataFrame, hub_edges: int) -> DataFrame:
    """Connect every larger neighbour of u to the smallest node around u."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    joined = _with_smallest(both, hub_edges)
    root = F.least("_m", "u")
    return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), root.alias("b")).distinct()


def _small_star(edges: DataFrame, hub_edges: int) -> DataFrame:
    """Connect u and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v")
    joined = _with_smallest(down, hub_edges)
    out = joined.select(F.explode(F.array("u", "v")).alias("a"), F.col("_m").alias("b"))
    return out.where("a > b").distinct()


def components(edges: DataFrame, nodes: DataFrame | None = None, a: str = "a", b: str = "b", hub_edges: int = HUB_EDGES) -> DataFrame:
    """(node, component): component is the smallest node id reachable from the node.

    Alternates the two star operations until the edge set stops changing (logarithmically many
    rounds, hub nodes included). Each round only aggregates and joins on node ids; the edges of a node
    with more than ``hub_edges`` are dealt over sub-keys, so no task joins a whole star. The edge set is
    written to the checkpoint folder, once between the two operations. ``nodes`` (column ``node``) adds isolated nodes.
    """
    named = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    seen = named.select(F.col("a").alias("node")).unionByName(named.select(F.col("b").alias("node")))
    if nodes is not None:
        seen = seen.unionByName(nodes.select("node"))
    work = cut(named.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def fingerprint(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = fingerprint(work)
    while True:
        work = cut(_small_star(cut(_large_star(work, hub_edges)), hub_edges))
        after = fingerprint(work)
        if after == before:
            break
        before = after
    return (
        seen.distinct()
        .join(work.select(F.col("a").alias("node"), F.col("b").alias("_root")), "node", "left")
        .select("node", F.coalesce("_root", "node").alias("component"))
    )


# --- similarity chains -----------------------------------------------------------------------

CHAIN_BLOCK = 512


def _fold(items: Column) -> Column:
    return F.aggregate(items, C.sim3_identity(), lambda acc, x: C.sim3_compose(acc, x["_row"]["sim3"]))


def accumulate_sim3(df: DataFrame, by: Sequence[str] = ("scene",), order: str = "window_id", block: int = CHAIN_BLOCK) -> DataFrame:
    """Prefix products of the ``sim3`` column in ``order``: adds ``total``.

    A scene may have any number of windows, so products are taken in blocks: first inside blocks of
    ``block`` consecutive windows, then over the block totals (recursively), then combined.
    """
    by = list(by)
    keyed = df.where(reduce(and_, [F.col(b).isNotNull() for b in by], F.lit(True)))
    placed = cut(ranked(keyed, by, [F.col(order)], "_place").withColumn("_place", F.col("_place") - 1))
    return _prefix(placed, by, block).drop("_place")


def _prefix(df: DataFrame, by: list[str], block: int) -> DataFrame:
    longest = df.agg(F.max("_place")).first()[0]
    rest = [c for c in df.columns if c not in by and c != "_place"]
    blocked = df.withColumn("_blk", F.floor(F.col("_place") / block))
    # a block carries its rows along, so totals need no join back to them; places differ, so they alone order a block
    item = F.struct("_place", F.struct(*rest).alias("_row"))
    packed = blocked.groupBy(*by, "_blk").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    if longest is None or longest < block:
        offsets = packed.withColumn("_before", C.sim3_identity())
    else:
        totals = packed.select(*by, F.col("_blk").alias("_place"), _fold(F.col("_items")).alias("sim3"))
        upper = _prefix(totals, by, block)
        shifted = upper.select(*by, (F.col("_place") + 1).alias("_blk"), F.col("total").alias("_before"))
        offsets = packed.join(shifted, [*by, "_blk"], "left").withColumn(
            "_before", F.coalesce("_before", C.sim3_identity())
        )

    def step(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.array(C.sim3_compose(F.element_at(acc, -1), x["_row"]["sim3"])))

    totals = F.aggregate("_items", F.array("_before"), step)
    chained = offsets.select(*by, "_items", totals.alias("_totals")).select(*by, F.posexplode("_items").alias("_at", "_item"), "_totals")
    return chained.select(*by, "_item._row.*", F.col("_item._place").alias("_place"), F.col("_totals")[F.col("_at") + 1].alias("total"))


def to_absolute(df: DataFrame, by: Sequence[str] = ("scene",), order: str = "node") -> DataFrame:
    """Absolute transforms T0 = I, T1 = S01, T2 = S01·S12, ... from relative ones.

    Row ``node = k`` of the input is the step from node k to k+1; the result has one row more.
    """
    by = list(by)
    steps = accumulate_sim3(df, by, order).select(*by, (F.col(order) + 1).cast("long").alias(order), F.col("total").alias("sim3"))
    first = df.groupBy(*by).agg(F.min(order).cast("long").alias(order)).withColumn("sim3", C.sim3_identity())
    return first.unionByName(steps)


def to_relative(df: DataFrame, by: Sequence[str] = ("scene",), order: str = "node") -> DataFrame:
    """Steps between consecutive absolute transforms: inverse(T_k)·T_{k+1}, keyed by k."""
    by = list(by)
    nxt = df.select(*by, (F.col(order) - 1).alias(order), F.col("sim3").alias("_next"))
    return df.join(shuffled(nxt), [*by, order]).select(
        *by, order, C.sim3_compose(C.sim3_inverse("sim3"), F.col("_next")).alias("sim3")
    )
