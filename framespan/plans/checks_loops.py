"""Queries: descriptor similarity, loop pairs, chunk ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from framespan.operators import loops as L
from framespan.operators import similarity as SIM
from framespan.operators.windows import window_bounds
from framespan.plans.registry import descriptors, query, table

DESC_SQL = "d AS (SELECT vec_id AS frame_id, embedding::DOUBLE[] AS e FROM embeddings)"
TOPK_SQL = f"""{DESC_SQL},
sims AS (SELECT a.frame_id AS i, b.frame_id AS j, list_inner_product(a.e, b.e) AS sim FROM d a JOIN d b ON a.frame_id <> b.frame_id),
top AS (SELECT i, j, sim, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rank FROM sims QUALIFY rank <= 5)"""
THR = 0.25  # the given vectors are less alike than place descriptors
CAND_SQL = f"""{TOPK_SQL}, cand AS (
  SELECT least(i, j) AS i, greatest(i, j) AS j, max(sim) AS sim FROM top WHERE sim > {THR} AND abs(i - j) > 10 GROUP BY 1, 2)"""


def candidates(spark, sf):
    return L.loop_candidates(SIM.topk_similar(descriptors(spark, sf), 5), THR)


@query("topk_similar", f"WITH {TOPK_SQL} SELECT i, j, round(sim, 5) AS sim, rank FROM top")
def topk_similar(spark, sf):
    out = SIM.topk_similar(descriptors(spark, sf), 5)
    return out.select("i", "j", F.round("sim", 5).alias("sim"), "rank")


@query("loop_candidates", f"WITH {CAND_SQL} SELECT i, j, round(sim, 5) AS sim FROM cand")
def loop_candidates(spark, sf):
    return candidates(spark, sf).select("i", "j", F.round("sim", 5).alias("sim"))


@query(
    "nms_pairs",
    f"""WITH RECURSIVE {CAND_SQL},
ord AS (SELECT i, j, sim, row_number() OVER (ORDER BY sim DESC, i, j) AS r FROM cand),
walk AS (SELECT CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS ends, false AS picked
  UNION ALL
  SELECT o.r, CASE WHEN hit THEN w.ends ELSE list_concat(w.ends, [o.i, o.j]) END, NOT hit
  FROM (SELECT w.r AS pr, w.ends, o.r, o.i, o.j,
          len(list_filter(w.ends, lambda x: abs(x - o.i) <= 25 OR abs(x - o.j) <= 25)) > 0 AS hit
        FROM walk w JOIN ord o ON o.r = w.r + 1) w, LATERAL (SELECT w.r AS r, w.i AS i, w.j AS j) o)
SELECT o.j AS i, o.i AS j, round(o.sim, 5) AS sim FROM walk JOIN ord o ON o.r = walk.r WHERE picked""",
)
def nms_pairs(spark, sf):
    return L.nms_pairs(candidates(spark, sf), 25).select("i", "j", F.round("sim", 5).alias("sim"))


@query(
    "reduce_edges",
    """WITH RECURSIVE e AS (SELECT o_custkey % 20 AS scene, o_orderkey % 50 AS j0, o_custkey % 200 AS i0, o_totalprice / 300.0 AS cost, o_orderkey FROM orders),
v AS (SELECT scene, i0 AS i, i0 + 30 + j0 AS j, min(cost) AS cost FROM e WHERE cost < 1000 GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY scene, j ORDER BY cost, i) AS r FROM v),
w AS (SELECT scene, j, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS kept, false AS picked FROM (SELECT DISTINCT scene, j FROM o)
  UNION ALL
  SELECT o.scene, o.j, o.r, CASE WHEN len(list_filter(w.kept, lambda x: abs(x - o.i) <= 3)) > 0 THEN w.kept ELSE list_append(w.kept, o.i) END,
    len(list_filter(w.kept, lambda x: abs(x - o.i) <= 3)) = 0
  FROM w JOIN o ON o.scene = w.scene AND o.j = w.j AND o.r = w.r + 1),
k AS (SELECT o.scene, o.i, o.j, o.cost FROM w JOIN o ON o.scene = w.scene AND o.j = w.j AND o.r = w.r WHERE picked)
SELECT scene, i, j, round(cost, 6) AS cost FROM k QUALIFY row_number() OVER (PARTITION BY scene ORDER BY cost, i, j) <= 40""",
)
def reduce_edges(spark, sf):
    o = table(spark, sf, "orders")
    i = F.col("o_custkey") % 200
    e = o.select(
        (F.col("o_custkey") % 20).alias("scene"), i.alias("i"), (i + 30 + F.col("o_orderkey") % 50).alias("j"), (F.col("o_totalprice") / 300.0).alias("cost")
    )
    e = e.groupBy("scene", "i", "j").agg(F.min("cost").alias("cost"))
    return L.reduce_edges(e, 40, 3).withColumn("cost", F.round("cost", 6))


BOUNDS_SQL = """n AS (SELECT count(*) AS n FROM embeddings),
b AS (SELECT k AS chunk, k * 20 AS s, least(k * 20 + 30, n.n) AS e FROM n, LATERAL (SELECT unnest(generate_series(0, CAST(ceil((n.n - 10) / 20.0) AS BIGINT) - 1)) AS k))"""
RANGE_SQL = f"""{CAND_SQL}, {BOUNDS_SQL},
l AS (SELECT i, j, sim, (SELECT max(chunk) FROM b WHERE s <= i) AS ca, (SELECT max(chunk) FROM b WHERE s <= j) AS cb FROM cand),
f AS (SELECT l.i, l.j, l.sim, x.chunk AS chunk_a, x.s AS sa, x.e AS ea, y.chunk AS chunk_b, y.s AS sb, y.e AS eb
  FROM l JOIN b x ON x.chunk = l.ca AND l.i < x.e JOIN b y ON y.chunk = l.cb AND l.j < y.e),
rg AS (SELECT i, j, sim, chunk_a,
  CASE WHEN i - 8 < sa THEN sa WHEN i + 8 > ea THEN greatest(sa, ea - 16) ELSE i - 8 END AS start_a,
  CASE WHEN i - 8 < sa THEN least(ea, sa + 16) WHEN i + 8 > ea THEN ea ELSE i + 8 END AS end_a, chunk_b,
  CASE WHEN j - 8 < sb THEN sb WHEN j + 8 > eb THEN greatest(sb, eb - 16) ELSE j - 8 END AS start_b,
  CASE WHEN j - 8 < sb THEN least(eb, sb + 16) WHEN j + 8 > eb THEN eb ELSE j + 8 END AS end_b FROM f)"""


def ranges(spark, sf):
    bounds = window_bounds(descriptors(spark, sf), 30, 10)
    return L.loop_ranges(candidates(spark, sf), bounds, 8)[0]


@query("loop_ranges", f"WITH {RANGE_SQL} SELECT i, j, chunk_a, start_a, end_a, chunk_b, start_b, end_b FROM rg")
def loop_ranges(spark, sf):
    return ranges(spark, sf).select("i", "j", "chunk_a", "start_a", "end_a", "chunk_b", "start_b", "end_b")


@query(
    "dedup_chunk_pairs",
    f"""WITH {RANGE_SQL} SELECT chunk_a, chunk_b, i, j, start_a, end_a, start_b, end_b FROM rg WHERE chunk_a <> chunk_b
QUALIFY row_number() OVER (PARTITION BY chunk_a, chunk_b ORDER BY sim DESC, i, j) = 1""",
)
def dedup_chunk_pairs(spark, sf):
    return L.dedup_chunk_pairs(ranges(spark, sf)).select("chunk_a", "chunk_b", "i", "j", "start_a", "end_a", "start_b", "end_b")


@query(
    "frame_to_chunk",
    """WITH b AS (SELECT o_custkey AS scene, o_orderkey AS s, o_orderkey + 400 AS e FROM orders),
q AS (SELECT DISTINCT o_custkey AS scene, o_orderkey + 37 AS idx FROM orders),
h AS (SELECT q.scene, q.idx, max(b.s) AS s FROM q LEFT JOIN b ON b.scene = q.scene AND b.s <= q.idx GROUP BY 1, 2)
SELECT scene, idx, CASE WHEN s + 400 > idx THEN s END AS chunk FROM h""",
)
def frame_to_chunk(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("scene"), F.col("o_orderkey").alias("idx"))
    bounds = o.select("scene", F.col("idx").alias("chunk"), F.col("idx").alias("start"), (F.col("idx") + 400).alias("end"))
    return L.frame_to_chunk(o.withColumn("idx", F.col("idx") + 37).distinct(), bounds, "idx").select("scene", "idx", "chunk")


@query(
    "most_representative",
    f"""WITH l AS (SELECT label AS scene, vec_id AS frame_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT scene, frame_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM l),
s AS (SELECT a.scene, a.frame_id, sum(list_inner_product(a.e, b.e)) AS ss FROM u a JOIN u b ON a.scene = b.scene AND a.frame_id <> b.frame_id GROUP BY 1, 2)
SELECT scene, frame_id, round(ss, 5) AS sim_sum FROM s QUALIFY row_number() OVER (PARTITION BY scene ORDER BY ss DESC, frame_id) = 1""",
)
def most_representative(spark, sf):
    d = table(spark, sf, "embeddings").select(F.col("label").alias("scene"), F.col("vec_id").alias("frame_id"), "embedding")
    return SIM.most_representative(d).withColumn("sim_sum", F.round("sim_sum", 5))


def _diverse_sql(k: int, mode: str) -> str:
    score = (
        "list_inner_product(u.e, w.vecs[len(w.vecs)])"
        if mode == "last"
        else "list_max(list_transform(w.vecs, lambda v: list_inner_product(u.e, v)))"
    )
    return f"""WITH RECURSIVE l AS (SELECT label AS scene, vec_id AS frame_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT scene, frame_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM l),
w AS (SELECT scene, [frame_id] AS picks, [e] AS vecs FROM u QUALIFY row_number() OVER (PARTITION BY scene ORDER BY frame_id) = 1
 UNION ALL
 SELECT scene, list_append(picks, frame_id), list_append(vecs, e) FROM (
  SELECT w.scene, w.picks, w.vecs, u.frame_id, u.e FROM w JOIN u ON u.scene = w.scene AND NOT list_contains(w.picks, u.frame_id) WHERE len(w.picks) < {k}
  QUALIFY row_number() OVER (PARTITION BY w.scene ORDER BY {score}, u.frame_id) = 1))
SELECT scene, pos, picks[pos + 1] AS frame_id FROM (SELECT scene, picks FROM w WHERE len(picks) = {k}), LATERAL (SELECT unnest(generate_series(0, {k - 1})) AS pos)"""


def _diverse(spark, sf, mode):
    d = table(spark, sf, "embeddings").select(F.col("label").alias("scene"), F.col("vec_id").alias("frame_id"), "embedding")
    seeds = d.groupBy("scene").agg(F.min("frame_id").alias("frame_id"))
    return SIM.select_diverse(d, 6, seeds, mode)


@query("select_diverse_last", _diverse_sql(6, "last"))
def select_diverse_last(spark, sf):
    return _diverse(spark, sf, "last")


@query("select_diverse_set", _diverse_sql(6, "set"))
def select_diverse_set(spark, sf):
    return _diverse(spark, sf, "set")
