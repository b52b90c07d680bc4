"""Queries over scores of cells and outputs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from boxlens.operators import cascade, grammar, inference, kernels, learning, selection
from boxlens.plans.registry import query
from boxlens.sources.fixtures import DET_SQL, GT_SQL, det, gt, read
from boxlens.tables import written

#: Grids: one for so many orders, of so many levels, rows, columns and symbols.
GRID_ORDERS, LEVELS, ROWS, COLS, SYMBOLS, INTERVAL = 2048, 6, 20, 24, 3, 2
#: Grids of a task, about.
TASK_GRIDS = 16

CELLS_SQL = f"""cells AS (SELECT image_id, CAST(l + 1 AS BIGINT) AS level, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, CAST(s AS BIGINT) AS symbol,
  CAST((seed + l * 31 + y * 17 + x * 13 + s * 7 + y * x) % 23 - 11 AS DOUBLE) AS score
  FROM (SELECT o_orderkey // {GRID_ORDERS} AS image_id, CAST(sum(o_custkey) AS BIGINT) AS seed FROM orders GROUP BY 1), range({LEVELS}) b(l), range({ROWS}) c(y), range({COLS}) d(x), range({SYMBOLS}) e(s))"""


def cells(spark, sf_dir):
    """Grids of whole-number scores for three symbols, more of them as orders grow; each differs by what its orders sum up to."""
    grids = read(spark, sf_dir, "orders").groupBy(F.expr(f"o_orderkey div {GRID_ORDERS}").alias("image_id")).agg(F.sum("o_custkey").alias("seed"))
    grids = written(grids, "grids")
    grids = grids.repartition(max(1, -(-grids.count() // TASK_GRIDS)), "image_id")  # a small table of large images: left alone, one task would make all their cells
    n = grids.select("image_id", "seed", F.explode(F.sequence(F.lit(0), F.lit(LEVELS * ROWS * COLS * SYMBOLS - 1))).alias("id"))
    part = lambda div, mod: (F.floor(F.col("id") / div) % mod).cast("long")
    grid = n.select("image_id", "seed", part(ROWS * COLS * SYMBOLS, LEVELS).alias("l"), part(COLS * SYMBOLS, ROWS).alias("y"), part(SYMBOLS, COLS).alias("x"), part(1, SYMBOLS).alias("symbol"))
    score = (F.col("seed") + F.col("l") * 31 + F.col("y") * 17 + F.col("x") * 13 + F.col("symbol") * 7 + F.col("y") * F.col("x")) % 23 - 11
    return grid.select("image_id", (F.col("l") + 1).alias("level"), "y", "x", "symbol", score.cast("double").alias("score"))


STRUCTURE_SQL = f"""structure AS (SELECT r.image_id, r.level, r.y, r.x, r.score + p.score + q.score + 0.5 AS score FROM cells r
  JOIN cells p ON p.symbol = 1 AND p.image_id = r.image_id AND p.level = r.level - {INTERVAL} AND p.y = 2 * r.y + 1 AND p.x = 2 * r.x
  JOIN cells q ON q.symbol = 2 AND q.image_id = r.image_id AND q.level = r.level - {INTERVAL} AND q.y = 2 * r.y AND q.x = 2 * r.x + 3 WHERE r.symbol = 0)"""
CHILDREN = [(0, 0, 0, 0), (1, 1, 0, 1), (2, 0, 3, 1)]


@query(f"WITH {CELLS_SQL}, {STRUCTURE_SQL} SELECT * FROM structure")
def structural_rule(spark, sf_dir):
    return grammar.structural(cells(spark, sf_dir), CHILDREN, 0.5, INTERVAL)


@query(f"""WITH {CELLS_SQL}, one AS (SELECT * FROM cells WHERE symbol = 0)
SELECT a.image_id, a.level, a.y, a.x, max(b.score - 0.5 * (a.x - b.x) * (a.x - b.x) - 0.25 * (a.x - b.x) - 0.75 * (a.y - b.y) * (a.y - b.y) + 0.5 * (a.y - b.y))::DOUBLE AS score
FROM one a JOIN one b ON a.image_id = b.image_id AND a.level = b.level AND abs(a.x - b.x) <= 4 AND abs(a.y - b.y) <= 4 GROUP BY a.image_id, a.level, a.y, a.x""")
def deformation_bounded(spark, sf_dir):
    return grammar.deform(cells(spark, sf_dir).where("symbol = 0"), 0.5, 0.25, 0.75, -0.5)


@query(f"WITH {CELLS_SQL} SELECT image_id, level, y, x, symbol AS rule, score FROM (SELECT *, row_number() OVER (PARTITION BY image_id, level, y, x ORDER BY score DESC, symbol) AS k FROM cells) WHERE k = 1")
def symbol_max(spark, sf_dir):
    return grammar.symbol_best(cells(spark, sf_dir).withColumnRenamed("symbol", "rule"))


@query(f"WITH {CELLS_SQL} SELECT level, CASE WHEN level <= {INTERVAL} THEN 1 ELSE 0 END AS f1, CASE WHEN level > {INTERVAL} AND level <= {2 * INTERVAL} THEN 1 ELSE 0 END AS f2, CASE WHEN level > {2 * INTERVAL} THEN 1 ELSE 0 END AS f3 FROM (SELECT DISTINCT image_id, level FROM cells)")
def loc_features(spark, sf_dir):
    """Of each level of each grid."""
    return grammar.location_features(cells(spark, sf_dir).select("image_id", "level").distinct().select("level"), INTERVAL)


@query(f"""WITH {CELLS_SQL} SELECT * FROM (SELECT image_id, level, y, x, score, CAST(row_number() OVER (PARTITION BY image_id ORDER BY score DESC, level, y, x) AS INT) AS rank FROM cells WHERE symbol = 0 AND score > 5) WHERE rank <= 20""")
def parse_outputs(spark, sf_dir):
    return grammar.top_outputs(cells(spark, sf_dir).where("symbol = 0").drop("symbol"), 5.0, 20)


@query(f"WITH {CELLS_SQL} SELECT image_id, level, y, x, score, (x - 1 - 3) * 12.0::DOUBLE + 1 AS x1, (y - 1 - 2) * 12.0::DOUBLE + 1 AS y1, (x - 1 - 3) * 12.0::DOUBLE + 60 AS x2, (y - 1 - 2) * 12.0::DOUBLE + 48 AS y2 FROM cells WHERE symbol = 0")
def window_to_pixels(spark, sf_dir):
    return grammar.to_pixels(cells(spark, sf_dir).where("symbol = 0"), 1.5, 8, 2, 3, 4, 5)


@query(f"""WITH {CELLS_SQL}, {STRUCTURE_SQL}, top AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, level, y, x) AS k FROM structure WHERE score > 10),
r AS (SELECT image_id * 100 + k AS det_id, image_id, level, y, x FROM top WHERE k <= 5)
SELECT det_id, '0' AS node, NULL AS parent, CAST(9 AS BIGINT) AS symbol, level, y, x FROM r
UNION ALL SELECT det_id, '0.0', '0', 0, level, y, x FROM r
UNION ALL SELECT det_id, '0.1', '0', 1, level - {INTERVAL}, 2 * y + 1, 2 * x FROM r
UNION ALL SELECT det_id, '0.2', '0', 2, level - {INTERVAL}, 2 * y, 2 * x + 3 FROM r""")
def derivation_tree(spark, sf_dir):
    scores = grammar.structural(cells(spark, sf_dir), CHILDREN, 0.5, INTERVAL)
    found = grammar.top_outputs(scores, 10.0, 5).select((F.col("image_id") * 100 + F.col("rank")).alias("det_id"), F.lit(9).cast("long").alias("symbol"), *grammar.CELL)
    choices = scores.select(F.lit(9).cast("long").alias("symbol"), *grammar.CELL, F.lit(0).cast("long").alias("rule"))
    rules = spark.createDataFrame([(0, k, s, ay, ax, ds, ds * INTERVAL) for k, (s, ay, ax, ds) in enumerate(CHILDREN)], "rule long, pos long, rhs long, ay long, ax long, ds long, dl long")
    return grammar.derive(found, rules, choices, 1).select("det_id", "node", "parent", "symbol", "level", "y", "x")


IOU_SQL = "CAST(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1) + 1) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1) + 1) AS DOUBLE) / ((a.x2 - a.x1 + 1) * (a.y2 - a.y1 + 1) + (b.x2 - b.x1 + 1) * (b.y2 - b.y1 + 1) - greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1) + 1) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1) + 1))"


@query(f"""WITH {DET_SQL}, {GT_SQL}, o AS (SELECT DISTINCT a.image_id, 1 + a.comp * 2 + a.cls_id % 5 AS level FROM det a JOIN gt b ON a.image_id = b.image_id AND a.cls_id = b.cls_id WHERE {IOU_SQL} >= 0.7)
SELECT image_id, level FROM o UNION SELECT image_id, level - 4 FROM o WHERE level > 4""")
def level_pruning(spark, sf_dir):
    from boxlens.operators.matching import box_meetings

    pairs = box_meetings(det(spark, sf_dir), gt(spark, sf_dir))
    overlaps = pairs.select("image_id", (1 + F.col("d_comp") * 2 + F.col("cls_id") % 5).alias("level"), F.col("iou").alias("overlap"))
    return grammar.levels_to_keep(overlaps, 0.7, 4)


@query(f"""WITH {DET_SQL}, {GT_SQL}, o AS (SELECT b.gt_id AS object_id, a.det_id AS output_id, a.x1, a.y1, a.x2, a.y2, a.score, {IOU_SQL} AS overlap FROM det a JOIN gt b ON a.image_id = b.image_id AND a.cls_id = b.cls_id AND a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2),
l AS (SELECT *, CASE WHEN overlap < 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS loss FROM o),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY score DESC, output_id) AS k FROM l WHERE overlap >= 0.3) WHERE k = 1)
SELECT object_id, output_id, round(score, 6) AS score, true AS is_belief FROM b
UNION ALL SELECT l.object_id, l.output_id, round(l.score + l.loss, 6), false FROM l JOIN b ON l.object_id = b.object_id WHERE l.score + l.loss >= b.score - 0.01::DOUBLE AND NOT (l.x1 = b.x1 AND l.y1 = b.y1 AND l.x2 = b.x2 AND l.y2 = b.y2)""")
def belief_select(spark, sf_dir):
    return grammar.belief_and_rivals(det(spark, sf_dir), gt(spark, sf_dir), 0.3).withColumn("score", F.round("score", 6))


@query(f"""WITH {DET_SQL}, {GT_SQL}, e AS (SELECT gt_id AS example_id, * FROM gt),
c AS (SELECT e.example_id, a.det_id AS cell_id, a.*, {IOU_SQL.replace('b.', 'e.')} AS own FROM det a JOIN e ON a.image_id = e.image_id AND a.cls_id = e.cls_id),
bad AS (SELECT DISTINCT a.example_id, a.cell_id FROM c a JOIN gt b ON a.image_id = b.image_id AND a.cls_id = b.cls_id AND b.gt_id <> a.example_id WHERE {IOU_SQL} >= 0.5)
SELECT c.example_id, c.cell_id, CASE WHEN own < 0.1 OR bad.cell_id IS NOT NULL THEN -1e9 WHEN own < 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS loss FROM c LEFT JOIN bad ON c.example_id = bad.example_id AND c.cell_id = bad.cell_id""")
def loss_field(spark, sf_dir):
    """Every object is an example, the detections of its image and class its windows. Minus infinity is shown as -1e9."""
    found = selection.loss_field(det(spark, sf_dir), gt(spark, sf_dir), ["image_id", "cls_id"], "det_id", "gt_id")
    return found.withColumn("loss", F.greatest("loss", F.lit(-1e9)))


#: An image's width: so many vectors, one a column; its height is their length.
COLUMNS = 96


def images(spark, sf_dir):
    """Grey images made of vectors: the components of a column's vector are its pixels. Vectors that do not fill an image are left out."""
    vectors = read(spark, sf_dir, "embeddings").select(F.expr(f"vec_id div {COLUMNS}").alias("image_id"), "vec_id", "embedding")
    whole = vectors.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("v")).where(F.size("v") == COLUMNS)  # COLUMNS a group
    h = F.size(F.col("v")[0]["embedding"])
    shade = lambda x: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), 128 + 48 * x.cast("double")))).cast("double")
    pixels = F.flatten(F.transform(F.sequence(F.lit(0), h - 1), lambda y: F.transform("v", lambda v: shade(v["embedding"][y]))))
    return whole.select("image_id", h.cast("long").alias("h"), F.lit(COLUMNS).cast("long").alias("w"), pixels.alias("pixels"))


@query()
def feature_pyramid(spark, sf_dir):
    found = kernels.image_levels(images(spark, sf_dir), interval=4)
    return found.select("image_id", "level", F.round("scale", 6).alias("scale"), "h", "w", "dims")


@query()
def hog_features(spark, sf_dir):
    found = kernels.image_levels(images(spark, sf_dir), interval=4).where("level = 1")
    return found.select("image_id", F.posexplode("feat").alias("at", "value")).withColumn("value", F.round(F.col("value").cast("double"), 4))


@query()
def part_model_detect(spark, sf_dir):
    """A root and two movable parts on images: responses, deformation, structure, parse, boxes."""
    rng = np.random.default_rng(3)
    root, part = rng.normal(size=(3, 4, kernels.DIMS)) * 0.1, rng.normal(size=(2, 2, kernels.DIMS)) * 0.1
    interval = 2
    scores = kernels.responses(kernels.image_levels(images(spark, sf_dir), interval), [root, part])
    moved = grammar.deform(scores.where("symbol = 1").drop("symbol"), 0.05, 0.0, 0.05, 0.0)
    both = scores.where("symbol = 0").unionByName(moved.withColumn("symbol", F.lit(1).cast("long")).select(scores.columns))
    whole = grammar.structural(both, [(0, 0, 0, 0), (1, 0, 1, 1), (1, 2, 4, 1)], 0.1, interval)
    return grammar.to_pixels(grammar.top_outputs(whole, -1e6, 10), 1.0, 8, 1, 1, 3, 4)


GRID_PAD = (1, 2)


def grid_model():
    """Symbols 0 to 2 are the grid's; 3 and 4 move 1 and 2; two rules of the start symbol 5, the second with one part at the root's level. Costs are exact in binary."""
    m = grammar.Model("grid")
    root, a, b = (m.add_symbol("T") for _ in range(3))
    first, second = m.add_symbol("N"), m.add_symbol("N")
    m.start = m.add_symbol("N")
    m.add_deformation(first, a, [0.5, 0.25, 0.75, -0.5], bias=0.05)
    m.add_deformation(second, b, [0.5, 0.0, 0.25, 0.0])
    m.add_structure(m.start, [root, first, second], [(0, 0, 0), (1, 0, 1), (0, 3, 1)], (4, 5), bias=0.025).location = m.add_block([1.0, 2.0, -1.0])
    m.add_structure(m.start, [root, first], [(0, 0, 0), (1, 1, 0)], (4, 5), bias=0.4)
    return m


def _moved(name: str, symbol: int, cost: str) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT a.image_id, a.level, a.y, a.x, b.y AS py, b.x AS px, b.score + {cost} AS score,
  row_number() OVER (PARTITION BY a.image_id, a.level, a.y, a.x ORDER BY b.score + {cost} DESC, b.x, b.y) AS k
  FROM cells a JOIN cells b ON a.symbol = {symbol} AND b.symbol = {symbol} AND a.image_id = b.image_id AND a.level = b.level AND abs(a.x - b.x) <= 4 AND abs(a.y - b.y) <= 4) WHERE k = 1)"""


GRID_SQL = f"""WITH {CELLS_SQL}, {_moved("f", 1, "(0.5 - 0.5 * (a.x - b.x) * (a.x - b.x) - 0.25 * (a.x - b.x) - 0.75 * (a.y - b.y) * (a.y - b.y) + 0.5 * (a.y - b.y))")},
{_moved("g", 2, "(-0.5 * (a.x - b.x) * (a.x - b.x) - 0.25 * (a.y - b.y) * (a.y - b.y))")},
matched AS (
  SELECT r.image_id, r.level, r.y, r.x, 2 AS rule, r.score + f.score + g.score + 0.25 + CASE WHEN r.level <= {INTERVAL} THEN 1 WHEN r.level <= {2 * INTERVAL} THEN 2 ELSE -1 END AS score, f.y AS fy, f.x AS fx, f.py AS fpy, f.px AS fpx, g.y AS gy, g.x AS gx, g.py AS gpy, g.px AS gpx
  FROM cells r JOIN f ON f.image_id = r.image_id AND f.level = r.level - {INTERVAL} AND f.y = 2 * r.y + 1 - {GRID_PAD[0]} AND f.x = 2 * r.x - {GRID_PAD[1]}
  JOIN g ON g.image_id = r.image_id AND g.level = r.level - {INTERVAL} AND g.y = 2 * r.y - {GRID_PAD[0]} AND g.x = 2 * r.x + 3 - {GRID_PAD[1]} WHERE r.symbol = 0
  UNION ALL SELECT r.image_id, r.level, r.y, r.x, 3, r.score + f.score + 4, f.y, f.x, f.py, f.px, NULL, NULL, NULL, NULL
  FROM cells r JOIN f ON f.image_id = r.image_id AND f.level = r.level AND f.y = r.y + 1 AND f.x = r.x + 1 WHERE r.symbol = 0),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, level, y, x ORDER BY score DESC, rule) AS c FROM matched) WHERE c = 1),
top AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, level, y, x) AS rank FROM one WHERE score > 10)"""


@query(f"{GRID_SQL} SELECT image_id, rank, CAST(rule AS BIGINT) AS rule, level, y, x, CAST(score AS DOUBLE) AS score FROM top")
def model_detect(spark, sf_dir):
    """A grammar evaluated on the grid, with location scores, virtual padding and moving parts: all outputs over the threshold."""
    found = inference.detect_on_cells(cells(spark, sf_dir), grid_model(), INTERVAL, GRID_PAD, 10.0)
    return found.select("image_id", "rank", "rule", "level", "y", "x", "score")


@query(f"""{GRID_SQL} SELECT image_id, rank, '0' AS node, NULL AS parent, CAST(5 AS BIGINT) AS symbol, level, y, x FROM top
UNION ALL SELECT image_id, rank, '0.0', '0', 0, level, y, x FROM top
UNION ALL SELECT image_id, rank, '0.1', '0', 3, level - CASE rule WHEN 2 THEN {INTERVAL} ELSE 0 END, fy, fx FROM top
UNION ALL SELECT image_id, rank, '0.1.0', '0.1', 1, level - CASE rule WHEN 2 THEN {INTERVAL} ELSE 0 END, fpy, fpx FROM top
UNION ALL SELECT image_id, rank, '0.2', '0', 4, level - {INTERVAL}, gy, gx FROM top WHERE rule = 2
UNION ALL SELECT image_id, rank, '0.2.0', '0.2', 2, level - {INTERVAL}, gpy, gpx FROM top WHERE rule = 2""")
def model_derivation(spark, sf_dir):
    """The derivations of the same outputs, parts at the cells they moved to."""
    found = inference.detect_on_cells(cells(spark, sf_dir), grid_model(), INTERVAL, GRID_PAD, 10.0)
    return found.select("image_id", "rank", F.explode("nodes").alias("n")).select("image_id", "rank", *[F.col(f"n.{c}").alias(c) for c in ("node", "parent", "symbol", "level", "y", "x")])


@query()
def single_image(spark, sf_dir):
    """The whole way from pixels to suppressed boxes, for each image."""
    return inference.process(images(spark, sf_dir), synthetic_model(), 0.0, 4)


def synthetic_model():
    rng = np.random.default_rng(3)
    root, parts = rng.normal(size=(3, 4, kernels.DIMS)) * 0.1, [rng.normal(size=(2, 2, kernels.DIMS)) * 0.1 for _ in range(2)]
    return grammar.star_model("synthetic", root, [(parts[0], (0, 1, 1), [0.05, 0, 0.05, 0]), (parts[1], (2, 4, 1), [0.05, 0, 0.05, 0])], mirrored=True)


@query()
def hard_negative_features(spark, sf_dir):
    """Vectors of all outputs on the images that are hard for images without objects, each with its zero belief."""
    return learning.hard_negatives(images(spark, sf_dir), synthetic_model(), INTERVAL)


@query()
def latent_positive_features(spark, sf_dir):
    """Beliefs, rivals and zero vectors of two boxes on each of the synthetic images."""
    found = images(spark, sf_dir)
    sides = F.array(*[F.struct(F.lit(j).alias("j"), *[F.lit(v).cast("long").alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), s, strict=True)]) for j, s in enumerate([(1, 1, 60, 50), (30, 10, 96, 62)])])
    boxes = found.select("image_id", F.explode(sides).alias("b")).select((2 * F.col("image_id") + F.col("b.j")).alias("gt_id"), "image_id", "b.x1", "b.y1", "b.x2", "b.y2")
    return learning.latent_positives(found, boxes, synthetic_model(), INTERVAL, 50, 0.5)


@query()
def block_shares(spark, sf_dir):
    """What each block adds to each output's score."""
    return learning.block_table(images(spark, sf_dir), synthetic_model(), -1.0, INTERVAL)


STAR_COSTS = [[0.0, 0.5, 2.0], [0.0, 1.0, 4.0]]
STAR_SQL = """s AS (SELECT det_id, CAST(x1 % 9 AS DOUBLE) AS root, [CAST(y1 % 7 AS DOUBLE), CAST(x2 % 5 AS DOUBLE), CAST(y2 % 11 AS DOUBLE)] AS a, [CAST(det_id % 6 AS DOUBLE), CAST((x1 + y1) % 8 AS DOUBLE), CAST((x2 + y2) % 13 AS DOUBLE)] AS b FROM det),
one AS (SELECT *, root >= 1 AS go1, list_filter([0.0::DOUBLE, 0.5::DOUBLE, 2.0::DOUBLE], lambda c: root - c >= 0) AS open1 FROM s),
p1 AS (SELECT *, greatest(a[1], CASE WHEN root - 0.5 >= 0 THEN a[2] - 0.5 ELSE -1e300 END, CASE WHEN root - 2 >= 0 THEN a[3] - 2 ELSE -1e300 END) + root AS s1 FROM one WHERE go1),
p2 AS (SELECT *, greatest(b[1], CASE WHEN s1 - 1 >= 2 THEN b[2] - 1 ELSE -1e300 END, CASE WHEN s1 - 4 >= 2 THEN b[3] - 4 ELSE -1e300 END) + s1 AS s2, list_filter([0.0::DOUBLE, 1.0::DOUBLE, 4.0::DOUBLE], lambda c: s1 - c >= 2) AS open2 FROM p1 WHERE s1 >= 3)"""


@query(f"WITH {DET_SQL}, {STAR_SQL} SELECT det_id, s2 AS score, CAST(len(open1) + len(open2) AS BIGINT) AS evaluated FROM p2 WHERE s2 >= 9")
def star_cascade_detect(spark, sf_dir):
    """Two parts with three places each; only what passes all stages."""
    whole = lambda e: e.cast("double")
    d = det(spark, sf_dir)
    parts = F.array(F.array(whole(F.col("y1") % 7), whole(F.col("x2") % 5), whole(F.col("y2") % 11)), F.array(whole(F.col("det_id") % 6), whole((F.col("x1") + F.col("y1")) % 8), whole((F.col("x2") + F.col("y2")) % 13)))
    rows = d.select("det_id", whole(F.col("x1") % 9).alias("root"), parts.alias("parts"))
    found = cascade.star_cascade(rows, np.array(STAR_COSTS), [1.0, 3.0], [0.0, 2.0], 9.0)
    return found.where("passed").select("det_id", "score", "evaluated")
