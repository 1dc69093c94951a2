"""Queries that paste objects into frames, with SQL that runs the greedy placement one box after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuboid.functions import geom
from cuboid.operators import augment, paste
from cuboid.operators.order import numbered
from cuboid.plans.registry import query, rounded, rounded_sql, uniform_sql
from cuboid.plans.scene import view
from cuboid.plans.tables import saved

POINT_ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "x", "f0", "f1"]
TARGETS = {0: 4, 1: 3, 2: 6}
_ROT = ", ".join(f"{v} AS {k}" for k, v in geom.rotation().items())
_SIDE = lambda s: ", ".join(f"{c} AS {s}_{c}" for c in [*geom.BOX, *geom.rotation()])
_APART = " AND ".join(geom.separated())

#: Placement as a fold: stock is the table of objects; r holds, for every frame, the candidates kept so far.
_PLACED = f"""t(label, target, c) AS (VALUES (0, 4, 0), (1, 3, 1), (2, 6, 2)), fr AS (SELECT DISTINCT frame_id FROM gt), hv AS (SELECT frame_id, label, count(*) AS n FROM gt GROUP BY ALL),
need AS (SELECT fr.frame_id, t.label, t.c, t.target - coalesce(hv.n, 0) AS missing FROM fr CROSS JOIN t LEFT JOIN hv ON hv.frame_id = fr.frame_id AND hv.label = t.label WHERE t.target > coalesce(hv.n, 0)),
st AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {uniform_sql(5, 'stock', 'box_idx')}, box_idx) - 1 AS pos, count(*) OVER (PARTITION BY label) AS m FROM stock),
ns AS (SELECT need.*, m, floor({uniform_sql(5, 'paste', 'frame_id', 'need.label')} * m)::BIGINT AS start, {list(augment._STEPS)}[1 + floor({uniform_sql(5, 'step', 'frame_id', 'need.label')} * {len(augment._STEPS)})::BIGINT] AS step
  FROM need JOIN (SELECT DISTINCT label, m FROM st) s ON s.label = need.label),
slot AS (SELECT frame_id, label, c, k, (start + k * (CASE WHEN m % step = 0 THEN 1 ELSE step END)) % m AS pos FROM (SELECT *, unnest(range(1, least(missing, m) + 1)) AS k FROM ns)),
cand AS MATERIALIZED (SELECT slot.frame_id, slot.c, slot.k, st.label, st.box_idx, {', '.join(f'st.{c}' for c in geom.BOX)}, row_number() OVER (PARTITION BY slot.frame_id ORDER BY slot.c, slot.k) AS o FROM slot JOIN st ON st.label = slot.label AND st.pos = slot.pos),
ra AS (SELECT frame_id, o, {_SIDE('a')} FROM (SELECT *, {_ROT} FROM cand)), rb AS (SELECT frame_id, o, {_SIDE('b')} FROM (SELECT *, {_ROT} FROM cand)), rg AS (SELECT frame_id, {_SIDE('b')} FROM (SELECT *, {_ROT} FROM gt)),
hit AS (SELECT DISTINCT ra.frame_id, o FROM ra JOIN rg ON rg.frame_id = ra.frame_id WHERE {_APART}),
e AS (SELECT ra.frame_id, rb.o, list(ra.o) AS better FROM ra JOIN rb ON ra.frame_id = rb.frame_id AND ra.o < rb.o WHERE {_APART} GROUP BY ALL),
steps AS MATERIALIZED (SELECT cand.frame_id, cand.o, hit.o IS NOT NULL AS hit, e.better FROM cand LEFT JOIN hit ON hit.frame_id = cand.frame_id AND hit.o = cand.o LEFT JOIN e ON e.frame_id = cand.frame_id AND e.o = cand.o),
r AS (SELECT DISTINCT frame_id, 0::BIGINT AS o, []::BIGINT[] AS kept FROM cand UNION ALL
  SELECT r.frame_id, r.o + 1, CASE WHEN s.hit OR (s.better IS NOT NULL AND list_has_any(s.better, r.kept)) THEN r.kept ELSE list_append(r.kept, s.o) END FROM r JOIN steps s ON s.frame_id = r.frame_id AND s.o = r.o + 1),
kept AS (SELECT frame_id, unnest(arg_max(kept, o)) AS o FROM r GROUP BY frame_id),
placed AS MATERIALIZED (SELECT cand.* FROM cand JOIN kept ON kept.frame_id = cand.frame_id AND kept.o = cand.o)"""

_BANK = f"""pts AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY {', '.join(POINT_ORDER)}) - 1 AS pt_idx FROM points), bx AS (SELECT *, {_ROT} FROM gt),
own AS MATERIALIZED (SELECT p.frame_id, p.pt_idx, min(b.box_idx) AS obj FROM pts p JOIN bx b ON b.frame_id = p.frame_id AND {geom.contains('p.x', 'p.y', 'p.z')} GROUP BY ALL),
stock AS MATERIALIZED (SELECT g.box_idx, g.frame_id, g.label, {', '.join(f'g.{c}' for c in geom.BOX)}, n.n_points FROM gt g JOIN (SELECT obj, count(*) AS n_points FROM own GROUP BY obj HAVING count(*) >= 2) n ON n.obj = g.box_idx
  QUALIFY row_number() OVER (PARTITION BY g.label ORDER BY g.frame_id DESC, g.box_idx DESC) <= 40)"""


@query(f"WITH RECURSIVE stock AS (SELECT box_idx, label, {', '.join(geom.BOX)} FROM gt), {_PLACED} SELECT frame_id, label, box_idx FROM placed")
def copy_paste_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes pasted into frames that lack some, without collisions."""
    gt = view(spark, sf_dir, "gt")
    return augment.place(gt, gt, TARGETS, 5).select("frame_id", "label", "box_idx")


@query()
def copy_paste_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with up to five random offsets for every candidate."""
    gt = view(spark, sf_dir, "gt")
    placed = augment.place(gt, gt, TARGETS, 5, (4.0, 4.0, 0.5), 2.0, 5)
    return rounded(placed.select("frame_id", "label", "box_idx", "cx", "cy", "cz"))


def numbered_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scene's points with pt_idx, their order in the frame."""
    p = view(spark, sf_dir, "points")
    return numbered(p, ["frame_id"], F.floor(F.col("l_orderkey") / 65536), POINT_ORDER, "pt_idx").select("frame_id", "pt_idx", "x", "y", "z", "f0", "f1")


def _bank(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, paste.Bank]:
    gt, points = view(spark, sf_dir, "gt"), numbered_points(spark, sf_dir)
    return gt, points, paste.object_bank(gt, points, 2, 40)


@query(f"WITH {_BANK} SELECT box_idx, label, n_points::BIGINT AS n_points FROM stock")
def copy_paste_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 40 objects of each class with at least two points."""
    return _bank(spark, sf_dir)[2].entries.select("box_idx", "label", "n_points")


@query(f"""WITH RECURSIVE {_BANK}, {_PLACED}, pb AS (SELECT frame_id, {', '.join(geom.BOX)}, {_ROT} FROM placed),
gone AS (SELECT DISTINCT p.frame_id, p.pt_idx FROM pts p JOIN pb b ON b.frame_id = p.frame_id AND {geom.contains('p.x', 'p.y', 'p.z')}),
al AS (SELECT frame_id, NULL::BIGINT AS source, 0 AS c, 0 AS k, pt_idx AS pos, x, y, z, f0 FROM pts p WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.frame_id = p.frame_id AND g.pt_idx = p.pt_idx)
  UNION ALL SELECT d.frame_id, d.box_idx, d.c + 1, d.k, p.pt_idx, p.x, p.y, p.z, p.f0 FROM placed d JOIN own o ON o.obj = d.box_idx JOIN pts p ON p.frame_id = o.frame_id AND p.pt_idx = o.pt_idx)
SELECT frame_id, (row_number() OVER (PARTITION BY frame_id ORDER BY c, k, pos) - 1)::BIGINT AS pt_idx, source, {rounded_sql('x y z f0')} FROM al""")
def copy_paste_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of all frames after objects with their points were pasted into those that lack some."""
    gt, points = view(spark, sf_dir, "gt"), saved(numbered_points(spark, sf_dir))
    _, out = paste.paste(gt, points, paste.object_bank(gt, points, 2, 40), TARGETS, 5)
    return rounded(out.select("frame_id", "pt_idx", "source", "x", "y", "z", F.col("f0").cast("double").alias("f0")))


@query(f"""WITH RECURSIVE {_BANK}, {_PLACED}, al AS (SELECT frame_id, label, NULL::BIGINT AS source, 0 AS c, 0 AS k, box_idx AS pos, cx, cy, cz FROM gt UNION ALL SELECT frame_id, label, box_idx, c + 1, k, 0, cx, cy, cz FROM placed)
SELECT frame_id, (row_number() OVER (PARTITION BY frame_id ORDER BY c, k, pos) - 1)::BIGINT AS box_idx, label, source, {rounded_sql('cx cy cz')} FROM al""")
def copy_paste_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of all frames after the same pasting."""
    gt, _, bank = _bank(spark, sf_dir)
    out, _ = paste.paste(gt, None, bank, TARGETS, 5)
    return rounded(out.select("frame_id", "box_idx", "label", "source", "cx", "cy", "cz"))
