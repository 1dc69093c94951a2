"""SQL of the distance-matching metrics: matching as a loop, curves read between their own rows."""

from __future__ import annotations

from collections.abc import Sequence

ERRORS = ("trans", "vel", "scale", "orient", "attr")


def matched(thresholds: Sequence[float], classes: Sequence[int] | None = None) -> str:
    """Common tables p, g (rows of the classes that count), labels, ths, r (the loop over the detections of every frame,
    class and threshold) and c (label, threshold, det_idx, score, tp, seen: every detection, best first)."""
    values = ", ".join(f"({float(t)}::DOUBLE)" for t in thresholds)
    only = f" WHERE label IN ({', '.join(map(str, classes))})" if classes else ""
    labels = "SELECT unnest([" + ", ".join(map(str, classes)) + "]) AS label" if classes else "SELECT label FROM p UNION SELECT label FROM g"
    return f"""WITH RECURSIVE ths(threshold) AS (VALUES {values}), p AS (SELECT * FROM pred{only}), g AS (SELECT * FROM gt{only}), labels AS ({labels}),
o AS (SELECT p.frame_id, p.label, p.det_idx, g.box_idx, p.score, sqrt((p.cx-g.cx)*(p.cx-g.cx)+(p.cy-g.cy)*(p.cy-g.cy)) AS v FROM p JOIN g ON g.frame_id = p.frame_id AND g.label = p.label),
w AS (SELECT frame_id, label, threshold, det_idx, score, list(box_idx ORDER BY v, box_idx) AS want FROM o JOIN ths ON v < threshold GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY frame_id, label, threshold ORDER BY score DESC, det_idx DESC) AS k FROM w),
r AS (SELECT DISTINCT frame_id, label, threshold, 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::BIGINT AS det_idx, NULL::BIGINT AS gt_idx FROM k UNION ALL
  SELECT r.frame_id, r.label, r.threshold, r.k + 1, CASE WHEN x.g IS NULL THEN r.taken ELSE list_append(r.taken, x.g) END, k.det_idx, x.g
  FROM r JOIN k ON r.frame_id = k.frame_id AND r.label = k.label AND r.threshold = k.threshold AND k.k = r.k + 1, LATERAL (SELECT list_filter(k.want, lambda q: NOT list_contains(r.taken, q))[1] AS g) x),
m AS (SELECT DISTINCT threshold, det_idx, gt_idx FROM r WHERE gt_idx IS NOT NULL),
c AS (SELECT p.label, h.threshold, p.det_idx, p.score, sum((m.det_idx IS NOT NULL)::INT) OVER w AS tp, row_number() OVER w AS seen FROM p CROSS JOIN ths h LEFT JOIN m ON m.threshold = h.threshold AND m.det_idx = p.det_idx WINDOW w AS (PARTITION BY p.label, h.threshold ORDER BY p.score DESC, p.det_idx DESC))"""


#: aps: label, threshold, ap.
AP = """n AS (SELECT l.label, h.threshold, coalesce(x.n, 0) AS num_gt, k FROM labels l CROSS JOIN ths h CROSS JOIN range(11, 101) s(k) LEFT JOIN (SELECT label, count(*) AS n FROM g GROUP BY label) x ON x.label = l.label),
j AS (SELECT n.label, n.threshold, n.num_gt, n.k, max(seen) FILTER (tp * 100 <= n.k * num_gt) AS j FROM n LEFT JOIN c ON c.label = n.label AND c.threshold = n.threshold GROUP BY ALL),
v AS (SELECT j.*, CASE WHEN num_gt = 0 OR f.seen IS NULL THEN 0 WHEN j IS NULL THEN f.tp / f.seen WHEN b.seen IS NULL THEN CASE WHEN a.tp * 100 = k * num_gt THEN a.tp / a.seen ELSE 0 END
    ELSE a.tp / a.seen + coalesce((k * num_gt / 100 - a.tp) / nullif(b.tp - a.tp, 0), 0) * (b.tp / b.seen - a.tp / a.seen) END AS p
  FROM j LEFT JOIN c a ON a.label = j.label AND a.threshold = j.threshold AND a.seen = j.j LEFT JOIN c b ON b.label = j.label AND b.threshold = j.threshold AND b.seen = j.j + 1 LEFT JOIN c f ON f.label = j.label AND f.threshold = j.threshold AND f.seen = 1),
aps AS (SELECT label, threshold, avg(greatest(p - 0.1, 0) / 0.9) AS ap FROM v GROUP BY ALL)"""


def errors(below: float, metrics: Sequence[str] = ERRORS, half_turn: Sequence[int] = (), skips: Sequence[tuple[int, str]] = ()) -> str:
    """errs: label, metric, error. Errors of matches by falling score, their means so far read at the scores of recalls."""
    half = f"CASE WHEN p.label IN ({', '.join(map(str, half_turn))}) THEN pi()/2 ELSE pi() END" if half_turn else "pi()"
    small, vol = "least(p.l,g.l)*least(p.w,g.w)*least(p.h,g.h)", "(p.l*p.w*p.h+g.l*g.w*g.h)"
    each = {
        "trans": "sqrt((p.cx-g.cx)*(p.cx-g.cx)+(p.cy-g.cy)*(p.cy-g.cy))", "vel": "sqrt((p.vx-g.vx)*(p.vx-g.vx)+(p.vy-g.vy)*(p.vy-g.vy))",
        "scale": f"1 - {small}/({vol}-{small})", "orient": f"abs(g.yaw-p.yaw - 2*{half}*round((g.yaw-p.yaw)/(2*{half})))", "attr": "CASE WHEN g.attr >= 0 THEN (p.attr <> g.attr)::INT::DOUBLE END",
    }
    rows = " UNION ALL ".join(f"SELECT label, det_idx, score, '{m}' AS metric, {m} AS e FROM raw" for m in metrics)
    skipped = " OR ".join(f"(l.label = {c} AND q.metric = '{m}')" for c, m in skips) or "false"
    names = ", ".join(f"('{m}')" for m in metrics)
    return f"""raw AS (SELECT p.label, p.det_idx, p.score, {", ".join(f"{each[m]} AS {m}" for m in metrics)} FROM m JOIN p ON p.det_idx = m.det_idx JOIN g ON g.box_idx = m.gt_idx WHERE m.threshold = {below}),
tall AS ({rows}),
mean AS (SELECT label, metric, score AS s, row_number() OVER w AS t, CASE WHEN count(e) OVER (PARTITION BY label, metric) = 0 THEN 1 ELSE coalesce(avg(e) OVER w, 0) END AS e
  FROM tall WINDOW w AS (PARTITION BY label, metric ORDER BY score DESC, det_idx DESC ROWS UNBOUNDED PRECEDING)),
cur AS (SELECT label, tp, seen, score FROM c WHERE threshold = {below}),
spots AS (SELECT x.label, k, k * x.n / 100 AS x, max(seen) FILTER (tp * 100 <= k * x.n) AS j FROM (SELECT label, count(*) AS n FROM g GROUP BY label) x CROSS JOIN range(11, 101) s(k) JOIN cur ON cur.label = x.label
  GROUP BY x.label, k, x.n HAVING max(tp) > 0 AND k * x.n <= 100 * max(tp)),
conf AS (SELECT z.label, z.k, CASE WHEN j IS NULL THEN f.score WHEN b.seen IS NULL OR a.tp = x THEN a.score ELSE a.score + (x - a.tp) / (b.tp - a.tp) * (b.score - a.score) END AS q
  FROM spots z LEFT JOIN cur a ON a.label = z.label AND a.seen = z.j LEFT JOIN cur b ON b.label = z.label AND b.seen = z.j + 1 LEFT JOIN cur f ON f.label = z.label AND f.seen = 1),
pos AS (SELECT conf.label, k, q, metric, min(t) FILTER (s <= q) AS t, max(t) AS last FROM conf JOIN mean ON mean.label = conf.label GROUP BY ALL),
val AS (SELECT pos.label, pos.metric, CASE WHEN b.t IS NULL THEN a.e ELSE a.e + (q - a.s) / (b.s - a.s) * (b.e - a.e) END AS v
  FROM pos JOIN mean a ON a.label = pos.label AND a.metric = pos.metric AND a.t = coalesce(pos.t, pos.last) LEFT JOIN mean b ON b.label = pos.label AND b.metric = pos.metric AND b.t = pos.t - 1),
errs AS (SELECT l.label, q.metric, CASE WHEN NOT ({skipped}) THEN coalesce(x.e, 1) END AS error FROM labels l CROSS JOIN (VALUES {names}) q(metric)
  LEFT JOIN (SELECT label, metric, avg(v) AS e FROM val GROUP BY ALL) x ON x.label = l.label AND x.metric = q.metric)"""


def score(thresholds: Sequence[float], below: float, weight: float, metrics: Sequence[str] = ERRORS, classes: Sequence[int] | None = None, half_turn: Sequence[int] = (), skips: Sequence[tuple[int, str]] = ()) -> str:
    """The composite score in one row."""
    means = ", ".join(f"(SELECT avg(error) FROM errs WHERE metric = '{m}') AS {m}" for m in metrics)
    gained = " + ".join(f"coalesce(greatest(0, 1 - {m}), 0)" for m in metrics)
    shown = ", ".join(f"round({m}, 6) + 0.0 AS {m}" for m in ("mean_ap", *metrics))
    return f"""{matched(thresholds, classes)}, {AP}, {errors(below, metrics, half_turn, skips)},
one AS (SELECT (SELECT avg(ap) FROM (SELECT label, avg(ap) AS ap FROM aps GROUP BY label)) AS mean_ap, {means})
SELECT {shown}, round(({float(weight)} * mean_ap + {gained}) / {float(weight) + len(metrics)}, 6) + 0.0 AS score FROM one"""
