"""SQL statements that are built from parameters: maps, communities, density feet."""

from __future__ import annotations

import numpy as np

from casebook.base import CELLS
from marrowgrid.operators.som import START_QUANTILE, grid_distances

KEY = "md5(concat_ws('|', '42', event_id))"


def som_ctes(xdim: int, ydim: int, epochs: int, d: int) -> str:
    """CTEs from ``pts(m, event_id, x)`` to the trained codes ``s<epochs>(m, node, code)``.

    Chained epochs: nearest code, sums per node, neighbourhood-weighted means.
    """
    nodes = xdim * ydim
    top = float(np.quantile(grid_distances(xdim, ydim), START_QUANTILE))
    parts = [f"""s0 AS (SELECT m, row_number() OVER (PARTITION BY m ORDER BY event_id) - 1 AS node, x AS code FROM (
    SELECT *, row_number() OVER (PARTITION BY m ORDER BY {KEY}, event_id) AS r FROM pts) WHERE r <= {nodes})"""]
    gap = f"greatest(abs(a.node % {xdim} - t.node % {xdim}), abs(a.node // {xdim} - t.node // {xdim}))"
    for e in range(epochs):
        radius = top * (1 - e / max(epochs - 1, 1))
        pull = f"exp(-0.5 * pow({gap} / {radius!r}, 2))" if radius > 0.5 else f"CASE WHEN {gap} = 0 THEN 1.0 ELSE 0.0 END"
        sums = ", ".join(f"sum(x[{i + 1}]) AS s{i}" for i in range(d))
        means = ", ".join(f"sum({pull} * t.s{i}) / sum({pull} * t.n)" for i in range(d))
        parts.append(f"b{e} AS (SELECT pts.m, event_id, any_value(x) AS x, arg_min(node, list_distance(x, code)) AS node FROM pts JOIN s{e} USING (m) GROUP BY 1, 2)")
        parts.append(f"t{e} AS (SELECT m, node, count(*) AS n, {sums} FROM b{e} GROUP BY 1, 2)")
        parts.append(f"""s{e + 1} AS (SELECT a.m, a.node, CASE WHEN sum({pull} * t.n) > 0 THEN [{means}] ELSE any_value(a.code) END AS code
    FROM s{e} a JOIN t{e} t ON a.m = t.m GROUP BY 1, 2)""")
    return ",\n".join(parts)


def placed(epochs: int) -> str:
    return (f"placed AS (SELECT pts.m, event_id, arg_min(node, list_distance(x, code)) AS node, min(list_distance(x, code)) AS d "
            f"FROM pts JOIN s{epochs} USING (m) GROUP BY 1, 2)")


def communities(steps: int) -> str:
    """CTEs from ``nn(query_id, base_id)`` to ``lab<steps>(id, label)``."""
    parts = ["""li AS (SELECT query_id AS id, list(base_id) AS l FROM nn GROUP BY 1),
ed AS (SELECT query_id AS src, base_id AS dst, len(list_intersect(a.l, b.l)) / len(list_distinct(a.l || b.l)) AS w
       FROM nn JOIN li a ON a.id = query_id JOIN li b ON b.id = base_id),
ee AS (SELECT src, dst, max(w) AS w FROM (SELECT * FROM ed UNION ALL SELECT dst, src, w FROM ed) GROUP BY 1, 2 HAVING max(w) > 0),
own AS (SELECT src, max(w) AS w FROM ee GROUP BY 1),
lab0 AS (SELECT vec_id AS id, vec_id AS label FROM v)"""]
    for i in range(steps):
        parts.append(f"""sc{i} AS (SELECT id, label, round(sum(w), 9) AS w FROM (
    SELECT src AS id, label, w FROM ee JOIN lab{i} ON dst = id
    UNION ALL SELECT id, label, coalesce(w, 1.0) FROM lab{i} LEFT JOIN own ON src = id) GROUP BY 1, 2),
lab{i + 1} AS (SELECT id, label FROM sc{i} QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, label) = 1)""")
    return ",\n".join(parts)


def left_foot_ctes(group: str) -> str:
    """CTEs from ``vals(g, v)`` to ``foot(g, threshold, n_values)``: histogram, kernel density, foot."""
    return f"""rng AS (SELECT g, min(v) AS lo, max(v) AS hi, count(*) AS n FROM vals GROUP BY 1),
hb AS (SELECT vals.g, any_value(lo) AS lo, any_value(hi) AS hi, least(floor((v - lo) / ((hi - lo) / 4096)), 4095) AS bin, count(*) AS c
       FROM vals JOIN rng ON vals.g = rng.g GROUP BY 1, 4),
hx AS (SELECT g, lo, hi, c, lo + (bin + 0.5) * ((hi - lo) / 4096) AS x, sum(c) OVER (PARTITION BY g) AS n,
              sum(c) OVER (PARTITION BY g ORDER BY bin ROWS UNBOUNDED PRECEDING) AS run FROM hb),
mom AS (SELECT g, any_value(lo) AS lo, any_value(hi) AS hi, any_value(n) AS n, sum(c * x) / sum(c) AS mean,
               min(x) FILTER (run >= 0.75 * n) - min(x) FILTER (run >= 0.25 * n) AS iqr FROM hx GROUP BY 1),
sp AS (SELECT mom.g, any_value(mom.lo) AS lo, any_value(mom.hi) AS hi, any_value(mom.n) AS n, any_value(iqr) AS iqr,
              sqrt(sum(c * (x - mean) ** 2) / sum(c)) AS sd FROM hx JOIN mom ON hx.g = mom.g GROUP BY 1),
bw AS (SELECT *, greatest(0.9 * least(sd, iqr / 1.34) * pow(n, -0.2) * 0.6, (hi - lo) / 4096, 1e-12) AS h FROM sp),
raw AS (SELECT bw.g, i, any_value(bw.lo + i * ((bw.hi - bw.lo) / 999)) AS at,
               sum(c * exp(-0.5 * pow((bw.lo + i * ((bw.hi - bw.lo) / 999) - x) / h, 2))) / any_value(bw.n * h) AS f
        FROM bw JOIN hx ON bw.g = hx.g, range(0, 1000) t(i) GROUP BY 1, 2),
ker AS (SELECT k, exp(-0.5 * pow(k / 10.0, 2)) AS w FROM range(-40, 41) t(k)),
sm AS (SELECT raw.g, dst.i, sum(w * f) AS f FROM range(0, 1000) dst(i), ker
       JOIN raw ON raw.i = CASE WHEN dst.i + k < 0 THEN -(dst.i + k) - 1 WHEN dst.i + k > 999 THEN 1999 - (dst.i + k) ELSE dst.i + k END GROUP BY 1, 2),
pk AS (SELECT g, max(f) AS top, arg_max(i, f) AS peak FROM sm GROUP BY 1),
foot AS (SELECT sm.g, max(sm.i) AS at FROM sm JOIN pk ON sm.g = pk.g WHERE sm.i BETWEEN 1 AND peak AND f < top * 0.05 GROUP BY 1),
cut AS (SELECT foot.g AS {group}, raw.at AS threshold, rng.n AS n_values FROM foot JOIN raw ON raw.g = foot.g AND raw.i = foot.at JOIN rng ON rng.g = foot.g)"""


LOG = "log10(1 + greatest(HLA_DR, 0)) * (4.5 / log10(1 + 262144.0))"

SOM_TRAIN = f"""WITH {CELLS}, pts AS (SELECT 0 AS m, event_id, [CD45 / 10, CD34 / 8, HLA_DR / 2000, SSC_A / 50] AS x FROM cells),
{som_ctes(7, 7, 3, 4)}, {placed(3)}
SELECT node::BIGINT AS node_id, count(*) AS n, round(avg(d), 4) AS quantization FROM placed GROUP BY 1"""


def patient_runs(nodes: str, summary: str, epochs: int) -> str:
    """Scaling of each patient and of the pool, pool shares, one map per patient, residual disease."""
    base = CELLS.replace("cells AS", "all_cells AS")
    return f"""WITH {base},
tr AS (SELECT CASE WHEN condition = 'Sain' THEN -1 ELSE patient_id END AS scale_id, patient_id, file_origin, event_id, condition,
              asinh(CD45 / 5) AS a, asinh(CD34 / 5) AS b, asinh(HLA_DR / 5) AS c FROM all_cells),
st AS (SELECT scale_id, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(c) AS mc, stddev_pop(c) AS sc FROM tr GROUP BY 1),
sx AS (SELECT patient_id, file_origin, event_id, condition, [(a - ma) / sa, (b - mb) / sb, (c - mc) / sc] AS x FROM tr JOIN st USING (scale_id)),
tg AS (SELECT patient_id AS pid, 2 * count(*) AS target FROM sx WHERE condition <> 'Sain' GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY file_origin ORDER BY {KEY}) AS k, count(*) OVER () AS pool_rows FROM sx WHERE condition = 'Sain'),
fs AS (SELECT count(DISTINCT file_origin) AS files FROM r),
pts AS (SELECT patient_id AS m, event_id, condition, x FROM sx WHERE condition <> 'Sain'
        UNION ALL SELECT pid, event_id, condition, x FROM r JOIN fs ON TRUE JOIN tg ON target >= pool_rows OR k <= greatest(1, target // files)),
{som_ctes(5, 5, epochs, 3)}, {placed(epochs)},
cells AS (SELECT placed.m AS patient_id, node AS node_id, condition FROM placed JOIN pts ON placed.m = pts.m AND placed.event_id = pts.event_id),
{nodes} {summary}"""


def right_foot_ctes() -> str:
    """CTEs from ``vals(g, v)`` to ``cut(g, threshold, method, n_values)``: right foot of the main peak.

    A peak counts when its prominence is at least 8 % of the top density.
    """
    return """rng AS (SELECT g, min(v) AS lo, max(v) AS hi, count(*) AS n FROM vals GROUP BY 1),
hb AS (SELECT vals.g, any_value(lo) AS lo, any_value(hi) AS hi, least(floor((v - lo) / ((hi - lo) / 4096)), 4095) AS bin, count(*) AS c
       FROM vals JOIN rng ON vals.g = rng.g GROUP BY 1, 4),
hx AS (SELECT g, lo, hi, c, lo + (bin + 0.5) * ((hi - lo) / 4096) AS x, sum(c) OVER (PARTITION BY g) AS n,
              sum(c) OVER (PARTITION BY g ORDER BY bin ROWS UNBOUNDED PRECEDING) AS run FROM hb),
mom AS (SELECT g, any_value(n) AS n, sum(c * x) / sum(c) AS mean, min(x) FILTER (run >= 0.9 * n) AS p90 FROM hx GROUP BY 1),
bw AS (SELECT hx.g, any_value(lo) AS lo, any_value(hi) AS hi, any_value(mom.n) AS n, any_value(p90) AS p90,
              greatest(sqrt(sum(c * (x - mean) ** 2) / sum(c)) * pow(any_value(mom.n) * 0.75, -0.2), (any_value(hi) - any_value(lo)) / 4096, 1e-12) AS h
       FROM hx JOIN mom ON hx.g = mom.g GROUP BY 1),
raw AS (SELECT bw.g, i, any_value(bw.lo + i * ((bw.hi - bw.lo) / 511)) AS at, any_value(p90) AS p90,
               sum(c * exp(-0.5 * pow((bw.lo + i * ((bw.hi - bw.lo) / 511) - x) / h, 2))) / any_value(bw.n * h) AS f
        FROM bw JOIN hx ON bw.g = hx.g, range(0, 512) t(i) GROUP BY 1, 2),
ker AS (SELECT k, exp(-0.5 * pow(k / 5.0, 2)) AS w FROM range(-20, 21) t(k)),
sm AS (SELECT raw.g, dst.i, sum(w * f) AS f FROM range(0, 512) dst(i), ker
       JOIN raw ON raw.i = CASE WHEN dst.i + k < 0 THEN -(dst.i + k) - 1 WHEN dst.i + k > 511 THEN 1023 - (dst.i + k) ELSE dst.i + k END GROUP BY 1, 2),
tp AS (SELECT g, max(f) AS top FROM sm GROUP BY 1),
nb AS (SELECT *, lag(f) OVER w AS before, lead(f) OVER w AS after FROM sm WINDOW w AS (PARTITION BY g ORDER BY i)),
mx AS (SELECT g, i, f FROM nb WHERE f > before AND f >= after),
ed AS (SELECT mx.g, mx.i, mx.f, coalesce(max(o.i) FILTER (o.i < mx.i AND o.f > mx.f), 0) AS l, coalesce(min(o.i) FILTER (o.i > mx.i AND o.f > mx.f), 511) AS r
       FROM mx JOIN sm o ON o.g = mx.g GROUP BY 1, 2, 3),
pr AS (SELECT ed.g, ed.i, ed.f, ed.f - greatest(min(o.f) FILTER (o.i BETWEEN l AND ed.i), min(o.f) FILTER (o.i BETWEEN ed.i AND r)) AS prom
       FROM ed JOIN sm o ON o.g = ed.g GROUP BY 1, 2, 3),
mn AS (SELECT pr.g, arg_max(i, f) AS main FROM pr JOIN tp ON pr.g = tp.g WHERE prom >= top * 0.08 GROUP BY 1),
dr AS (SELECT sm.g, min(sm.i) AS at FROM sm JOIN mn ON sm.g = mn.g JOIN tp ON sm.g = tp.g WHERE sm.i >= main AND f < top * 0.12 GROUP BY 1),
zn AS (SELECT sm.g, arg_min(sm.i, sm.f) AS at FROM sm JOIN mn ON sm.g = mn.g JOIN raw ON raw.g = sm.g AND raw.i = sm.i WHERE sm.i >= main AND raw.at <= raw.p90 GROUP BY 1),
cn AS (SELECT sm.g, arg_min(i, f) AS at FROM sm WHERE i BETWEEN ceil(511 * 0.3) AND floor(511 * 0.8) GROUP BY 1),
pick AS (SELECT rng.g, rng.n, CASE WHEN main IS NULL THEN cn.at WHEN dr.at IS NOT NULL THEN dr.at ELSE zn.at END AS at,
                CASE WHEN main IS NULL THEN 'central_minimum' WHEN dr.at IS NOT NULL THEN 'kde_foot' ELSE 'right_minimum' END AS method
         FROM rng LEFT JOIN mn ON rng.g = mn.g LEFT JOIN dr ON rng.g = dr.g LEFT JOIN zn ON rng.g = zn.g LEFT JOIN cn ON rng.g = cn.g),
cut AS (SELECT pick.g, raw.at AS threshold, method, pick.n AS n_values FROM pick JOIN raw ON raw.g = pick.g AND raw.i = pick.at)"""


DENSITY = f"""WITH {CELLS},
sp AS (SELECT min(FSC_A) AS x0, max(FSC_A) AS x1, min(HLA_DR) AS y0, max(HLA_DR) AS y1, count(*) AS n FROM cells),
pl AS (SELECT condition, n, least(floor((FSC_A - x0) / ((x1 - x0) / 128)), 127) AS bx, least(floor((HLA_DR - y0) / ((y1 - y0) / 128)), 127) AS bz FROM cells, sp),
gr AS (SELECT bx, bz, count(*) AS c, any_value(n) AS n FROM pl GROUP BY 1, 2),
sd AS (SELECT greatest(sqrt(sum(c * bx * bx) / sum(c) - pow(sum(c * bx) / sum(c), 2)) * pow(any_value(n), -1 / 6.0), 0.5) AS sx,
              greatest(sqrt(sum(c * bz * bz) / sum(c) - pow(sum(c * bz) / sum(c), 2)) * pow(any_value(n), -1 / 6.0), 0.5) AS sz FROM gr),
kx AS (SELECT k, exp(-0.5 * pow(k / sx, 2)) AS w FROM sd, range(-128, 129) t(k) WHERE abs(k) <= floor(4 * sx + 0.5)),
kz AS (SELECT k, exp(-0.5 * pow(k / sz, 2)) AS w FROM sd, range(-128, 129) t(k) WHERE abs(k) <= floor(4 * sz + 0.5)),
s1 AS (SELECT d.i AS bx, bz, sum(w * c) AS f FROM range(0, 128) d(i), kx
       JOIN gr ON bx = CASE WHEN d.i + k < 0 THEN -(d.i + k) - 1 WHEN d.i + k > 127 THEN 255 - (d.i + k) ELSE d.i + k END GROUP BY 1, 2),
s2 AS (SELECT bx, d.i AS bz, sum(w * f) AS f FROM range(0, 128) d(i), kz
       JOIN s1 ON bz = CASE WHEN d.i + k < 0 THEN -(d.i + k) - 1 WHEN d.i + k > 127 THEN 255 - (d.i + k) ELSE d.i + k END GROUP BY 1, 2),
oc AS (SELECT gr.bx, gr.bz, c, f, sum(c) OVER (ORDER BY f, gr.bx, gr.bz ROWS UNBOUNDED PRECEDING) AS run FROM gr JOIN s2 USING (bx, bz)),
ct AS (SELECT 0.3 * min(f) FILTER (run >= 0.5 * n) AS t FROM oc, sp)
SELECT condition, count(*) AS n, count(*) FILTER (f >= t) AS n_kept FROM pl JOIN oc USING (bx, bz), ct GROUP BY 1"""
