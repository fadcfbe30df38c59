"""SQL of the sequential operators, for checks by another engine: recursive common table expressions, one step a row."""

from __future__ import annotations


def smoother(source: str, out: str, car: float, sigma_meas: float = 0.04, sigma_jerk: float = 0.35, window_s: float = 0.5) -> str:
    """``out`` (track_id, k, t, x, y, vx, vy, speed): both passes over ``source`` (track_id, k, t, x, y, jac)."""
    least, q = sigma_meas * car, (sigma_jerk * car) ** 2

    def one(n: int, src: str) -> str:
        c = "m.d"
        h = f"({c} * {c} / 2)"
        a0, a1, a2 = f"(p00 + {c} * p01 + {h} * p02)", f"(p01 + {c} * p11 + {h} * p12)", f"(p02 + {c} * p12 + {h} * p22)"
        b1, b2 = f"(p11 + {c} * p12)", f"(p12 + {c} * p22)"
        places = ", ".join(f"{z}0 + {c} * {z}1 + {h} * {z}2 AS {z}0, {z}1 + {c} * {z}2 AS {z}1, {z}2" for z in "xy")
        taken = ", ".join(f"{z}{j} + p0{j} * e{z} AS {z}{j}" for z in "xy" for j in range(3))
        back = ", ".join(f"f{n}.{z}0 - (p00 * l{z}0 + p01 * l{z}1 + p02 * l{z}2) AS p{z}, f{n}.{z}1 - (p01 * l{z}0 + p11 * l{z}1 + p12 * l{z}2) AS pv{z}, l{z}0 - (g0 * l{z}0 + g1 * l{z}1 + g2 * l{z}2 + e{z}) AS l{z}0, l{z}1, l{z}2" for z in "xy")
        moved = ", ".join(f"p{z}, pv{z}, l{z}0, l{z}1 + d * l{z}0 AS l{z}1, l{z}2 + d * l{z}1 + d * d / 2 * l{z}0 AS l{z}2" for z in "xy")
        last = ", ".join(f"f{n}.{z}0 AS p{z}, f{n}.{z}1 AS pv{z}, -e{z} AS l{z}0, 0.0::DOUBLE AS l{z}1, 0.0::DOUBLE AS l{z}2" for z in "xy")
        return f"""m{n} AS (SELECT *, sig * sig AS r, power(50 * quantile_cont(sig, 0.5) OVER (PARTITION BY track_id), 2) AS wide FROM {src}),
f{n} AS (
  SELECT track_id, i, d, x::DOUBLE AS x0, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS x2, y::DOUBLE AS y0, 0.0::DOUBLE AS y1, 0.0::DOUBLE AS y2, r / 2 AS p00, 0.0::DOUBLE AS p01, 0.0::DOUBLE AS p02, wide AS p11, 0.0::DOUBLE AS p12, wide AS p22,
    0.5::DOUBLE AS g0, 0.0::DOUBLE AS g1, 0.0::DOUBLE AS g2, 0.0::DOUBLE AS ex, 0.0::DOUBLE AS ey FROM m{n} WHERE i = 0
  UNION ALL
  SELECT track_id, i, d, {taken}, p00 - g0 * p00, p01 - g0 * p01, p02 - g0 * p02, p11 - g1 * p01, p12 - g1 * p02, p22 - g2 * p02, g0, g1, g2, ex, ey
  FROM (SELECT *, p00 / (p00 + r) AS g0, p01 / (p00 + r) AS g1, p02 / (p00 + r) AS g2, (zx - x0) / (p00 + r) AS ex, (zy - y0) / (p00 + r) AS ey FROM (
    SELECT m.track_id, m.i, m.d, m.r, m.x AS zx, m.y AS zy, {places},
      {a0} + {c} * {a1} + {h} * {a2} + {q!r} * power({c}, 5) / 20 AS p00, {a1} + {c} * {a2} + {q!r} * power({c}, 4) / 8 AS p01, {a2} + {q!r} * power({c}, 3) / 6 AS p02,
      {b1} + {c} * {b2} + {q!r} * power({c}, 3) / 3 AS p11, {b2} + {q!r} * power({c}, 2) / 2 AS p12, p22 + {q!r} * {c} AS p22
    FROM f{n} f JOIN m{n} m ON m.track_id = f.track_id AND m.i = f.i + 1))),
g{n} AS (
  SELECT track_id, i, {moved} FROM (SELECT f{n}.track_id, f{n}.i, d, {last} FROM f{n} JOIN (SELECT track_id, max(i) AS i FROM m{n} GROUP BY track_id) z ON z.track_id = f{n}.track_id AND z.i = f{n}.i)
  UNION ALL
  SELECT track_id, i, {moved} FROM (SELECT f{n}.track_id, f{n}.i, f{n}.d, {back} FROM g{n} g JOIN f{n} ON f{n}.track_id = g.track_id AND f{n}.i = g.i - 1))"""

    return f"""s1 AS (SELECT track_id, k, t, x, y, row_number() OVER w - 1 AS i, coalesce(t - lag(t) OVER w, 0)::DOUBLE AS d, {least!r} * greatest(jac, 1.0) AS sig FROM {source} WINDOW w AS (PARTITION BY track_id ORDER BY k)),
{one(1, "s1")},
res AS (SELECT s1.*, sqrt(power(x - px, 2) + power(y - py, 2)) AS miss FROM s1 JOIN g1 USING (track_id, i)),
s2 AS (SELECT track_id, k, t, x, y, i, d, greatest(sig, quantile_cont(miss, 0.5) OVER (PARTITION BY track_id ORDER BY t RANGE BETWEEN {window_s} PRECEDING AND {window_s} FOLLOWING), {least!r}) AS sig FROM res),
{one(2, "s2")},
{out} AS (SELECT track_id, k, t, px AS x, py AS y, pvx AS vx, pvy AS vy, sqrt(pvx * pvx + pvy * pvy) AS speed FROM s2 JOIN g2 USING (track_id, i))"""


def hysteresis(source: str, out: str, low: float, high: float) -> str:
    return f"{out} AS (SELECT *, coalesce(last_value(CASE WHEN speed < {low!r} THEN true WHEN speed > {high!r} THEN false END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY k), false) AS stopped FROM {source})"


def absorbed(source: str, out: str, least: int) -> str:
    """``out`` (track_id, run_no, stopped, f0, f1): the runs of ``source`` (track_id, k, stopped) after absorption, one absorption a step."""
    near = "rs[j - 1].s = rs[j + 1].s"
    return f"""{out}_i AS (SELECT track_id, k, stopped, row_number() OVER (PARTITION BY track_id ORDER BY k) AS i FROM {source}),
{out}_c AS (SELECT *, CASE WHEN lag(stopped) OVER (PARTITION BY track_id ORDER BY i) = stopped THEN 0 ELSE 1 END AS c FROM {out}_i),
{out}_n AS (SELECT *, sum(c) OVER (PARTITION BY track_id ORDER BY i) AS n FROM {out}_c),
{out}_l AS (SELECT track_id, list({{'s': s, 'a': a, 'b': b}} ORDER BY a) AS rs FROM (SELECT track_id, n, any_value(stopped) AS s, min(i) AS a, max(i) AS b FROM {out}_n GROUP BY track_id, n) GROUP BY track_id),
{out}_r AS (
  SELECT track_id, 0 AS step, rs FROM {out}_l
  UNION ALL
  SELECT track_id, step + 1, CASE
    WHEN j > 1 AND j < len(rs) AND {near} THEN list_concat(list_concat(rs[:j - 2], [{{'s': rs[j - 1].s, 'a': rs[j - 1].a, 'b': rs[j + 1].b}}]), rs[j + 2:])
    WHEN j > 1 THEN list_concat(list_concat(rs[:j - 2], [{{'s': rs[j - 1].s, 'a': rs[j - 1].a, 'b': rs[j].b}}]), rs[j + 1:])
    ELSE list_concat([{{'s': rs[2].s, 'a': rs[1].a, 'b': rs[2].b}}], rs[3:]) END
  FROM (SELECT *, list_position(list_transform(rs, lambda r: r.b - r.a + 1 < {least}), true) AS j FROM {out}_r) WHERE j > 0 AND len(rs) > 1),
{out}_z AS (SELECT track_id, arg_max(rs, step) AS rs FROM {out}_r GROUP BY track_id),
{out}_u AS (SELECT track_id, unnest(range(1, len(rs) + 1)) AS n, unnest(rs) AS r FROM {out}_z),
{out} AS (SELECT u.track_id, (n - 1)::INT AS run_no, r.s AS stopped, p.k AS f0, q.k AS f1 FROM {out}_u u JOIN {out}_i p ON p.track_id = u.track_id AND p.i = r.a JOIN {out}_i q ON q.track_id = u.track_id AND q.i = r.b)"""


def onsets(samples: str, runs: str, out: str, v_stop: float, min_path: float, min_seconds: float) -> str:
    """``out`` (track_id, frame, t, x, y): stopped runs after a moving one of enough path and time."""
    return f"""{out}_p AS (SELECT *, lag(f0) OVER w AS p0, lag(f1) OVER w AS p1 FROM {runs} WINDOW w AS (PARTITION BY track_id ORDER BY run_no)),
{out}_s AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS step, lag(t) OVER w AS pt, lag(speed) OVER w AS pv FROM {samples} WINDOW w AS (PARTITION BY track_id ORDER BY k)),
{out}_o AS (SELECT c.track_id, c.run_no, c.f0, sum(CASE WHEN s.k <= c.p1 AND s.k > c.p0 THEN step END) AS path, max(CASE WHEN s.k <= c.p1 THEN s.t END) - min(s.t) AS seconds,
  max(CASE WHEN s.k = c.f0 THEN s.t END) AS t, max(CASE WHEN s.k = c.f0 THEN s.speed END) AS v, max(CASE WHEN s.k = c.f0 THEN s.pt END) AS pt, max(CASE WHEN s.k = c.f0 THEN s.pv END) AS pv, max(CASE WHEN s.k = c.f0 THEN s.x END) AS x, max(CASE WHEN s.k = c.f0 THEN s.y END) AS y
  FROM {out}_p c JOIN {out}_s s ON s.track_id = c.track_id AND s.k BETWEEN c.p0 AND c.f0 WHERE c.stopped AND c.p0 IS NOT NULL GROUP BY c.track_id, c.run_no, c.f0),
{out} AS (SELECT track_id, f0 AS frame, CASE WHEN pv > {v_stop!r} AND v < {v_stop!r} THEN pt + (pv - {v_stop!r}) / (pv - v) * (t - pt) ELSE t END AS t, x, y FROM {out}_o WHERE path >= {min_path!r} AND seconds >= {min_seconds!r})"""


def wavelets(samples: str, events: str, out: str, fps: float, scales=(0.16, 0.24, 0.36, 0.54, 0.8), search=(-2.0, 0.5)) -> str:
    """``out`` (track_id, frame, t_wav) for ``events`` (track_id, frame): the greatest wavelet energy, a sample a row."""
    values = ", ".join(f"({j}, {max(w * fps, 1.5)!r}::DOUBLE, {int(10 * max(w * fps, 1.5)) // 2})" for j, w in enumerate(scales))
    return f"""{out}_i AS (SELECT track_id, k, t, speed, row_number() OVER (PARTITION BY track_id ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY track_id) AS n FROM {samples}),
{out}_e AS (SELECT e.track_id, e.frame, i.i AS spot, i.n FROM {events} e JOIN {out}_i i ON i.track_id = e.track_id AND i.k = e.frame),
{out}_p AS (SELECT *, unnest(range(greatest(0, spot + {int(search[0] * fps)} - 1), least(n, spot + {int(search[1] * fps)} + 2))) AS i FROM {out}_e),
{out}_w(j, a, half) AS (VALUES {values}),
{out}_c AS (SELECT p.track_id, p.frame, p.spot, p.n, p.i, w.j, sum(s.speed * 2 / sqrt(3 * w.a) / power(pi(), 0.25) * (1 - power((s.i - p.i) / w.a, 2)) * exp(-power((s.i - p.i) / w.a, 2) / 2)) AS c
  FROM {out}_p p CROSS JOIN {out}_w w JOIN {out}_i s ON s.track_id = p.track_id AND abs(s.i - p.i) <= least(w.half, (p.n - 1) // 2) GROUP BY ALL),
{out}_g AS (SELECT track_id, frame, spot, n, i, sum(c * c) AS e FROM {out}_c GROUP BY ALL),
{out}_b AS (SELECT track_id, frame, n, count(*) AS wide, arg_max(i, {{'e': e, 'i': -i}}) AS i FROM {out}_g WHERE i BETWEEN spot + {int(search[0] * fps)} AND spot + {int(search[1] * fps)} GROUP BY ALL),
{out}_h AS (SELECT b.*, l.e AS el, h.e AS eh, r.e AS er FROM {out}_b b JOIN {out}_g h USING (track_id, frame, i) LEFT JOIN {out}_g l ON l.track_id = b.track_id AND l.frame = b.frame AND l.i = b.i - 1 LEFT JOIN {out}_g r ON r.track_id = b.track_id AND r.frame = b.frame AND r.i = b.i + 1),
{out}_s AS (SELECT *, i + CASE WHEN i > 0 AND i < n - 1 AND el - 2 * eh + er < 0 THEN greatest(-0.5, least(0.5, (el - er) / (2 * (el - 2 * eh + er)))) ELSE 0 END AS p FROM {out}_h WHERE n >= 8 AND wide >= 3),
{out} AS (SELECT s.track_id, s.frame, u.t + (coalesce(v.t, u.t) - u.t) * (s.p - u.i) AS t_wav FROM {out}_s s JOIN {out}_i u ON u.track_id = s.track_id AND u.i = floor(s.p) LEFT JOIN {out}_i v ON v.track_id = s.track_id AND v.i = floor(s.p) + 1)"""


def refractory(source: str, out: str, seconds: float) -> str:
    """``out``: the accepted rows of ``source`` (track_id, k, t), the last accepted time carried from row to row."""
    return f"""{out}_i AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t, k) AS i FROM {source}),
{out}_r AS (
  SELECT track_id, k, t, i, t AS last, true AS ok FROM {out}_i WHERE i = 1
  UNION ALL
  SELECT e.track_id, e.k, e.t, e.i, CASE WHEN e.t - r.last >= {seconds!r} THEN e.t ELSE r.last END, e.t - r.last >= {seconds!r} FROM {out}_r r JOIN {out}_i e ON e.track_id = r.track_id AND e.i = r.i + 1),
{out} AS (SELECT track_id, k, t FROM {out}_r WHERE ok)"""


def screened(source: str, out: str, limit: float) -> str:
    """``out``: the rows of ``source`` (track_id, frame, x, y) within reach of the last kept one."""
    near = f"sqrt(power(e.x - r.lx, 2) + power(e.y - r.ly, 2)) <= {limit!r} * (e.frame - r.lf)"
    return f"""{out}_i AS (SELECT track_id, frame, x::DOUBLE AS x, y::DOUBLE AS y, row_number() OVER (PARTITION BY track_id ORDER BY frame) AS i FROM {source}),
{out}_r AS (
  SELECT track_id, frame, x, y, i, x AS lx, y AS ly, frame AS lf, true AS ok FROM {out}_i WHERE i = 1
  UNION ALL
  SELECT e.track_id, e.frame, e.x, e.y, e.i, CASE WHEN {near} THEN e.x ELSE r.lx END, CASE WHEN {near} THEN e.y ELSE r.ly END, CASE WHEN {near} THEN e.frame ELSE r.lf END, {near}
  FROM {out}_r r JOIN {out}_i e ON e.track_id = r.track_id AND e.i = r.i + 1),
{out} AS (SELECT track_id, frame, x, y FROM {out}_r WHERE ok)"""


def three_states(source: str, out: str, v_stop: float, v_move: float, hold: int, stop_out: float = 1.8, brake_in: float = 1.7, brake_out: float = 2.2) -> str:
    """``out`` (track_id, k, state): committed states; ``pe`` is the pending one, the committed one where none is."""

    def to(v: str, ref: str) -> str:
        held = f"CASE WHEN {v} <= {brake_out * v_move!r} THEN 'braking' ELSE 'rolling' END"
        return f"CASE WHEN {ref} = 'stopped' THEN CASE WHEN {v} <= {stop_out * v_stop!r} THEN 'stopped' ELSE {held} END WHEN {v} < {v_stop!r} THEN 'stopped' WHEN {ref} = 'braking' THEN {held} WHEN {v} < {brake_in * v_move!r} THEN 'braking' ELSE 'rolling' END"

    done = f"go <> st AND go = pe AND ct + 1 >= {hold}"
    return f"""{out}_i AS (SELECT track_id, k, speed, row_number() OVER (PARTITION BY track_id ORDER BY k) AS i FROM {source}),
{out}_r AS (
  SELECT track_id, k, i, st, st AS pe, 0 AS ct FROM (SELECT *, {to('speed', "'rolling'")} AS st FROM {out}_i WHERE i = 1)
  UNION ALL
  SELECT track_id, k, i, CASE WHEN {done} THEN go ELSE st END, go, CASE WHEN go = st THEN 0 WHEN go = pe THEN ct + 1 ELSE 1 END
  FROM (SELECT e.track_id, e.k, e.i, r.st, r.pe, r.ct, {to('e.speed', 'r.pe')} AS go FROM {out}_r r JOIN {out}_i e ON e.track_id = r.track_id AND e.i = r.i + 1)),
{out} AS (SELECT track_id, k, st AS state FROM {out}_r)"""
