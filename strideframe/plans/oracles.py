"""DuckDB SQL that states what the queries compute, over the same tables."""

from __future__ import annotations

from .. import layouts
from ..operators.cameras import fundamentals
from ..sources.adapters import BODY21, CAMERAS


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(str, r)) + ")" for r in rows)


SKELETON = f"""raw as (select label::bigint as seq_id, (row_number() over (partition by label order by vec_id) - 1)::int as frame, embedding from embeddings),
names(k, joint) as (values {_values(enumerate(BODY21))}),
xyz as (select seq_id, frame, joint::int as joint, embedding[3 * k + 1]::double * 1000 as ax, embedding[3 * k + 2]::double * 1000 as ay, embedding[3 * k + 3]::double * 1000 as az from raw, names),
pts as (select seq_id, frame, joint, case when abs(ax) >= 5 then ax end as x, case when abs(ax) >= 5 then ay end as y, case when abs(ax) >= 5 then az end as z from xyz)"""

# The same, computed once each however often a query names them.
HELD = SKELETON.replace("raw as (", "raw as materialized (").replace("pts as (", "pts as materialized (")

CHANNEL = """chan as (select user_id as seq_id, (row_number() over (partition by user_id order by ts, event_id) - 1)::int as frame, epoch(ts)::double as t,
case when event_type <> 'error' then value::double end as v from events)"""

STAMPS = "stamps as (select event_type as cam, (row_number() over (partition by event_type order by ts, event_id) - 1)::int as frame, (epoch_us(ts)::double / 1e6) as t from events)"

DETS = """dets as (select l_orderkey as frame, (l_linenumber % 3)::int as cam,
(row_number() over (partition by l_orderkey, l_linenumber % 3 order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1)::int as det_pos,
(l_quantity * 20)::double as cx, (l_extendedprice / 100)::double as cy, (l_quantity + 40)::double as w, (l_quantity * 2 + 60)::double as h, abs(l_discount * 10)::double as conf from lineitem)"""

MOVES = SKELETON + """,
lagged as (select *, case when lag(frame) over j = frame - 1 then lag(x) over j end as px, case when lag(frame) over j = frame - 1 then lag(y) over j end as py,
case when lag(frame) over j = frame - 1 then lag(z) over j end as pz from pts window j as (partition by seq_id, joint order by frame)),
mv as (select *, sqrt((x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz)) as step from lagged)"""

_P = [f"p{k + 1}" for k in range(12)]
OBS = SKELETON + f""",
cams(cam, {", ".join(_P)}) as (values {_values([(c, *p) for c, p in CAMERAS])}),
hom as (select seq_id, cam::int as cam, frame, joint, p1 * x + p2 * y + p3 * z + p4 as hu, p5 * x + p6 * y + p7 * z + p8 as hv, p9 * x + p10 * y + p11 * z + p12 as hw from pts, cams),
obs as (select seq_id, cam, frame, joint, case when abs(hw) > 1e-10 then hu / hw end as u, case when abs(hw) > 1e-10 then hv / hw end as v, ((joint * 7 + frame * 3 + cam * 5) % 10 + 1) / 10.0 as conf from hom)"""


def bones(pairs) -> str:
    return f"bones(ord, parent, child) as (values {_values([(k, p, c) for k, (p, c) in enumerate(pairs)])}), lens as (select a.seq_id, a.frame, b.ord, b.parent, b.child, sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y) + (a.z - c.z) * (a.z - c.z)) as length from bones b join pts a on a.joint = b.parent join pts c on c.seq_id = a.seq_id and c.frame = a.frame and c.joint = b.child)"


SLOW_FEET = """ft as (select seq_id, frame, case when joint in (27, 29, 31) then 'left' else 'right' end side, avg(x) x, avg(y) y, avg(z) z from pts where joint in (27, 28, 29, 30, 31, 32) group by all),
n as (select *, lag(frame) over j pf, lead(frame) over j nf, lag(x) over j px, lead(x) over j nx, lag(y) over j py, lead(y) over j ny, lag(z) over j pz, lead(z) over j nz from ft window j as (partition by seq_id, side order by frame)),
v as (select *, 30 * ((case when nf is null then x else nx end) - (case when pf is null then x else px end)) / (coalesce(nf, frame) - coalesce(pf, frame)) vx, 30 * ((case when nf is null then y else ny end) - (case when pf is null then y else py end)) / (coalesce(nf, frame) - coalesce(pf, frame)) vy, 30 * ((case when nf is null then z else nz end) - (case when pf is null then z else pz end)) / (coalesce(nf, frame) - coalesce(pf, frame)) vz from n),
s as (select *, sqrt(vx * vx + vy * vy + vz * vz) sp from v), l as (select seq_id, side, greatest(quantile_cont(sp, 0.25), 0.5) lim from s group by all),
g as (select s.*, frame - row_number() over (partition by s.seq_id, s.side order by frame) g from s join l on l.seq_id = s.seq_id and l.side = s.side where sp < lim)"""

RIGID = bones(layouts.RIGID_BONES)
NAMED = bones(layouts.NAMED_BONES)
OUTLIER = bones(layouts.OUTLIER_BONES)

SCENE = OBS + """,
scene as (select (frame // 20)::bigint as seq_id, frame % 20 as frame, cam, ((seq_id * 3 + cam * 7) % 10)::int as det_pos, joint, u, v, conf, seq_id as person from obs where u is not null and v is not null)"""
_F = [f"f{k}" for k in range(9)]
PAIRS = f"fund(cam_a, cam_b, {', '.join(_F)}) as (values {_values([(a, b, *[repr(float(x)) + '::double' for x in f.ravel()]) for (a, b), f in fundamentals(CAMERAS).items()])})"

# Sound: events' values as samples, eight to a window; peaks over the median, kept five windows apart by recursion.
LEVELS = """smp as (select event_type as cam, row_number() over (partition by event_type order by ts, event_id) - 1 as idx, value::double as v from events),
sz as (select cam, count(*) n from smp group by cam),
lev as materialized (select s.cam, s.idx // 8 as win, avg(v * v) e, 10 * log10(greatest(avg(v * v), 1e-10)) db from smp s join sz on sz.cam = s.cam where s.idx // 8 < n // 8 or n < 8 group by all),
med as materialized (select cam, quantile_cont(db, 0.5) as median from lev group by cam),
loc as materialized (select n.cam, win, e, db, median, db - median as over_ from (select *, lag(db) over w a, lead(db) over w b from lev window w as (partition by cam order by win)) n join med on med.cam = n.cam where db > a and db >= b),
lim as (select cam, case when max(over_) > 2.0 then 2.0 else 1.0 end as lim from loc group by cam),
pk as materialized (select l.*, row_number() over (partition by l.cam order by win) as k from loc l join lim on lim.cam = l.cam where over_ > lim),
walk as (select cam, k, win, e, db, median, win as last, true as kept from pk where k = 1
union all select p.cam, p.k, p.win, p.e, p.db, p.median, case when p.win - w.last >= 5 then p.win else w.last end, p.win - w.last >= 5 from walk w join pk p on p.cam = w.cam and p.k = w.k + 1)"""


def _lens_columns() -> str:
    from .queries import LENSES

    rows = [(cam, *(f"{float(k[i])!r}::double" for i in (0, 4, 2, 5)), *(f"{x!r}::double" for x in [*dist, *[0.0] * 8][:8])) for cam, k, dist in LENSES]
    return f"lens(cam, fx, fy, cx, cy, k1, k2, p1, p2, k3, k4, k5, k6) as (values {_values(rows)})"


# Floors of rooms and the arrangements of four cameras that are tried on them.
ROOMS = SKELETON + """,
rooms as materialized (select seq_id as room, round(3 + (max(x) - min(x)) / 200, 1) as w, round(3 + (max(z) - min(z)) / 200, 1) as d from pts group by seq_id),
dim as (select *, greatest(2, floor(w / 0.2)::int) as nx, greatest(2, floor(d / 0.2)::int) as ny from rooms),
cells as materialized (select room, w * i / (nx - 1) as x, d * j / (ny - 1) as y, w, d from dim, range(1000) a(i), range(1000) b(j) where i < nx and j < ny),
four as (select unnest(range(4)) as cam),
ring as (select room, 0 as ord, 'circle_equal' as arrangement, cam, w / 2 + least(w, d) * 0.42 * cos(2 * pi() * cam / 4) as x, d / 2 + least(w, d) * 0.42 * sin(2 * pi() * cam / 4) as y, w, d from rooms, four
union all select room, 1, 'circle_alternating', cam, w / 2 + least(w, d) * 0.42 * (0.85 + 0.15 * (cam % 2)) * cos(2 * pi() * cam / 4 + pi() / 4), d / 2 + least(w, d) * 0.42 * (0.85 + 0.15 * (cam % 2)) * sin(2 * pi() * cam / 4 + pi() / 4), w, d from rooms, four
union all select room, 1000 + ord, 'random_optimized', cam, w / 2 + least(w, d) * (0.35::double + ((ord * 613 + cam * 257 + 11) * 1103515245 % 2147483648) / 2147483648.0::double * 0.13::double) * cos(2 * pi() * cam / 4 + (((ord * 977 + cam * 131 + 7) * 1103515245 % 2147483648) / 2147483648.0::double * 0.6::double - 0.3::double)),
d / 2 + least(w, d) * (0.35::double + ((ord * 613 + cam * 257 + 11) * 1103515245 % 2147483648) / 2147483648.0::double * 0.13::double) * sin(2 * pi() * cam / 4 + (((ord * 977 + cam * 131 + 7) * 1103515245 % 2147483648) / 2147483648.0::double * 0.6::double - 0.3::double)), w, d from rooms, four, range(30) r(ord)),
aimed as (select room, ord, arrangement, cam, case when ord >= 1000 then greatest(0.3, least(w - 0.3, x)) else x end as x, case when ord >= 1000 then greatest(0.3, least(d - 0.3, y)) else y end as y, degrees(atan2(d / 2 - y, w / 2 - x)) as yaw from ring
union all select room, 2, 'wall_opposite', cam, case cam when 0 then 0.3 when 1 then w - 0.3 else w / 2 end, case cam when 2 then 0.3 when 3 then d - 0.3 else d / 2 end, case cam when 0 then 0 when 1 then 180 when 2 then 90 else -90 end from rooms, four
union all select room, 3, 'corners_plus_center', cam, case when cam in (0, 3) then 0.5 else w - 0.5 end, case when cam in (0, 1) then 0.5 else d - 0.5 end, case cam when 0 then 45 when 1 then 135 when 2 then -135 else -45 end from rooms, four),
axes as materialized (select *, cos(radians(-15)) * cos(radians(yaw)) as ax, cos(radians(-15)) * sin(radians(yaw)) as ay, sin(radians(-15)) as az from aimed),
hit as (select c.room, a.ord, c.x, c.y, c.w, c.d, count(*) filter (dist between 0.5 and 10 and degrees(acos(greatest(-1, least(1, (ax * dx + ay * dy + az * -2.5) / dist)))) <= 35) as n
from (select room, x, y, w, d from cells) c join lateral (select ord, ax, ay, az, c.x - a.x as dx, c.y - a.y as dy, sqrt((c.x - a.x) * (c.x - a.x) + (c.y - a.y) * (c.y - a.y) + 6.25) as dist from axes a where a.room = c.room) a on true group by all),
tot as (select room, ord, count(*) as total_cells, 100.0 * count(*) filter (n >= 1) / count(*) as c1, 100.0 * count(*) filter (n >= 2) / count(*) as c2, 100.0 * count(*) filter (n >= 3) / count(*) as c3,
100.0 * count(*) filter (n >= 2 and x between w / 4 and w * 3 / 4 and y between d / 4 and d * 3 / 4) / greatest(1, count(*) filter (x between w / 4 and w * 3 / 4 and y between d / 4 and d * 3 / 4)) as cc from hit group by all),
sc as (select *, round_even((0.30::double * c1 + 0.35::double * c2 + 0.15::double * c3 + 0.20::double * cc) / 100.0, 4) as score from tot),
top as (select * from sc qualify row_number() over (partition by room order by score desc, ord) = 1)"""

# What is true of the scene: poses of one person match, at the cost and confidence that the cameras' geometry gives.
MATCHES = SCENE + f""", {PAIRS}, own as materialized (select * from scene where conf > 0.3), det as materialized (select seq_id, frame, cam, det_pos, avg(conf) s from scene group by all),
la as materialized (select o.*, f.*, f0 * u + f1 * v + f2 x0, f3 * u + f4 * v + f5 x1, f6 * u + f7 * v + f8 x2 from own o join fund f on f.cam_a = o.cam),
sam as (select a.seq_id, a.frame, a.cam_a, a.cam_b, a.det_pos as i, b.det_pos as j, sqrt((b.u * x0 + b.v * x1 + x2) ** 2 / greatest(x0 * x0 + x1 * x1 + (f0 * b.u + f3 * b.v + f6) ** 2 + (f1 * b.u + f4 * b.v + f7) ** 2, 1e-12)) e, sqrt((a.u - b.u) ** 2 + (a.v - b.v) ** 2) d
from la a join own b on b.seq_id = a.seq_id and b.frame = a.frame and b.joint = a.joint and b.cam = a.cam_b and b.person = a.person),
co as materialized (select seq_id, frame, cam_a, cam_b, i, j, avg(e) epi, exp(-avg(d) / 50) alike from sam group by all having avg(e) <= 5),
mat as materialized (select c.*, epi * (2 - alike) as cost, 0.3 * (p.s + q.s) / 2 + 0.4 * greatest(0, 1 - epi / 5) + 0.3 * alike as confidence from co c
join det p on p.seq_id = c.seq_id and p.frame = c.frame and p.cam = c.cam_a and p.det_pos = c.i join det q on q.seq_id = c.seq_id and q.frame = c.frame and q.cam = c.cam_b and q.det_pos = c.j),
both_ as materialized (select a.seq_id, a.frame, cam_a, cam_b from fund join (select distinct seq_id, frame, cam from det) a on a.cam = cam_a join (select distinct seq_id, frame, cam from det) b on b.cam = cam_b and b.seq_id = a.seq_id and b.frame = a.frame),
lone as materialized (select b.seq_id, b.frame, b.cam_a, b.cam_b, d.cam, d.det_pos from both_ b join det d on d.seq_id = b.seq_id and d.frame = b.frame and d.cam in (b.cam_a, b.cam_b)
where not exists (select 1 from mat m where m.seq_id = b.seq_id and m.frame = b.frame and m.cam_a = b.cam_a and m.cam_b = b.cam_b and ((d.cam = m.cam_a and d.det_pos = m.i) or (d.cam = m.cam_b and d.det_pos = m.j))))"""


def _health(errors: str, window: int, sigmas: float) -> str:
    """Calibration health over a table of errors (seq_id, frame, v)."""
    return f"""er as materialized (select *, row_number() over (partition by seq_id order by frame) k, count(*) over (partition by seq_id) n from ({errors}) where v is not null),
ba as materialized (select seq_id, avg(v) m, greatest(stddev_pop(v), 1e-8) sd from er where k <= {window} group by seq_id),
hi as (select e.seq_id, k - row_number() over (partition by e.seq_id order by k) run, (v - m) / sd as o from er e join ba on ba.seq_id = e.seq_id where v > m + {sigmas} * sd),
sg as (select seq_id, run, max(o) as sev from hi group by all), sq as (select seq_id, count(*) signals, max(sev) severity from sg group by all),
hs as (select seq_id, avg(v) mean_error, any_value(n) n, avg(v) filter (k <= n // 2) a, avg(v) filter (k > n // 2) b from er group by all)
select h.seq_id, case when severity > {2 * sigmas} then 'unreliable' when signals > 0 then 'drift_detected' else 'ok' end as status, round(mean_error, 6) as mean_error,
case when n <= {window} then 'stable' when b > a * 1.2 then 'increasing' when b < a * 0.8 then 'decreasing' else 'stable' end as trend, coalesce(signals, 0) as signals, round(severity, 6) as severity from hs h left join sq on sq.seq_id = h.seq_id"""


def _drift(metrics: str, first: int, last: int, limits: tuple[float, float, float]) -> str:
    """The drift report over a table of metrics (seq_id, frame, n_detections, confidence, completeness)."""
    drops = {"confidence": "greatest(0.01, base_confidence)", "completeness": "greatest(0.01, base_completeness)", "n_detections": "case when base_n_detections > 0 then base_n_detections end"}
    over = lambda k: " + ".join(f"coalesce(((base_{c} - {c}) / {of} > {k * limit!r})::int, 0)" for (c, of), limit in zip(drops.items(), limits, strict=True))
    return f"""me as materialized (select *, row_number() over (partition by seq_id order by frame) k, row_number() over (partition by seq_id order by frame desc) back from ({metrics})),
ba as materialized (select seq_id, avg(confidence) base_confidence, avg(completeness) base_completeness, avg(n_detections) base_n_detections from me where k <= {first} group by seq_id having count(*) = {first}),
ju as (select m.*, base_confidence, base_completeness, base_n_detections, {over(2)} as high, {over(1)} as every from me m left join ba on ba.seq_id = m.seq_id),
su as (select seq_id, count(*) frames, any_value(base_confidence) bc, any_value(base_completeness) bp, any_value(base_n_detections) bn, round_even(avg(confidence) filter (back <= {last}), 4) nc, round_even(avg(completeness) filter (back <= {last}), 4) np,
coalesce(sum(high) filter (k >= {first}), 0)::bigint high_alerts, coalesce(sum(every - high) filter (k >= {first}), 0)::bigint moderate_alerts from ju group by seq_id),
sc as (select *, coalesce(round_even(round(abs(bc - nc) * 50 + abs(bp - np) * 50, 9), 3), 0) as score from su)
select seq_id, frames, round(bc, 3) as base_confidence, round(bp, 3) as base_completeness, round(bn, 3) as base_n_detections, round(nc, 3) as now_confidence, round(np, 3) as now_completeness, high_alerts, moderate_alerts, score,
case when score < 0.05 then 'stable' when score < 0.15 then 'minor' when score < 0.30 then 'moderate' else 'significant' end as level from sc"""


ORACLES: dict[str, str] = {
    "pose_matches": f"with {MATCHES} select seq_id, frame, cam_a::int as cam_a, cam_b::int as cam_b, i, j, round(cost, 4) + 0.0 as cost, round(confidence, 4) as confidence, confidence < 0.6 as ambiguous from mat",
    "unmatched_detections": f"with {MATCHES} select seq_id, frame, cam_a::int as cam_a, cam_b::int as cam_b, cam, det_pos from lone",
    "pair_statistics": f"""with {MATCHES} select f.cam_a::int as cam_a, f.cam_b::int as cam_b, (select count(*) from both_ b where b.cam_a = f.cam_a and b.cam_b = f.cam_b) as frames,
(select count(*) from mat m where m.cam_a = f.cam_a and m.cam_b = f.cam_b) as matches, round((select count(*) from mat m where m.cam_a = f.cam_a and m.cam_b = f.cam_b) / (select count(*) from both_ b where b.cam_a = f.cam_a and b.cam_b = f.cam_b), 6) as per_frame,
(select count(*) from mat m where m.cam_a = f.cam_a and m.cam_b = f.cam_b and confidence >= 0.6) as confident, (select count(*) from mat m where m.cam_a = f.cam_a and m.cam_b = f.cam_b and confidence < 0.6) as ambiguous,
(select count(*) from lone m where m.cam_a = f.cam_a and m.cam_b = f.cam_b) as unmatched from fund f""",
    "crossing_statistics": f"""with {MATCHES}, pe as materialized (select (frame // 20)::bigint as seq_id, frame % 20 as frame, seq_id as person, x, y, z from pts where joint = 0 and x is not null),
le as (select a.seq_id, a.frame, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) < 150 as crossing from pe a join pe b on b.seq_id = a.seq_id and b.frame = a.frame and a.person < b.person group by all)
select crossing, count(*) as total, count(*) filter (confidence >= 0.6) as confident, count(*) filter (confidence < 0.6) as ambiguous, round(100 * count(*) filter (confidence >= 0.6) / count(*), 6) as confident_percent from mat m join le on le.seq_id = m.seq_id and le.frame = m.frame group by crossing""",
    "drift_report": f"""with {DETS}, {_drift("select cam as seq_id, frame, count(*) n_detections, round_even(avg(conf), 4) as confidence, 1.0::double as completeness from dets group by all", 30, 50, (0.15, 0.20, 0.30))}""",
    "skeleton_drift": f"""with {SKELETON}, {_drift("select seq_id, frame, (count(x) > 0)::bigint n_detections, round_even(count(x) / count(*), 4) as confidence, round_even(count(x) / count(*), 4) as completeness from pts group by all", 10, 15, (0.03, 0.04, 0.3))}""",
    "calibration_health": f"with {CHANNEL}, {_health('select seq_id, frame, v from chan', 10, 1.0)}",
    "trajectory_health": f"""with {MOVES}, ch as (select *, abs(lead(step) over (partition by seq_id, joint order by frame) - step) c from mv), en as (select seq_id, min(frame) a, max(frame) b from pts group by seq_id),
ro as (select ch.seq_id, ch.frame, case when ch.frame = any_value(a) or ch.frame = any_value(b) then 0 else avg(c) end as v from ch join en on en.seq_id = ch.seq_id group by ch.seq_id, ch.frame), {_health('select seq_id, frame, v from ro', 10, 1.5)}""",
    # The p-value by the power series of the incomplete beta function in the squared correlation.
    "deblur_impact": f"""with recursive {CHANNEL}, dq as (select seq_id, frame, v, t - lag(t) over (partition by seq_id order by frame) as q from chan), rw as materialized (select * from dq where v is not null and q is not null),
st as materialized (select seq_id, count(*) n, corr(v, q) r, quantile_cont(q, 0.25) q25, quantile_cont(v, 0.25) v25 from rw group by seq_id),
lo as (select rw.seq_id, quantile_cont(v, 0.75) l from rw join st on st.seq_id = rw.seq_id where q < q25 group by rw.seq_id),
se as (select seq_id, (n - 2) / 2.0::double as a, r * r as x, 1.0::double as term, 0 as k, 2.0::double as total from st where n >= 3 and r is not null and abs(r) < 1
union all select seq_id, a, x, term * (k + 1 - a) / (k + 1) * x, k + 1, total + term * (k + 1 - a) / (k + 1) * x / (k + 1.5::double) from se where k < 300),
pv as (select seq_id, 1 - sqrt(x) * total * exp(lgamma(a + 0.5::double) - lgamma(a) - lgamma(0.5::double)) as p from se where k = 300),
fi as (select st.seq_id, n, r, coalesce(l, v25) th, p from st left join lo on lo.seq_id = st.seq_id left join pv on pv.seq_id = st.seq_id)
select seq_id, n, round(r, 6) + 0.0 as correlation, round(th, 6) as threshold, round(p, 6) + 0.0 as p_value, case when abs(r) > 0.5 and p < 0.05 then 'deblur likely helps' when abs(r) > 0.25 and p < 0.1 then 'marginal benefit' else 'not recommended' end as advice from fi""",
    "cross_tracker": f"""with {HELD}, cams(cam, {", ".join(_P)}) as (values {_values([(c, *p) for c, p in CAMERAS])}),
tw as (select seq_id, frame, joint, 0 as who, x, y, z from pts union all select seq_id, frame, joint, 1, x + 3 + joint % 4, y + 3 + joint % 4, z + 3 + joint % 4 from pts where (joint + frame) % 7 > 0),
ey as materialized (select seq_id, frame, joint, who, cam::int as cam, case when p9 * x + p10 * y + p11 * z + p12 > 1e-8 then (p1 * x + p2 * y + p3 * z + p4) / (p9 * x + p10 * y + p11 * z + p12) end as u, case when p9 * x + p10 * y + p11 * z + p12 > 1e-8 then (p5 * x + p6 * y + p7 * z + p8) / (p9 * x + p10 * y + p11 * z + p12) end as v from tw, cams where x is not null and z > 1e-8),
er as (select seq_id, cam, who, avg(sqrt((u - 180) ** 2 + (v - 135) ** 2) / 360 * 0.01) filter (u >= 0 and u < 360 and v >= 0 and v < 270) e from ey group by all),
di as (select a.seq_id, a.cam, avg(sqrt((a.u - b.u) ** 2 + (a.v - b.v) ** 2)) d from ey a join ey b on b.seq_id = a.seq_id and b.frame = a.frame and b.joint = a.joint and b.cam = a.cam and a.who = 0 and b.who = 1 group by all),
al_ as (select seq_id, cam, max(e) filter (who = 0) ea, max(e) filter (who = 1) eb from er group by all), li as (select seq_id, coalesce(quantile_cont(e, 0.75), 0) lim from er group by all), mo as (select seq_id, max(d) most from di group by all)
select a.seq_id, a.cam, round(ea, 6) as a_error, round(eb, 6) as b_error, round(d, 6) as distance, round(coalesce(greatest(0, least(1, 1 - most / 450.0::double)), 0), 6) as agreement, coalesce(ea > lim and eb > lim, false) as suspect
from al_ a left join di on di.seq_id = a.seq_id and di.cam = a.cam join li on li.seq_id = a.seq_id left join mo on mo.seq_id = a.seq_id""",
    "sync_peaks": f"with recursive {LEVELS} select cam, win, round(db, 6) as db, round(median, 6) as median from walk where kept",
    "sync_offsets": f"""with recursive {LEVELS},
best as (select cam, win, round_even(least(greatest((db - median) / 40, 0), 1), 4) as confidence from walk where kept qualify row_number() over (partition by cam order by db desc, win) = 1),
ref as (select cam as rc, win as rw from best order by confidence desc, cam limit 1),
o as (select c.cam, coalesce(rc, (select min(cam) from sz)) as reference, coalesce((win - rw) * 8, 0)::bigint as offset_samples, confidence, rc is null as none from (select distinct cam from lev) c left join best b on b.cam = c.cam left join ref on true),
m as (select max(abs(round_even(offset_samples / 100.0::double * 1000, 2))) as most from o)
select cam, reference, offset_samples, round_even(offset_samples / (100.0::double / 30), 0)::bigint as offset_frames, round(round_even(offset_samples / 100.0::double * 1000, 2), 6) as offset_ms, round(confidence, 6) as confidence, round(most, 6) as max_offset_ms,
case when none then 'no_pulses_found' when most < 5 / 30.0 then 'excellent' when most < 20 / 30.0 then 'good' when most < 60000 then 'acceptable' else 'poor' end as quality from o, m""",
    "camera_placement": f"""with {ROOMS}
select t.room, a.arrangement, t.score, round_even(c1, 1) as coverage, round_even(c2, 1) as coverage_2plus, round_even(c3, 1) as coverage_3plus, round_even(cc, 1) as central, total_cells, a.cam::int as cam,
round_even(a.x, 3) + 0.0 as x, round_even(a.y, 3) + 0.0 as y, 2.5::double as z, round_even(a.yaw, 1) + 0.0 as yaw, -15.0::double as pitch from top t join aimed a on a.room = t.room and a.ord = t.ord""",
    "missing_runs": f"""with {SKELETON}, g as (select seq_id || '/' || joint as k, frame, frame - row_number() over (partition by seq_id, joint order by frame) as run from pts where x is null)
select k, min(frame)::bigint as start, max(frame)::bigint as stop, count(*) as size from g group by k, run""",
    "processing_time": f"""with {SKELETON}, n as (select seq_id, count(distinct frame) as frames from pts group by seq_id)
select seq_id, frames, 3::int as cameras, round_even(frames / 25.0::double, 1) as duration_s, round_even(frames * 1.86::double * 3, 1) as processing_s, round_even(frames * 1.86::double * 3 / 60, 1) as processing_min,
round_even(frames * 1.86::double * 3 / greatest(1, frames / 25.0::double), 1) as realtime_factor from n""",
    "undistorted": f"""with recursive {OBS}, {_lens_columns()},
n0 as materialized (select seq_id, o.cam, frame, joint, (u - cx) / fx as bx, (v - cy) / fy as by_, l.* exclude (cam) from obs o join lens l on l.cam = o.cam),
it as (select *, bx as x, by_ as y, 0 as step from n0 where bx is not null
union all select * exclude (x, y, step), (bx - 2 * p1 * x * y - p2 * (x * x + y * y + 2 * x * x)) * (1 + (x * x + y * y) * (k4 + (x * x + y * y) * (k5 + (x * x + y * y) * k6))) / (1 + (x * x + y * y) * (k1 + (x * x + y * y) * (k2 + (x * x + y * y) * k3))),
(by_ - p1 * (x * x + y * y + 2 * y * y) - 2 * p2 * x * y) * (1 + (x * x + y * y) * (k4 + (x * x + y * y) * (k5 + (x * x + y * y) * k6))) / (1 + (x * x + y * y) * (k1 + (x * x + y * y) * (k2 + (x * x + y * y) * k3))), step + 1 from it where step < 30)
select seq_id, cam, frame, joint, round(x * fx + cx, 4) + 0.0 as u, round(y * fy + cy, 4) + 0.0 as v from it where step = 30
union all select seq_id, cam, frame, joint, null, null from n0 where bx is null""",
    "pair_costs": f"""with {SCENE}, {PAIRS}, own as materialized (select * from scene where joint in (0, 11, 12, 23, 24) and conf >= 0.3),
lines as materialized (select a.*, f.cam_a, f.cam_b, f0 * u + f1 * v + f2 as la, f3 * u + f4 * v + f5 as lb, f6 * u + f7 * v + f8 as lc from own a join fund f on f.cam_a = a.cam),
d as (select a.seq_id, a.frame, a.cam_a, a.cam_b, a.det_pos as i, b.det_pos as j, abs(la * b.u + lb * b.v + lc) / sqrt(la * la + lb * lb) as d
from lines a join own b on b.seq_id = a.seq_id and b.frame = a.frame and b.joint = a.joint and b.cam = a.cam_b where sqrt(la * la + lb * lb) >= 1e-10)
select seq_id, frame, cam_a::int as cam_a, cam_b::int as cam_b, i, j, round(quantile_cont(d, 0.5), 4) + 0.0 as cost from d group by all having count(*) >= 2""",
    "bone_length_stats": f"""with {SKELETON}, {NAMED}, own as (select * from lens where length is not null),
st as (select seq_id, parent, child, count(*) n, avg(length) m, quantile_cont(length, 0.5) med, stddev_pop(length) sd from own group by all)
select o.seq_id, o.parent::int as parent, o.child::int as child, any_value(n)::bigint as n, round(any_value(m), 6) as mean_length, round(any_value(med), 6) as median_length, round(any_value(sd), 6) as std_length,
round(avg((abs(length - med) / med > 0.5)::int), 6) as off_share from own o join st on o.seq_id = st.seq_id and o.parent = st.parent and o.child = st.child group by all""",
    "gap_fill_linear": f"""with {CHANNEL},
near as (select *, last_value(v ignore nulls) over a as pv, last_value(case when v is not null then frame end ignore nulls) over a as pf, first_value(v ignore nulls) over b as nv, first_value(case when v is not null then frame end ignore nulls) over b as nf, count(v) over (partition by seq_id) as k
from chan window a as (partition by seq_id order by frame rows between unbounded preceding and current row), b as (partition by seq_id order by frame rows between current row and unbounded following)),
f as (select *, v is null and k >= 2 and coalesce(nf - pf - 1 between 1 and 10, false) as filled from near)
select seq_id, frame, round(case when filled then pv + (nv - pv) * (frame - pf) / (nf - pf) else v end, 6) as v, filled from f""",
    "step_outliers": f"""with {CHANNEL}, s as (select seq_id, lag(frame) over w as before, frame as after, v - lag(v) over w as diff from chan where v is not null window w as (partition by seq_id order by frame)),
d as (select * from s where diff is not null), m as (select seq_id, quantile_cont(diff, 0.5) med, count(*) n from d group by 1),
o as (select d.*, n, abs(diff - med) as off from d join m using (seq_id)), mm as (select seq_id, quantile_cont(off, 0.5) mad from o group by 1)
select seq_id, before, after, round(diff, 6) as diff from o join mm using (seq_id) where n > 5 and n + 1 >= 10 and mad > 0 and off > 2.0 * mad * 1.4826""",
    "fill_and_erase": f"""with {CHANNEL}, s as (select seq_id, lag(frame) over w as before, frame as after, v - lag(v) over w as diff from chan where v is not null window w as (partition by seq_id order by frame)),
d as (select * from s where diff is not null), m as (select seq_id, quantile_cont(diff, 0.5) med, count(*) n from d group by 1),
o as (select d.*, n, abs(diff - med) as off from d join m using (seq_id)), mm as (select seq_id, quantile_cont(off, 0.5) mad from o group by 1),
bad as (select distinct seq_id, unnest(range(before, after + 1))::int as frame from o join mm using (seq_id) where n > 5 and mad > 0 and off > 2.0 * mad * 1.4826),
near as (select *, last_value(v ignore nulls) over a as pv, last_value(case when v is not null then frame end ignore nulls) over a as pf, first_value(v ignore nulls) over b as nv, first_value(case when v is not null then frame end ignore nulls) over b as nf, count(v) over (partition by seq_id) as k
from chan window a as (partition by seq_id order by frame rows between unbounded preceding and current row), b as (partition by seq_id order by frame rows between current row and unbounded following)),
f as (select *, v is null and k >= 3 and coalesce(nf - pf - 1 between 1 and 10, false) as filled from near)
select f.seq_id, f.frame, round(case when bad.frame is not null then null when filled then pv + (nv - pv) * (f.frame - pf) / (nf - pf) else v end, 6) as v, filled, bad.frame is not null as erased
from f left join bad on bad.seq_id = f.seq_id and bad.frame = f.frame""",
    "fill_edges": f"""with {CHANNEL}, near as (select *, last_value(v ignore nulls) over a as pv, last_value(case when v is not null then frame end ignore nulls) over a as pf, first_value(v ignore nulls) over b as nv, first_value(case when v is not null then frame end ignore nulls) over b as nf
from chan window a as (partition by seq_id order by frame rows between unbounded preceding and current row), b as (partition by seq_id order by frame rows between current row and unbounded following))
select seq_id, frame, round(coalesce(v, pv + (nv - pv) * (frame - pf) / (nf - pf), pv, nv), 6) as v from near""",
    "channel_gaps": f"""with {CHANNEL}, g as (select seq_id, frame, frame - row_number() over (partition by seq_id order by frame) as g from chan where v is null)
select seq_id, min(frame) as "start", max(frame) as "end", count(*)::int as length, case when count(*) / 30.0 < 0.1 then 'short' when count(*) / 30.0 < 0.5 then 'medium' when count(*) / 30.0 < 2 then 'long' else 'critical' end as kind from g group by seq_id, g.g""",
    "body_gaps": f"""with {SKELETON}, f as (select seq_id, frame, max((x is null)::int) gap from pts group by all), g as (select seq_id, frame, frame - row_number() over (partition by seq_id order by frame) g from f where gap = 1),
r as (select seq_id, min(frame) s, count(*) n from g group by seq_id, g.g), a as (select *, s - lag(s) over (partition by seq_id order by s) as apart from r),
o as (select seq_id, count(*) n_gaps, sum(n) gap_frames, avg(n) mean_length, max(n) max_length, case when count(*) >= 3 then stddev_pop(apart) / avg(apart) end cv from a group by 1)
select seq_id, n_gaps, gap_frames::bigint as gap_frames, round(mean_length, 6) as mean_length, max_length::int as max_length, round(cv, 6) as cv, case when cv > 2 then 'highly clustered' when cv > 1 then 'moderately clustered' when cv is not null then 'evenly spread' else 'insufficient' end as clustering from o""",
    "worst_joints": f"""with {SKELETON}, c as (select seq_id, joint, count(*) filter (x is null) as missing from pts group by all), r as (select *, row_number() over (partition by seq_id order by missing desc, joint)::int as rank from c) select * from r where rank <= 5""",
    "time_drift": f"""with {MOVES}, s as (select seq_id, frame, avg(step) ms from mv group by all having count(step) > 3), m as (select seq_id, quantile_cont(ms, 0.5) filter (ms > 0) med, count(*) filter (ms > 0) k from s group by 1 having k >= 10),
o as (select s.*, abs(ms - med) off from s join m using (seq_id)), d as (select seq_id, quantile_cont(off, 0.5) filter (ms > 0) mad from o group by 1)
select seq_id, frame, round(ms, 6) as mean_step, round(off / (mad * 1.4826), 6) as z from o join d using (seq_id) where mad > 0 and off / (mad * 1.4826) > 2""",
    "side_swaps": f"""with {SKELETON}, b as (select l.seq_id, l.frame, sign(l.x - r.x) side, sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y) + (l.z - r.z) * (l.z - r.z)) dist from pts l join pts r on l.seq_id = r.seq_id and l.frame = r.frame where l.joint = 15 and r.joint = 16 and l.x is not null and r.x is not null),
w as (select *, lag(side) over (partition by seq_id order by frame) s0, lag(dist) over (partition by seq_id order by frame) d0 from b) select seq_id, frame, round(dist, 6) as dist from w where side * s0 < 0 and dist > 0.1 * d0 and frame >= 2""",
    "frame_confidence": f"""with {SKELETON}, n as (select *, lag(x) over j ax1, lag(y) over j ay1, lag(z) over j az1, lead(x) over j bx, lead(y) over j by_, lead(z) over j bz from pts window j as (partition by seq_id, joint order by frame)),
m as (select seq_id, frame, x, (abs(x - ax1) + abs(y - ay1) + abs(z - az1)) / 3 speed, (abs(bx - 2 * x + ax1) + abs(by_ - 2 * y + ay1) + abs(bz - 2 * z + az1)) / 3 accel from n where joint < 33),
f as (select seq_id, frame, avg((x is not null)::int) vis, avg(speed) filter (accel is not null) sp, avg(accel) ac, count(accel) k from m group by all)
select seq_id, frame, round(vis, 6) as visibility, round(0.6 * vis + 0.4 * case when k > 3 then 1 / (1 + 10 * sp + 5 * ac) else 0.5 end, 6) as confidence from f""",
    "outlier_flags": f"""with {MOVES}, {OUTLIER},
nx as (select *, case when lead(frame) over j = frame + 1 then lead(x) over j end qx, case when lead(frame) over j = frame + 1 then lead(y) over j end qy, case when lead(frame) over j = frame + 1 then lead(z) over j end qz from mv window j as (partition by seq_id, joint order by frame)),
f0 as (select seq_id, frame, count(*) n, count(*) filter (x is null) missing, max(step) step, max(sqrt((qx - 2 * x + px) ** 2 + (qy - 2 * y + py) ** 2 + (qz - 2 * z + pz) ** 2)) accel from nx group by all),
f as (select *, lag(missing) over (partition by seq_id order by frame) was from f0),
own as (select * from lens where length is not null), med as (select seq_id, ord, quantile_cont(length, 0.5) med from own group by all having med >= 1e-6),
b as (select seq_id, frame, count(*) n, count(*) filter (abs(length - med) / med > 0.5) bad from own join med using (seq_id, ord) group by all having bad >= 2)
select seq_id, frame, 'nan_ratio' as category, case when missing / n > 0.8 then 'critical' when missing / n > 0.5 then 'high' else 'moderate' end as severity, round(missing / n * 10, 6) as score from f where missing / n > 0.3
union all select seq_id, frame, 'velocity_spike', case when step > 1200 then 'critical' else 'high' end, round(step / 400, 6) from f where step > 400
union all select seq_id, frame, 'jitter_burst', case when accel > 1800 then 'high' else 'moderate' end, round(accel / 600, 6) from f where accel > 600
union all select seq_id, frame, 'sudden_appearance', 'moderate', 5.0 from f where was > 0.8 * n and missing < 0.3 * n
union all select seq_id, frame, 'sudden_disappearance', 'moderate', 5.0 from f where was < 0.3 * n and missing > 0.8 * n
union all select seq_id, frame, 'bone_stretch', case when bad / n > 0.3 then 'high' else 'moderate' end, round(bad::double, 6) from b""",
    "frame_drops": f"""with {MOVES}, s0 as (select seq_id, frame, count(x) nv, count(step) n, avg(step) mean, max(step) most from mv group by all),
s1 as (select *, coalesce(nv >= 10 and lag(nv) over (partition by seq_id order by frame) >= 10 and n >= 5, false) ok from s0),
s as (select seq_id, frame, nv, case when ok then mean * 30 else 0 end speed, case when ok then most else 0 end most from s1),
g as (select seq_id, frame - row_number() over (partition by seq_id order by frame) g from s where nv = 0), b as (select seq_id, count(distinct g) bursts from g group by 1),
t as (select seq_id, count(*) frames, count(*) filter (nv = 0) empty_frames, count(*) filter (most > 100) jumps, count(*) filter (speed > 5000 and nv >= 10) too_fast,
case when count(*) filter (speed > 0) > 10 then quantile_cont(speed, 0.5) filter (speed > 0) else 0 end md, case when count(*) filter (speed > 0) > 10 then quantile_cont(speed, 0.95) filter (speed > 0) else 0 end p95 from s group by 1)
select seq_id, frames, empty_frames, jumps, too_fast, round(md, 6) as median_speed, round(p95, 6) as p95_speed, coalesce(bursts, 0) as bursts,
[0.0, 0.3, 0.6, 0.9][(coalesce(bursts, 0) >= 2)::int + (jumps > frames * 0.01)::int + (p95 > 4000)::int + 1]::double as confidence from t left join b using (seq_id)""",
    "timestamp_drops": f"""with {STAMPS}, g as (select cam, t - lag(t) over (partition by cam order by frame) gap from stamps), u as (select cam, case when quantile_cont(gap, 0.5) > 10 then 1.0 else 1000.0 end k from g where gap is not null group by 1), m as (select cam, gap * k as ms from g join u using (cam) where gap is not null)
select cam, count(*) as intervals, count(*) filter (ms > 1000.0 / 30 + 2) as drops, round(avg(ms) filter (ms > 0), 4) as mean_ms, round(stddev_pop(ms) filter (ms > 0), 4) as std_ms, round(max(ms), 4) as max_ms from m group by 1""",
    "shared_drops": f"""with {STAMPS}, g as (select cam, frame, t - lag(t) over (partition by cam order by frame) gap from stamps), u as (select cam, case when quantile_cont(gap, 0.5) > 10 then 1.0 else 1000.0 end k from g where gap is not null group by 1)
select frame, count(*) as n_cams, case when count(*) >= 2 then 'correlated' else 'specific' end as kind from g join u using (cam) where gap * k > 1000.0 / 30 + 2 group by 1""",
    "desync": f"""with {MOVES}, f0 as (select seq_id, frame, count(x) nv, count(step) n, avg(sqrt((x - px) * (x - px) + (y - py) * (y - py))) xy, avg(abs(z - pz)) dz, avg(step) speed from mv group by all),
f1 as (select *, lag(nv) over (partition by seq_id order by frame) pv from f0), f as (select *, dz / greatest(xy, 1e-8) ratio from f1 where nv > 10 and pv > 10 and n >= 5),
t as (select seq_id, count(*) n, quantile_cont(ratio, 0.5) md, avg(ratio) mn, quantile_cont(speed, 0.75) p75, quantile_cont(speed, 0.25) p25, coalesce(corr(speed, ratio), 0) c from f group by 1 having n >= 10),
e as (select f.seq_id, quantile_cont(ratio, 0.5) filter (speed > p75) fr, quantile_cont(ratio, 0.5) filter (speed < p25) sr from f join t using (seq_id) group by 1)
select seq_id, n, round(md, 6) as median_ratio, round(mn, 6) as mean_ratio, round(coalesce(fr, md), 6) as fast_ratio, round(coalesce(sr, md), 6) as slow_ratio, round(c, 6) as speed_corr,
case when md > 2.5 or c > 0.5 then 'high' when md > 1.5 or c > 0.3 then 'moderate' else 'low' end as severity from t join e using (seq_id)""",
    "side_asymmetry": f"""with {SKELETON}, o as (select *, case when joint in (11, 13, 15, 23, 25, 27) then 'left' else 'right' end side from pts where joint in (11, 13, 15, 23, 25, 27, 12, 14, 16, 24, 26, 28)),
r as (select seq_id, side, count(*) filter (x is null) / count(*) * 100 v from o group by all),
st as (select seq_id, side, sqrt((x - lag(x) over j) ** 2 + (y - lag(y) over j) ** 2 + (z - lag(z) over j) ** 2) step from o where x is not null window j as (partition by seq_id, joint order by frame)), jt as (select seq_id, side, avg(step) v from st group by all),
nz as (select seq_id, side, avg(sd) v from (select seq_id, side, joint, count(z) n, stddev_pop(z) sd from o group by all having n > 10) group by all),
w as (select r.seq_id, max(r.v) filter (r.side = 'left') a, max(coalesce(jt.v, 0)) filter (r.side = 'left') b, max(coalesce(nz.v, 0)) filter (r.side = 'left') c, max(r.v) filter (r.side = 'right') d, max(coalesce(jt.v, 0)) filter (r.side = 'right') e, max(coalesce(nz.v, 0)) filter (r.side = 'right') f
from r left join jt on jt.seq_id = r.seq_id and jt.side = r.side left join nz on nz.seq_id = r.seq_id and nz.side = r.side group by 1)
select seq_id, round(a, 6) as left_nan_rate, round(b, 6) as left_jitter, round(c, 6) as left_depth_noise, round(d, 6) as right_nan_rate, round(e, 6) as right_jitter, round(f, 6) as right_depth_noise, case when a + b > d + e then 'left' else 'right' end as worse_side,
case when abs(a - d) > 15 or abs(b - e) > 15 or abs(c - f) > 30 then 'high' when abs(a - d) > 5 or abs(b - e) > 5 or abs(c - f) > 10 then 'moderate' else 'low' end as severity from w""",
    "quality_by_position": f"""with {SKELETON}, ns as (select seq_id, frame, x nx from pts where joint = 0 and x is not null), e as (select seq_id, min(nx) lo, max(nx) hi from ns group by 1 having count(*) >= 25),
b as (select ns.seq_id, frame, least(floor((nx - lo) / (hi - lo) * 5), 4)::int bin from ns join e using (seq_id)),
o as (select p.*, bin, sqrt((x - lag(x) over j) ** 2 + (y - lag(y) over j) ** 2 + (z - lag(z) over j) ** 2) step from pts p join b on b.seq_id = p.seq_id and b.frame = p.frame window j as (partition by p.seq_id, joint, bin order by p.frame)),
f as (select seq_id, bin, frame, max((x is null)::int) gap, count(step) n, avg(step) jit from o group by all)
select seq_id, bin, count(*) as frames, round(avg(gap) * 100, 6) as nan_rate, round(coalesce(avg(jit) filter (n > 3), 0), 6) as mean_jitter from f group by all having count(*) >= 3""",
    "motion_intensity": f"""with {MOVES}, s as (select seq_id, frame - 1 as frame, avg(step) ms from mv group by all having ms is not null), t as (select seq_id, avg(ms) + 1.5 * stddev_pop(ms) lim from s group by 1) select seq_id, frame, round(ms, 6) as mean_step from s join t using (seq_id) where ms > lim""",
    "blur_scores": f"""with {CHANNEL}, t as (select seq_id, avg(v) - 1.0 * stddev_pop(v) th, quantile_cont(v, 0.05) p5, quantile_cont(v, 0.95) p95 from chan group by 1), l as (select seq_id, count(*) filter (v < th) k from chan join t using (seq_id) group by 1)
select seq_id, round(th, 6) as threshold, round(p5, 6) as p5, round(p95, 6) as p95, k as n_blurred from t join l using (seq_id)""",
    "texture_risk": f"""with {MOVES}, rg(joint, region) as (values {_values([(j, f"'{r}'") for r, js in layouts.REGIONS.items() for j in js])}),
sp as (select mv.seq_id, region, mv.joint, frame, step, abs(step - case when lag(frame) over j = frame - 1 then lag(step) over j end) * 30 as change from mv join rg on rg.joint = mv.joint window j as (partition by mv.seq_id, mv.joint order by frame)),
fr as (select seq_id, region, frame, avg(step) disp from sp group by all having avg(step) is not null), mx as (select seq_id, region, max(disp) most from fr group by all),
st as (select seq_id, region, avg(case when most > 1e-8 then 1 - least(disp / most, 1) else 1 end) quality from fr join mx using (seq_id, region) group by all),
jj as (select seq_id, region, joint, avg(change) jit from sp group by all), jr as (select seq_id, region, avg(jit) jitter from jj group by all),
al as (select s.seq_id, r.region, coalesce(quality, 0) quality, coalesce(jitter, 0) jitter from (select distinct seq_id from pts) s cross join (select distinct region from rg) r left join st on st.seq_id = s.seq_id and st.region = r.region left join jr on jr.seq_id = s.seq_id and jr.region = r.region),
ms as (select seq_id, avg(quality) mq, stddev_pop(quality) sq, avg(jitter) mj, stddev_pop(jitter) sj from al group by 1),
fl as (select *, case when sj > 1e-8 then jitter > mj + 1.5 * sj else jitter > 1.5 * mj end hi, case when sq > 1e-8 then quality < mq - sq else quality < 0.7 * mq end lo from al join ms using (seq_id))
select seq_id, region, round(quality, 6) as quality, round(jitter, 6) as jitter, case when hi and lo then 'interference' when hi then 'artifact' when quality < 0.3 then 'low quality' end as finding from fl""",
    "calibration_drift": f"""with {CHANNEL}, k as (select *, row_number() over (partition by seq_id order by frame) k from chan where v is not null), b as (select seq_id, avg(v) + 1.0 * stddev_pop(v) lim from k where k <= 10 group by 1),
h as (select c.*, c.frame - row_number() over (partition by c.seq_id order by c.frame) g from chan c join b using (seq_id) where v > lim) select seq_id, min(frame) as "start", max(frame) as "end", count(*) as length, round(max(v), 6) as worst from h group by seq_id, g""",
    "drift_alerts": f"""with {SKELETON}, f as (select seq_id, frame, avg((x is not null)::int) confidence, count(x) / 17.0 completeness from pts group by all), k as (select *, row_number() over (partition by seq_id order by frame) k from f), b as (select seq_id, avg(confidence) b0, avg(completeness) b1 from k where k <= 10 group by 1),
d as (select k.seq_id, frame, 'confidence' metric, (b0 - confidence) / b0 dr, 0.03 lim from k join b using (seq_id) where k > 10 union all select k.seq_id, frame, 'completeness', (b1 - completeness) / b1, 0.04 from k join b using (seq_id) where k > 10)
select seq_id, frame, metric, round(dr, 6) as "drop", case when dr > 2 * lim then 'high' else 'moderate' end as severity from d where dr > lim""",
    "self_occlusion": f"""with {OBS}, a as (select seq_id, cam, frame, joint, u / 640 as u, v / 480 as v, coalesce(conf > 0.3, false) and u is not null and v is not null as ok from obs),
p as (select a.seq_id, a.cam, a.frame, a.joint, avg(sqrt((a.u - b.u) ** 2 + (a.v - b.v) ** 2)) d from a join a b on a.seq_id = b.seq_id and a.frame = b.frame and a.joint = b.joint and a.cam <> b.cam where a.ok and b.ok group by all),
m as (select a.seq_id, a.cam, a.frame, a.joint, coalesce(d, 0) score from a left join p using (seq_id, cam, frame, joint)),
w as (select *, avg(score) over (partition by seq_id, cam, joint order by frame rows between 15 preceding and 15 following) base from m)
select seq_id, cam, frame, joint, round(score, 4) as score, round(base, 4) as baseline from w where score > 2 * greatest(base, 1e-10)""",
    "edge_reliability": f"""with {OBS} select cam, joint, count(*) as n, round(avg((sqrt((u - 320) ** 2 + (v - 240) ** 2) / 400 > 0.7)::int), 6) as edge_share, avg((sqrt((u - 320) ** 2 + (v - 240) ** 2) / 400 > 0.7)::int) > 0.5 as unreliable from obs where u is not null group by all""",
    "joint_coverage": f"""with {OBS} select cam, least(greatest(floor(v / 480 * 10), 0), 9)::int as "row", least(greatest(floor(u / 640 * 10), 0), 9)::int as col, count(*) as n, round(avg(conf), 6) as mean_conf from obs where u is not null and v is not null group by all""",
    "detection_stats": f"""with {DETS}, f as (select cam, frame, count(*) n, sum(conf) c from dets group by all) select cam, count(*) as frames, sum(n)::bigint as detections, round(avg(n), 6) as mean_n, max(n) as max_n, round(sum(c) / sum(n), 6) as mean_conf from f group by all""",
    "hand_jitter": f"""with {MOVES}, f as (select seq_id, frame, count(x) n, avg(step) step from mv where joint in (15, 16, 30, 31, 32) group by all) select seq_id, round(avg(n) / 5 * 100, 6) as coverage, round(coalesce(avg(step), 0), 6) as mean_jitter, round(coalesce(quantile_cont(step, 0.95), 0), 6) as p95_jitter from f group by 1""",
    "frame_issues": f"""with {SKELETON}, f as (select seq_id, frame, avg((x is not null)::int) c from pts group by all) select seq_id, round(avg(c), 6) as mean_confidence, round(avg((c > 0.95)::int), 6) as good_share_95, count(*) filter (c < 0.95) as gap_frames from f group by 1""",
    "energy_peaks": f"""with a as (select event_type cam, (row_number() over (partition by event_type order by ts, event_id) - 1) as idx, value::double * value::double e from events), w as (select cam, (idx // 8)::bigint win, avg(e) e from a group by all), d as (select cam, win, 10 * log10(greatest(e, 1e-10)) db from w), m as (select cam, quantile_cont(db, 0.5) + 3 lim from d group by 1),
n as (select d.*, lag(db) over (partition by cam order by win) a, lead(db) over (partition by cam order by win) b from d) select cam, win, round(db, 6) as db from n join m using (cam) where db > lim and db > a and db >= b""",
    "foot_contacts": f"""with {SKELETON}, {SLOW_FEET}
select seq_id, side, min(frame) as "start", max(frame) as "end", count(*) as length, round(avg(x), 6) as mx, round(avg(y), 6) as my, round(avg(z), 6) as mz from g group by seq_id, side, g having count(*) >= 2""",
    "wrist_mismatch": f"""with {SKELETON}, d as (select a.seq_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) d from pts a join pts b on a.seq_id = b.seq_id and a.frame = b.frame where a.joint = 15 and b.joint = 31 and a.x is not null and b.x is not null)
select seq_id, count(*) as n, round(avg(d), 6) as mean, round(max(d), 6) as max, round(quantile_cont(d, 0.5), 6) as median, round(quantile_cont(d, 0.95), 6) as p95, count(*) filter (d > 200) as flagged from d group by 1""",
    "proportions": f"""with {SKELETON}, {NAMED}, m as (select seq_id, ord, quantile_cont(length, 0.5) q from lens where length is not null group by all),
s as (select seq_id, max(q) filter (ord = 0) hw, max(q) filter (ord = 1) sw, max(q) filter (ord = 2) + max(q) filter (ord = 3) la, max(q) filter (ord = 4) + max(q) filter (ord = 5) ra, max(q) filter (ord = 6) + max(q) filter (ord = 7) ll, max(q) filter (ord = 8) + max(q) filter (ord = 9) rl from m group by 1),
a as (select seq_id, quantile_cont(y, 0.5) ay from (select seq_id, frame, avg(y) y from pts where joint in (27, 28) group by all) group by 1), n as (select seq_id, quantile_cont(y, 0.5) ny from pts where joint = 0 group by 1)
select seq_id, round(hw, 6) as hip_width, round(sw, 6) as shoulder_width, round(la, 6) as left_arm, round(ra, 6) as right_arm, round(ll, 6) as left_leg, round(rl, 6) as right_leg, round(abs(ay - ny), 6) as height, round(sw / hw, 6) as shoulder_hip_ratio, round((la + ra) / (ll + rl), 6) as arm_leg_ratio from s left join a using (seq_id) left join n using (seq_id)""",
    "virtual_markers": f"""with {SKELETON}, vm(name, joint, w) as (values {_values([(f"'{n}'", j, w) for n, js in layouts.VIRTUAL.items() for j, w in js.items()])}), k as (select name, count(*) k from vm group by 1)
select seq_id, frame, p.name, round(case when count(x) = any_value(k) then sum(w * x) end, 6) as x, round(case when count(x) = any_value(k) then sum(w * y) end, 6) as y, round(case when count(x) = any_value(k) then sum(w * z) end, 6) as z from (select pts.*, name, w from pts join vm on vm.joint = pts.joint) p join k on k.name = p.name group by seq_id, frame, p.name""",
    "contact_pairs": f"""with {SKELETON}, a as materialized (select *, floor(x / 40)::bigint gx, floor(y / 40)::bigint gy from pts where x is not null),
b as materialized (select seq_id, frame, joint, x, y, z, gx + dx as gx, gy + dy as gy from a, (values (-1), (0), (1)) as s(dx), (values (-1), (0), (1)) as t(dy))
select a.frame, a.seq_id as actor_a, b.seq_id as actor_b, a.joint as joint_a, b.joint as joint_b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) as dist from a join b on a.frame = b.frame and a.gx = b.gx and a.gy = b.gy where a.seq_id < b.seq_id and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) < 40""",
    "interpenetration": f"""with {SKELETON}, a as (select * from pts where x is not null), n as (select a.frame, a.seq_id sa, b.seq_id sb, a.joint, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) d from a join a b on a.frame = b.frame and a.seq_id < b.seq_id group by all),
j as (select frame, sa, sb, avg((d < 60)::int) f from n group by all) select frame, sa as actor_a, sb as actor_b, round(f, 6) as overlap_fraction from j where f >= 0.3""",
    "detection_iou": f"""with {DETS}, p as (select a.frame, a.cam, a.det_pos i, b.det_pos j, greatest(least(a.cx + a.w / 2, b.cx + b.w / 2) - greatest(a.cx - a.w / 2, b.cx - b.w / 2), 0) * greatest(least(a.cy + a.h / 2, b.cy + b.h / 2) - greatest(a.cy - a.h / 2, b.cy - b.h / 2), 0) inter, greatest(a.w * a.h, 1) aa, greatest(b.w * b.h, 1) ab from dets a join dets b on a.frame = b.frame and a.cam = b.cam and a.det_pos < b.det_pos)
select frame, cam, i, j, round(inter / greatest(aa + ab - inter, 1), 6) as iou from p where inter > 0""",
    "nearest_marker": f"""with {DETS}, m as (select frame, cam, det_pos, cx, cy from dets where det_pos > 0), b as (select frame, cam, det_pos as person, cx + 30 as tx, cy + 20 as ty from dets), d as (select m.frame, m.cam, m.det_pos as marker_id, person, sqrt((cx - tx) ** 2 + (cy - ty) ** 2) dist from m join b on b.frame = m.frame and b.cam = m.cam),
r as (select *, row_number() over (partition by frame, cam, marker_id order by dist, person) k from d where dist <= 120) select frame, cam, marker_id, person, round(dist, 6) as dist from r where k = 1""",
    "marker_votes": f"""with {DETS}, v as (select det_pos as marker, (cx::int % 4) as actor, cam from dets), c as (select marker, actor, count(*) n, min(cam) first_cam from v group by all), r as (select *, row_number() over (partition by marker order by n desc, first_cam, actor) k, sum(n) over (partition by marker) tot from c) select marker, actor, n as votes from r where k = 1 and (n >= 2 or tot = 1)""",
    "shutter_severity": f"""with {SKELETON}, n as (select *, lag(frame) over j pf, lead(frame) over j nf, lag(x) over j px, lead(x) over j nx, lag(y) over j py, lead(y) over j ny, lag(z) over j pz, lead(z) over j nz from pts window j as (partition by seq_id, joint order by frame)),
v as (select seq_id, frame, ((case when nf is null then x else nx end) - (case when pf is null then x else px end)) / nullif(coalesce(nf, frame) - coalesce(pf, frame), 0) * 30 vx, ((case when nf is null then y else ny end) - (case when pf is null then y else py end)) / nullif(coalesce(nf, frame) - coalesce(pf, frame), 0) * 30 vy, ((case when nf is null then z else nz end) - (case when pf is null then z else pz end)) / nullif(coalesce(nf, frame) - coalesce(pf, frame), 0) * 30 vz from n),
d as (select seq_id, frame, max(sqrt(vx * vx + vy * vy + vz * vz)) * 0.016 dist from v group by all) select seq_id, frame, round(dist, 6) as distortion, case when dist > 5 then 'severe' when dist > 1 then 'moderate' else 'mild' end as severity from d where dist > 0.1""",
    "triangulation_weights": f"""with {OBS} select seq_id, cam, frame, joint, round(1 / (1 + (sqrt((u - 320) ** 2 + (v - 240) ** 2) / 400) ** 2), 6) as weight from obs where u is not null""",
    "bounding_boxes": f"""with {OBS} select seq_id, cam, frame, round(greatest(min(u) - 15, 0), 4) as x1, round(greatest(min(v) - 15, 0), 4) as y1, round(max(u) + 15, 4) as x2, round(max(v) + 15, 4) as y2 from obs where u is not null and not (u = 0 and v = 0) group by all""",
    "segment_means": f"""with {SKELETON} select seq_id, case when joint < 33 then 'body' end as segment, count(x) as n_valid, round(avg(x), 6) as mean_x, round(avg(y), 6) as mean_y, round(avg(z), 6) as mean_z from pts group by all""",
    "frame_spine": f"""with {DETS}, ends as (select min(frame) lo, max(frame) hi from dets), sp as (select unnest(range(lo, hi + 1)) frame from ends), c as (select frame, count(*) n from dets where conf >= 0.5 group by 1) select count(*) as frames, sum(coalesce(n, 0))::bigint as detections, round(avg(coalesce(n, 0)), 6) as mean_persons, max(coalesce(n, 0)) as max_persons, count(*) filter (n is null) as empty_frames from sp left join c using (frame)""",
    "pin_feet": f"""with {HELD}, {SLOW_FEET},
r as materialized (select seq_id, side, g, min(frame) s, max(frame) e, count(*) n, avg(x) mx, avg(y) my, avg(z) mz from g group by seq_id, side, g having count(*) >= 3),
sh as (select g.seq_id, g.side, g.frame, least(1.0::double, (least(g.frame - r.s, r.e - g.frame) + 1) / (least(5, r.n // 2) + 1.0::double)) a, mx - x as dx, my - y as dy, mz - z as dz from g join r on r.seq_id = g.seq_id and r.side = g.side and r.g = g.g)
select p.seq_id, p.frame, p.joint, round(p.x + coalesce(a * dx, 0), 6) as x, round(p.y + coalesce(a * dy, 0), 6) as y, round(p.z + coalesce(a * dz, 0), 6) as z
from pts p left join sh on sh.seq_id = p.seq_id and sh.frame = p.frame and sh.side = case when p.joint in (27, 29, 31) then 'left' when p.joint in (28, 30, 32) then 'right' end""",
    "wrist_fix": f"""with {HELD}, st as materialized (select seq_id, frame, joint, x, y, z, sqrt((x - lag(x) over j) ** 2 + (y - lag(y) over j) ** 2 + (z - lag(z) over j) ** 2) step from pts where joint in (15, 31) window j as (partition by seq_id, joint order by frame)),
sm as (select *, avg(step) over (partition by seq_id, joint order by frame rows between 4 preceding and current row) sp from st),
b as (select w.seq_id, w.frame, w.x - h.x dx, w.y - h.y dy, w.z - h.z dz, w.sp ws, h.sp hs, h.x hx, h.y hy, h.z hz, sqrt((w.x - h.x) ** 2 + (w.y - h.y) ** 2 + (w.z - h.z) ** 2) d from sm w join sm h on h.seq_id = w.seq_id and h.frame = w.frame and w.joint = 15 and h.joint = 31 where w.x is not null and h.x is not null),
c as (select seq_id, quantile_cont(d, 0.5) + 3 * stddev_pop(d) lim from b group by 1),
ra as (select p.seq_id, p.frame, count(p.x) n, avg(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2)) r from pts p join pts q on q.seq_id = p.seq_id and q.frame = p.frame and q.joint = 31 where p.joint in (31, 29, 32) and q.x is not null group by all),
rd as (select seq_id, avg(r) radius from ra where n = 3 group by 1),
m as (select p.seq_id, p.frame, p.joint, dx, dy, dz, (case when ws is null or hs is null then 0.5 when ws + hs > 0 then hs / (hs + ws) else 0 end) / (1 + sqrt((p.x - hx) ** 2 + (p.y - hy) ** 2 + (p.z - hz) ** 2) / coalesce(nullif(radius, 0), 1)) k
from pts p join b on b.seq_id = p.seq_id and b.frame = p.frame join c on c.seq_id = p.seq_id left join rd on rd.seq_id = p.seq_id where p.joint in (31, 29, 32) and d > lim)
select p.seq_id, p.frame, p.joint, round(p.x + coalesce(k * dx, 0), 6) as x, round(p.y + coalesce(k * dy, 0), 6) as y, round(p.z + coalesce(k * dz, 0), 6) as z from pts p left join m using (seq_id, frame, joint)""",
    "hand_quality": f"""with {MOVES}, hd as (select * from mv where joint in (15, 29, 30, 31, 32)), ce as (select seq_id, frame, avg(x) mx, avg(y) my, avg(z) mz from hd where x is not null group by all),
sh as (select h.seq_id, h.frame, avg(sqrt((h.x - mx) ** 2 + (h.y - my) ** 2 + (h.z - mz) ** 2)) spread, avg(sqrt((h.x - w.x) ** 2 + (h.y - w.y) ** 2 + (h.z - w.z) ** 2)) dist from hd h join ce using (seq_id, frame) join pts w on w.seq_id = h.seq_id and w.frame = h.frame and w.joint = 13 where h.x is not null and w.x is not null group by all),
wr as (select seq_id, count(*) k from sh where spread > 0 and dist > 0 and (spread / dist < 0.3 or spread / dist > 3) group by 1),
fr as (select seq_id, frame, count(x) n, case when count(step) > 3 then avg(step) end st from hd group by all),
su as (select seq_id, count(*) frames, avg(n) / 5 * 100 cov, coalesce(avg(st), 0) mj, coalesce(quantile_cont(st, 0.95), 0) pj from fr group by 1),
sc as (select su.*, coalesce(k, 0) k, greatest(100 - case when cov < 50 then (50 - cov) * 0.5 else 0 end - case when mj > 20 then (mj - 20) * 0.3 else 0 end - case when coalesce(k, 0) > frames * 0.1 then 15 else 0 end, 0) score from su left join wr using (seq_id))
select seq_id, round(cov, 6) as coverage, k as boundary_frames, round(k / frames * 100, 6) as boundary_rate, round(mj, 6) as mean_jitter, round(pj, 6) as p95_jitter, round(score, 6) as score, case when score < 60 then 'poor' when score < 80 then 'moderate' else 'good' end as severity from sc""",
    "face_quality": f"""with {MOVES}, fc as (select seq_id, frame, count(x) n, avg(x) cx, avg(y) cy, avg(z) cz, max(z) - min(z) deep, greatest(max(x), max(y)) - least(min(x), min(y)) wide, count(step) k, avg(step) step from mv where joint in (7, 8, 9, 10, 11, 12) group by all),
st as (select fc.*, lag(n) over (partition by fc.seq_id order by fc.frame) pn, case when n > 3 then deep / greatest(wide, 1e-6) end depth, sqrt((cx - w.x) ** 2 + (cy - w.y) ** 2 + (cz - w.z) ** 2) off_ from fc left join pts w on w.seq_id = fc.seq_id and w.frame = fc.frame and w.joint = 0 and w.x is not null),
su as (select seq_id, avg(n) / 6 * 100 cov, coalesce(avg(depth) filter (depth > 0), 0) md, count(*) filter (depth > 0 and depth < 0.05) col, case when count(off_) > 5 then stddev_pop(off_) else 0 end nw, coalesce(avg(step) filter (n > 2 and pn > 2 and k > 1 and step > 0), 0) mj from st group by 1),
sc as (select *, greatest(100 - case when cov < 50 then (50 - cov) * 0.5 else 0 end - least(col * 2, 30) - case when nw > 30 then least((nw - 30) * 0.5, 20) else 0 end - case when mj > 15 then least((mj - 15) * 0.5, 15) else 0 end, 0) score from su)
select seq_id, round(cov, 6) as coverage, round(md, 6) as mean_depth, col as collapsed, round(nw, 6) as nose_wander, round(mj, 6) as mean_jitter, round(score, 6) as score, case when score < 60 then 'poor' when score < 80 then 'moderate' else 'good' end as severity from sc""",
    "hand_blend": f"""with {HELD}, hd as materialized (select *, case when lag(frame) over j is not null then sqrt(coalesce((x - lag(x) over j) ** 2, 0) + coalesce((y - lag(y) over j) ** 2, 0) + coalesce((z - lag(z) over j) ** 2, 0)) end step from pts where joint in (15, 29, 30, 31, 32) window j as (partition by seq_id, joint order by frame)),
fr as (select seq_id, frame, count(x) / 5 as share, count(x) = 5 as whole, sum(step) moved, (frame * 3 % 10) / 10.0::double conf from hd group by all), us as (select seq_id, quantile_cont(moved, 0.5) usual from fr group by 1),
q as (select fr.*, share * coalesce(greatest(1 - moved / ((case when usual > 0 then usual else 1 end) * 5 + 1e-8), 0), 1) quality from fr join us using (seq_id)),
u as (select *, conf > 0.3 and (quality < 0.3 or not whole) as use_ from q),
p as (select *, frame - max(case when use_ then frame end) over (partition by seq_id order by frame rows between 6 preceding and current row) - 1 as k from u),
w as (select seq_id, frame, case when use_ then 1.0 when k between 1 and 5 then k / 6.0 end::double wt from p),
b as (select p.*, w.wt, case when (p.joint + p.frame) % 7 > 0 then coalesce(p.x, 0) + 5 end ox, case when (p.joint + p.frame) % 7 > 0 then coalesce(p.y, 0) + 5 end oy, case when (p.joint + p.frame) % 7 > 0 then coalesce(p.z, 0) + 5 end oz from pts p left join w on w.seq_id = p.seq_id and w.frame = p.frame and p.joint in (15, 29, 30, 31, 32) and w.wt > 0)
select seq_id, frame, joint, {", ".join(f"round(case when wt is null then {c} when x is null and ox is null then null else (1 - wt) * coalesce({c}, 0) + wt * coalesce(o{c}, 0) end, 6) as {c}" for c in "xyz")} from b""",
    "fused_drops": f"""with dr as (FRAME_DROPS), td as (TIMESTAMP_DROPS),
st as (select seq_id, drops, 1 - drops / intervals as conf from dr join td on td.cam = ['click', 'error', 'purchase', 'signup', 'view'][seq_id // 2 + 1])
select dr.seq_id, round(case when drops is null then dr.confidence when drops > 0 and dr.confidence > 0.3 then least(0.99, greatest(conf, dr.confidence) + 0.03) when drops > 0 then conf when dr.confidence > 0.3 then dr.confidence * 0.7 else greatest(conf, dr.confidence) end, 6) as confidence,
case when drops is null then 'motion_only' when drops > 0 and dr.confidence > 0.3 then 'both_agree' when drops > 0 then 'timestamps_only' when dr.confidence > 0.3 then 'motion_only_possible_artifact' else 'neither' end as source from dr left join st using (seq_id)""",
    "coverage_heatmap": f"""with {SKELETON}, grid as (select distinct floor(x / 100) * 100 gx, floor(y / 100) * 100 gy, floor(z / 100) * 100 gz from pts where x is not null), cams(cam, {", ".join(_P)}) as (values {_values([(c, *p) for c, p in CAMERAS])}),
hm as (select gx, gy, gz, p1 * gx + p2 * gy + p3 * gz + p4 hu, p5 * gx + p6 * gy + p7 * gz + p8 hv, p9 * gx + p10 * gy + p11 * gz + p12 hw from grid, cams),
ce as (select gx, gy, gz, count(*) filter (abs(hw) > 1e-10 and hu / hw >= 0 and hu / hw < 300 and hv / hw >= 0 and hv / hw < 230) n from hm group by all), ht as (select gx as x, gz as z, max(n) as n_cams from ce group by all)
select x, z, n_cams from ht""",
    "coverage_summary": f"""with {SKELETON}, grid as (select distinct floor(x / 100) * 100 gx, floor(y / 100) * 100 gy, floor(z / 100) * 100 gz from pts where x is not null), cams(cam, {", ".join(_P)}) as (values {_values([(c, *p) for c, p in CAMERAS])}),
hm as (select gx, gy, gz, p1 * gx + p2 * gy + p3 * gz + p4 hu, p5 * gx + p6 * gy + p7 * gz + p8 hv, p9 * gx + p10 * gy + p11 * gz + p12 hw from grid, cams),
ce as (select gx, gy, gz, count(*) filter (abs(hw) > 1e-10 and hu / hw >= 0 and hu / hw < 300 and hv / hw >= 0 and hv / hw < 230) n from hm group by all), ht as (select gx as x, gz as z, max(n) as n_cams from ce group by all),
c as (select n_cams, count(*) cells from ht group by 1)
select n_cams, cells, round(cells / (select sum(cells) from c) * 100, 6) as percent, round((select sum(d.cells) from c d where d.n_cams >= c.n_cams) / (select sum(cells) from c) * 100, 6) as percent_or_more from c""",
    "same_time": f"""with {STAMPS} select a.cam as cam_a, b.cam as cam_b, floor(a.t)::bigint as t, a.frame as frame_a, b.frame as frame_b from stamps a join stamps b on floor(a.t) = floor(b.t) and a.cam < b.cam""",
    "pose_similarity": f"""with {OBS} select a.seq_id, a.frame, a.cam as cam_a, b.cam as cam_b, round(coalesce(exp(-avg(sqrt((a.u - b.u) ** 2 + (a.v - b.v) ** 2)) filter (a.conf > 0.3 and b.conf > 0.3) / 50), 0), 6) as similarity
from obs a join obs b on a.seq_id = b.seq_id and a.frame = b.frame and a.joint = b.joint and a.cam < b.cam group by all""",
    "near_plane": f"""with {SKELETON} select seq_id, frame, joint, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z from pts where abs((2 * (y - 100) + z) / sqrt(5)) < 60""",
}

ORACLES["fused_drops"] = ORACLES["fused_drops"].replace("FRAME_DROPS", ORACLES["frame_drops"]).replace("TIMESTAMP_DROPS", ORACLES["timestamp_drops"])
ORACLES["worst_frames"] = f"""with fl as ({ORACLES["outlier_flags"]}), su as (select seq_id, frame, round(sum(score), 6) as score from fl group by all)
select seq_id, frame, score, row_number() over (partition by seq_id order by score desc, frame)::int as rank from su qualify rank <= 10"""
ORACLES["flag_counts"] = f"""with fl as ({ORACLES["outlier_flags"]})
select seq_id, category, severity, count(*) as n, count(distinct frame) as frames from fl group by grouping sets ((seq_id, category, severity), (seq_id, category), (seq_id, severity), (seq_id))"""
