"""Queries on potential fields, electromagnetic approximations and analytic shapes."""

from __future__ import annotations

from math import cos, radians, sin

from pyspark.sql import functions as F

from terralith.functions import geometry as g
from terralith.operators import forward as fw
from terralith.operators.storage import dealt
from terralith.plans import bindings as b
from terralith.plans import sqlgen as s
from terralith.plans.registry import query

INC, DEC, FIELD = -66.16, -0.10, 58874.0
_F = tuple(f"({x!r}::DOUBLE)" for x in (cos(radians(INC)) * cos(radians(DEC)), cos(radians(INC)) * sin(radians(DEC)), -sin(radians(INC))))
_G = f"{g.G_MGAL!r}::DOUBLE"
_T = "(-susceptibility * 588.74::DOUBLE * (100.0::DOUBLE / (4.0::DOUBLE * pi())))"
_PAIR = f"WITH {b.OBS_SQL},\n{b.BOXES_SQL},\n{s.box_facets()},\npair AS (SELECT * FROM obs, facets),\n{s.pair_ctes()}\n"


def _facets(spark, d):
    return fw.box_facets(b.boxes(spark, d))


def _out(df, *names, value="response", places=6):
    return df.select(*names, F.round(value, places).alias(value))


@query("gravity_boxes", f"{_PAIR} SELECT obs_id, round(sum({s.gravity_term()} * {_G} * density), 6) AS response FROM k4 GROUP BY obs_id")
def gravity_boxes(spark, d):
    return _out(fw.gravity(b.obs(spark, d), _facets(spark, d)), "obs_id")


@query("gravity_by_body", f"{_PAIR} SELECT obs_id, group_id, round(sum({s.gravity_term()} * {_G} * density), 6) AS response FROM k4 GROUP BY obs_id, group_id")
def gravity_by_body(spark, d):
    return _out(fw.gravity(b.obs(spark, d), _facets(spark, d), ["group_id"]), "obs_id", "group_id")


@query(
    "unit_response_matrix",
    f"{_PAIR}, u AS (SELECT obs_id, group_id, round(sum({s.gravity_term()} * {_G}), 6) AS r FROM k4 GROUP BY obs_id, group_id)"
    " SELECT obs_id, " + ", ".join(f"max(CASE WHEN group_id = {i} THEN r END) AS u{i}" for i in range(25)) + " FROM u GROUP BY obs_id",
)
def unit_response_matrix(spark, d):
    unit = fw.gravity(b.obs(spark, d), _facets(spark, d), ["group_id"], density=None)
    wide = unit.groupBy("obs_id").pivot("group_id", list(range(25))).agg(F.round(F.first("response"), 6))
    return wide.toDF("obs_id", *[f"u{i}" for i in range(25)])


@query("tmi_boxes", f"{_PAIR} SELECT obs_id, round(sum({s.tmi_term(_F, _F)} * {_T}), 6) AS response FROM k4 GROUP BY obs_id")
def tmi_boxes(spark, d):
    return _out(fw.total_field(b.obs(spark, d), _facets(spark, d), INC, DEC, FIELD), "obs_id")


@query("tmi_boxes_ascoded", f"{_PAIR} SELECT obs_id, round(sum({s.tmi_term(_F, _F, True)} * {_T}), 4) AS response FROM k4 GROUP BY obs_id")
def tmi_boxes_ascoded(spark, d):
    return _out(fw.total_field(b.obs(spark, d), _facets(spark, d), INC, DEC, FIELD, ascoded=True), "obs_id", places=4)


@query("tmi_unit_susceptibility", f"{_PAIR} SELECT obs_id, group_id, round(sum({s.tmi_term(_F, _F)} * {_T.replace('susceptibility', '1.0')}), 6) AS response FROM k4 GROUP BY obs_id, group_id")
def tmi_unit_susceptibility(spark, d):
    return _out(fw.total_field(b.obs(spark, d), _facets(spark, d), INC, DEC, FIELD, ["group_id"], susceptibility=F.lit(1.0)), "obs_id", "group_id")


_M = ("(susceptibility*588.74::DOUBLE*{0}+0.1::DOUBLE*group_id)", "(susceptibility*588.74::DOUBLE*{1})", "(susceptibility*588.74::DOUBLE*{2}-0.2::DOUBLE)")
_M = tuple(m.format(*_F) for m in _M)


@query("tmi_remanent_boxes", f"{_PAIR} SELECT obs_id, round(sum({s.tmi_term(_M, _F)} * -(100.0::DOUBLE / (4.0::DOUBLE * pi()))), 6) AS response FROM k4 GROUP BY obs_id")
def tmi_remanent_boxes(spark, d):
    facets = _facets(spark, d).withColumns({"mx": 0.1 * F.col("group_id"), "my": F.lit(0.0), "mz": F.lit(-0.2)})
    return _out(fw.total_field(b.obs(spark, d), facets, INC, DEC, FIELD, mode="vector"), "obs_id")


@query("solid_angle_sum", f"{_PAIR} SELECT obs_id, round(sum(om), 6) + 0.0 AS response FROM k4 GROUP BY obs_id")
def solid_angle_sum(spark, d):
    return fw.solid_angles(b.obs(spark, d), _facets(spark, d)).select("obs_id", (F.round("response", 6) + 0.0).alias("response"))


@query("surface_term_sum", f"{_PAIR} SELECT obs_id, round(sum(om * h), 4) AS response FROM k4 GROUP BY obs_id")
def surface_term_sum(spark, d):
    return _out(fw.forward(b.obs(spark, d), _facets(spark, d), "surface", F.lit(1.0)), "obs_id", places=4)


@query("gravity_two_level", f"{_PAIR}, per AS (SELECT obs_id, group_id, any_value(density) AS rho, sum({s.gravity_term()}) AS f FROM k4 GROUP BY obs_id, group_id) SELECT obs_id, round(sum(f * {_G} * rho), 6) AS predicted, count(*) AS n_bodies FROM per GROUP BY obs_id")
def gravity_two_level(spark, d):
    per = fw.gravity(b.obs(spark, d), _facets(spark, d), ["group_id"])
    return per.groupBy("obs_id").agg(F.round(F.sum("response"), 6).alias("predicted"), F.count("*").alias("n_bodies"))


_BOX = f"WITH {b.BOXES_SQL},\n{s.box_facets()}\n"


@query("mesh_volume", f"{_BOX} SELECT group_id, round(sum({s.dot(s.v('p'), s.cross(s.v('q'), s.v('r')))}) / 6.0, 6) AS volume FROM facets GROUP BY group_id")
def mesh_volume(spark, d):
    return _out(fw.mesh_volume(_facets(spark, d), ["group_id"]), "group_id", value="volume")


@query("model_volume_total", f"{_BOX}, per AS (SELECT group_id, sum({s.dot(s.v('p'), s.cross(s.v('q'), s.v('r')))}) / 6.0 AS volume FROM facets GROUP BY group_id) SELECT round(sum(abs(volume)), 6) AS total, count(*) AS n_bodies FROM per")
def model_volume_total(spark, d):
    return fw.mesh_volume(_facets(spark, d), ["group_id"]).agg(F.round(F.sum(F.abs("volume")), 6).alias("total"), F.count("*").alias("n_bodies"))


_N = s.cross(s.minus(s.v("q"), s.v("p")), s.minus(s.v("r"), s.v("p")))


@query("face_normals", f"{_BOX} SELECT group_id, t_id, " + ", ".join(f"round({n} / {s.size(_N)}, 6) + 0.0 AS n{a}" for a, n in zip("xyz", _N, strict=True)) + f", round({s.size(_N)} / 2, 6) AS area FROM facets")
def face_normals(spark, d):
    n, size = g.normal(*fw.corners())
    return _facets(spark, d).select("group_id", "t_id", *[(F.round(x, 6) + 0.0).alias(f"n{a}") for a, x in zip("xyz", n, strict=True)], F.round(size / 2, 6).alias("area"))


@query("tetra_volumes", f"{_BOX} SELECT group_id, t_id, round({s.dot(s.minus(s.v('q'), s.v('p')), s.cross(s.minus(s.v('r'), s.v('p')), s.minus(('0.0', '0.0', '0.0'), s.v('p'))))} / 6.0, 4) AS volume FROM facets")
def tetra_volumes(spark, d):
    p, q, r = fw.corners()
    return _facets(spark, d).select("group_id", "t_id", F.round(g.tetra_volume(p, q, r, (F.lit(0.0),) * 3), 4).alias("volume"))


@query("field_unit_vector", "SELECT n_nationkey AS k, round(cos(radians(n_nationkey*7-80))*cos(radians(n_nationkey*14)), 9) AS fx, round(cos(radians(n_nationkey*7-80))*sin(radians(n_nationkey*14)), 9) AS fy, round(-sin(radians(n_nationkey*7-80)), 9) AS fz FROM nation")
def field_unit_vector(spark, d):
    k = F.col("n_nationkey")
    f = g.field_unit((k * 7 - 80).cast("double"), (k * 14).cast("double"))
    return b.read(spark, d, "nation").select(k.alias("k"), *[F.round(x, 9).alias(f"f{a}") for a, x in zip("xyz", f, strict=True)])


@query(
    "group_magnetisation",
    f"WITH {b.BOXES_SQL}, m AS (SELECT group_id, susceptibility*588.74*{_F[0]}+0.1*group_id AS mx, susceptibility*588.74*{_F[1]} AS my, susceptibility*588.74*{_F[2]} AS mz FROM boxes)"
    " SELECT group_id, round(sqrt(mx*mx+my*my+mz*mz), 6) AS amplitude, round(mx/sqrt(mx*mx+my*my+mz*mz), 6) AS dx, round(mz/sqrt(mx*mx+my*my+mz*mz), 6) AS dz FROM m",
)
def group_magnetisation(spark, d):
    field = g.field_unit(F.lit(INC), F.lit(DEC))
    size, direction = g.magnetisation(F.col("susceptibility"), FIELD, field, "vector", (0.1 * F.col("group_id"), F.lit(0.0), F.lit(0.0)))
    return b.boxes(spark, d).select("group_id", F.round(size, 6).alias("amplitude"), F.round(direction[0], 6).alias("dx"), F.round(direction[2], 6).alias("dz"))


@query("skin_depths", "SELECT p_partkey AS k, round(CASE WHEN p_size % 7 = 0 THEN 1e9 ELSE 503.0/sqrt((p_size % 7)*0.01*(p_size*2.0)) END, 6) AS fd, round(CASE WHEN p_size % 7 = 0 THEN 1e9 ELSE 503.0/sqrt((p_size % 7)*0.01*(1.0/(2.0*p_retailprice/1e6))) END, 6) AS td FROM part")
def skin_depths(spark, d):
    sigma = (F.col("p_size") % 7) * 0.01
    return b.read(spark, d, "part").select(
        F.col("p_partkey").alias("k"), F.round(g.skin_depth(sigma, F.col("p_size") * 2.0), 6).alias("fd"), F.round(g.skin_depth_time(sigma, F.col("p_retailprice") / 1e6), 6).alias("td")
    )


_GATES = [5e-5, 1e-4, 2e-4, 4e-4, 8e-4, 1.6e-3, 3.2e-3, 6.4e-3]


@query(
    "em_active_response",
    f"WITH {b.BOXES_SQL}, rx AS (SELECT s_suppkey AS rx_id, (s_suppkey % 20)*150.0 AS x, (s_suppkey // 20)*150.0 AS y FROM supplier), gates(gate, t) AS (VALUES "
    + ", ".join(f"({i}, {t!r}::DOUBLE)" for i, t in enumerate(_GATES))
    + """), active AS (SELECT rx_id, max(greatest(0.0001::DOUBLE, group_id*0.01)) AS sig FROM rx JOIN boxes ON abs(cx-x) <= 350 AND abs(cy-y) <= 350 GROUP BY rx_id),
 r AS (SELECT rx.rx_id, gate, coalesce(sig, 0.0001::DOUBLE) AS sig, t, greatest(1.0, sqrt(x*x+y*y)) AS dist FROM rx LEFT JOIN active USING (rx_id) CROSS JOIN gates)
 SELECT rx_id, gate, round(sig*pow(503.0/sqrt(sig*(1.0/(2.0*t))),3)/pow(dist,3), 9) AS response FROM r""",
)
def em_active_response(spark, d):
    rx = b.read(spark, d, "supplier").select(F.col("s_suppkey").alias("rx_id"), ((F.col("s_suppkey") % 20) * 150.0).alias("x"), (F.floor(F.col("s_suppkey") / 20) * 150.0).alias("y"))
    groups = b.boxes(spark, d).select("cx", "cy", (F.col("group_id") * 0.01).alias("sigma"))
    near = (F.abs(F.col("cx") - F.col("x")) <= 350) & (F.abs(F.col("cy") - F.col("y")) <= 350)
    active = rx.join(F.broadcast(groups), near).groupBy("rx_id").agg(F.max(F.greatest(F.lit(1e-4), "sigma")).alias("sig"))
    gates = F.explode(F.array(*[F.struct(F.lit(i).alias("gate"), F.lit(t).alias("t")) for i, t in enumerate(_GATES)]))
    rows = rx.join(active, "rx_id", "left").select("rx_id", F.coalesce("sig", F.lit(1e-4)).alias("sig"), F.sqrt(F.col("x") ** 2 + F.col("y") ** 2).alias("dist"), gates.alias("g"))
    return rows.select("rx_id", F.col("g.gate").alias("gate"), F.round(g.active_response(F.col("sig"), F.col("g.t"), F.col("dist")), 9).alias("response"))


@query("em_unit_response", "SELECT a.n_nationkey AS group_id, s_suppkey AS rx_id, round(greatest(0.0001::DOUBLE, a.n_nationkey*0.01)*pow(503.0/sqrt(greatest(0.0001::DOUBLE, a.n_nationkey*0.01)*500.0),3)/pow(greatest(1.0, s_suppkey*10.0),3), 9) AS response FROM nation a, supplier")
def em_unit_response(spark, d):
    groups = b.read(spark, d, "nation").select(F.col("n_nationkey").alias("group_id"), F.greatest(F.lit(1e-4), F.col("n_nationkey") * 0.01).alias("sigma"))
    rx = b.read(spark, d, "supplier").select(F.col("s_suppkey").alias("rx_id"))
    both = rx.crossJoin(F.broadcast(groups))
    return both.select("group_id", "rx_id", F.round(g.active_response(F.col("sigma"), F.lit(1e-3), F.col("rx_id") * 10.0), 9).alias("response"))


@query(
    "mt_impedance",
    f"WITH {b.BOXES_SQL}, sg AS (SELECT avg(group_id*0.01+0.001) AS sigma FROM boxes), st AS (SELECT s_suppkey AS station, pow(10.0, s_suppkey % 6 - 3) AS f FROM supplier)"
    " SELECT station, c.component, round(CASE c.component WHEN 'xy' THEN 1 WHEN 'yx' THEN -1 ELSE 0 END * sqrt(2*pi()*f*4e-7*pi()/sigma), 9) + 0.0 AS z FROM st, sg, (VALUES ('xx'),('xy'),('yx'),('yy')) c(component)",
)
def mt_impedance(spark, d):
    sigma = b.boxes(spark, d).agg(F.avg(F.col("group_id") * 0.01 + 0.001).alias("sigma"))
    st = b.read(spark, d, "supplier").select(F.col("s_suppkey").alias("station"), F.pow(F.lit(10.0), (F.col("s_suppkey") % 6 - 3).cast("double")).alias("f"))
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.lit(k).alias("k")) for c, k in (("xx", 0), ("xy", 1), ("yx", -1), ("yy", 0))]))
    rows = st.crossJoin(F.broadcast(sigma)).select("station", "f", "sigma", parts.alias("c"))
    return rows.select("station", "c.component", (F.round(F.col("c.k") * g.mt_impedance(F.col("sigma"), F.col("f")), 9) + 0.0).alias("z"))


@query(
    "prism_forward",
    f"WITH obs AS (SELECT s_suppkey AS obs_id, (s_suppkey % 10)*100.0 AS x, (s_suppkey // 10)*100.0 AS y, 50.0::DOUBLE AS z FROM supplier), {b.VOXELS_SQL},"
    " cubes AS (SELECT 0 AS group_id, ix*100.0+50 AS cx, iy*100.0+50 AS cy, -iz*100.0-50 AS cz, 50.0::DOUBLE AS half, density-2.67 AS density, susceptibility FROM voxels),\n"
    f"{s.box_facets('cubes')},\npair AS (SELECT * FROM obs, facets),\n{s.pair_ctes()} SELECT obs_id, round(sum({s.gravity_term()} * {_G} * density), 6) AS response FROM k4 GROUP BY obs_id",
)
def prism_forward(spark, d):
    k = F.col("s_suppkey")
    stations = b.read(spark, d, "supplier").select(k.alias("obs_id"), ((k % 10) * 100.0).alias("x"), (F.floor(k / 10) * 100.0).alias("y"), F.lit(50.0).alias("z"))
    cubes = dealt(b.voxels(spark, d), "cell_id").select(
        F.lit(0).alias("group_id"), (F.col("ix") * 100.0 + 50).alias("cx"), (F.col("iy") * 100.0 + 50).alias("cy"), (-F.col("iz") * 100.0 - 50).alias("cz"), F.lit(50.0).alias("half"), (F.col("density") - 2.67).alias("density")
    )
    return _out(fw.gravity(stations, fw.box_facets(cubes)), "obs_id")


@query("ellipsoid_and_bowl", f"WITH {b.OBS_SQL}, w AS (SELECT *, pow((x-2000)/900.0,2)+pow((y-1000)/600.0,2) AS val FROM obs) SELECT obs_id, round(CASE WHEN val > 1 THEN 0 ELSE -300+120*sqrt(1-val) END, 6) AS top, round(CASE WHEN val > 1 THEN -100 ELSE -100-80*sqrt(1-val) END, 6) AS bowl FROM w")
def ellipsoid_and_bowl(spark, d):
    x, y = F.col("x"), F.col("y")
    return b.obs(spark, d).select(
        "obs_id", F.round(g.ellipsoid_top(x, y, 2000.0, 1000.0, -300.0, 900.0, 600.0, 120.0), 6).alias("top"), F.round(g.bowl(x, y, 2000.0, 1000.0, 80.0, 900.0, 600.0, -100.0), 6).alias("bowl")
    )


@query("dipping_plane", f"WITH {b.OBS_SQL} SELECT obs_id, round(-200+(x*sin(radians(35))+y*cos(radians(35)))*tan(radians(12)), 6) AS z_true, round(-200-(x*sin(radians(35))+y*cos(radians(35)))*tan(radians(12)), 6) AS z_initial FROM obs")
def dipping_plane(spark, d):
    x, y = F.col("x"), F.col("y")
    return b.obs(spark, d).select("obs_id", F.round(g.dipping_plane(x, y, -200.0, 12.0, 35.0), 6).alias("z_true"), F.round(g.dipping_plane(x, y, -200.0, 12.0, 35.0, -1), 6).alias("z_initial"))


@query("bouguer_slab", f"WITH {b.OBS_SQL} SELECT obs_id, round(2*pi()*{_G}*2.67*value, 6) AS slab FROM obs")
def bouguer_slab(spark, d):
    return b.obs(spark, d).select("obs_id", F.round(g.bouguer_slab(F.lit(2.67), F.col("value")), 6).alias("slab"))


@query("cross_gradient_weight", "SELECT p_size AS cell, count(*) AS n, pow(p_size, 4)/16.0 AS weight FROM part GROUP BY p_size")
def cross_gradient_weight(spark, d):
    return b.read(spark, d, "part").groupBy(F.col("p_size").alias("cell")).agg(F.count("*").alias("n")).select("cell", "n", g.cross_gradient_weight(F.col("cell").cast("double")).alias("weight"))


@query("gravity_facet_gradient")
def gravity_facet_gradient(spark, d):
    return fw.facet_gradient(b.obs(spark, d), _facets(spark, d))
