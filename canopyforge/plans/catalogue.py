"""Every query of the point-cloud engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyforge.functions import names, sensors, storage
from canopyforge.functions.points import POINTS_SQL, bounds_of, cell, points, with_cells
from canopyforge.operators import cells, change, crowns, focal, ground, lookup, outliers, regions, surface, terrain, tiles, trees
from canopyforge.sources import gtiff, las, layout, shapefile, vectors

from . import post

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# Tables that several queries start from, as SQL.
PTS = f"pts as ({POINTS_SQL})"
CELLS = f"{PTS}, c as (select floor(x/2)::int as ix, floor(y/2)::int as iy, max(z) as value from pts group by all)"
DEM = f"{PTS}, dem as (select floor(x/2)::int as col, floor((48-y)/2)::int as row, min(z) as z from pts where classification = 2 group by all)"
MASK = f"{PTS}, m as (select floor(x/2)::int as ix, floor(y/2)::int as iy from pts group by all having max(z) >= 133)"


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return with_cells(points(spark, sf), 2.0).groupBy("ix", "iy").agg(F.max("z").alias("value"))


def _dem(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf).where("classification = 2")
    return p.groupBy(cell("x", 2.0).alias("col"), F.floor((48 - F.col("y")) / 2).cast("int").alias("row")).agg(F.min("z").alias("z"))


def _mask(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf).where("value >= 133").select("ix", "iy")


def _unique(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct points with a key of their values."""
    p = points(spark, sf).select("x", "y", "z", "classification").distinct()
    return p.withColumn("key", F.struct("x", "y", "z", "classification"))


def _crowns(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/customer.parquet")
    x, y = (F.col("c_custkey") * 7 % 180) * 0.25, (F.col("c_custkey") * 11 % 176) * 0.25
    w, h = 1 + (F.col("c_custkey") % 5) * 0.5, 1 + (F.col("c_custkey") % 3) * 0.5
    return c.select(F.col("c_custkey").cast("int").alias("crown_id"), x.alias("xmin"), y.alias("ymin"), (x + w).alias("xmax"), (y + h).alias("ymax"), (w * h).alias("area"), (x + w / 2).alias("cx"), (y + h / 2).alias("cy"))


CROWNS = """crowns as (select crown_id, x as xmin, y as ymin, x + w as xmax, y + h as ymax, w * h as area, x + w / 2 as cx, y + h / 2 as cy from (
  select c_custkey::int as crown_id, (c_custkey * 7 % 180) * 0.25e0 as x, (c_custkey * 11 % 176) * 0.25e0 as y, 1 + (c_custkey % 5) * 0.5e0 as w, 1 + (c_custkey % 3) * 0.5e0 as h
  from customer) t)"""


def _epochs(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).groupBy("epoch", cell("x", 4.0).alias("col"), cell("y", 4.0).alias("row")).agg(F.max("z").alias("v"))


EPOCHS = f"{PTS}, r as (select epoch, floor(x/4)::int as col, floor(y/4)::int as row, max(z) as v from pts group by all), e as (select epoch, row_number() over (order by epoch) - 1 as i from (select distinct epoch from r))"


def _add(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


# --- aggregates by cell ---------------------------------------------------------------------------------------------


@_add("cell_stats", f"with {PTS} select floor(x/2)::int as ix, floor(y/2)::int as iy, count(*) as n, min(z) as z_min, max(z) as z_max, round(avg(z), 9) as z_mean, round(quantile_cont(z, 0.99), 10) as z_pct from pts group by 1, 2")
def _(spark, sf):
    return cells.cell_stats(points(spark, sf), 2.0, 0.99)


@_add("nearest_in_cell", f"""with {PTS}, t as (select *, floor(x/2)::int as ix, floor(y/2)::int as iy from pts),
 d as (select ix, iy, (x-(ix+0.5e0)*2)*(x-(ix+0.5e0)*2)+(y-(iy+0.5e0)*2)*(y-(iy+0.5e0)*2) as d2, z from t)
 select ix, iy, d2, z from (select *, row_number() over (partition by ix, iy order by d2, z) as r from d) where r = 1""")
def _(spark, sf):
    return cells.nearest_in_cell(points(spark, sf), 2.0)


@_add("candidate_layer", f"with {PTS}, t as (select point_id, x, y, z, floor(x/2)::int as ix, floor(y/2)::int as iy, classification from pts) select point_id, ix, iy, x, y, z, z_low from (select *, min(z) over (partition by ix, iy) as z_low from t) where z <= z_low + 0.75e0")
def _(spark, sf):
    return cells.candidate_layer(points(spark, sf), 2.0, 0.75).select("point_id", "ix", "iy", "x", "y", "z", "z_low")


@_add("remove_outliers", f"""with {PTS}, m as (select median(z) as mid, count(*) as n from pts), d as (select median(abs(z - mid)) as mad from pts, m)
 select point_id, x, y, z from pts, m, d where n < 10 or abs(z - mid) / (1.4826e0 * (mad + 1e-12)) <= 1.5""")
def _(spark, sf):
    return cells.remove_outliers(points(spark, sf), 1.5).select("point_id", "x", "y", "z")


@_add("density_stats", f"""with {PTS}, k as (select floor(x/2)::int as ix, floor(y/2)::int as iy, count(*) as n from pts group by all)
 select count(*) as occupied, ((max(ix)-min(ix)+1)*(max(iy)-min(iy)+1))::bigint as cells, round(count(*)::double / ((max(ix)-min(ix)+1)*(max(iy)-min(iy)+1)), 9) as occupancy,
 median(n) as n_median, round(avg(n), 9) as n_mean, round(quantile_cont(n, 0.25), 9) as n_q25, round(quantile_cont(n, 0.75), 9) as n_q75 from k""")
def _(spark, sf):
    return cells.density_stats(points(spark, sf), 2.0)


_ENTROPY = """b as (select floor(x/4)::int as ix, floor(y/4)::int as iy, floor(h/2)::int as bin, count(*) as n, max(h) as top from pts where h >= {least} group by 1, 2, 3),
 en as (select ix, iy, sum(n)::bigint as n, sum(n * ln(n)) as nln, count(*) as bins, max(top) as top from b group by 1, 2),
 ent as (select ix, iy, round(case when top > 0 then abs(ln(n) - nln / n) end, 6) as fhd, round(case when top > 0 then case when bins > 1 then abs(ln(n) - nln / n) / ln(greatest(bins, 2)) else 0 end end, 6) as vci from en)"""


@_add("height_entropy", f"with {PTS}, {_ENTROPY.format(least=0)} select * from ent")
def _(spark, sf):
    return cells.entropy(points(spark, sf), 4.0, 2.0)


@_add("structure_metrics", f"""with {PTS}, {_ENTROPY.format(least=2)}, s as (select floor(x/4)::int as ix, floor(y/4)::int as iy, count(*) as n, round(avg(h), 6) as h_mean, max(h) as h_max,
 round(stddev_pop(h), 6) as h_sd, round(avg((h >= 10)::int::double), 6) as cover from pts where h >= 2 group by 1, 2) select s.*, fhd, vci from s join ent using (ix, iy)""")
def _(spark, sf):
    return cells.structure_metrics(points(spark, sf), 4.0, 2.0, 10.0, 2.0)


@_add("otsu_threshold", f"""with {PTS}, e as (select min(z) as lo, max(z) as hi, count(*) as n from pts), w as (select *, (hi - lo) / 256 as width from e),
 hist as (select least(255, floor((z - lo) / width)::int) as bin, lo, width, n, count(*) as c from pts, w group by all),
 s as (select *, sum(c) over u as w0, sum(c * (lo + (bin + 0.5e0) * width)) over u as m0, sum(c * (lo + (bin + 0.5e0) * width)) over () as mt from hist window u as (order by bin rows between unbounded preceding and current row)),
 q as (select n, bin, round(lo + (bin + 0.5e0) * width, 9) as mid, round(w0 * (n - w0) * power(m0 / w0 - (mt - m0) / nullif(n - w0, 0), 2), 3) as between_ from s)
 select case when n >= 1000 then mid end as threshold from q where between_ is not null order by between_ desc, bin limit 1""")
def _(spark, sf):
    return cells.otsu(points(spark, sf), "z")


@_add("lowest_m", f"with {PTS} select * from (select floor(x/2)::int as ix, floor(y/2)::int as iy, z, row_number() over (partition by floor(x/2)::int, floor(y/2)::int order by z)::int as rank from pts) where rank <= 4")
def _(spark, sf):
    return cells.top_m(points(spark, sf), 2.0, 4)


@_add("layer_envelope", f"with {PTS} select floor(x/2)::int as ix, floor(y/2)::int as iy, max(z) as value from pts where h >= 5 or h < 2 group by 1, 2")
def _(spark, sf):
    p = with_cells(points(spark, sf), 2.0)
    layers = [p.where(w).groupBy("ix", "iy").agg(F.max("z").alias("value")) for w in ("h < 2", "h >= 5 and h < 15", "h >= 15")]
    return cells.envelope(layers[0].unionByName(layers[1]).unionByName(layers[2]), True)


# --- neighbourhoods -------------------------------------------------------------------------------------------------


@_add("focal_median", f"with {CELLS} select a.ix, a.iy, a.value, median(b.value) as mid from c a join c b on abs(a.ix-b.ix) <= 1 and abs(a.iy-b.iy) <= 1 group by all")
def _(spark, sf):
    return focal.focal(_cells(spark, sf), 1, F.median("value"), "mid")


@_add("focal_mean", f"with {CELLS} select a.ix, a.iy, round(sum(b.value) / count(*), 9) as mean from c a join c b on abs(a.ix-b.ix) <= 3 and abs(a.iy-b.iy) <= 3 group by all")
def _(spark, sf):
    c = _cells(spark, sf)
    total, n = (focal.running(c, 3, w).select("ix", "iy", F.col("focal").alias(w)) for w in ("sum", "count"))
    return total.join(n, ["ix", "iy"]).select("ix", "iy", F.round(F.col("sum") / F.col("count"), 9).alias("mean"))


@_add("local_maxima", f"with {CELLS}, f as (select a.ix, a.iy, a.value, max(b.value) as top from c a join c b on abs(a.ix-b.ix) <= 1 and abs(a.iy-b.iy) <= 1 group by all) select ix, iy, value from f where value = top and value >= 120")
def _(spark, sf):
    return focal.local_maxima(_cells(spark, sf), 3, 120.0)


@_add("dilate", f"with {MASK}, n(dx, dy) as (values (0,0),(1,0),(-1,0),(0,1),(0,-1),(1,1),(1,-1),(-1,1),(-1,-1),(2,0),(-2,0),(0,2),(0,-2)) select distinct (ix+dx)::int as ix, (iy+dy)::int as iy from m, n")
def _(spark, sf):
    return focal.dilate(_mask(spark, sf), 2)


@_add("robust_vote", f"""with {CELLS}, u as (select distinct a.ix + dx as ix, a.iy + dy as iy from c a, (select unnest(range(-1, 2))::int as dx) x, (select unnest(range(-1, 2))::int as dy) y),
 near as (select u.ix, u.iy, b.value from u join c b on abs(u.ix-b.ix) <= 1 and abs(u.iy-b.iy) <= 1), m as (select ix, iy, median(value) as mid from near group by 1, 2),
 d as (select ix, iy, median(abs(value - mid)) as mad from near join m using (ix, iy) group by 1, 2),
 k as (select ix, iy, value from near join m using (ix, iy) join d using (ix, iy) where abs(value - mid) / (1.4826e0 * greatest(mad, 0.05e0)) <= 1.5)
 select ix, iy, count(*) as n, case when count(*) >= 4 then median(value) end as value from k group by 1, 2""")
def _(spark, sf):
    return focal.robust_vote(_cells(spark, sf), 1, 1.5, 4, 0.05)


@_add("fix_pits", f"with {CELLS}, f as (select a.ix, a.iy, a.value, median(b.value) as mid from c a join c b on abs(a.ix-b.ix) <= 1 and abs(a.iy-b.iy) <= 1 group by all) select ix, iy, case when value < mid - 1 then mid else value end as value from f")
def _(spark, sf):
    return focal.fix_pits(_cells(spark, sf), 1.0)


@_add("gaussian", f"""with {CELLS}, w as (select k::int as k, exp(-0.5e0 * k * k) as w from (select unnest(range(-3, 4)) as k)),
 h as (select a.ix, a.iy, sum(b.value * w) / sum(w) as value from c a, w join c b on b.ix = a.ix - w.k and b.iy = a.iy group by all)
 select a.ix, a.iy, round(sum(b.value * w) / sum(w), 6) as value from h a, w join h b on b.iy = a.iy - w.k and b.ix = a.ix group by all""")
def _(spark, sf):
    return focal.smooth(_cells(spark, sf), 1.0).select("ix", "iy", F.round("value", 6).alias("value"))


@_add("fill_idw", f"""with {CELLS}, v as (select * from c where (ix * 5 + iy) % 7 <> 0), holes as (select ix, iy from c where (ix * 5 + iy) % 7 = 0)
 select h.ix, h.iy, round(sum(value / ((v.ix-h.ix)*(v.ix-h.ix)+(v.iy-h.iy)*(v.iy-h.iy))) / sum(1e0 / ((v.ix-h.ix)*(v.ix-h.ix)+(v.iy-h.iy)*(v.iy-h.iy))), 9) as value
 from holes h join v on abs(v.ix-h.ix) <= 2 and abs(v.iy-h.iy) <= 2 group by all having count(*) >= 3""")
def _(spark, sf):
    c = _cells(spark, sf)
    hole = (F.col("ix") * 5 + F.col("iy")) % 7 == 0
    return focal.fill_local(c.where(~hole), c.where(hole), 2, "idw", 3).select("ix", "iy", F.round("value", 9).alias("value"))


# --- lookups --------------------------------------------------------------------------------------------------------

_CORNERS = """q as (select *, floor(x/2 - {s})::int as i, floor(y/2 - {s})::int as j from p), ab as (select *, x/2 - {s} - i as a, y/2 - {s} - j as b from q),
 v as (select x, y, z, classification, c0.value as v0, case when c0.value is not null and c1.value is not null and c2.value is not null and c3.value is not null then (1-a)*(1-b)*c0.value + a*(1-b)*c1.value + (1-a)*b*c2.value + a*b*c3.value end as v
   from ab left join c c0 on c0.ix = i and c0.iy = j left join c c1 on c1.ix = i+1 and c1.iy = j left join c c2 on c2.ix = i and c2.iy = j+1 left join c c3 on c3.ix = i+1 and c3.iy = j+1)"""


@_add("bilinear_corner", f"with {CELLS}, p as (select x, y, z, classification from pts), {_CORNERS.format(s='0')} select x, y, z, classification, round(coalesce(v, v0), 9) as value from v")
def _(spark, sf):
    return lookup.bilinear(points(spark, sf), _cells(spark, sf), 2.0, "corner").select("x", "y", "z", "classification", F.round("value", 9).alias("value"))


@_add("bilinear_centre", f"with {CELLS}, p as (select x, y, z, classification from pts), {_CORNERS.format(s='0.5e0')} select x, y, z, classification, round(v, 9) as value from v")
def _(spark, sf):
    return lookup.bilinear(points(spark, sf), _cells(spark, sf), 2.0, "centre").select("x", "y", "z", "classification", F.round("value", 9).alias("value"))


_LOW = f"{PTS}, c as (select floor(x/2)::int as ix, floor(y/2)::int as iy, min(z) as value from pts where classification = 2 group by all)"


@_add("normalize_heights", f"with {_LOW}, p as (select x, y, z, classification from pts), {_CORNERS.format(s='0.5e0')} select x, y, z, classification, round(case when classification = 2 then 0 else greatest(0, z - coalesce(v, z)) end, 9) as height from v")
def _(spark, sf):
    low = with_cells(points(spark, sf).where("classification = 2"), 2.0).groupBy("ix", "iy").agg(F.min("z").alias("value"))
    return lookup.normalize_heights(points(spark, sf), low, 2.0).select("x", "y", "z", "classification", F.round("height", 9).alias("height"))


@_add("idw_k8", f"""with {PTS}, g as (select distinct x, y, z from pts where classification = 2), c as (select distinct floor(x/4)::int as ix, floor(y/4)::int as iy from pts),
 d as (select ix, iy, (x-(ix+0.5e0)*4)*(x-(ix+0.5e0)*4)+(y-(iy+0.5e0)*4)*(y-(iy+0.5e0)*4) as d2, z from c, g), r as (select *, row_number() over (partition by ix, iy order by d2, z) as r from d)
 select ix, iy, round(sum(z / power(greatest(sqrt(d2), 1e-6), 2)) / sum(1 / power(greatest(sqrt(d2), 1e-6), 2)), 6) as value from r where r <= 8 group by 1, 2""")
def _(spark, sf):
    p = points(spark, sf)
    return lookup.idw(p.where("classification = 2").select("x", "y", "z").distinct(), with_cells(p, 4.0).select("ix", "iy").distinct(), 4.0, reach=1).select("ix", "iy", F.round("value", 6).alias("value"))


@_add("nearest_cell", f"""with {CELLS}, v as (select * from c where value >= 136), d as (select c.ix, c.iy, v.value, ((v.ix-c.ix)*(v.ix-c.ix)+(v.iy-c.iy)*(v.iy-c.iy))::bigint as d2, v.ix as sx, v.iy as sy from c, v)
 select ix, iy, value, d2 from (select *, row_number() over (partition by ix, iy order by d2, sx, sy) as r from d) where r = 1""")
def _(spark, sf):
    c = _cells(spark, sf)
    return lookup.nearest_cell(c, c.where("value >= 136"), 2)


# --- terrain --------------------------------------------------------------------------------------------------------


def _slope_sql(t: str, value: str, axis: str, name: str) -> str:
    """A derivative of a raster t, as SQL."""
    dx, dy = ("1", "0") if axis == "col" else ("0", "1")
    return (
        f"{name} as (select a.*, coalesce((f.{value} - p.{value}) / 4, (f.{value} - a.{value}) / 2, (a.{value} - p.{value}) / 2, 0) as {name}_ from {t} a "
        f"left join {t} f on f.col = a.col + {dx} and f.row = a.row + {dy} left join {t} p on p.col = a.col - {dx} and p.row = a.row - {dy})"
    )


GRADS = f"{DEM}, {_slope_sql('dem', 'z', 'col', 'gx')}, {_slope_sql('gx', 'z', 'row', 'gy')}"


@_add("slope_aspect_hillshade", f"""with {GRADS}, s as (select col, row, gx_ as gx, gy_ as gy, sqrt(gx_*gx_+gy_*gy_) as s, atan(sqrt(gx_*gx_+gy_*gy_)) as lean from gy)
 select col, row, round(100*s, 6) as slope_pct, round(degrees(lean), 6) as slope_deg, round(case when s >= 1e-8 then (90 - degrees(atan2(gy, -gx)) + 720) % 360 end, 6) as aspect,
 round(255 * greatest(0, least(1, sin(radians(45)) * cos(lean) + cos(radians(45)) * sin(lean) * cos(radians(135) - atan2(gy, -gx)))), 5) as hillshade from s""")
def _(spark, sf):
    t = terrain.slope_aspect_shade(_dem(spark, sf), 2.0)
    return t.select("col", "row", *[F.round(c, 6).alias(c) for c in ("slope_pct", "slope_deg", "aspect")], F.round("hillshade", 5).alias("hillshade"))


@_add("curvature", f"with {GRADS}, {_slope_sql('gy', 'gx_', 'col', 'gxx')}, {_slope_sql('gxx', 'gy_', 'row', 'gyy')} select col, row, round(gxx_ + gyy_, 6) as curvature from gyy")
def _(spark, sf):
    return terrain.curvature(_dem(spark, sf), 2.0).select("col", "row", F.round("curvature", 6).alias("curvature"))


@_add("topographic_position", f"with {DEM} select a.col, a.row, round(a.z - sum(b.z) / count(*), 9) as tpi from dem a join dem b on abs(a.col-b.col) <= 3 and abs(a.row-b.row) <= 3 group by a.col, a.row, a.z")
def _(spark, sf):
    return terrain.tpi(_dem(spark, sf), 3).select("col", "row", F.round("tpi", 9).alias("tpi"))


@_add("convergence", f"""with {GRADS}, s as (select *, sqrt(gx_*gx_+gy_*gy_) as s from gy), u as (select *, case when s > 1e-12 then -gx_/s else 0 end as ux, case when s > 1e-12 then -gy_/s else 0 end as uy from s),
 {_slope_sql('u', 'ux', 'col', 'a')}, {_slope_sql('a', 'uy', 'row', 'b')} select col, row, round(case when s > 1e-12 then -(a_ + b_) end, 6) as tci from b""")
def _(spark, sf):
    return terrain.tci(_dem(spark, sf), 2.0).select("col", "row", F.round("tci", 6).alias("tci"))


D8 = f"""{DEM}, n(k, dx, dy) as (values (0,-1,-1),(1,0,-1),(2,1,-1),(3,-1,0),(4,1,0),(5,-1,1),(6,0,1),(7,1,1)),
 pr as (select a.col, a.row, b.col as to_col, b.row as to_row, (a.z - b.z) / (2 * sqrt(dx*dx + dy*dy)) as s, k from dem a, n join dem b on b.col = a.col + dx and b.row = a.row + dy where a.z > b.z),
 d8 as (select dem.col, dem.row, z, to_col, to_row from dem left join (select *, row_number() over (partition by col, row order by s desc, k) as r from pr) p on p.col = dem.col and p.row = dem.row and r = 1)"""


@_add("d8_receivers", f"with {D8} select * from d8")
def _(spark, sf):
    return terrain.d8_receivers(_dem(spark, sf), 2.0)


ACC = f"""{D8}, w(src_c, src_r, col, row) as (select col, row, col, row from d8 union all select src_c, src_r, to_col, to_row from w join d8 using (col, row) where to_col is not null),
 acc as (select col, row, count(*)::bigint as acc from w group by 1, 2)"""


@_add("flow_accumulation", f"with recursive {ACC} select * from acc")
def _(spark, sf):
    return terrain.flow_accumulation(terrain.d8_receivers(_dem(spark, sf), 2.0), tile=8)


@_add("wetness_index", f"with recursive {ACC}, {_slope_sql('dem', 'z', 'col', 'gx')}, {_slope_sql('gx', 'z', 'row', 'gy')} select acc.col, acc.row, acc, round(ln((acc * 2 + 1e-6) / greatest(tan(radians(greatest(degrees(atan(sqrt(gx_*gx_+gy_*gy_))), 0.001))), 1e-6)), 6) as twi from acc join gy using (col, row)")
def _(spark, sf):
    return terrain.twi(_dem(spark, sf), 2.0).select("col", "row", "acc", F.round("twi", 6).alias("twi"))


@_add("depth_to_water", f"""with recursive {ACC}, hi as (select col, row from acc where acc * 2 >= 500), top as (select quantile_cont(acc * 2.0::double, 0.99) as t from acc),
 wet as (select col, row from hi union all select col, row from acc, top where acc * 2 >= t and not exists (select 1 from hi)),
 wz as (select wet.col, wet.row, z from wet join dem using (col, row)),
 d as (select a.col, a.row, a.z, b.z as wz, row_number() over (partition by a.col, a.row order by (a.col-b.col)*(a.col-b.col)+(a.row-b.row)*(a.row-b.row), b.col, b.row) as r from dem a, wz b)
 select col, row, greatest(0, z - wz) as dtw from d where r = 1""")
def _(spark, sf):
    return terrain.depth_to_water(_dem(spark, sf), 2.0)


# --- change ---------------------------------------------------------------------------------------------------------

_PAIRS = {"pairwise": "a.i < b.i", "sequential": "b.i = a.i + 1", "baseline": "a.i = 1 and b.i <> 1"}
_CHANGE = """p as (select a.epoch as e1, b.epoch as e2 from e a, e b where {on}), d as (select e1, e2, x.col, x.row, y.v - x.v as delta from p join r x on x.epoch = e1 join r y on y.epoch = e2 and y.col = x.col and y.row = x.row)"""
_SUMMARY = """select e1, e2, count(*) as valid_cells, min(delta) as delta_min, max(delta) as delta_max, round(avg(delta), 6) as delta_mean, round(stddev_pop(delta), 6) as delta_std,
 (count(*) filter (abs(delta) > 0.5) * 16)::double as changed_area, (count(*) filter (abs(delta) <= 0.5) * 16)::double as stable_area, (count(*) filter (delta > 0.5) * 16)::double as gain_area, (count(*) filter (delta < -0.5) * 16)::double as loss_area,
 round(coalesce(sum(delta) filter (delta > 0.5), 0) * 16, 6) as gain_volume, round(coalesce(sum(delta) filter (delta < -0.5), 0) * 16, 6) as loss_volume, round(coalesce(sum(delta) filter (abs(delta) > 0.5), 0) * 16, 6) as net_volume from d group by 1, 2"""


def _changes(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    r = _epochs(spark, sf)
    return change.change(r, change.pairs(r, mode, 1), 0.5)


for _mode, _on in _PAIRS.items():
    _add(f"change_summary_{_mode}", f"with {EPOCHS}, {_CHANGE.format(on=_on)} {_SUMMARY}")(lambda spark, sf, m=_mode: change.summary(_changes(spark, sf, m), 16.0))


@_add("change_cells", f"with {EPOCHS}, {_CHANGE.format(on=_PAIRS['sequential'])} select *, abs(delta) as absolute, delta > 0.5 as gain, delta < -0.5 as loss, abs(delta) <= 0.5 as stable, abs(delta) > 0.5 as detected from d")
def _(spark, sf):
    return _changes(spark, sf, "sequential")


@_add("order_names", "with t as (select p_name || '_' || p_partkey || '_v' || (p_size % 7) || '.tif' as name from part) select name, list_transform(regexp_extract_all(name, '\\d+'), lambda x: x::bigint)[-2] as stamp from t")
def _(spark, sf):
    t = spark.read.parquet(f"{sf}/part.parquet").select(F.concat("p_name", F.lit("_"), "p_partkey", F.lit("_v"), F.col("p_size") % 7, F.lit(".tif")).alias("name"))
    return change.order_key(t).select("name", F.element_at("sort_key", -2).alias("stamp"))


# --- tiles ----------------------------------------------------------------------------------------------------------


@_add("tile_halo", f"""with {PTS}, t as (select tx::int as tx, ty::int as ty from (select unnest(range(-1, 4)) as tx) a, (select unnest(range(-1, 4)) as ty) b)
 select tx, ty, count(*) as n, count(*) filter (x >= tx*16 and x < tx*16+16 and y >= ty*16 and y < ty*16+16) as n_core, max(z) as z_max from pts join t on x >= tx*16-2 and x <= tx*16+18 and y >= ty*16-2 and y <= ty*16+18 group by 1, 2""")
def _(spark, sf):
    return tiles.assign(points(spark, sf), 16.0, 2.0).groupBy("tx", "ty").agg(F.count("*").alias("n"), F.count_if("is_core").alias("n_core"), F.max("z").alias("z_max"))


@_add("mosaic_first", f"""with {PTS}, t as (select tx, ty from (select unnest(range(-1, 4)) as tx) a, (select unnest(range(-1, 4)) as ty) b),
 v as (select (tx + 1) * 10 + ty + 1 as tile, floor(x/2)::int as col, floor(y/2)::int as row, max(z) as value from pts join t on x >= tx*16-2 and x <= tx*16+18 and y >= ty*16-2 and y <= ty*16+18 group by all)
 select col, row, value, tile::int as tile from (select *, row_number() over (partition by col, row order by tile) as r from v) where r = 1""")
def _(spark, sf):
    t = tiles.assign(points(spark, sf), 16.0, 2.0).withColumn("tile", ((F.col("tx") + 1) * 10 + F.col("ty") + 1).cast("int"))
    return tiles.mosaic(t.groupBy("tile", cell("x", 2.0).alias("col"), cell("y", 2.0).alias("row")).agg(F.max("z").alias("value")))


@_add("tile_sources", """with s as (select 'f' || s_suppkey as path, (s_suppkey * 7 % 40)::double as x, (s_suppkey * 13 % 40)::double as y, 1.0 + s_suppkey % 9 as w from supplier),
 t as (select tx * 4 + ty as tile, tx * 12.0 - 1 as x0, ty * 12.0 - 1 as y0 from (select unnest(range(0, 4)) as tx) a, (select unnest(range(0, 4)) as ty) b)
 select 't' || tile as tile, count(*) as n, string_agg(path, ',' order by path) as paths from t join s on x <= x0 + 14 and x + w >= x0 and y <= y0 + 14 and y + w >= y0 group by 1""")
def _(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.concat(F.lit("f"), "s_suppkey").alias("path"), (F.col("s_suppkey") * 7 % 40).cast("double").alias("x"), (F.col("s_suppkey") * 13 % 40).cast("double").alias("y"), (1.0 + F.col("s_suppkey") % 9).alias("w"))
    files = s.select("path", F.struct(F.col("x").alias("xmin"), F.col("y").alias("ymin"), (F.col("x") + F.col("w")).alias("xmax"), (F.col("y") + F.col("w")).alias("ymax")).alias("bounds"))
    plan = [tiles.Tile(f"t{i * 4 + j}", (i * 12.0, j * 12.0, i * 12.0 + 12, j * 12.0 + 12), (i * 12.0 - 1, j * 12.0 - 1, i * 12.0 + 13, j * 12.0 + 13)) for i in range(4) for j in range(4)]
    out = tiles.sources_of_tiles(tiles.as_table(spark, plan), files, 12.0)
    return out.select("tile", F.size("paths").cast("long").alias("n"), F.array_join("paths", ",").alias("paths"))


# --- regions --------------------------------------------------------------------------------------------------------

_LABEL = """e as (select a.ix as ax, a.iy as ay, b.ix as bx, b.iy as by_ from m a join m b on {near}), w(sx, sy, ix, iy) as (select ix, iy, ix, iy from m union select sx, sy, bx, by_ from w join e on ax = ix and ay = iy),
 l as (select ix, iy, min(sx::bigint * 4294967296 + sy + 2147483648) as label from w group by 1, 2)"""
_EIGHT, _FOUR = "abs(a.ix-b.ix) <= 1 and abs(a.iy-b.iy) <= 1", "abs(a.ix-b.ix) + abs(a.iy-b.iy) <= 1"


@_add("components_8", f"with recursive {MASK}, {_LABEL.format(near=_EIGHT)} select * from l")
def _(spark, sf):
    return regions.components(_mask(spark, sf), True, tile=8)


@_add("components_4", f"with recursive {MASK}, {_LABEL.format(near=_FOUR)} select * from l")
def _(spark, sf):
    return regions.components(_mask(spark, sf), False, tile=8)


_HOLES = """v as (select ix, iy, value from c where value >= 128), x as (select min(ix) as x0, max(ix) as x1, min(iy) as y0, max(iy) as y1 from v),
 m as (select a.ix::int as ix, b.iy::int as iy from x, unnest(range(x0, x1 + 1)) a(ix), unnest(range(y0, y1 + 1)) b(iy) where not exists (select 1 from v where v.ix = a.ix and v.iy = b.iy)),
 {label}, big as (select label from l, x group by label having count(*) <= 12 and not bool_or(ix in (x0, x1) or iy in (y0, y1))), h as (select ix, iy, label from l join big using (label))"""


@_add("small_holes", f"with recursive {CELLS}, {_HOLES.format(label=_LABEL.format(near=_FOUR))} select * from h")
def _(spark, sf):
    return regions.small_holes(_cells(spark, sf).where("value >= 128"), 12, False)


_HIGH = _HOLES.replace("value >= 128", "value >= 133")


@_add("small_holes_of_high_cells", f"with recursive {CELLS}, {_HIGH.format(label=_LABEL.format(near=_FOUR))} select * from h")
def _(spark, sf):
    return regions.small_holes(_cells(spark, sf).where("value >= 133"), 12, False)


@_add("fill_holes_of_high_cells", f"""with recursive {CELLS}, {_HIGH.format(label=_LABEL.format(near=_FOUR))}, f as (select h.ix, h.iy, avg(v.value) as value from h join v on abs(v.ix-h.ix) <= 1 and abs(v.iy-h.iy) <= 1 group by 1, 2)
 select ix, iy, value from v union all select ix, iy, round(value, 9) from f""")
def _(spark, sf):
    return regions.fill_small_voids(_cells(spark, sf).where("value >= 133"), "mean", 12, 1, diagonal=False).select("ix", "iy", F.round("value", 9).alias("value"))


_ENCLOSED = _HIGH.replace("count(*) <= 12 and ", "")


@_add("fill_enclosed", f"""with recursive {CELLS}, {_ENCLOSED.format(label=_LABEL.format(near=_FOUR))}, f as (select h.ix, h.iy, max(v.value) as value from h join v on abs(v.ix-h.ix) <= 1 and abs(v.iy-h.iy) <= 1 group by 1, 2)
 select ix, iy, coalesce(f.value, c.value) as value from c full join f using (ix, iy)""")
def _(spark, sf):
    return regions.fill_enclosed(_cells(spark, sf), 133.0)


_CROSS = "(values (0,0),(1,0),(-1,0),(0,1),(0,-1)) n(dx, dy)"


@_add("closed_mask", f"""with recursive {PTS}, m0 as (select floor(x/2)::int as ix, floor(y/2)::int as iy from pts group by all having max(z) >= 135), g as (select distinct (ix+dx)::int as ix, (iy+dy)::int as iy from m0, {_CROSS}),
 v as (select ix, iy from (select ix+dx as ix, iy+dy as iy from g, {_CROSS}) group by 1, 2 having count(*) = 5 union select ix, iy from m0), x as (select min(ix) as x0, max(ix) as x1, min(iy) as y0, max(iy) as y1 from v),
 m as (select a.ix::int as ix, b.iy::int as iy from x, unnest(range(x0, x1 + 1)) a(ix), unnest(range(y0, y1 + 1)) b(iy) where not exists (select 1 from v where v.ix = a.ix and v.iy = b.iy)),
 {_LABEL.format(near=_FOUR)}, big as (select label from l, x group by label having not bool_or(ix in (x0, x1) or iy in (y0, y1)))
 select ix::int as ix, iy::int as iy from v union all select ix, iy from l join big using (label)""")
def _(spark, sf):
    return regions.closed(_cells(spark, sf).where("value >= 135").select("ix", "iy"))


@_add("segments_of_high_cells", f"with recursive {MASK}, {_LABEL.format(near=_FOUR)}, k as (select label, row_number() over (order by label)::int as segment from l group by label having count(*) >= 3) select ix, iy, segment from l join k using (label)")
def _(spark, sf):
    return regions.drop_small(regions.components(_mask(spark, sf), False, tile=8), 3)


@_add("fill_small_voids", f"""with recursive {CELLS}, {_HOLES.format(label=_LABEL.format(near=_FOUR))}, f as (select h.ix, h.iy, median(v.value) as value from h join v on abs(v.ix-h.ix) <= 1 and abs(v.iy-h.iy) <= 1 group by 1, 2)
 select ix, iy, value from v union all select ix, iy, value from f""")
def _(spark, sf):
    return regions.fill_small_voids(_cells(spark, sf).where("value >= 128"), "median", 12, 1, diagonal=False)


@_add("fill_small_voids_hybrid", f"""with recursive {CELLS}, {_HIGH.format(label=_LABEL.format(near=_FOUR))},
 f as (select h.ix, h.iy, avg(v.value) as value from h join v on abs(v.ix-h.ix) <= 1 and abs(v.iy-h.iy) <= 1 group by 1, 2 having count(*) >= 5),
 n as (select h.ix, h.iy, v.value, row_number() over (partition by h.ix, h.iy order by (v.ix-h.ix)*(v.ix-h.ix)+(v.iy-h.iy)*(v.iy-h.iy), v.ix, v.iy) as r from h, v where not exists (select 1 from f where f.ix = h.ix and f.iy = h.iy))
 select ix, iy, value from v union all select ix, iy, round(value, 9) from f union all select ix, iy, value from n where r = 1""")
def _(spark, sf):
    return regions.fill_small_voids(_cells(spark, sf).where("value >= 133"), "hybrid", 12, 1, 5, diagonal=False).select("ix", "iy", F.round("value", 9).alias("value"))


# --- crowns ---------------------------------------------------------------------------------------------------------

_PIP = f"""{PTS}, {CROWNS}, p as (select distinct x, y, z, h from pts), i as (select p.*, crown_id, row_number() over (partition by p.x, p.y, p.z, p.h order by area, crown_id) as r
 from p left join crowns c on p.x between xmin and xmax and p.y between ymin and ymax)"""


def _tree_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points, to be made distinct once they have a crown. That is a second shuffle, by row: at one place there may be very many."""
    return points(spark, sf).select("x", "y", "z", F.col("h").alias("height"))


@_add("crown_of_point", f"with {_PIP} select x, y, z, h as height, crown_id from i where r = 1")
def _(spark, sf):
    return crowns.assign(_tree_points(spark, sf), _crowns(spark, sf), 4.0, True).select("x", "y", "z", "height", "crown_id").distinct()


@_add("tree_points", f"""with {_PIP}, o as (select x, y, z, h, crown_id from i where r = 1 and h >= 5), far as (select o.x, o.y, o.z, o.h, c.crown_id as near, row_number() over (partition by o.x, o.y, o.z, o.h order by (x-cx)*(x-cx)+(y-cy)*(y-cy), c.crown_id) as r from o, crowns c where o.crown_id is null)
 select o.x, o.y, o.z, o.h as height, coalesce(crown_id, near) as crown_id, case when crown_id is not null then 'inside' else 'nearest' end as how from o left join far on o.x = far.x and o.y = far.y and o.z = far.z and o.h = far.h and r = 1""")
def _(spark, sf):
    return crowns.segment(_tree_points(spark, sf), _crowns(spark, sf), 4.0, 5.0, True).select("x", "y", "z", "height", "crown_id", "how").distinct()


@_add("ring_contains", f"with {_PIP} select x, y, z, h as height, crown_id from i where r = 1 and x * 16 % 4 <> 0 and y * 16 % 4 <> 0")
def _(spark, sf):
    # rectangles as rings; points off the quarter-metre lines aren't on an edge, where sides would be open to choice
    c, xy = _crowns(spark, sf), lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    c = c.withColumn("ring", F.array(xy("xmin", "ymin"), xy("xmax", "ymin"), xy("xmax", "ymax"), xy("xmin", "ymax")))
    p = _tree_points(spark, sf).where((F.col("x") * 16 % 4 != 0) & (F.col("y") * 16 % 4 != 0))
    return crowns.assign(p, c, 4.0, False).select("x", "y", "z", "height", "crown_id").distinct()

# --- surfaces -------------------------------------------------------------------------------------------------------

RASTER = f"{PTS}, g as (select floor(x/2)::int as col, floor((48-y)/2)::int as row, h, z, x, y, classification, return_number from pts)"


@_add("canopy_p2r", f"with {RASTER} select col, row, case when max(h) <= 0 then 0 when max(h) < 2 then 0 else max(h) end as value from g group by 1, 2")
def _(spark, sf):
    return surface.canopy_model(points(spark, sf), 2.0, 48.0, method="p2r", least_height=2.0)


@_add("canopy_p99", f"with {RASTER} select col, row, round(case when max(h) <= 0 then 0 else quantile_cont(h, 0.99) end, 9) as value from g group by 1, 2")
def _(spark, sf):
    return surface.canopy_model(points(spark, sf), 2.0, 48.0, method="p99").select("col", "row", F.round("value", 9).alias("value"))


@_add("canopy_band", f"with {RASTER} select col, row, max(h) as value from g where h between 5 and 15 and return_number = 1 group by 1, 2")
def _(spark, sf):
    p = surface.select_heights(points(spark, sf), "band", low=15.0, high=5.0, first_returns=True)
    return surface.canopy_model(p, 2.0, 48.0)


@_add("canopy_minus_ground", f"with {RASTER} select a.col, a.row, greatest(0, a.v - b.v) as value from (select col, row, max(z) as v from g group by 1, 2) a join (select col, row, min(z) as v from g where classification = 2 group by 1, 2) b using (col, row)")
def _(spark, sf):
    top = surface._stat(points(spark, sf), 2.0, 48.0, 0.0, F.max("z"))
    low = surface._stat(points(spark, sf).where("classification = 2"), 2.0, 48.0, 0.0, F.min("z")).withColumnRenamed("value", "low")
    return top.join(low, ["col", "row"]).select("col", "row", F.greatest(F.lit(0.0), F.col("value") - F.col("low")).alias("value"))


@_add("resample_average", f"with {RASTER}, t as (select col, row, max(z) as v from g group by 1, 2) select floor(col/3)::int as col, floor(row/3)::int as row, round(avg(v), 9) as value from t group by 1, 2")
def _(spark, sf):
    return surface.resample(surface._stat(points(spark, sf), 2.0, 48.0, 0.0, F.max("z")), 3).select("col", "row", F.round("value", 9).alias("value"))


@_add("clip_polygon", f"with {RASTER} select col, row, max(z) as value from g where (col + 0.5) * 2 + (48 - (row + 0.5) * 2) < 39.5 group by 1, 2")
def _(spark, sf):
    return surface.clip(surface._stat(points(spark, sf), 2.0, 48.0, 0.0, F.max("z")), [(-60.0, -60.0), (99.5, -60.0), (-60.0, 99.5)], 2.0, 48.0)


@_add("edge_limit", f"""with {PTS}, g as materialized (select row_number() over () as point_id, x, y, floor(x/8)::int as bx, floor(y/8)::int as by_ from pts where classification = 2), o as (select * from (values (-1),(0),(1)) a(dx), (values (-1),(0),(1)) b(dy)),
 n as (select a.point_id, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) as d from g a, o join g b on b.bx = a.bx + dx and b.by_ = a.by_ + dy where a.point_id <> b.point_id),
 r as (select d from (select point_id, d, row_number() over (partition by point_id order by d) as r from n where d <= 8) where r <= 6 and d > 0)
 select round(greatest(3 * quantile_cont(d, 0.9), 1), 9) as edge_limit from r""")
def _(spark, sf):
    limit = surface.edge_limit(points(spark, sf).where("classification = 2"), 0.25)
    return spark.createDataFrame([(round(limit, 9),)], "edge_limit double")


@_add("fill_within", f"""with {PTS}, g as (select x, y, z, floor(x)::int as col, floor(48-y)::int as row from pts where classification = 2), c as (select col, row, min(z) as value from g group by 1, 2),
 m as (select distinct col + dx as col, row + dy as row from c, (values (0,0),(0,1),(1,0),(0,-1),(-1,0)) o(dx, dy)), n as (select * from m where not exists (select 1 from c where c.col = m.col and c.row = m.row)),
 d as (select n.col, n.row, (x-(n.col+0.5e0))*(x-(n.col+0.5e0))+((48-y)-(n.row+0.5e0))*((48-y)-(n.row+0.5e0)) as d2, z from n, g), r as (select *, row_number() over (partition by col, row order by d2, z) as r from d)
 select col, row, round(value, 6) as value from c union all select col, row, round(sum(z / greatest(d2, 1e-12)) / sum(1 / greatest(d2, 1e-12)), 6) as value from r where r <= 8 group by 1, 2""")
def _(spark, sf):
    g = points(spark, sf).where("classification = 2")
    made = surface._stat(g, 1.0, 48.0, 0.0, F.min("z"))
    grown = focal.dilate(made.select(F.col("col").alias("ix"), F.col("row").alias("iy"))).select(F.col("ix").alias("col"), F.col("iy").alias("row"))
    return surface.fill_within(made, grown, g, 1.0, 48.0).select("col", "row", F.round("value", 6).alias("value"))


@_add("ground_mask")
def _(spark, sf):
    return surface.ground_mask(points(spark, sf).where("classification = 2"), 1.0, 48.0)


def _rasters(spark: SparkSession, sf: str) -> DataFrame:
    """The epochs' greatest z in 4 m cells, as rasters of 13 by 13 cells."""
    place = {"xmin": F.lit(0.0), "ymax": F.lit(52.0), "res": F.lit(4.0), "res_y": F.lit(4.0), "width": F.lit(13), "height": F.lit(13)}
    return _epochs(spark, sf).select(F.col("epoch").cast("string").alias("path"), "col", "row", F.col("v").alias("value")).withColumns(place)


@_add("rasters_resampled", f"""with {EPOCHS}, s as (select epoch, col, row, v, res, greatest(1, round(52 / res))::int as n from r, (values (6.0e0), (1.5e0)) a(res)), k as (select *, 13.0e0 / n as k from s),
 w as (select epoch, res, n, a.c, b.r, v, (least(c + 1, (col + 1) / k) - greatest(c, col / k)) * (least(r + 1, (row + 1) / k) - greatest(r, row / k)) as part from k, unnest(range(floor(col / k)::int, ceil((col + 1) / k)::int)) a(c), unnest(range(floor(row / k)::int, ceil((row + 1) / k)::int)) b(r))
 select epoch::varchar as path, res as resolution, c::int as col, r::int as row, n as width, round(sum(v * part) / sum(part), 6) as value from w where part > 1e-9 group by all""")
def _(spark, sf):
    return post.resample(_rasters(spark, sf), [6.0, 1.5]).select("path", "resolution", "col", "row", "width", F.round("value", 6).alias("value"))


@_add("rasters_clipped", f"""with {EPOCHS}, {CROWNS}, i as (select epoch, col, row, v from r where exists (select 1 from crowns where (col + 0.5) * 4 >= xmin and (col + 0.5) * 4 < xmax and 52 - (row + 0.5) * 4 >= ymin and 52 - (row + 0.5) * 4 < ymax)),
 b as (select epoch, min(col) as c0, max(col) as c1, min(row) as r0, max(row) as r1 from i group by 1) select epoch::varchar as path, col - c0 as col, row - r0 as row, v as value, c0 * 4.0e0 as xmin, 52 - r0 * 4.0e0 as ymax, c1 - c0 + 1 as width, r1 - r0 + 1 as height from i join b using (epoch)""")
def _(spark, sf):
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    boxes = _crowns(spark, sf).withColumn("ring", F.array(corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"), corner("xmin", "ymax"), corner("xmin", "ymin")))
    return post.clip(_rasters(spark, sf), boxes, 8.0).drop("res", "res_y")


@_add("elevation_min")
def _(spark, sf):
    return surface.elevation_model(points(spark, sf).where("classification = 2"), 1.0, 48.0)


@_add("elevation_nearest")
def _(spark, sf):
    return surface.elevation_model(points(spark, sf).where("classification = 2"), 1.0, 48.0, method="nearest")


@_add("elevation_tin")
def _(spark, sf):
    return surface.elevation_model(points(spark, sf).where("classification = 2"), 1.0, 48.0, method="tin")


@_add("surface_spikefree")
def _(spark, sf):
    return surface.surface_model(points(spark, sf), 1.0, 48.0, method="spikefree")


@_add("canopy_pitfree")
def _(spark, sf):
    return surface.canopy_model(points(spark, sf), 1.0, 48.0, method="pitfree", pit_threshold=1.0, smooth="median")


@_add("canopy_cloth")
def _(spark, sf):
    return surface.canopy_model(points(spark, sf), 1.0, 48.0, method="cloth")


# --- trees ----------------------------------------------------------------------------------------------------------


def _canopy(spark: SparkSession, sf: str) -> DataFrame:
    return surface.filtered(surface.canopy_model(points(spark, sf), 0.5, 48.0), "gaussian", sigma=2.0)


for _method in ("lmf", "watershed", "yun2021"):
    _add(f"trees_{_method}")(lambda spark, sf, m=_method: trees.detect(_canopy(spark, sf), 0.5, m)[0])


@_add("crown_table")
def _(spark, sf):
    canopy = _canopy(spark, sf)
    peaks, crown = trees.detect(canopy, 0.5, "watershed")
    return trees.crown_table(crown, canopy, peaks, 0.5)


@_add("crown_outlines")
def _(spark, sf):
    return trees.outlines(trees.detect(_canopy(spark, sf), 0.5, "watershed")[1], 0.5, 48.0)


@_add("tree_point_segments")
def _(spark, sf):
    p = crowns.segment(_tree_points(spark, sf), _crowns(spark, sf), 4.0, 5.0, True).where("how = 'nearest'").distinct()
    return crowns.residual_segments(storage.written(p, "nearest-points"), 0.5)


# --- ground ---------------------------------------------------------------------------------------------------------


@_add("swept_surface", f"""with {PTS}, o as (select i * 0.5e0 as ox, j * 0.5e0 as oy from (values (0),(1)) a(i), (values (0),(1)) b(j)),
 l as (select x, y, z, row_number() over (partition by ox, oy, floor(x + ox), floor(y + oy) order by z, x, y) as r from pts, o)
 select floor(x)::int as ix, floor(y)::int as iy, min(z) as value from l where r = 1 group by 1, 2""")
def _(spark, sf):
    return ground.swept_surface(points(spark, sf), 1.0)


@_add("snapped_surface", f"""with {PTS}, s as (select floor(x/2)::int as ix, floor(y/2)::int as iy, median(z) as s from pts group by 1, 2), d as (select ix, iy, z, abs(z - s) as d, z < s as below from pts join s on floor(x/2)::int = ix and floor(y/2)::int = iy)
 select ix, iy, z as value from (select *, row_number() over (partition by ix, iy order by d, below, z) as r from d) where r = 1""")
def _(spark, sf):
    p = points(spark, sf)
    return ground.snapped(p, with_cells(p, 2.0).groupBy("ix", "iy").agg(F.median("z").alias("value")), 2.0)


@_add("demote_high_cells", f"""with {PTS}, l as (select floor(x)::int as ix, floor(y)::int as iy, count(*) as n, min(z) as low from pts where classification = 2 group by 1, 2),
 m as (select a.ix, a.iy, a.n, a.low, median(b.low) as around from l a join l b on abs(a.ix-b.ix) <= 1 and abs(a.iy-b.iy) <= 1 and (a.ix, a.iy) <> (b.ix, b.iy) group by all),
 bad as (select ix, iy from m where n <= 2 and low - around > 1) select point_id, x, y, z, case when bad.ix is not null and classification = 2 then 1 else classification end as classification from pts left join bad on floor(x)::int = bad.ix and floor(y)::int = bad.iy""")
def _(spark, sf):
    return ground.demote_high_cells(points(spark, sf), 1.0).select("point_id", "x", "y", "z", "classification")


_POINT = ["x", "y", "z", "classification"]


@_add("classify_als")
def _(spark, sf):
    return ground.classify(points(spark, sf).drop("classification"), "ALS").select(*_POINT)


@_add("classify_tls")
def _(spark, sf):
    return ground.classify(points(spark, sf).drop("classification"), "TLS").select(*_POINT)


@_add("classify_adaptive")
def _(spark, sf):
    p = points(spark, sf).drop("classification")
    return ground.classify(p, "ULS", ground.adapted_settings(p, "ULS")).select(*_POINT)


@_add("fix_false_ground")
def _(spark, sf):
    return ground.fix_false_ground(points(spark, sf), 1.0).select(*_POINT)


@_add("lowest_surface", f"with {PTS} select floor(x/0.5e0)::int as ix, floor(y/0.5e0)::int as iy, min(z) as value from pts group by 1, 2")
def _(spark, sf):
    return ground.lowest_surface(points(spark, sf), 0.5)


_VOTE = """near as (select u.ix, u.iy, b.value from (select distinct a.ix + dx as ix, a.iy + dy as iy from seed a, (select unnest(range(-{r}, {r} + 1))::int as dx) x, (select unnest(range(-{r}, {r} + 1))::int as dy) y) u
   join seed b on abs(u.ix-b.ix) <= {r} and abs(u.iy-b.iy) <= {r}), m as (select ix, iy, median(value) as mid from near group by 1, 2),
 d as (select ix, iy, median(abs(value - mid)) as mad from near join m using (ix, iy) group by 1, 2),
 k as (select ix, iy, value from near join m using (ix, iy) join d using (ix, iy) where abs(value - mid) / (1.4826e0 * greatest(mad, 0.05e0)) <= 2.8)"""


@_add("membrane_vote", f"""with {PTS}, seed as (select floor(x)::int as ix, floor(y)::int as iy, quantile_cont(z, 0.25) as value from pts where classification = 2 group by 1, 2), {_VOTE.format(r=4)}
 select ix, iy, count(*) as n, case when count(*) >= 6 then round(median(value), 9) end as value from k group by 1, 2""")
def _(spark, sf):
    return focal.robust_vote(ground.membrane_seeds(points(spark, sf), 1.0), 4, 2.8, 6, 0.05).select("ix", "iy", "n", F.round("value", 9).alias("value"))


@_add("membrane_gate")
def _(spark, sf):
    return ground.refine_by_membrane(points(spark, sf), 1.0).select(*_POINT)


@_add("adaptive_scale", """with t as (select s_suppkey as tile, (s_suppkey * 37 % 400)::double as c, (s_suppkey * 11 % 90)::double as d, (s_suppkey % 10) / 10.0e0 as o from supplier)
 select tile, round(greatest(0.8, least(1.8, 1.2 + greatest(-0.1, least(0.12,
  case when c / 50 < 0.5 then 0.1 when c / 50 < 0.8 then 0.05 when c / 50 > 2.5 then -0.08 when c / 50 > 1.8 then -0.05 else 0 end +
  case when o - 0.5 < -0.2 then 0.05 when o - 0.5 < -0.1 then 0.025 when o - 0.5 > 0.2 then -0.03 when o - 0.5 > 0.1 then -0.015 else 0 end +
  case when d / 20 < 0.5 then 0.04 when d / 20 > 2 then -0.03 else 0 end)))), 9)::double as scale from t""")
def _(spark, sf):
    t = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("tile"), (F.col("s_suppkey") * 37 % 400).cast("double").alias("c"), (F.col("s_suppkey") * 11 % 90).cast("double").alias("d"), ((F.col("s_suppkey") % 10) / F.lit(10.0)).alias("o"))
    k = sensors.scale("ALS", F.lit(50.0), F.lit(20.0), F.col("c"), F.col("d"), F.col("o"), F.lit(0.5))
    return t.select("tile", F.round(k, 9).alias("scale"))



# --- names, outliers, files -----------------------------------------------------------------------------------------


@_add("safe_names", r"""with t as (select '/data/' || p_name || ' #' || p_partkey || '/' || p_type || '_CHM_' || p_brand || '.tif' as path from part), u as (select path, regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\.[^.]*$', '') as stem from t)
 select path, stem, regexp_replace(stem, '[^A-Za-z0-9_]+', '_', 'g') as label, regexp_extract(lower(stem), '_chm_(.+)$', 1) as variant from u""")
def _(spark, sf):
    t = spark.read.parquet(f"{sf}/part.parquet").select(F.concat(F.lit("/data/"), "p_name", F.lit(" #"), "p_partkey", F.lit("/"), "p_type", F.lit("_CHM_"), "p_brand", F.lit(".tif")).alias("path"))
    return t.select("path", names.stem(F.col("path")).alias("stem"), names.dataset_label(F.col("path")).alias("label"), names.surface_of(F.col("path"))["variant"].alias("variant"))


@_add("isolated_points", f"""with {PTS}, p as (select distinct x, y, z from pts) select a.x, a.y, a.z from p a left join p b on (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 0.25e0
 and (a.x <> b.x or a.y <> b.y or a.z <> b.z) group by 1, 2, 3 having count(b.x) < 2""")
def _(spark, sf):
    p = points(spark, sf).select("x", "y", "z").distinct().withColumn("key", F.struct("x", "y", "z"))
    return outliers.isolated(p, 0.5, 2, "key").select("x", "y", "z")


@_add("statistical_outliers")
def _(spark, sf):
    return outliers.statistical_outliers(points(spark, sf).select("x", "y", "z").distinct(), 8, 2.0, 4.0)


@_add("robust_z", f"""with {PTS}, t as (select floor(x/4)::int as ix, floor(y/4)::int as iy, z from pts), m as (select ix, iy, median(z) as mid from t group by 1, 2), d as (select ix, iy, median(abs(z - mid)) as mad from t join m using (ix, iy) group by 1, 2)
 select ix, iy, z, round((z - mid) / (1.4826e0 * mad + 1e-12), 6) as robust_z from t join m using (ix, iy) join d using (ix, iy)""")
def _(spark, sf):
    return outliers.robust_z(with_cells(points(spark, sf), 4.0).select("ix", "iy", "z"), "z", "ix", "iy").select("ix", "iy", "z", F.round("robust_z", 6).alias("robust_z"))


@_add("quantiles", f"with {PTS} select epoch, round(quantile_cont(h, 0.1), 9) as q0, round(quantile_cont(h, 0.5), 9) as q1, round(quantile_cont(h, 0.9), 9) as q2 from pts group by 1")
def _(spark, sf):
    q = outliers.quantiles(points(spark, sf), "h", (0.1, 0.5, 0.9), "epoch")
    return q.select("epoch", *[F.round(c, 9).alias(c) for c in ("q0", "q1", "q2")])


@_add("file_overlaps", """with s as (select 'f' || s_suppkey as path, (s_suppkey * 7 % 40)::double as x, (s_suppkey * 13 % 40)::double as y, 1.0e0 + s_suppkey % 9 as w from supplier)
 select a.path as a, b.path as b, (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.w, b.y + b.w) - greatest(a.y, b.y)) as area from s a join s b on a.path < b.path
 and least(a.x + a.w, b.x + b.w) > greatest(a.x, b.x) and least(a.y + a.w, b.y + b.w) > greatest(a.y, b.y)""")
def _(spark, sf):
    return tiles.overlaps(_files(spark, sf), 8.0)


@_add("file_diagnosis")
def _(spark, sf):
    return tiles.diagnosis(_files(spark, sf), 8.0)


def _files(spark: SparkSession, sf: str) -> DataFrame:
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.concat(F.lit("f"), "s_suppkey").alias("path"), (F.col("s_suppkey") * 7 % 40).cast("double").alias("x"), (F.col("s_suppkey") * 13 % 40).cast("double").alias("y"), (F.lit(1.0) + F.col("s_suppkey") % 9).alias("w"))
    return s.select("path", F.struct(F.col("x").alias("xmin"), F.col("y").alias("ymin"), (F.col("x") + F.col("w")).alias("xmax"), (F.col("y") + F.col("w")).alias("ymax")).alias("bounds"))


# --- summaries, alignment, files ---------------------------------------------------------------------------------------


@_add("structure_subset", f"with {PTS}, s as (select floor(x/4)::int as ix, floor(y/4)::int as iy, count(*) as n, max(h) as h_max from pts where h >= 2 group by 1, 2) select ix, iy, h_max from s")
def _(spark, sf):
    return cells.metrics(cells.structure_metrics(points(spark, sf), 4.0, 2.0, 10.0, 2.0), ("h_max",))


@_add("mean_repeated", f"""with {CELLS}, x as (select min(ix) as x0, max(ix) as x1, min(iy) as y0, max(iy) as y1 from c), o as (select a.dx, b.dy from (values (-1),(0),(1)) a(dx), (values (-1),(0),(1)) b(dy))
 select a.ix, a.iy, round(avg(b.value), 9) as value from c a, o, x join c b on b.ix = least(x1, greatest(x0, a.ix + dx)) and b.iy = least(y1, greatest(y0, a.iy + dy)) group by 1, 2""")
def _(spark, sf):
    c = _cells(spark, sf)
    ends = c.agg(F.min("ix"), F.max("ix"), F.min("iy"), F.max("iy")).first()
    return focal.mean_repeated(c, tuple(ends)).select("ix", "iy", F.round("value", 9).alias("value"))


@_add("dataset_summary", f"""with {PTS}, t as (select floor(x/8)::int as tx, floor(y/8)::int as ty, count(*) as n, avg(z) as mean_z, max(h) as top from pts group by 1, 2 union all select 99, 99, 0, null, null)
 select count(*) as tiles, count(*) filter (n > 0) as occupied_tiles, median(n::double) filter (n > 0) as median_n, round(median(mean_z) filter (n > 0), 9) as median_mean_z, median(top) filter (n > 0) as median_top from t""")
def _(spark, sf):
    t = points(spark, sf).groupBy(cell("x", 8.0).alias("tx"), cell("y", 8.0).alias("ty")).agg(F.count("*").alias("n"), F.avg("z").alias("mean_z"), F.max("h").alias("top"))
    t = t.unionByName(spark.sql("select 99 as tx, 99 as ty, 0L as n, cast(null as double) as mean_z, cast(null as double) as top"))
    out = cells.dataset_summary(t, ("n", "mean_z", "top"))
    return out.select("tiles", "occupied_tiles", "median_n", F.round("median_mean_z", 9).alias("median_mean_z"), "median_top")


@_add("stage_summary", """with r as (select o_orderpriority as stage, case o_orderstatus when 'F' then 'ok' when 'O' then 'skipped' else 'failed' end as status, o_totalprice as seconds from orders)
 select stage, count(*) as total, count(*) filter (status = 'ok') as ok, count(*) filter (status = 'skipped') as skipped, count(*) filter (status = 'failed') as failed, round(avg(seconds), 4) as mean_seconds from r group by 1""")
def _(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "skipped").otherwise("failed")
    out = cells.stage_summary(spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderpriority").alias("stage"), status.alias("status"), F.col("o_totalprice").alias("seconds")))
    return out.withColumn("mean_seconds", F.round("mean_seconds", 4))


@_add("align_grids", f"""with {CELLS}, r as (select distinct floor(x/3)::int as ix, floor(y/3)::int as iy from pts), p as (select ix, iy, (ix + 0.5e0) * 3 + 0.5e0 as x, (iy + 0.5e0) * 3 - 0.25e0 as y from r),
 q as (select *, floor(x/2 - 0.5e0)::int as i, floor(y/2 - 0.5e0)::int as j from p), ab as (select *, x/2 - 0.5e0 - i as a, y/2 - 0.5e0 - j as b from q)
 select ab.ix, ab.iy, round((1-a)*(1-b)*c0.value + a*(1-b)*c1.value + (1-a)*b*c2.value + a*b*c3.value, 9) as value
 from ab left join c c0 on c0.ix = i and c0.iy = j left join c c1 on c1.ix = i+1 and c1.iy = j left join c c2 on c2.ix = i and c2.iy = j+1 left join c c3 on c3.ix = i+1 and c3.iy = j+1""")
def _(spark, sf):
    r = with_cells(points(spark, sf), 3.0).select("ix", "iy").distinct()
    return lookup.align(_cells(spark, sf), r, 2.0, 3.0, 0.5, -0.25).select("ix", "iy", F.round("value", 9).alias("value"))


@_add("align_equal_grids", f"with {CELLS}, r as (select distinct ix, iy from c where ix % 2 = 0) select ix, iy, value from r join c using (ix, iy)")
def _(spark, sf):
    c = _cells(spark, sf)
    return lookup.align(c, c.where("ix % 2 = 0").select("ix", "iy"), 2.0, 2.0)


@_add("tile_merge", f"""with {PTS}, t as (select tx, ty from (select unnest(range(0, 4)) as tx) a, (select unnest(range(0, 4)) as ty) b), v as (select 'tile_' || lpad(tx::varchar, 4, '0') || '_' || lpad(ty::varchar, 4, '0') as tile, pts.* from pts join t on x >= tx*16 and x < tx*16+16 and y >= ty*16 and y < ty*16+16)
 select tile, count(*) as n, min(z) as z_min, max(z) as z_max from v group by 1""")
def _(spark, sf):
    plan = tiles.plan((0.0, 0.0, 64.0, 64.0), 16.0, 2.0)
    wide = tiles.assign(points(spark, sf), 16.0, 2.0)
    named = wide.withColumn("tile", F.format_string("tile_%04d_%04d", "tx", "ty")).drop("tx", "ty", "is_core")
    return tiles.merge(named, "CLASSIFIED", tiles.as_table(spark, plan)).groupBy("tile").agg(F.count("*").alias("n"), F.min("z").alias("z_min"), F.max("z").alias("z_max"))


@_add("tile_plan", """with e as (select max(s_suppkey % 90)::double + 1 as x1, max(s_suppkey % 70)::double + 1 as y1 from supplier), n as (select *, ceil(x1/30)::int as nx, ceil(y1/30)::int as ny from e),
 m as (select *, nx - (case when nx > 1 and x1 - (nx-1)*30 < 7.5 then 1 else 0 end) as mx, ny - (case when ny > 1 and y1 - (ny-1)*30 < 7.5 then 1 else 0 end) as my from n)
 select 'tile_' || lpad(i::varchar, 4, '0') || '_' || lpad(j::varchar, 4, '0') as tile, i * 30.0e0 as xmin, j * 30.0e0 as ymin, case when i = mx - 1 then x1 else (i+1)*30.0e0 end as xmax, case when j = my - 1 then y1 else (j+1)*30.0e0 end as ymax
 from m, unnest(range(0, mx)) a(i), unnest(range(0, my)) b(j)""")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/supplier.parquet").agg(F.max(F.col("s_suppkey") % 90), F.max(F.col("s_suppkey") % 70)).first()
    plan = tiles.plan((0.0, 0.0, float(e[0] + 1), float(e[1] + 1)), 30.0, 2.0)
    return tiles.as_table(spark, plan).select("tile", "core.*")


def _las_folder(spark: SparkSession, sf: str) -> str:
    """The points as one LAS file an epoch; their coordinates are whole multiples of the files' scale."""
    folder = storage.local_folder(spark, "las")
    p = points(spark, sf).select("epoch", "x", "y", "z", "classification", "return_number", "number_of_returns", F.col("epoch").alias("tree_id"))
    las.write_points(p, folder, "epoch", ("tree_id",), 2.0**-8).collect()
    return f"file://{folder}"


@_add("las_round_trip", f"with {PTS} select epoch, x, y, z, classification, return_number, number_of_returns, epoch::bigint as tree_id from pts")
def _(spark, sf):
    got = las.read_points(spark, _las_folder(spark, sf), extra="tree_id long")
    return got.select(names.stem(F.col("path")).cast("int").alias("epoch"), "x", "y", "z", "classification", "return_number", "number_of_returns", "tree_id")


@_add("las_headers", f"with {PTS} select epoch, count(*) as points, min(x) as xmin, min(y) as ymin, min(z) as zmin, max(x) as xmax, max(y) as ymax, max(z) as zmax from pts group by 1")
def _(spark, sf):
    got = las.read_headers(spark, _las_folder(spark, sf))
    return got.select(names.stem(F.col("path")).cast("int").alias("epoch"), "points", "xmin", "ymin", "zmin", "xmax", "ymax", "zmax")


@_add("gtiff_round_trip", f"with {EPOCHS} select epoch, col, row, v as value from r")
def _(spark, sf):
    folder = storage.local_folder(spark, "tif")
    gtiff.write(_epochs(spark, sf).select("epoch", "col", "row", F.col("v").alias("value")), folder, "epoch", 0.0, 400.0, 4.0).collect()
    got = gtiff.read(spark, f"file://{folder}")
    at = lambda v, c: (F.col(c) + F.round(v / F.col("res"))).cast("int")
    return got.select(names.stem(F.col("path")).cast("int").alias("epoch"), at(F.col("xmin"), "col").alias("col"), at(F.lit(400.0) - F.col("ymax"), "row").alias("row"), "value")


@_add("label_raster_round_trip", f"with recursive {MASK}, {_LABEL.format(near=_FOUR)}, k as (select label, row_number() over (order by label)::int as segment from l group by label) select ix, iy, segment::double as segment from l join k using (label)")
def _(spark, sf):
    folder = storage.local_folder(spark, "labels")
    named = regions.drop_small(regions.components(_mask(spark, sf), False, tile=8), 1)
    gtiff.write(named.select(F.lit("labels").alias("name"), F.col("ix").alias("col"), (F.lit(100) - F.col("iy")).alias("row"), F.col("segment").alias("value")), folder, "name", 0.0, 200.0, 2.0, True).collect()
    got = gtiff.read(spark, f"file://{folder}").where("value <> 0")
    return got.select((F.col("col") + F.round(F.col("xmin") / 2)).cast("int").alias("ix"), (100 - F.col("row") - F.round((200 - F.col("ymax")) / 2)).cast("int").alias("iy"), F.col("value").alias("segment"))


@_add("features_round_trip", f"with {CROWNS} select crown_id, area, xmin, ymin, xmax, ymax from crowns")
def _(spark, sf):
    c = _crowns(spark, sf)
    corner = lambda x, y: F.array(x, y)
    ring = F.array(corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"), corner("xmin", "ymax"), corner("xmin", "ymin"))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct("crown_id").alias("properties"))
    path = f"file://{storage.local_folder(spark, 'features')}"
    vectors.write_collection(c.select(F.to_json(feature).alias("value")), path)
    return vectors.read_polygons(spark, path).select("crown_id", "area", "xmin", "ymin", "xmax", "ymax")


@_add("shapefile_round_trip", f"with {CROWNS} select crown_id, area, xmin, ymin, xmax, ymax from crowns")
def _(spark, sf):
    c = _crowns(spark, sf)
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"), corner("xmin", "ymax"), corner("xmin", "ymin"))
    folder = storage.local_folder(spark, "shapes")
    shapefile.write(c.select(F.lit("crowns").alias("name"), F.array(ring).alias("rings"), "crown_id", F.col("area").alias("area_m2")), folder, "name").collect()
    got = vectors.read_polygons(spark, f"file://{folder}/crowns.shp")
    return got.select("crown_id", "area", "xmin", "ymin", "xmax", "ymax")


@_add("manifest_round_trip", "select 'f' || s_suppkey as tile, (s_suppkey * 7 % 40)::double as x, s_nationkey as n from supplier")
def _(spark, sf):
    path = f"file://{storage.local_folder(spark, 'manifest')}"
    t = spark.read.parquet(f"{sf}/supplier.parquet").select(F.concat(F.lit("f"), "s_suppkey").alias("tile"), (F.col("s_suppkey") * 7 % 40).cast("double").alias("x"), F.col("s_nationkey").alias("n"))
    vectors.write_manifest(t, path)
    return vectors.read_manifest(spark, path).select("tile", "x", F.col("n").cast("int").alias("n"))


@_add("summary_round_trip", f"with {EPOCHS}, {_CHANGE.format(on=_PAIRS['sequential'])} select e1, e2, count(*) as valid_cells, min(delta) as delta_min, max(delta) as delta_max from d group by 1, 2")
def _(spark, sf):
    path = f"file://{storage.local_folder(spark, 'summary')}"
    vectors.write_summary(change.summary(_changes(spark, sf, "sequential"), 16.0), path)
    kinds = {"e1": "int", "e2": "int", "valid_cells": "long", "delta_min": "double", "delta_max": "double"}
    return spark.read.option("header", "true").csv(path).select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()])


@_add("crs_fallback", """with h as (select 'f' || s_suppkey as path, case when s_suppkey % 3 = 0 then 'own' || s_suppkey end as own, s_suppkey as k from supplier),
 o as (select k, case when k % 2 = 0 then 'src' || k end as a, case when k % 5 = 0 then 'src' || (k + 1) end as b from h) select path, coalesce(own, a, b, 'none') as crs from h join o using (k)""")
def _(spark, sf):
    k = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("k"))
    headers = k.select(F.concat(F.lit("f"), "k").alias("path"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("own"), "k")).alias("crs_wkt"), F.array(F.concat(F.lit("a"), "k"), F.concat(F.lit("b"), "k")).alias("sources"))
    a = k.select(F.concat(F.lit("a"), "k").alias("path"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("src"), "k")).alias("crs_wkt"))
    b = k.select(F.concat(F.lit("b"), "k").alias("path"), F.when(F.col("k") % 5 == 0, F.concat(F.lit("src"), F.col("k") + 1)).alias("crs_wkt"))
    return layout.crs_of(headers, a.unionByName(b), "none")


@_add("point_bounds", f"with {PTS} select min(x) as xmin, min(y) as ymin, max(x) as xmax, max(y) as ymax from pts")
def _(spark, sf):
    return bounds_of(points(spark, sf))


@_add("peaks_of_segments", f"""with recursive {CELLS}, m as (select ix, iy from c where value >= 133), {_LABEL.format(near=_FOUR)}, k as (select label, row_number() over (order by label)::int as segment from l group by label having count(*) >= 3),
 f as (select a.ix, a.iy, a.value, max(b.value) as top from c a join c b on abs(a.ix-b.ix) <= 1 and abs(a.iy-b.iy) <= 1 group by all) select segment, count(*) as peaks from k join l using (label) join f using (ix, iy) where value = top and value >= 120 group by 1""")
def _(spark, sf):
    named = regions.drop_small(regions.components(_mask(spark, sf), False, tile=8), 3)
    return crowns.peak_counts(named, focal.local_maxima(_cells(spark, sf), 3, 120.0))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, candidate points and canopy percentile of every 2 m cell."""
    p = points(spark, sf_dir)
    stats = cells.cell_stats(p, 2.0, 0.99)
    low = cells.candidate_layer(p, 2.0, 0.75).groupBy("ix", "iy").agg(F.count("*").alias("n_candidates"))
    return stats.join(low, ["ix", "iy"])


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
