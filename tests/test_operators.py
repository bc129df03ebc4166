import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyforge.functions import sensors
from canopyforge.functions.points import Grid, finite
from canopyforge.operators import cells, change, crowns, focal, ground, lookup, outliers, regions, surface, terrain, tiles, trees
from canopyforge.plans import catalogue, cli, workflow
from canopyforge.sources import gtiff, las, vectors
from canopyforge.streaming import ingest


def raster(spark, f, n=9):
    return spark.createDataFrame([(c, r, float(f(c, r))) for c in range(n) for r in range(n)], "col int, row int, z double")


@pytest.mark.parametrize(("f", "azimuth"), [(lambda c, r: r, 0), (lambda c, r: -c, 90), (lambda c, r: -r, 180), (lambda c, r: c, 270)])
def test_aspect_is_downslope(spark, f, azimuth):
    out = terrain.slope_aspect_shade(raster(spark, f), 1.0).where("col between 1 and 7 and row between 1 and 7")
    assert {round(r.aspect) % 360 for r in out.collect()} == {azimuth}
    assert {round(r.slope_deg, 6) for r in out.collect()} == {45.0}


def test_flat_raster(spark):
    flat = raster(spark, lambda c, r: 7)
    s = terrain.slope_aspect_shade(flat, 1.0).collect()
    assert all(r.slope_pct == 0 and r.aspect is None for r in s)
    assert all(r.tci is None for r in terrain.tci(flat, 1.0).collect())
    assert all(r.to_col is None for r in terrain.d8_receivers(flat, 1.0).collect())
    assert all(r.curvature == 0 for r in terrain.curvature(flat, 1.0).collect())


@pytest.mark.parametrize("tile", [3, 5, 64])
def test_valley_drains_to_its_outlet_over_tiles(spark, tile):
    valley = raster(spark, lambda c, r: 10 * abs(c - 5) + (10 - r) * 0.5, 11)
    acc = terrain.flow_accumulation(terrain.d8_receivers(valley, 1.0), tile)
    assert acc.agg(F.max("acc")).first()[0] == 121
    assert acc.where("col = 5 and row = 10").first().acc == 121


@pytest.mark.parametrize("extent", [(0, 0, 91, 91), (0, 0, 105, 95), (0, 0, 95, 93), (0, 0, 10, 10)])
def test_tiles_partition_the_extent(extent):
    plan = tiles.plan(extent, 30.0, 5.0)
    assert sum(tiles.area(t.core) for t in plan) == tiles.area(extent)
    assert all(tiles.intersection(a.core, b.core) is None for i, a in enumerate(plan) for b in plan[:i])
    assert all(t.buffer == tiles.grown(t.core, 5.0) for t in plan)


def test_grid_rules():
    assert (Grid.of((0, 0, 10, 10), 1.0).nx, Grid.of((0, 0, 10, 10), 1.0, "floor1").nx, Grid.of((0, 0, 10, 10), 1.0, "ceil").nx) == (10, 11, 10)


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,), (None,)], "z double")
    assert [r.z for r in finite(df, "z").collect()] == [None, None, 1.0, None]


@pytest.mark.parametrize("tile", [2, 3, 1000])
def test_components_over_tiles(spark, tile):
    rng = np.random.default_rng(3)
    cells_ = [(int(x), int(y)) for x, y in {tuple(p) for p in rng.integers(0, 14, (90, 2))}]
    got = {(r.ix, r.iy): r.label for r in regions.components(spark.createDataFrame(cells_, "ix int, iy int"), True, tile).collect()}
    left, seen = set(cells_), {}
    while left:
        todo, own = [left.pop()], []
        while todo:
            x, y = todo.pop()
            own.append((x, y))
            for p in [(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if p in left:
                    left.remove(p)
                    todo.append(p)
        for p in own:
            seen[p] = min(own)
    names = {}
    for p, label in got.items():
        assert names.setdefault(label, seen[p]) == seen[p]
    assert len(names) == len(set(seen.values())) and len(got) == len(cells_)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "ix int, iy int, value double")
    assert regions.components(none.select("ix", "iy"), True).count() == 0
    assert focal.dilate(none, 1).count() == 0
    assert lookup.nearest_cell(none, none).count() == 0
    pts = spark.createDataFrame([], "point_id long, x double, y double, z double")
    assert ground.classify(pts).count() == 0
    assert cells.cell_stats(pts, 1.0).count() == 0


def test_few_points_are_all_non_ground(spark):
    pts = spark.range(100).selectExpr("id as point_id", "cast(id as double) as x", "0.0 as y", "1.0 as z").selectExpr("point_id", "x", "cast(y as double) y", "cast(z as double) z")
    assert {r.classification for r in ground.classify(pts).collect()} == {1}


def test_ground_of_a_tilted_plane_is_found(spark):
    rng = np.random.default_rng(5)
    n = 4000
    x, y = rng.random(n) * 40, rng.random(n) * 40
    tree = rng.random(n) < 0.4
    z = 100 + x / 8 + y / 16 + np.where(tree, 3 + rng.random(n) * 15, rng.random(n) * 0.05)
    pts = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(zip(x, y, z))], "point_id long, x double, y double, z double")
    got = {r.point_id: r.classification for r in ground.classify(pts, "ALS").collect()}
    right = np.mean([(got[i] == 2) == (not tree[i]) for i in range(n)])
    assert len(got) == n and right > 0.97


def test_smallest_crown_wins_and_leftovers_go_to_the_nearest(spark):
    c = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0, 100.0, 5.0, 5.0), (2, 4.0, 4.0, 6.0, 6.0, 4.0, 5.0, 5.0), (3, 50.0, 0.0, 52.0, 2.0, 4.0, 51.0, 1.0)], "crown_id int, xmin double, ymin double, xmax double, ymax double, area double, cx double, cy double")
    p = spark.createDataFrame([(1, 5.0, 5.0, 9.0), (2, 1.0, 1.0, 9.0), (3, 40.0, 1.0, 9.0), (4, 5.0, 5.0, 1.0)], "point_id long, x double, y double, height double")
    got = {r.point_id: (r.crown_id, r.how) for r in crowns.segment(p, c, 2.0, 2.0, True).collect()}
    assert got == {1: (2, "inside"), 2: (1, "inside"), 3: (3, "nearest")}


def test_change_limits():
    assert change.detection_limit(0.5) == 0.5
    assert change.detection_limit(0.1, 3.0, 4.0, "rss") == 5.0
    assert change.detection_limit(9.0, 3.0, 4.0, "max") == 9.0
    with pytest.raises(ValueError):
        change.detection_limit(1.0, mode="x")


def test_filtering_by_tiles_equals_one_tile(spark):
    rng = np.random.default_rng(4)
    rows = [(c, r, float(rng.random())) for c in range(20) for r in range(20)]
    df = spark.createDataFrame(rows, "col int, row int, value double")
    for how in ("median", "gaussian"):
        a, b = ({(r.col, r.row): r.value for r in surface.filtered(df, how, tile=t).collect()} for t in (7, 64))
        assert a.keys() == b.keys()
        inner = [p for p in a if 4 <= p[0] < 16 and 4 <= p[1] < 16]
        assert all(math.isclose(a[p], b[p], abs_tol=1e-9) for p in inner)


def test_settings():
    assert sensors.adapted("ALS", 1.0) == sensors.SENSORS["ALS"]
    assert sensors.adapted("ALS", 9.0).vote_cell_m == 2.0
    with pytest.raises(ValueError):
        sensors.settings("SONAR")


def test_products_and_specs():
    assert workflow.resolve(["chm"]) == ["CLASSIFIED", "DEM", "NORMALIZED", "CHM"]
    assert workflow.resolve(["all"])[0] == "CLASSIFIED" and len(workflow.resolve(["all"])) == 7
    with pytest.raises(ValueError):
        workflow.resolve(["X"])
    spec = workflow.CanopySpec.parse("band:p2r:low=2:high=2.5")
    assert (spec.method, spec.selector, spec.options, spec.label) == ("p2r", "band", {"low": 2.0, "high": 2.5}, "band_p2r_high2p5_low2")
    with pytest.raises(ValueError):
        workflow.CanopySpec.parse("nothing")
    with pytest.raises(ValueError):
        trees.detect(None, 1.0, "li2012")


def test_command_line():
    with pytest.raises(SystemExit) as e:
        cli.main(["--help"])
    assert e.value.code == 0
    with pytest.raises(SystemExit):
        cli.main(["a", "b", "--sensor", "SONAR"])


def test_las_round_trip(spark, tmp_path):
    rng = np.random.default_rng(6)
    x, y, z = rng.random(1000) * 100, rng.random(1000) * 50 + 5e5, rng.random(1000) * 30
    cls = rng.integers(1, 3, 1000)
    data = las.to_bytes(x, y, z, cls, (np.ones(1000, int), np.full(1000, 3)), {"tree_id": np.arange(1000)}, crs_wkt="LOCAL")
    (tmp_path / "a.las").write_bytes(data)
    (tmp_path / "empty.las").write_bytes(las.to_bytes(x[:0], y[:0], z[:0]))
    got = las.read_points(spark, f"file://{tmp_path}", extra="tree_id long").orderBy("ordinal").toPandas()
    assert np.allclose(got[["x", "y", "z"]].to_numpy().T, [x, y, z], atol=0.0005001)
    assert (got.classification == cls).all() and (got.number_of_returns == 3).all() and (got.tree_id == np.arange(1000)).all()
    h = las.read_headers(spark, f"file://{tmp_path}").collect()
    assert [(r.points, r.crs_wkt, r.point_format) for r in h] == [(1000, "LOCAL", 6)]
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        workflow.from_las(spark, f"file://{tmp_path}/none")


def test_las_files_by_tile(spark, tmp_path):
    pts = spark.range(100).selectExpr("id % 3 as tile", "cast(id as double) as x", "cast(id as double) as y", "1.5d as z", "2 as classification")
    made = las.write_points(pts, str(tmp_path / "out"), "tile").collect()
    assert sum(r.points for r in made) == 100
    assert las.read_points(spark, f"file://{tmp_path}/out").count() == 100


def test_geotiff_round_trip(spark, tmp_path):
    a = np.arange(600, dtype=np.float32).reshape(20, 30)
    a[3, 4] = np.nan
    b, g = gtiff.decode(gtiff.encode(a, 10.0, 99.0, 0.5))
    assert np.array_equal(a, b, equal_nan=True) and (g["xmin"], g["ymax"], g["res"]) == (10.0, 99.0, 0.5)
    ints, g = gtiff.decode(gtiff.encode(np.arange(6).reshape(2, 3), 0, 0, 1.0, 0))
    assert ints.tolist() == [[0, 1, 2], [3, 4, 5]] and g["nodata"] == 0
    cells_ = spark.createDataFrame([("t", 2, 1, 5.0), ("t", 3, 2, 6.0)], "tile string, col int, row int, value double")
    gtiff.write(cells_, str(tmp_path / "r"), "tile", 0.0, 10.0, 1.0).collect()
    got = gtiff.read(spark, f"file://{tmp_path}/r").orderBy("value").collect()
    assert [(r.col, r.row, r.value, r.xmin, r.ymax) for r in got] == [(0, 0, 5.0, 2.0, 9.0), (1, 1, 6.0, 2.0, 9.0)]


def test_geojson_polygons(spark, tmp_path):
    (tmp_path / "c.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"tree_id":7},"geometry":{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,2],[0,2],[0,0]]]}}]}')
    r = vectors.read_polygons(spark, f"file://{tmp_path}/c.geojson").first()
    assert (r.crown_id, r.area, r.xmax, r.ymax) == (7, 8.0, 4.0, 2.0)


def test_streamed_cells_equal_batch_ones(spark, tmp_path):
    pts = spark.range(1000).selectExpr("cast(id % 37 as double) as x", "cast(id % 23 as double) as y", "cast(id as double) as z", "2 as classification", "2020 as epoch")
    pts.repartition(3).write.parquet(str(tmp_path / "in"))
    q = ingest.keep_cells(ingest.arriving(spark, str(tmp_path / "in"), files_at_once=1), 5.0, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = ingest.cells_so_far(spark, str(tmp_path / "out")).orderBy("ix", "iy").select("ix", "iy", "n", "z_min", "z_max").collect()
    want = cells.cell_stats(pts, 5.0).orderBy("ix", "iy").select("ix", "iy", "n", "z_min", "z_max").collect()
    assert got == want


def test_whole_run(spark):
    rng = np.random.default_rng(8)
    n = 3000
    x, y = rng.random(n) * 20, rng.random(n) * 20
    crown = np.maximum(12 - np.hypot(x - 6, y - 6) * 3, 10 - np.hypot(x - 15, y - 14) * 3).clip(0)
    z = 50 + x / 10 + np.where(rng.random(n) < 0.5, crown, rng.random(n) * 0.03)
    pts = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(zip(x, y, z))], "point_id long, x double, y double, z double")
    out = workflow.run(spark, pts, "ALS", ["all", "ITD", "TREECLOUDS"], 1.0, "p2r")
    assert set(out) >= {"CLASSIFIED", "DEM", "NORMALIZED", "DSM", "CHM", "TERRAIN", "STRUCTURE", "ITD", "TREECLOUDS"}
    assert out["DEM"].count() == 400
    top = {(r.col, r.row) for r in out["ITD"].collect()}
    assert any(abs(c - 6) <= 1 and abs(r - 14) <= 1 for c, r in top) and any(abs(c - 15) <= 1 and abs(r - 6) <= 1 for c, r in top)
    assert out["TREECLOUDS"].where("tree is null").count() == 0
    assert set(out["TERRAIN"].columns) == {"col", "row", *workflow.TERRAIN}


def test_outliers_equal_brute_force_whatever_the_distance(spark):
    rng = np.random.default_rng(9)
    clump = np.array([500.0, 500.0, 90.0]) + rng.random((3, 3)) * 0.1
    xyz = np.concatenate([rng.random((400, 3)) * 10, rng.random((30, 3)) * 60, clump, [[-900.0, 0.0, 0.0]]])
    pts = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "point_id long, x double, y double, z double")
    d = np.sort(np.linalg.norm(xyz[:, None] - xyz[None], axis=2), 1)[:, 1:]
    for k, reach in ((8, 4.0), (20, 5.0)):
        mean = d[:, :k].mean(1)
        got = {r.point_id: (r.n, r.mean_d) for r in outliers.neighbour_distance(pts, k, reach).collect()}
        assert len(got) == len(xyz) and all(got[i][0] == k and math.isclose(got[i][1], mean[i]) for i in got)
        want = set(np.nonzero(mean - mean.mean() > 2 * mean.std(ddof=1))[0].tolist())
        assert {r.point_id for r in outliers.statistical_outliers(pts, k, 2.0, reach).collect()} == want
        assert {430, 431, 432, 433} <= want
    assert outliers.statistical_outliers(pts.limit(9), 8).count() == 0


def _small_cloud(spark, path, n=44, quantities=15):
    lines = [(1 + i, 1 + i % 7, 1 + i * 53 % 199, 1 + i % 11, 1 + i * 7 % quantities, "1995-01-01") for i in range(n)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity int, l_shipdate string").selectExpr("* except (l_shipdate)", "cast(l_shipdate as date) l_shipdate").write.parquet(f"{path}/lineitem.parquet")
    return catalogue.points(spark, str(path)).select("x", "y", "z", "classification").toPandas()


def test_outlier_query_judges_all_points(spark, tmp_path):
    cloud = np.unique(_small_cloud(spark, tmp_path)[["x", "y", "z"]].to_numpy(), axis=0)
    mean = np.sort(np.linalg.norm(cloud[:, None] - cloud[None], axis=2), 1)[:, 1:9].mean(1)
    want = cloud[mean - mean.mean() > 2 * mean.std(ddof=1)]
    got = catalogue.queries()["statistical_outliers"](spark, str(tmp_path)).collect()
    assert len(want) and sorted(map(tuple, got)) == sorted(map(tuple, want.tolist()))


def test_crown_queries_use_all_crowns(spark, tmp_path):
    """Held against all pairs, without the queries' SQL: crowns 401 to 1,000 take points, too."""
    _small_cloud(spark, tmp_path, 400, 50)
    k = np.arange(1, 1001)
    spark.createDataFrame([(int(i),) for i in k], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    x0, y0, w, h = k * 7 % 180 * 0.25, k * 11 % 176 * 0.25, 1 + k % 5 * 0.5, 1 + k % 3 * 0.5
    p = np.unique(catalogue.points(spark, str(tmp_path)).select("x", "y", "z", "h").toPandas().to_numpy(), axis=0)
    x, y = p[:, :1], p[:, 1:2]
    holds = (x >= x0) & (x <= x0 + w) & (y >= y0) & (y <= y0 + h)
    smallest = np.lexsort((k, w * h))
    inside = [next((int(k[c]) for c in smallest if row[c]), None) for row in holds]
    near = k[np.argmin((x - x0 - w / 2) ** 2 + (y - y0 - h / 2) ** 2, axis=1)]
    run = lambda name: sorted(map(tuple, catalogue.queries()[name](spark, str(tmp_path)).collect()), key=repr)
    want = [(*map(float, r), c) for r, c in zip(p, inside)]
    assert run("crown_of_point") == sorted(want, key=repr)
    assert run("ring_contains") == sorted((r for r in want if r[0] * 16 % 4 and r[1] * 16 % 4), key=repr)
    high = [(*r[:4], r[4] or int(n), "inside" if r[4] else "nearest") for r, n in zip(want, near) if r[3] >= 5]
    assert run("tree_points") == sorted(high, key=repr)
    assert {r[5] for r in high} == {"inside", "nearest"} and max(r[4] for r in high) > 400
    left = [r for r in high if r[5] == "nearest"]
    assert len(run("tree_point_segments")) == len(left)


def test_tin_query_has_the_triangles_of_all_ground_points(spark, tmp_path):
    p = _small_cloud(spark, tmp_path)
    assert (p.classification == 2).all()
    x, y, z = p.groupby(["x", "y"], as_index=False).z.max().to_numpy().T
    i, j, k = np.array([(a, b, c) for a in range(len(x)) for b in range(a) for c in range(b)]).T
    det = (y[j] - y[k]) * (x[i] - x[k]) + (x[k] - x[j]) * (y[i] - y[k])
    i, j, k, det = (v[np.abs(det) > 1e-9] for v in (i, j, k, det))
    sq = x * x + y * y
    cx = (sq[i] * (y[j] - y[k]) + sq[j] * (y[k] - y[i]) + sq[k] * (y[i] - y[j])) / (2 * det)
    cy = (sq[i] * (x[k] - x[j]) + sq[j] * (x[i] - x[k]) + sq[k] * (x[j] - x[i])) / (2 * det)
    r = np.hypot(x[i] - cx, y[i] - cy)
    empty = (np.hypot(x[None] - cx[:, None], y[None] - cy[:, None]) >= r[:, None] - 1e-9).all(1)
    i, j, k, det = (v[empty] for v in (i, j, k, det))
    got = catalogue.queries()["elevation_tin"](spark, str(tmp_path)).collect()
    within = 0
    for g in got:
        px, py = g.col + 0.5, 48 - (g.row + 0.5)
        a = ((y[j] - y[k]) * (px - x[k]) + (x[k] - x[j]) * (py - y[k])) / det
        b = ((y[k] - y[i]) * (px - x[k]) + (x[i] - x[k]) * (py - y[k])) / det
        holds = (a >= -1e-8) & (b >= -1e-8) & (a + b <= 1 + 1e-8)
        near = np.hypot(x - px, y - py)
        want = (a * z[i] + b * z[j] + (1 - a - b) * z[k])[holds] if holds.any() else z[near <= near.min() + 1e-9]
        within += holds.any()
        assert np.abs(want - g.value).min() < 1e-6
    assert within > 400


def test_holes_are_filled_for_all_rounds(spark):
    rows = [(i, j, 5.0 if i < 2 or i > 250 else None) for i in range(320) for j in range(3)]
    got = ground._filled(spark.createDataFrame(rows, "ix int, iy int, value double"), 80).collect()
    filled = {r.ix for r in got}
    assert {81, 171} <= filled and not {82, 170} & filled and all(r.value == 5.0 for r in got)


def test_tin_over_tiles_and_gaps_equals_one_tile(spark):
    rng = np.random.default_rng(11)
    x, y = rng.random(500) * 60, rng.random(500) * 40
    keep = ~((x > 14) & (x < 46) & (y > 3)) & ~((x > 40) & (y > 25) & (y < 34))
    x, y = x[keep], y[keep]
    z = np.sin(x / 5) * 3 + y / 4 + rng.random(len(x))
    pts = spark.createDataFrame([tuple(map(float, p)) for p in zip(x, y, z)], "x double, y double, z double")
    for options in ({}, {"longest": 6.0, "nearest_outside": False}):
        many, one = ({(r.col, r.row): r.value for r in surface.tin(pts, 1.0, 40.0, tile=t, halo=2, **options).collect()} for t in (8, 64))
        assert many.keys() == one.keys() and all(math.isclose(many[p], one[p], abs_tol=1e-6) for p in one)
        assert options or len(one) == 2400


def _copies(spark, monkeypatch):
    """(points, crowns, sizes of what is written): 40 points at each of 9 places, 50 copies of each of 2 crowns."""
    from canopyforge.operators import crowns

    sizes, written = {}, crowns.written
    monkeypatch.setattr(crowns, "written", lambda df, name: (w := written(df, name), sizes.update({name: w.count()}))[0])
    p = spark.createDataFrame([(i, float(i % 3) * 4 + 1, float(i % 9 // 3) * 4 + 1, float(3 + i // 9)) for i in range(360)], "point_id long, x double, y double, height double")
    shapes = ((0.0, 0.0, 2.0, 2.0), (4.5, 4.5, 8.5, 8.5))
    rows = [(i, *shapes[i % 2], (shapes[i % 2][2] - shapes[i % 2][0]) ** 2, *(sum(shapes[i % 2][j::2]) / 2 for j in (0, 1))) for i in range(100, 0, -1)]
    c = spark.createDataFrame(rows, "crown_id int, xmin double, ymin double, xmax double, ymax double, area double, cx double, cy double")
    return p, c, sizes


def test_points_at_one_place_and_crowns_of_one_centre_meet_once(spark, monkeypatch):
    p, c, sizes = _copies(spark, monkeypatch)
    got = crowns.segment(p, c, 4.0, 5.0, True).collect()
    first = {(1.0, 1.0): 2, (5.0, 5.0): 1}
    centre = {2: (1.0, 1.0), 1: (6.5, 6.5)}
    assert len(got) == 342 and sizes == {"crown-shapes": 2, "crown-places": 9, "crown-centres": 2, "nearest-places": 7}
    for r in got:
        near = min(centre, key=lambda k: ((r.x - centre[k][0]) ** 2 + (r.y - centre[k][1]) ** 2, k))
        assert (r.crown_id, r.how) == ((first[r.x, r.y], "inside") if (r.x, r.y) in first else (near, "nearest"))


def test_segments_are_made_of_points_found_once(spark, tmp_path, monkeypatch):
    from canopyforge.functions import storage

    _small_cloud(spark, tmp_path, 400, 50)
    spark.createDataFrame([(i,) for i in range(1, 1001)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    want = {tuple(r)[:5] for r in catalogue.queries()["tree_points"](spark, str(tmp_path)).where("how = 'nearest'").collect()}
    sizes, written = {}, storage.written
    monkeypatch.setattr(storage, "written", lambda df, name: (w := written(df, name), sizes.update({name: w.count()}))[0])
    got = catalogue.queries()["tree_point_segments"](spark, str(tmp_path)).collect()
    assert sizes == {"nearest-points": len(want)} and {(r.x, r.y, r.z, r.height, r.crown_id) for r in got} == want


def test_outliers_of_a_dense_cloud_take_few_rounds(spark, monkeypatch):
    rng = np.random.default_rng(21)
    xyz = rng.random((3000, 3)) * 8
    rows = [(i, *map(float, p)) for i, p in enumerate([*xyz, *xyz[:40], [20.0, 4.0, 4.0], [float("nan"), 1.0, 1.0]])]
    pts = spark.createDataFrame(rows, "point_id long, x double, y double, z double")
    rounds, written = [], outliers.written
    monkeypatch.setattr(outliers, "written", lambda df, name: rounds.append(name) or written(df, name))
    got = {r.point_id for r in outliers.statistical_outliers(pts, 8, 2.0, 4.0).collect()}
    all_ = np.array([r[1:] for r in rows[:-1]])
    mean = np.sort(np.linalg.norm(all_[:, None] - all_[None], axis=2), 1)[:, 1:9].mean(1)
    assert got == set(np.nonzero(mean - mean.mean() > 2 * mean.std(ddof=1))[0].tolist()) | {len(all_)}
    assert rounds.count("neighbour-distances") <= 5


def test_crown_of_point_tests_a_place_and_a_shape_once(spark, monkeypatch):
    p, c, sizes = _copies(spark, monkeypatch)
    got = crowns.assign(p, c, 4.0, True).collect()
    assert len(got) == 360 and sizes == {"crown-shapes": 2, "crown-places": 2}
    assert {(r.x, r.y, r.crown_id) for r in got if r.crown_id} == {(1.0, 1.0, 2), (5.0, 5.0, 1)}


def test_ring_contains_tests_a_place_and_a_ring_once(spark, monkeypatch):
    p, c, sizes = _copies(spark, monkeypatch)
    xy = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    c = c.withColumn("ring", F.array(xy("xmin", "ymin"), xy("xmax", "ymin"), xy("xmax", "ymax"), xy("xmin", "ymin")))
    got = crowns.assign(p.withColumn("x", F.col("x") + 0.25), c, 4.0).collect()
    # triangles: below the diagonal of each box
    assert len(got) == 360 and sizes == {"crown-shapes": 2, "crown-places": 2}
    assert {(r.x, r.y, r.crown_id) for r in got if r.crown_id} == {(1.25, 1.0, 2), (5.25, 5.0, 1)}
