import json
import struct

import pytest
from pyspark.sql import functions as F

from canopyforge.operators import outliers, regions, surface
from canopyforge.plans import post
from canopyforge.sources import gtiff, shapefile, vectors


def rasters(spark, shapes):
    """One raster a shape: value 10 * k + col + row, without the cells of its holes."""
    rows = []
    for k, (w, h, holes) in enumerate(shapes):
        rows += [(f"/in/r{k}.tif", c, r, float(10 * k + c + r), 100.0 * k, 50.0, 2.0, 2.0, w, h) for c in range(w) for r in range(h) if (c, r) not in holes]
    return spark.createDataFrame(rows, "path string, col int, row int, value double, xmin double, ymax double, res double, res_y double, width int, height int")


SHAPES = [(9, 7, {(3, 3), (4, 3), (0, 2), (8, 6)}), (5, 12, {(2, r) for r in range(3, 9)}), (4, 4, set()), (7, 7, {(c, r) for c in (2, 3, 4) for r in (2, 3, 4)})]


@pytest.mark.parametrize("how", ["hybrid", "nearest", "median"])
def test_folder_fill_equals_each_raster_alone(spark, how):
    many = rasters(spark, SHAPES)
    got = {(r.path, r.col, r.row): r.value for r in post.fill(many, how, 8, 1, 3).collect()}
    want = {}
    for path in ("/in/r0.tif", "/in/r1.tif", "/in/r2.tif", "/in/r3.tif"):
        one = many.where(F.col("path") == path).select(F.col("col").alias("ix"), F.col("row").alias("iy"), "value")
        want |= {(path, r.ix, r.iy): r.value for r in regions.fill_small_voids(one, how, 8, 1, 3).collect()}
    assert got == want
    assert ("/in/r0.tif", 3, 3) in got and ("/in/r0.tif", 0, 2) not in got and ("/in/r3.tif", 3, 3) not in got


def test_hybrid_takes_the_mean_then_the_nearest(spark):
    cells = [(c, r, 100.0 if (c, r) == (1, 1) else 1.0) for c in range(7) for r in range(7) if (c, r) not in {(2, 2), (3, 2), (4, 2)}]
    df = spark.createDataFrame(cells, "ix int, iy int, value double")
    got = {(r.ix, r.iy): r.value for r in regions.fill_small_voids(df, "hybrid", 5, 1, 7).collect()}
    assert got[(2, 2)] == (100 + 6) / 7 and got[(3, 2)] == 1.0


def test_fill_without_rasters_or_negative_values(spark):
    none = rasters(spark, SHAPES).limit(0)
    assert post.fill(none).count() == 0
    low = rasters(spark, SHAPES[:1]).withColumn("value", F.col("value") - 5)
    assert post.fill(low, keep_negative=False).agg(F.min("value")).first()[0] == 0.0


def test_folder_runs_write_and_read_back(spark, tmp_path):
    gtiff.write_placed(rasters(spark, SHAPES).withColumn("name", F.regexp_extract("path", r"(r\d)", 1)), str(tmp_path / "in")).collect()
    back = gtiff.read(spark, f"file://{tmp_path}/in")
    assert back.count() == rasters(spark, SHAPES).count()
    assert {(r.xmin, r.width, r.height) for r in back.select("xmin", "width", "height").distinct().collect()} == {(100.0 * k, w, h) for k, (w, h, _) in enumerate(SHAPES)}
    assert post.run(spark, f"file://{tmp_path}/in", str(tmp_path / "full"), "fill", most=8, radius=1) == 4
    assert post.run(spark, f"file://{tmp_path}/in", str(tmp_path / "re"), "resample", resolutions=[4.0, 0.5]) == 8
    assert sorted(p.name for p in (tmp_path / "re").iterdir())[:2] == ["r0_0p5m.tif", "r0_4p0m.tif"]
    ring = [[0.0, 40.0], [10.0, 40.0], [10.0, 50.0], [0.0, 50.0], [0.0, 40.0]]
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {}}]}))
    assert post.run(spark, f"file://{tmp_path}/in", str(tmp_path / "cut"), "clip", polygons=f"file://{tmp_path}/c.geojson") == 1
    cut = gtiff.read(spark, f"file://{tmp_path}/cut")
    assert {(r.col, r.row) for r in cut.collect()} == {(c, r) for c in range(5) for r in range(5)} - {(3, 3), (4, 3), (0, 2)}
    for bad in ({"operation": "resample"}, {"operation": "clip"}, {"operation": "other"}):
        with pytest.raises(ValueError):
            post.run(spark, f"file://{tmp_path}/in", str(tmp_path / "no"), **bad)


def test_resample_nearest_takes_the_cell_under_the_centre(spark):
    one = rasters(spark, [(9, 6, {(4, 1)})])
    for res in (5.0, 0.7, 2.0):
        got = post.resample(one, [res], "nearest").collect()
        w, h = got[0].width, got[0].height
        old = {(r.col, r.row): r.value for r in one.collect()}
        want = {(c, r): old.get((int((c + 0.5) * 9 / w), int((r + 0.5) * 6 / h))) for c in range(w) for r in range(h)}
        assert {(r.col, r.row): r.value for r in got} == {k: v for k, v in want.items() if v is not None}


def test_shapefile_of_rings_holes_points_and_odd_attributes(spark, tmp_path):
    outer, hole = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0), (1.0, 1.0)]
    rows = [("a", [outer, hole], 7, 0.1, "Bäume"), ("a", [outer], None, -1e-300, None), ("b", [outer], 3, None, "")]
    df = spark.createDataFrame([(n, [[{"x": x, "y": y} for x, y in r] for r in rings], k, v, t) for n, rings, k, v, t in rows], f"name string, rings {shapefile.RINGS}, crown_id int, value double, note string")
    assert {(r.name, r.features) for r in shapefile.write(df, str(tmp_path), "name", crs_wkt="WKT").collect()} == {("a.shp", 2), ("b.shp", 1)}
    assert (tmp_path / "a.prj").read_text() == "WKT"
    # sizes in the headers, as the format has them, and outer rings clockwise
    shp = (tmp_path / "b.shp").read_bytes()
    assert 2 * struct.unpack_from(">i", shp, 24)[0] == len(shp) and struct.unpack_from("<2d", shp, 100 + 8 + 44 + 4 + 16) == (0.0, 4.0)
    got = shapefile.read(spark, f"file://{tmp_path}").orderBy("path", "i").collect()
    assert [[[(q.x, q.y) for q in ring] for ring in r.rings] for r in got if r.path.endswith("a.shp")] in ([[outer, hole], [outer]], [[outer], [outer, hole]])
    props = [r.properties for r in got]
    assert {"crown_id": "7", "value": "0.1", "note": "Bäume"} in props and {"value": "-1e-300"} in props and {"crown_id": "3"} in props
    assert vectors.read_polygons(spark, f"file://{tmp_path}/b.shp").first().crown_id == 3
    places = spark.createDataFrame([("p", [[{"x": 1.5, "y": -2.0}]], 1)], f"name string, rings {shapefile.RINGS}, peak int")
    shapefile.write(places, str(tmp_path / "p"), "name", polygon=False).collect()
    p = shapefile.read(spark, f"file://{tmp_path}/p").first()
    assert p.kind == "Point" and (p.rings[0][0].x, p.rings[0][0].y) == (1.5, -2.0)
    with pytest.raises(ValueError):
        shapefile.write(df.limit(0), str(tmp_path), "name")


def test_edge_limit_and_mask_keep_to_the_ground(spark):
    # two dense squares, 30 m apart: nothing between them is covered
    rows = [(x * 0.5 + o, y * 0.5, 1.0) for o in (0.0, 40.0) for x in range(20) for y in range(20)]
    g = spark.createDataFrame(rows, "x double, y double, z double")
    limit = surface.edge_limit(g, 0.25)
    assert 1.5 <= limit < 4 and surface.edge_limit(g.limit(2), 0.25) == 1.0
    cols = {r.col for r in surface.ground_mask(g, 1.0, 10.0).collect()}
    assert set(range(10)) | set(range(40, 50)) <= cols and not cols & set(range(12, 38))
    assert surface.ground_mask(g, 1.0, 10.0, longest=60.0).where("col = 25").count() >= 8


def test_neighbours_on_two_axes_equal_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    xy = rng.random((60, 2)) * 20
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "point_id int, x double, y double")
    d = np.sort(np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1)), axis=1)[:, 1:5]
    for r in outliers.neighbour_distance(df, 4, 0.5, axes="xy").collect():
        assert np.allclose(sorted(r.all_d), d[r.point_id])


def test_edge_limit_counts_points_at_one_place_without_pairing_them(spark):
    """20,000 points at one place would be 400 million pairs; they are one place that counts as often."""
    import numpy as np

    places = [(float(x) * 3, float(y) * 2, 1 + (x + y) % 3) for x in range(6) for y in range(5)] + [(7.5, 5.0, 20_000)]
    df = spark.createDataFrame(places, "x double, y double, m int").selectExpr("explode(sequence(1, m)) i", "x", "y")
    xy, m = np.array([p[:2] for p in places]), np.array([p[2] for p in places])
    far = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    near = [np.sort(np.repeat(d, m - (np.arange(len(m)) == i)))[:6] for i, d in enumerate(far)]
    d = np.concatenate([np.tile(n[n > 0], k) for n, k in zip(near, m, strict=True)])
    assert np.isclose(surface.edge_limit(df, 0.25), max(3 * np.quantile(d, 0.9), 1.0))
    made = outliers.place_distances(outliers.places_of(df, "xy"), 6, 1.0, "xy").collect()
    assert sum(r.m for r in made) == m.sum() and all(len(r.all_d) == r.n == 6 for r in made)


def test_ground_mask_triangulates_places_in_tiles_of_few(spark, monkeypatch):
    import numpy as np

    xy = np.random.default_rng(4).random((300, 2)) * [30, 20]
    df = spark.createDataFrame([(float(x), float(y), 1.0) for x, y in xy], "x double, y double, z double")
    one = {tuple(r) for r in surface.ground_mask(df, 1.0, 20.0).collect()}
    sizes, written = [], surface.written
    monkeypatch.setattr(surface, "written", lambda d, name: sizes.append((name, (w := written(d, name)).count())) or w)
    monkeypatch.setattr(surface, "MOST_POINTS", 20, raising=False)
    many = {tuple(r) for r in surface.ground_mask(df.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(50)))), 1.0, 20.0, longest=surface.edge_limit(df, 1.0)).collect()}
    # a repeated point is one place, before anything is written; longest is given, as repeats change it
    assert ("tin-points", 300) in sizes and len(many ^ one) == 0
