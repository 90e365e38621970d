"""Intake and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from geoloom.operators import grid as G
from geoloom.sources import adapters as A
from geoloom.sources import sinks as S
from geoloom.sources import storage


def _item(**changes):
    properties = {"datetime": "2022-03-06T05:13:17.287Z", "platform": "sentinel-2a", "proj:epsg": 32644, "s2:processing_baseline": "04.00", "earthsearch:boa_offset_applied": True, "eo:cloud_cover": 1.5, "mgrs:utm_zone": 44, "mgrs:latitude_band": "Q", "mgrs:grid_square": "NH"}
    return {"id": "x", "collection": "sentinel-2-l2a", "properties": properties | changes}


def test_items(spark, tmp_path):
    for i, item in enumerate([_item(), _item(**{"datetime": "2022-03-06T05:13:17", "eo:cloud_cover": 120}), _item(**{"earthsearch:boa_offset_applied": None})]):
        (tmp_path / f"{i}.json").write_text(json.dumps(item | {"id": str(i)}))
    (tmp_path / "9.json").write_text("{broken")
    rows = {r.source_id: r for r in A.stac_scenes(spark, str(tmp_path)).collect()}
    assert rows["0"].reasons == [] and rows["0"].offset_decision == "apply:0" and rows["0"].tile_code == "44QNH"
    assert rows["1"].reasons == ["acquired_at_without_zone", "cloud_cover_out_of_range"] and rows["2"].offset_decision == "radiometry_ambiguous"
    assert "unreadable_json" in rows[None].reasons
    good, bad = A.split_valid(A.stac_scenes(spark, str(tmp_path)))
    assert (good.count(), bad.count()) == (2, 2)


def test_sidecars_listing_and_offsets(spark, tmp_path):
    full = {"acquired_at": "2024-01-01T00:00:00+05:30", "sensor": "s", "platform": "p", "processing_level": "L2A", "gsd_m": 10, "bands": ["B02"], "scale": 10000, "offset": -1000, "nodata": 0}
    (tmp_path / "a.json").write_text(json.dumps(full))
    assert A.sidecar_scenes(spark, str(tmp_path / "a.json")).first().reasons == ["radiometry_ambiguous"]
    (tmp_path / "b.tif").write_text("x")
    (tmp_path / "c.tif.part").write_text("x")
    found = A.candidates(spark, str(tmp_path)).select("name", A.adapter(F.col("path")).alias("adapter")).collect()
    assert [(r.name, r.adapter) for r in found] == [("a.json", None), ("b.tif", "geotiff")]
    xml = spark.createDataFrame([('<BOA_ADD_OFFSET band_id="1">-1000</B><BOA_ADD_OFFSET band_id="12">0</B>',)], "x string")
    assert xml.select(A.product_offsets(F.col("x"))).first()[0] == {1: -1000, 12: 0}


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, p string, v double")
    new = spark.createDataFrame([(2, "b", 5.0), (3, "b", 6.0)], "k int, p string, v double")
    assert sorted((r.k, r.v) for r in S.merge(old, new, ["k"]).collect()) == [(1, 1.0), (2, 5.0), (3, 6.0)]
    assert [r.k for r in S.absent(old, new, ["k"]).collect()] == [3]
    assert sorted((r.k, r.v) for r in S.coalesce_update(old, new, ["k"], "v").collect()) == [(1, 1.0), (2, 5.0)]
    path = str(tmp_path / "t")
    S.overwrite_partitions(old, path, ["p"])
    S.overwrite_partitions(new, path, ["p"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, 1.0), (2, 5.0), (3, 6.0)]
    S.geojson_lines(old.withColumn("x", F.lit(1)).withColumn("y", F.lit(2)), str(tmp_path / "g"), "x", "y", ["k"])
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "g")).collect()]
    assert lines[0]["geometry"] == {"type": "Point", "coordinates": [1.0, 2.0]}


def test_golden_grids(spark):
    rows = {r.aoi: (r.xmin, r.ymin, r.xmax, r.ymax, r.width, r.height) for r in G.grids(G.areas(spark)).collect()}
    assert rows["korba"] == (657920, 2467200, 674560, 2473600, 1664, 640)
    assert rows["gangrel"] == (549120, 2273920, 561920, 2282880, 1280, 896)
    assert rows["prayagraj"] == (585600, 2809600, 593280, 2817920, 768, 832)
    assert rows["naya_raipur"] == (577920, 2336000, 584960, 2344960, 704, 896)
    assert rows["raipur_kharun"] == (554240, 2342400, 561920, 2352640, 768, 1024)
    tiles = G.tiles(G.grids(G.areas(spark)))
    assert tiles.count() == 899 and tiles.select("tile_id").distinct().count() == 899


def test_all_rules_of_clips_and_rasters(spark, tmp_path):
    import struct

    def tiff(path, side, size, code=32644, bands=1, bits=16):
        tag = lambda t, k, n, v: struct.pack("<HHII", t, k, n, v)
        body = struct.pack("<HHI", 0x4949, 42, 8) + struct.pack("<H", 6) + tag(256, 3, 1, side) + tag(257, 3, 1, side) + tag(258, 3, 1, bits) + tag(277, 3, 1, bands) + tag(33550, 12, 3, 200) + tag(34735, 3, 8, 224)
        path.write_bytes(body.ljust(200, b"\0") + struct.pack("<3d", size, size, 0.0) + struct.pack("<8H", 1, 1, 0, 1, 3072, 0, 1, code))

    sizes = {"B02": 10, "B03": 10, "B04": 10, "B08": 10, "B11": 20, "B12": 20, "SCL": 20}
    for name, at, skip in (("good", "2021-12-21T05:13:08Z", None), ("bad", "2010-12-21T05:13:08Z", "B08"), ("late", "noon", None)):
        (tmp_path / name).mkdir()
        item = {"id": "S2B_L2A", "collection": "sentinel-2-l2a", "properties": {"datetime": at, "platform": "sentinel-2b", "instruments": ["msi"], "proj:epsg": 32644}}
        (tmp_path / name / "item.json").write_text(json.dumps(item))
        for b, size in sizes.items():
            if b != skip:
                tiff(tmp_path / name / f"{b}.tif", 1000 // size, size, 32643 if name == "bad" and b == "B11" else 32644)
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "item.json").write_text("{no")
    headers = storage.raster_headers(spark, str(tmp_path))
    got = {r.path.split("/")[-2]: (r.code, r.reasons) for r in A.judged_stac(spark, str(tmp_path / "*" / "item.json"), headers).collect()}
    assert got["good"] == (None, []) and got["bad"] == ("validation_failed", ["outside_mission", "missing_B08", "crs_B11"])
    assert got["late"][0] == "timestamp_invalid" and got["broken"][0] == "metadata_unreadable"
    one = tmp_path / "single"
    one.mkdir()
    facts = {"acquired_at": "2021-01-01T00:00:00Z", "sensor": "x", "platform": "p", "processing_level": "L2A", "gsd_m": 10.0, "bands": ["a", "b"], "scale": 1.0, "offset": 0, "nodata": 0}
    for name, change, bands in (("ok", {}, 2), ("few", {}, 1), ("none", None, 2), ("part", {"scale": None}, 2), ("size", {"gsd_m": 11.0}, 2)):
        tiff(one / f"{name}.tif", 50, 10, bands=bands)
        if change is not None:
            (one / f"{name}.sidecar.json").write_text(json.dumps({k: v for k, v in (facts | change).items() if v is not None}))
    found = {r.path.split("/")[-1]: (r.code, r.reasons) for r in A.judged_rasters(spark, str(one / "*.sidecar.json"), storage.raster_headers(spark, str(one))).collect()}
    assert found == {"ok.tif": (None, []), "few.tif": ("validation_failed", ["bands"]), "none.tif": ("metadata_missing", [f"missing_{f}" for f in A.REQUIRED]), "part.tif": ("metadata_missing", ["missing_scale"]), "size.tif": ("validation_failed", ["resolution"])}
    with pytest.raises(KeyError):
        A.by_name("other")
