"""Query plans, outlines, files on the driver and the commands."""

import datetime as dt
import io
import json
import struct
import tarfile
import zipfile
import zlib

import pytest

from geoloom import cli
from geoloom.operators import geometry as G
from geoloom.operators import planning as P
from geoloom.sources import storage as S

TODAY = dt.date(2026, 1, 31)


def test_plan(spark, tmp_path):
    rows = [
        {"id": "pit", "kind": "visual", "synonyms": ["open-pit mine", "mine", "खदान"], "evidence": "inferred", "route": "appearance", "max_gsd_m": 30.0},
        {"id": "pit_edge", "kind": "visual", "synonyms": ["open-pit mine edge"], "evidence": "inferred", "route": "appearance", "max_gsd_m": 5.0},
        {"id": "new_building", "kind": "change", "synonyms": ["new buildings"], "evidence": "observed", "route": "event"},
        {"id": "road", "kind": "reference", "synonyms": ["road", "roads"], "evidence": "gis", "route": "gis", "layer_requirement": "roads", "evidence_otherwise": "unverifiable"},
    ]
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, rows)))
    concepts = P.registry(spark, str(tmp_path / "c.json"))
    plan = lambda t, layers=("roads",): P.plan(spark, t, concepts, TODAY, 10.0, list(layers), 500)
    a = plan("New buildings within 2 km of roads since March 2021")
    assert a["intent"] == "find_changes" and [c["id"] for c in a["chips"]] == ["new_building", "road", "time", "distance"]
    assert a["chips"][2]["value"] == {"from": "2021-03-01", "to": None} and a["chips"][3]["value"] == {"m": 2000} and a["unverifiable"] == []
    b = plan("an open-pit mine near a road", ())
    assert b["intent"] == "find_appearance" and [c["label"] for c in b["chips"]] == ["open-pit mine", "road", "500 m"] and b["unverifiable"][0]["wouldNeed"] == "roads"
    c = plan("open-pit mine edge")
    assert c["intent"] == "unanswerable" and [x["id"] for x in c["chips"]] == ["pit_edge"] and "5 m" in c["unverifiable"][0]["wouldNeed"]
    assert [x["id"] for x in plan("खदान")["chips"]] == ["pit"] and plan("")["chips"] == []


def test_dates():
    assert P.dates("between 2019 and 2021", TODAY) == ("2019-01-01", "2021-12-31") and P.dates("in february 2024", TODAY) == ("2024-02-01", "2024-02-29")
    assert P.dates("before 2020", TODAY) == (None, "2020-01-01") and P.dates("last 2 weeks", TODAY) == ("2026-01-17", "2026-01-31") and P.dates("now", TODAY) == (None, None)


def _slow_area(cells):
    return len(cells), sum((r + a, c + b) not in cells for r, c in cells for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))


def test_outlines(spark):
    ring = {(r, c) for r in range(5) for c in range(5)} - {(2, 2)}
    corner = {(10, 10), (11, 11), (10, 11)}
    df = spark.createDataFrame([(1, *x) for x in ring] + [(2, *x) for x in corner], "label int, r int, c int")
    out = {r.label: r for r in G.outlines(df, 10.0, 100.0, 1000.0).collect()}
    for label, cells in ((1, ring), (2, corner)):
        n, length = _slow_area(cells)
        assert (out[label].area, out[label].perimeter) == (n * 100, length * 10)
    assert out[1].vertices == 8 and out[1].wkt.startswith("MULTIPOLYGON (((100 1000, 150 1000") and out[1].wkt.count("(") == 4
    apart = G.rings(list(map(tuple, G.boundary(spark.createDataFrame([(1, 0, 0), (1, 1, 1)], "label int, r int, c int")).select("r0", "c0", "r1", "c1").collect())))
    assert sorted(map(G.area, apart)) == [1.0, 1.0]  # cells that touch in a corner are two rings


def test_extract(tmp_path):
    def made(name, path="a/b.txt", link=False):
        at = tmp_path / name
        if name.endswith("zip"):
            with zipfile.ZipFile(at, "w") as z:
                z.writestr(path, "hello")
        else:
            with tarfile.open(at, "w") as t:
                m = tarfile.TarInfo(path)
                m.size = 0 if link else 5
                m.type, m.linkname = (tarfile.SYMTYPE, "/etc/passwd") if link else (tarfile.REGTYPE, "")
                t.addfile(m, io.BytesIO(b"hello"))
        return at

    for name in ("x.zip", "x.tar"):
        assert [p.read_text() for p in S.extract(made(name), tmp_path / name[2:])] == ["hello"]
    for bad in (made("u.zip", "../up.txt"), made("u.tar", "/abs.txt"), made("l.tar", "l", True)):
        with pytest.raises(S.UnsafeArchive):
            S.extract(bad, tmp_path / "out")
    with pytest.raises(S.UnsafeArchive):
        S.extract(tmp_path / "x.zip", tmp_path / "out", most_bytes=4)
    assert not (tmp_path / "out").exists()


def test_files(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "one.tif").write_bytes(b"no raster")
    head = struct.pack("<HHI", 0x4949, 42, 8) + struct.pack("<H", 6)
    tag = lambda t, k, n, v: struct.pack("<HHII", t, k, n, v)
    body = head + tag(256, 3, 1, 40) + tag(257, 3, 1, 30) + tag(258, 3, 1, 16) + tag(277, 3, 1, 1) + tag(33550, 12, 3, 200) + tag(34735, 3, 8, 224)
    body = body.ljust(200, b"\0") + struct.pack("<3d", 10.0, 10.0, 0.0) + struct.pack("<8H", 1, 1, 0, 1, 3072, 0, 1, 32644)
    (tmp_path / "B04.tif").write_bytes(body)
    rows = {r.band: r for r in S.raster_headers(spark, str(tmp_path)).collect()}
    assert (rows["B04"].width, rows["B04"].height, rows["B04"].resolution, rows["B04"].crs, rows["B04"].dtype) == (40, 30, 10.0, "EPSG:32644", "uint16") and rows["one"].width is None
    assert {r.length for r in S.manifest(spark, str(tmp_path)).collect()} == {9, len(body)}
    kept = S.store_raw(tmp_path / "one.tif", tmp_path / "raw")
    assert kept.stat().st_mode & 0o222 == 0
    (tmp_path / "one.tif").write_bytes(b"again")
    with pytest.raises(FileExistsError):
        S.store_raw(tmp_path / "one.tif", tmp_path / "raw")
    with pytest.raises(PermissionError):
        S.wipe(tmp_path, ["raw"])
    with pytest.raises(S.UnsafeArchive):
        S.wipe(tmp_path, ["../x"], sure=True)
    assert len(S.wipe(tmp_path, ["raw"], sure=True)) == 1 and list((tmp_path / "raw").iterdir()) == []
    S.chip(spark.createDataFrame([(0, 1, 255, 0, 9)], "r int, c int, red int, green int, blue int"), tmp_path / "c.png", 2)
    data = (tmp_path / "c.png").read_bytes()
    at = data.index(b"IDAT")
    assert zlib.decompress(data[at + 4 : at + 4 + struct.unpack(">I", data[at - 4 : at])[0]]) == b"\0" + b"\0\0\0\xff\0\x09" + b"\0" * 7


def test_commands(spark, tmp_path, capsys):
    run = lambda *a: cli.main(["--root", str(tmp_path), *a], spark)
    assert run("db-init") == 0 and run("jobs") == 0 and run("audit-verify") == 0 and run("worker") == 0 and run("status") == 0 and run("aoi-sync") == 0
    assert run("reset-archive") == 1 and run("reset-archive", "--yes") == 0 and "refusing" in capsys.readouterr().out
