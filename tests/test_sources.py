import os
import struct
import zipfile
import zlib

import numpy as np
import pytest

from florascope.operators import clean
from florascope.operators.raster import sample
from florascope.sources import formats, readers, sinks


def _xlsx(path, sheets):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="m" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{s}" r:id="r{i}"/>' for i, s in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<R xmlns="p">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</R>")
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>plot_id</t></si><si><t>species</t></si></sst>')
        for i, rows in enumerate(sheets.values()):
            body = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
            body += "".join(f'<row r="{k + 2}"><c r="A{k + 2}"><v>{a}</v></c>' + (f'<c r="C{k + 2}" t="inlineStr"><is><t>{b}</t></is></c>' if b else "") + "</row>" for k, (a, b) in enumerate(rows))
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="m"><sheetData>{body}</sheetData></worksheet>')


def test_workbook(spark, tmp_path):
    p = str(tmp_path / "a.xlsx")
    _xlsx(p, {"Trees": [(1, "Acer x"), (2, None)], "Notes": [(9, "n")], "Herbs": [(1, "Poa")]})
    got = sorted((r.stratum, r.plot_id, r.species or "") for r in readers.read_inventory_workbook(spark, p, ["plot_id", "species"]).collect())
    assert got == [("Herbs", "1", "Poa"), ("Trees", "1", "Acer x"), ("Trees", "2", "")]
    with pytest.raises(ValueError, match="none of the sheets"):
        readers.read_inventory_workbook(spark, p, ["plot_id"], ("Ferns",))


def test_geopackage_and_fallback(spark, tmp_path):
    df = spark.createDataFrame([("a", 90.5, 27.25), ("b", 89.0, 27.0), ("c", None, 1.0)], "plot_id string, longitude double, latitude double")
    p, c = str(tmp_path / "p.gpkg"), str(tmp_path / "p.csv")
    assert sinks.export_gpkg(df, p, "plots") == 2
    assert formats.gpkg_layers(p) == [("plots", "geom", 4326)]
    sinks.export_csv(df, c, True)
    assert sorted(map(tuple, readers.read_points(spark, p, c, ["plot_id"]).collect())) == [("a", 90.5, 27.25), ("b", 89.0, 27.0)]
    (tmp_path / "p.gpkg").write_bytes(b"broken")
    assert readers.read_points(spark, p, c, ["plot_id"]).count() == 3


def test_shapefile(spark, tmp_path):
    ring = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (0.0, 0.0)]
    body = struct.pack("<i4d2ii", 5, 0, 0, 2, 2, 1, len(ring), 0) + b"".join(struct.pack("<2d", *q) for q in ring)
    (tmp_path / "s.shp").write_bytes(b"\0" * 100 + struct.pack(">2i", 1, len(body) // 2) + body)
    field = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([6, 0]) + b"\0" * 14
    (tmp_path / "s.dbf").write_bytes(b"\x03" + b"\0" * 3 + struct.pack("<IHH", 1, 65, 7) + b"\0" * 20 + field + b"\r" + b" soil1 ")
    r = readers.read_shapefile(spark, str(tmp_path / "s.shp"), ["NAME"]).first()
    assert r.NAME == "soil1" and r.geometry_wkt == "POLYGON ((0.0 0.0, 0.0 2.0, 2.0 2.0, 0.0 0.0))"


def test_geotiff(spark, tmp_path):
    a = np.arange(20, dtype="<f4").reshape(4, 5)
    a[1, 1] = -9999
    strips = [zlib.compress(a[i : i + 2].tobytes()) for i in (0, 2)]
    tags = [(256, 4, [5]), (257, 4, [4]), (258, 3, [32]), (259, 3, [8]), (273, 4, None), (278, 4, [2]), (279, 4, [len(s) for s in strips]), (339, 3, [3]), (33550, 12, [0.5, 0.25, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 90.0, 28.0, 0.0]), (42113, 2, b"-9999\0")]
    base = 8 + 2 + 12 * len(tags) + 4
    blob, entries = b"".join(strips), []
    offs = [base, base + len(strips[0])]
    for t, k, v in tags:
        v = offs if v is None else v
        raw = v if k == 2 else struct.pack("<" + {3: "H", 4: "I", 12: "d"}[k] * len(v), *v)
        n = len(raw) if k == 2 else len(v)
        if len(raw) <= 4:
            entries.append(struct.pack("<HHI", t, k, n) + raw.ljust(4, b"\0"))
        else:
            entries.append(struct.pack("<HHII", t, k, n, base + len(blob)))
            blob += raw
    os.makedirs(tmp_path / "r")
    (tmp_path / "r" / "wc_bio_12.tif").write_bytes(b"II*\0" + struct.pack("<IH", 8, len(tags)) + b"".join(entries) + b"\0" * 4 + blob)
    path = str(tmp_path / "r" / "wc_bio_12.tif")
    df, grid = readers.read_geotiff(spark, path)
    got = {(r.row, r.col): r.value for r in df.collect()}
    assert len(got) == 19 and (1, 1) not in got and got[3, 4] == 19.0
    pts = spark.createDataFrame([(90.6, 27.9), (90.7, 27.6), (10.0, 10.0)], "x double, y double")
    assert [r.v for r in sample(pts, df, grid, "x", "y", "v").orderBy("x").collect()] == [None, 1.0, None]
    assert [r.variable for r in readers.discover_rasters(spark, str(tmp_path / "r")).collect()] == ["bio12"]


def test_tables_and_json(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, `E v-i` string")
    sinks.write_table(df, str(tmp_path / "t"))
    sinks.write_table(df.limit(1), str(tmp_path / "t"))
    assert sinks.alias_view(spark, str(tmp_path / "t"), "again").count() == 1 and spark.table("again").count() == 1
    sinks.write_json(str(tmp_path / "j" / "m.json"), {"p": tmp_path})
    assert sinks.read_json(str(tmp_path / "j" / "m.json")) == {"p": str(tmp_path)} and sinks.read_json("/nowhere") == {}
    sinks.write_text(str(tmp_path / "r.txt"), "Report", {"part": ["one"]})
    assert "PART" in (tmp_path / "r.txt").read_text()
    inv = {r.path: r for r in readers.file_inventory(spark, [str(tmp_path / "r.txt"), "/nowhere.csv"]).collect()}
    assert inv["/nowhere.csv"].found is False and inv[str(tmp_path / "r.txt")].kind == "txt"
    assert readers.read_optional(spark, "/nowhere.csv") is None
    assert readers.head_check(df, ["a"]) == 2
    with pytest.raises(ValueError, match="not found"):
        readers.head_check(df, ["b"])
    s = spark.createDataFrame([("1",), ("3",), ("bad",)], "`E.V.I` string")
    assert tuple(readers.country_series(s).first())[:2] == (2.0, 2.0)
    assert clean.normalize_header("Plot_ID#") == "plotid"
