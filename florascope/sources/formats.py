"""Decoders of the file formats inventories come in, in plain Python: workbooks, GeoPackages, shapefiles and GeoTIFFs."""

from __future__ import annotations

import io
import os
import re
import sqlite3
import struct
import tempfile
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np


def xlsx_sheets(data: bytes) -> dict[str, str]:
    """Sheet names and their parts inside a workbook."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        rid = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
        out = {}
        for s in book.iter():
            if s.tag.endswith("}sheet"):
                target = rels[s.get(rid)]
                out[s.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        return out


def xlsx_rows(data: bytes, sheet: str) -> Iterator[dict[str, str | None]]:
    """Rows of a sheet as texts under the names of its first row; empty cells are null, empty rows are left out."""
    parts = xlsx_sheets(data)
    if sheet not in parts:
        raise ValueError(f"sheet {sheet} not found; there are {', '.join(parts)}")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        strings: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                strings.append("".join(t.text or "" for t in si.iter() if t.tag.endswith("}t")))
        header: dict[int, str] = {}
        with z.open(parts[sheet]) as f:
            for _, e in ElementTree.iterparse(f):
                if not e.tag.endswith("}row"):
                    continue
                cells: dict[int, str | None] = {}
                for at, c in enumerate(e):
                    ref = re.match(r"[A-Z]+", c.get("r") or "")
                    col = at
                    if ref:
                        col = 0
                        for ch in ref[0]:
                            col = col * 26 + ord(ch) - 64
                        col -= 1
                    v = next((x for x in c if x.tag.endswith("}v")), None)
                    if c.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter() if t.tag.endswith("}t"))
                    else:
                        text = None if v is None else v.text
                        if c.get("t") == "s" and text is not None:
                            text = strings[int(text)]
                    cells[col] = text if text != "" else None
                e.clear()
                if not header:
                    header = {k: t for k, t in cells.items() if t}
                elif any(v is not None for v in cells.values()):
                    yield {name: cells.get(k) for k, name in header.items()}


def wkb_to_wkt(b: bytes) -> str | None:
    """Points, polygons and multi-polygons of well-known binary (2-D) as text."""

    def num(x: float) -> str:
        return repr(float(x)).removesuffix(".0")

    def ring(at: int, o: str) -> tuple[str, int]:
        n = struct.unpack_from(o + "I", b, at)[0]
        xy = struct.unpack_from(f"{o}{2 * n}d", b, at + 4)
        return "(" + ", ".join(f"{num(xy[2 * i])} {num(xy[2 * i + 1])}" for i in range(n)) + ")", at + 4 + 16 * n

    def one(at: int) -> tuple[str, str, int]:
        o = "<" if b[at] == 1 else ">"
        kind = struct.unpack_from(o + "I", b, at + 1)[0] % 1000
        at += 5
        if kind == 1:
            x, y = struct.unpack_from(o + "2d", b, at)
            return "POINT", f"({num(x)} {num(y)})", at + 16
        n = struct.unpack_from(o + "I", b, at)[0]
        at += 4
        parts = []
        for _ in range(n):
            if kind == 3:
                p, at = ring(at, o)
            elif kind == 6:
                _, p, at = one(at)
            else:
                raise ValueError(f"geometry kind {kind} isn't supported")
            parts.append(p)
        return {3: "POLYGON", 6: "MULTIPOLYGON"}[kind], "(" + ", ".join(parts) + ")", at

    if not b:
        return None
    name, body, _ = one(0)
    return f"{name} {body}"


def gpkg_geometry(blob: bytes | None) -> str | None:
    """Text of a GeoPackage geometry: a header, an envelope of the size its flags tell, well-known binary."""
    if not blob or blob[:2] != b"GP" or blob[3] & 16:
        return None
    return wkb_to_wkt(blob[8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7] :])


def gpkg_point(x: float, y: float, srs: int = 4326) -> bytes:
    return b"GP\x00\x01" + struct.pack("<i", srs) + struct.pack("<BI2d", 1, 1, x, y)


def gpkg_layers(path: str) -> list[tuple[str, str, int]]:
    """(table, geometry column, srs) of the feature tables."""
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        return con.execute("select table_name, column_name, srs_id from gpkg_geometry_columns").fetchall()
    finally:
        con.close()


def gpkg_rows(path: str, layer: str | None = None) -> Iterator[dict]:
    layers = gpkg_layers(path)
    table, geom, _ = next((x for x in layers if layer in (None, x[0])), (None, None, None))
    if table is None:
        raise ValueError(f"layer {layer} not found in {path}")
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    con.row_factory = sqlite3.Row
    try:
        for row in con.execute('select * from "' + table.replace('"', '""') + '"'):
            out = dict(row)
            out["geometry_wkt"] = gpkg_geometry(out.pop(geom))
            yield out
    finally:
        con.close()


def write_gpkg(path: str, layer: str, rows: list[dict], lon: str, lat: str) -> None:
    """Points into a GeoPackage: written beside the target, read again and counted, then put in its place."""
    cols = list(rows[0]) if rows else [lon, lat]
    fd, tmp = tempfile.mkstemp(suffix=".gpkg", dir=os.path.dirname(os.path.abspath(path)))
    os.close(fd)
    os.unlink(tmp)
    try:
        con = sqlite3.connect(tmp)
        kind = lambda c: "REAL" if any(isinstance(r[c], float) for r in rows) else "INTEGER" if any(isinstance(r[c], int) for r in rows) else "TEXT"
        q = lambda c: '"' + c.replace('"', '""') + '"'
        con.executescript(f"""PRAGMA application_id = 1196444487; PRAGMA user_version = 10300;
create table gpkg_spatial_ref_sys (srs_name text not null, srs_id integer primary key, organization text not null, organization_coordsys_id integer not null, definition text not null, description text);
insert into gpkg_spatial_ref_sys values ('WGS 84', 4326, 'EPSG', 4326, 'undefined', null);
create table gpkg_contents (table_name text primary key, data_type text not null, identifier text, description text default '', last_change text default current_timestamp, min_x real, min_y real, max_x real, max_y real, srs_id integer);
create table gpkg_geometry_columns (table_name text not null, column_name text not null, geometry_type_name text not null, srs_id integer not null, z tinyint not null, m tinyint not null, primary key (table_name, column_name));
create table {q(layer)} (fid integer primary key, geom blob, {", ".join(f"{q(c)} {kind(c)}" for c in cols if c != "fid")});""")
        con.execute("insert into gpkg_contents (table_name, data_type, identifier, srs_id) values (?, 'features', ?, 4326)", (layer, layer))
        con.execute("insert into gpkg_geometry_columns values (?, 'geom', 'POINT', 4326, 0, 0)", (layer,))
        names = [c for c in cols if c != "fid"]
        con.executemany(
            f"insert into {q(layer)} (geom, {', '.join(map(q, names))}) values ({', '.join('?' * (len(names) + 1))})",
            ((gpkg_point(r[lon], r[lat]), *[r[c] for c in names]) for r in rows))
        con.commit()
        con.close()
        if sum(1 for _ in gpkg_rows(tmp, layer)) != len(rows):
            raise OSError(f"{path}: what was written doesn't read back")
        os.replace(tmp, path)
    finally:
        if os.path.exists(tmp):
            os.unlink(tmp)


def dbf_rows(data: bytes) -> Iterator[dict[str, str | float | None]]:
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 13:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(data[at + 11]), data[at + 16]))
        at += 32
    for i in range(n):
        rec, pos, out = data[head + i * size : head + (i + 1) * size], 1, {}
        for name, kind, width in fields:
            text = rec[pos : pos + width].decode("utf-8", "replace").strip()
            pos += width
            if kind in "NF":
                try:
                    out[name] = float(text)
                except ValueError:
                    out[name] = None
            else:
                out[name] = text or None
        yield out


def shp_shapes(data: bytes) -> Iterator[str | None]:
    """Text of each shape: points and polygons; rings of a polygon become the parts of one even-odd polygon."""
    at = 100
    while at < len(data):
        length = 2 * struct.unpack_from(">i", data, at + 4)[0]
        kind = struct.unpack_from("<i", data, at + 8)[0] % 10
        if kind == 1:
            x, y = struct.unpack_from("<2d", data, at + 12)
            yield f"POINT ({x} {y})"
        elif kind == 5:
            parts, points = struct.unpack_from("<2i", data, at + 44)
            starts = [*struct.unpack_from(f"<{parts}i", data, at + 52), points]
            xy = struct.unpack_from(f"<{2 * points}d", data, at + 52 + 4 * parts)
            rings = ["(" + ", ".join(f"{xy[2 * i]} {xy[2 * i + 1]}" for i in range(a, b)) + ")" for a, b in zip(starts, starts[1:], strict=False)]
            yield "POLYGON (" + ", ".join(rings) + ")"
        else:
            yield None
        at += 8 + length


class GeoTiff:
    """A north-up TIFF of strips or tiles, plain or deflated, with its place on the globe. Blocks are read one by one."""

    _KIND = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d", 16: "Q"}

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.order = "<" if data[:2] == b"II" else ">"
        if data[:2] not in (b"II", b"MM") or self._at("H", 2)[0] != 42:
            raise ValueError("not a TIFF file")
        at = self._at("I", 4)[0]
        tags: dict[int, tuple] = {}
        for i in range(self._at("H", at)[0]):
            tag, kind, n, _ = self._at("HHII", at + 2 + 12 * i)
            code = self._KIND.get(kind)
            if code is None:
                continue
            size = struct.calcsize("<" + code) * n
            pos = at + 10 + 12 * i if size <= 4 else self._at("I", at + 10 + 12 * i)[0]
            tags[tag] = (data[pos : pos + n],) if code == "s" else self._at(code * n, pos)
        self.tags = tags
        self.width, self.height = tags[256][0], tags[257][0]
        self.bands = tags.get(277, (1,))[0]
        bits, form = tags.get(258, (8,))[0], tags.get(339, (1,))[0]
        self.dtype = np.dtype(f"{self.order}{'uif'[form - 1]}{bits // 8}")
        self.compression, self.predictor = tags.get(259, (1,))[0], tags.get(317, (1,))[0]
        self.planar = tags.get(284, (1,))[0]
        scale, tie = tags.get(33550, (1.0, 1.0, 0.0)), tags.get(33922, (0, 0, 0, 0.0, 0.0, 0))
        self.xres, self.yres, self.x0, self.y0 = scale[0], scale[1], tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]
        nodata = tags.get(42113, (b"",))[0].strip(b"\0 ")
        self.nodata = float(nodata) if nodata else None
        self.tiled = 322 in tags
        self.bw = tags[322][0] if self.tiled else self.width
        self.bh = tags[323][0] if self.tiled else tags.get(278, (self.height,))[0]
        self.offsets, self.counts = tags[324 if self.tiled else 273], tags[325 if self.tiled else 279]
        self.across = -(-self.width // self.bw)
        self.per_plane = self.across * -(-self.height // self.bh)

    def _at(self, form: str, at: int) -> tuple:
        return struct.unpack_from(self.order + form, self.data, at)

    def __len__(self) -> int:
        return len(self.offsets)

    def block(self, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(band, rows, cols, values) of block k; nodata and infinite values are not-a-number."""
        raw = self.data[self.offsets[k] : self.offsets[k] + self.counts[k]]
        if self.compression in (8, 32946):
            raw = zlib.decompress(raw)
        elif self.compression != 1:
            raise ValueError(f"compression {self.compression} isn't supported")
        plane, place = divmod(k, self.per_plane) if self.planar == 2 else (0, k)
        r0, c0 = place // self.across * self.bh, place % self.across * self.bw
        inside = 1 if self.planar == 2 else self.bands
        a = np.frombuffer(raw, self.dtype)
        a = a[: len(a) // (self.bw * inside) * self.bw * inside].reshape(-1, self.bw, inside)
        if self.predictor == 2:
            a = np.cumsum(a, axis=1, dtype=self.dtype.newbyteorder("="))
        elif self.predictor != 1:
            raise ValueError(f"predictor {self.predictor} isn't supported")
        a = a[: self.height - r0, : self.width - c0]
        rows, cols = (x.ravel() for x in np.mgrid[r0 : r0 + a.shape[0], c0 : c0 + a.shape[1]])
        for b in range(inside):
            v = a[:, :, b].ravel().astype(float)
            v[~np.isfinite(v) | (v == self.nodata if self.nodata is not None else False)] = np.nan
            yield plane + b + 1, rows, cols, v
