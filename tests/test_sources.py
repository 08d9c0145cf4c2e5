import io
import json
import sqlite3
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenweave.functions import bands as B
from lumenweave.operators import catalog, provenance
from lumenweave.operators.grid import Grid
from lumenweave.sources import cubes, rasters, sinks, spectra, tables
from lumenweave.streaming import trajectory

G = Grid(350000, 3760000, 30, 7, 5, "EPSG:32611")


@pytest.mark.parametrize("dtype, nodata", [("<f4", -9999.0), ("<i2", -1.0), ("<u1", None)])
def test_geotiff_round_trip(spark, tmp_path, dtype, nodata):
    data = np.arange(70).reshape(2, 5, 7).astype(dtype)
    if nodata is not None:
        data[0, 1, 2] = nodata
    (tmp_path / "a.tif").write_bytes(rasters.encode_geotiff(data, G, nodata, strip_rows=2))
    back, grid, missing = rasters.decode_geotiff((tmp_path / "a.tif").read_bytes())
    assert np.array_equal(back, data) and grid == G and missing == nodata
    got = {(r.row, r.col): r for r in rasters.read_geotiff(spark, str(tmp_path / "a.tif"), ("a", "b")).collect()}
    assert len(got) == 35 and got[1, 2].a is None or nodata is None
    assert (got[0, 0].x, got[0, 0].y, got[4, 6].b) == (350015, 3759985, float(data[1, 4, 6]))


def test_geotiff_tiles_and_refusals():
    tile = np.zeros((16, 16), ">u2")
    tile[:5, :7] = np.arange(35).reshape(5, 7)
    tags = [(256, 3, 7), (257, 3, 5), (258, 3, 16), (259, 3, 1), (277, 3, 1), (322, 3, 16), (323, 3, 16), (324, 4, 8), (325, 4, 512)]
    head = b"MM\0*" + struct.pack(">I", 8 + 512) + tile.tobytes() + struct.pack(">H", len(tags))
    body = b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in tags)
    back, _, _ = rasters.decode_geotiff(head + body + b"\0\0\0\0")
    assert np.array_equal(back[0], np.arange(35).reshape(5, 7))
    with pytest.raises(ValueError):
        rasters.decode_geotiff(b"PK\3\4....")
    with pytest.raises(ValueError):
        rasters.decode_geotiff((head + body).replace(struct.pack(">HHIHH", 259, 3, 1, 1, 0), struct.pack(">HHIHH", 259, 3, 1, 5, 0)) + b"\0\0\0\0")


def test_products_and_quicklook(spark, tmp_path):
    df = spark.createDataFrame([(r, c, float(r * 7 + c)) for r in range(5) for c in range(7) if (r, c) != (0, 3)], "row int, col int, v double")
    sinks.write_geotiff(df, "v", G, str(tmp_path / "v.tif"))
    back, grid, _ = rasters.decode_geotiff((tmp_path / "v.tif").read_bytes())
    assert np.isnan(back[0, 0, 3]) and back[0, 4, 6] == 34 and grid == G
    sinks.write_quicklook(df, "v", 5, 7, str(tmp_path / "v.png"))
    assert (tmp_path / "v.png").read_bytes()[:8] == b"\x89PNG\r\n\x1a\n"
    sinks.write_product(df.selectExpr("'s' scene_id", "'v' product", "row", "col", "v value"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).filter("product = 'v'").count() == 34
    log = []
    assert sinks.stage(log, "ok")(lambda: 3)() == 3 and sinks.stage(log, "bad")(lambda: 1 / 0)() is None
    assert [r["status"] for r in log] == ["ok", "error"] and "ZeroDivisionError" in sinks.report(log)
    with pytest.raises(KeyError):
        sinks.style_of("?")


def test_scene_layout_prunes_columns_and_tiles(spark, tmp_path):
    bands = B.even(400, 2500, 22)
    df = spark.range(600).selectExpr("'a' scene_id", "cast(id div 2 as int) row", "cast(id % 2 as int) col", "transform(sequence(1, 22), i -> cast(i as double)) spectrum")
    rasters.write_scene(df, str(tmp_path / "s"), bands, tile=100)
    some = rasters.read_scene(spark, str(tmp_path / "s"), ["NIR", "SWIR2"], (150, 160), tile=100)
    assert some.count() == 20 and some.columns == ["scene_id", "row", "col", "b_nir", "b_swir2"]
    plan = some._jdf.queryExecution().toString()
    assert "spectrum" not in plan.split("ReadSchema: ")[-1].split("\n")[0] and "PartitionFilters: [isnotnull(tile" in plan


META = "XDim=5\nYDim=4\nUpperLeftPointMtrs=(300000.0,4000000.0)\nLowerRightMtrs=(300150.0,3999880.0)\nProjection=HE5_GCTP_UTM\nZoneCode=11\nGridOrigin=HE5_HDFE_GD_UL\n"


def test_grid_metadata():
    meta = rasters.parse_grid_metadata(META)
    assert rasters.grid_of_metadata(meta) == Grid(300000, 4000000, 30, 5, 4, "EPSG:32611") and meta["origin"] == "HE5_HDFE_GD_UL"
    with pytest.raises(ValueError, match="y_dim"):
        rasters.parse_grid_metadata(META.replace("YDim", "Y"))
    spaced = rasters.parse_grid_metadata(META.replace("=", " = ").replace("(", "\t( ").replace("ZoneCode", "Zone") + 'GridName="HYP"\n')
    assert spaced == meta | {"zone": None} and rasters.grid_of_metadata(spaced).crs is None


class Field:
    """An array with attributes and a file of them, as h5py has."""

    def __init__(self, data, **attrs):
        self.data, self.attrs, self.shape = data, attrs, getattr(data, "shape", ())

    def __getitem__(self, key):
        return self.data if key == () else self.data[key]


CUBE = np.arange(60, dtype=float).reshape(3, 4, 5) / 100
AXIS = {"wavelengths": [400.0, 500.0, 600.0], "fwhm": [5.0] * 3, "good_wavelengths": [1, 0, 1], "_FillValue": -9999.0}


def pixels_of(blocks):
    return {(r["row"], r["col"]): r for b in blocks for r in b.to_pylist()}


def test_gridded_scene():
    cube = CUBE.copy()
    cube[:, 0, 0] = -9999
    clouds = Field(np.eye(4, 5, dtype=np.uint8))
    f = {f"{cubes.GRID_FIELDS}/surface_reflectance": Field(cube, **AXIS), cubes.GRID_TEXT: Field(META.encode()), f"{cubes.SWATH_META}/beta_cloud_mask": clouds, "beta_cirrus_mask": Field(np.zeros((2, 2)))}
    got = pixels_of(cubes.scene_blocks(f, "a", 450, 700, block_rows=3))
    assert len(got) == 20 and got[0, 0]["spectrum"] == [None, None] and got[3, 4]["spectrum"] == pytest.approx([0.39, 0.59])
    assert (got[0, 0]["x"], got[0, 0]["y"], got[1, 1]["cloud"], got[1, 2]["cloud"], got[0, 0]["cirrus"]) == (300015, 3999985, 1, 0, None)
    b = cubes.bands_of(f)
    assert b.good == (True, False, True) and b.fwhm == (5.0,) * 3
    with pytest.raises(ValueError):
        list(cubes.scene_blocks(f, "a", 700, 800))
    with pytest.raises(ValueError):
        cubes.bands_of({})


def test_swath():
    lat, lon = np.mgrid[34:34.4:0.1, -118:-117.5:0.1]
    f = {f"{cubes.SWATH_FIELDS}/toa_radiance": Field(CUBE, **AXIS), f"{cubes.SWATH_PLACES}/Latitude": Field(lat), f"{cubes.SWATH_PLACES}/Longitude": Field(lon)}
    got = pixels_of(cubes.scene_blocks(f, "a"))
    assert got[2, 3]["y"] == pytest.approx(34.2) and got[2, 3]["x"] == pytest.approx(-117.7) and len(got[0, 0]["spectrum"]) == 3
    del f[f"{cubes.SWATH_PLACES}/Latitude"]
    with pytest.raises(ValueError):
        list(cubes.scene_blocks(f, "a"))


@pytest.mark.parametrize("last", [False, True])
def test_airborne_cube(last):
    cube = CUBE.copy()
    cube[1, 2, 2] = -9999
    f = {"reflectance/reflectance": Field(np.moveaxis(cube, 0, 2) if last else cube), "reflectance/wavelength": Field(np.array([0.4, 0.5, 0.6])), "easting": Field(np.arange(5) * 2.0), "northing": Field(100 - np.arange(4) * 2.0)}
    got = pixels_of(cubes.airborne_blocks(f, "a", 450, 700, block_rows=2))
    assert got[2, 2]["spectrum"][0] is None and got[3, 4]["spectrum"] == pytest.approx([0.39, 0.59]) and (got[3, 4]["x"], got[3, 4]["y"]) == (8, 94)
    with pytest.raises(ValueError):
        list(cubes.airborne_blocks({"reflectance/wavelength": f["reflectance/wavelength"]}, "a"))


def test_hdf5_files(spark, tmp_path):
    h5py = pytest.importorskip("h5py")
    with h5py.File(tmp_path / "a.h5", "w") as f:
        d = f.create_dataset(f"{cubes.GRID_FIELDS}/surface_reflectance", data=CUBE)
        d.attrs["wavelengths"], d.attrs["_FillValue"] = [400.0, 500.0, 600.0], -9999.0
        f[cubes.GRID_TEXT] = META
    assert cubes.read_scenes(spark, str(tmp_path / "a.h5"), 450, 700).count() == 20


def test_class_and_fraction_rasters(spark, tmp_path):
    codes = np.array([[0, 1, 2, 3], [4, 5, 5, 255]], np.uint8)
    g = Grid(0, 60, 30, 4, 2, "EPSG:32611")
    (tmp_path / "c.tif").write_bytes(rasters.encode_geotiff(codes[None], g, 255))
    got = {(r.row, r.col): r.code for r in rasters.read_classes(spark, str(tmp_path / "c.tif"), {0: -1}).collect()}
    assert [got[i // 4, i % 4] for i in range(8)] == [-1, 1, 2, 3, 4, 4, 4, -1]
    moved = rasters.read_classes(spark, str(tmp_path / "c.tif"), target=Grid(30, 60, 30, 4, 1, "EPSG:32611")).collect()
    assert {r.col: r.code for r in moved} == {0: 1, 1: 2, 2: 3, 3: -1}
    parts = np.stack([np.full((4, 4), v, np.float32) for v in (0.1, 0.2, 0.3, 0.4)])
    (tmp_path / "f.tif").write_bytes(rasters.encode_geotiff(parts, Grid(0, 60, 15, 4, 4, "EPSG:32611")))
    df, grid = rasters.read_fractions(spark, str(tmp_path / "f.tif"), 4)
    assert df.count() == 4 and grid == Grid(0, 60, 30, 2, 2, "EPSG:32611") and df.first().soil == pytest.approx(0.4)


def test_fraction_names():
    assert rasters.fraction_columns(["Burn", "GV", "litter", "rock", "x"]) == ["char", "pv", "npv", "soil", "x"]
    assert rasters.fraction_columns(5) == ["char", "pv", "npv", "soil", "shade"]
    for bad in (3, ["x"]):
        with pytest.raises(ValueError):
            rasters.fraction_columns(bad)


def test_mineral_library(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "splib07a_Wavelengths_ASD.txt").write_text("Wavelengths\n0.3\n0.5\n1.0\n3.0\n")
    (tmp_path / "sub" / "s07ASD_Char_Pinus.txt").write_text("header text\n0.1\n-1.23e34\n1.4\n0.4\n")
    (tmp_path / "s07ASD_Soil_A.txt").write_text("0.2\n0.2\n0.2\n0.2\n")
    (tmp_path / "s07ASD_Soil_short.txt").write_text("h\n0.2\n")
    (tmp_path / "s07ASD_Rock_empty.txt").write_text("h\n0.2\n-1.23e34\n-1.23e34\n0.1\n")
    (tmp_path / "s07BECK_Soil.txt").write_text("h\n1\n1\n1\n1\n")
    (tmp_path / "s07ASD_Quartz.txt").write_text("h\n1\n1\n1\n1\n")
    df, bands = spectra.mineral_library(spark, str(tmp_path))
    got = {r.spectrum_id: r for r in df.collect()}
    assert bands.wavelengths == (300, 500, 1000, 3000) and set(got) == {"mineral_char_0001", "mineral_soil_0001"}
    assert got["mineral_char_0001"].spectrum == [0.1, 0, 1.0, 0.4] and got["mineral_char_0001"].name == "s07ASD_Char_Pinus"
    assert spectra.mineral_library(spark, str(tmp_path), categories=["soil"])[0].count() == 1
    with pytest.raises(FileNotFoundError):
        spectra.mineral_library(spark, str(tmp_path), "NIC4")


def test_field_library(spark, tmp_path):
    (tmp_path / "a_char.txt").write_text("# wl, r\n0.4, 10\n0.5\t20\n0.6 30\n")
    (tmp_path / "b_green.txt").write_text("450 0.2\n550 0.4\nbad line\n")
    (tmp_path / "c_other.txt").write_text("1 1\n2 2\n")
    df, bands = spectra.field_library(spark, str(tmp_path))
    got = {r.category: r.spectrum for r in df.collect()}
    assert bands.wavelengths == pytest.approx((400, 500, 600)) and got["char"] == pytest.approx([0.1, 0.2, 0.3])
    assert got["pv"][0] is None and got["pv"][1] == pytest.approx(0.3) and got["pv"][2] is None


def test_sample_database(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "s.db")
    db.execute("create table Samples (SampleID int, Type text, Class text, SubClass text, Name text)")
    db.execute("create table Spectra (SpectrumID int, SampleID int, XUnit text, XData blob, YData blob)")
    pack = lambda *v: struct.pack(f"{len(v)}f", *v)
    db.executemany("insert into Samples values (?, ?, ?, ?, ?)", [(1, "vegetation", "tree", None, "oak"), (2, "Soil", "x", "y", "clay"), (3, "water", "", "", "sea"), (4, "non-photosynthetic vegetation", "", "", "bark")])
    db.executemany("insert into Spectra values (?, ?, ?, ?, ?)", [(10, 1, "Wavelength (micrometers)", pack(0.2, 0.4, 0.6), pack(9, 20, 40)), (11, 2, "um", pack(0.4, 0.5), pack(0.1, 0.3)), (12, 3, "um", pack(0.4), pack(0.1)), (13, 4, "um", pack(0.4, 0.6), pack(0.5, 0.5))])
    db.commit()
    db.close()
    df, bands = spectra.sample_database(spark, str(tmp_path / "s.db"))
    got = {r.name: (r.spectrum_id, r.category, r.spectrum) for r in df.collect()}
    assert bands.wavelengths == pytest.approx((400, 600), rel=1e-6)
    assert got["oak"][:2] == ("samples_pv_0001", "pv") and got["oak"][2] == pytest.approx([0.2, 0.4]) and got["clay"][2][1] is None and got["bark"][1] == "npv" and "sea" not in got


def xlsx(rows, sheet):
    cell = lambda v, r, c: f'<c r="{chr(65 + c)}{r + 1}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + c)}{r + 1}"><v>{v}</v></c>' if v is not None else ""
    body = "".join(f'<row r="{i + 1}">' + "".join(cell(v, i, j) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows))
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="other" r:id="r1"/><sheet name="{sheet}" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_sites(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Lat,LON,obs_date,lfmc,species\n34.1,-118.2,2025-01-05,80,Chamise\nx,-118,2025-01-05,80,Oak\n34,-118,never,80,Oak\n")
    (r,) = tables.read_sites(spark, str(tmp_path / "a.csv")).collect()
    assert (r.latitude, r.longitude, r.lfmc_percent, str(r.date)) == (34.1, -118.2, 80.0, "2025-01-05 00:00:00")
    head = ["Latitude (WGS84, EPSG:4326)", "Longitude (WGS84, EPSG:4326)", "Sampling date (YYYYMMDD)", "LFMC value (%)", "Site name"]
    (tmp_path / "b.xlsx").write_bytes(xlsx([head, [34.1, -118.2, 20250105, 91.5, "Bitter"], [None, -118.2, 20250105, 91.5, "x"]], "LFMC data"))
    (r,) = tables.read_sites(spark, str(tmp_path / "b.xlsx")).collect()
    assert (r.latitude, r.lfmc_percent, r.site_name, str(r.date)) == (34.1, 91.5, "Bitter", "2025-01-05 00:00:00")
    (tmp_path / "c.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="latitude"):
        tables.read_sites(spark, str(tmp_path / "c.csv"))
    assert tables.canonical_columns([" LAT ", "date", "Veg_Type"]) == {" LAT ": "latitude", "Veg_Type": "vegetation_type"}
    assert tables.canonical_columns(["vegetation", "lat", "veg_type", "latitude", "lng", "long", "other"]) == {"veg_type": "vegetation_type", "long": "longitude"}


def test_geojson(spark, tmp_path):
    point = lambda d, c: {"type": "Feature", "properties": {"DAMAGE": d}, "geometry": c and {"type": "Point", "coordinates": c}}
    (tmp_path / "d.json").write_text(json.dumps({"type": "FeatureCollection", "features": [point("No Damage", [-118.5, 34.0]), point("Destroyed (>50%)", [-118.4, 34.1]), point("?", [-118.4, 34.1]), point("No Damage", None), point(None, [0, 0])]}))
    got = sorted((r.ordinal, round(r.x)) for r in tables.read_structures(spark, str(tmp_path / "d.json")).collect())
    assert [g[0] for g in got] == [0, 4] and got[0][1] == 361472
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    (tmp_path / "p.json").write_text(json.dumps({"features": [{"properties": {"name": "a"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"properties": {"name": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}]}))
    got = tables.read_perimeters(spark, str(tmp_path / "p.json")).collect()
    assert sorted((r.properties["name"], r.part) for r in got) == [("a", 0), ("b", 0), ("b", 1)] and got[0].ring[1].x == 1


def test_catalog(spark, tmp_path):
    item = lambda i, t, a: {"id": i, "properties": {"datetime": t}, "bbox": [0, 0, 1, 1], "assets": a}
    for i, t, a in (("a", "2025-01-23T18:55:07Z", {"x": {"href": "h", "file:size": 1048576}, "y": {"href": "g", "size": 1048576}}), ("b", "2025-01-22", {"x": {"href": "h"}}), ("c", None, {})):
        (tmp_path / f"{i}.json").write_text(json.dumps(item(i, t, a)))
    df = tables.read_catalog(spark, str(tmp_path))
    assert {r.scene_id: r.mb for r in df.select("scene_id", catalog.size_mb(F.col("assets")).alias("mb")).collect()} == {"a": 2.0, "b": None, "c": None}
    assert [r.scene_id for r in catalog.between(df, "2025-01-01", "2025-01-23").collect()] == ["b"]
    known = catalog.known_scenes(spark)
    items = known.select("scene_id", "datetime")
    assert catalog.with_phases(items, known).count() == 8 and known.count() == 11
    days = spark.createDataFrame([(d,) for d in (-1, 0, 30, 31, 120, 121, 270, 271, 365, 366)], "d int")
    assert [r.p for r in days.select(catalog.phase(F.col("d")).alias("p")).collect()] == ["pre-fire", "post-fire", "post-fire", "early-recovery", "early-recovery", "mid-recovery", "mid-recovery", "late-recovery", "late-recovery", "other"]


def test_provenance(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "a.bin").write_bytes(b"abc")
    entry = lambda p, m, b=True: {"path": p, "checksum_md5": m, "bundled": b}
    manifest = {
        "artifacts": {"a": entry("data/a.bin", "900150983cd24fb0d6963f7d28e17f72"), "b": entry("data/a.bin", "00"), "c": entry("gone", "00"), "d": entry("data/a.bin", None), "e": entry("x", None, False) | {"provenance_status": "unverifiable"}},
        "claims": {"k1": {"backing_artifact": "a", "independence": "full"}, "k2": {"backing_artifact": "zzz"}, "k3": {"backing_artifact": "e"}, "k4": {"independence": "none"}, "k5": {"independence": "none", "synthetic": True}},
    }
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    artifacts, claims = provenance.load_manifest(spark, str(tmp_path / "m.json"))
    asked = spark.createDataFrame([(k,) for k in "abcdex"], "artifact_key string")
    files = provenance.file_checksums(spark, str(tmp_path))
    got = {r.artifact_key: r.status for r in provenance.verify_artifacts(artifacts, files, asked).collect()}
    assert got == {"a": "ok", "b": "mismatch", "c": "missing", "d": "no_checksum", "e": "not_bundled", "x": "unknown"}
    bare = spark.createDataFrame([("n", "gone", None, True), ("m", "gone", "", True)], "artifact_key string, path string, checksum_md5 string, bundled boolean")
    assert {r.status for r in provenance.verify_artifacts(bare, files).collect()} == {"no_checksum"}
    found = sorted((r.claim_key, r.severity) for r in provenance.audit_claims(claims, artifacts).collect())
    assert found == [("k2", "error"), ("k3", "warning"), ("k4", "error"), ("k4", "error")]
    assert provenance.claims_table(claims).first().markdown.count("\n") == 6
    df = spark.createDataFrame([(37.7, 4), (119.0, 4), (70.0, 13)], "m double, k int")
    assert [r.p for r in df.select(provenance.plausible_lfmc(F.col("m"), F.col("k")).alias("p")).collect()] == [False, True, False]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2025-01-{d:02d} {h:02d}:00:00", c, float(d * h)) for d in range(1, 6) for h in range(3) for c in "ab"]
    df = spark.createDataFrame(rows, "t string, cls string, v double").withColumn("t", F.to_timestamp("t"))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    got = sorted(map(tuple, trajectory.run_once(spark, str(tmp_path / "in"), "t", "cls", "v").collect()))
    want = sorted(map(tuple, trajectory.windowed(df, "t", "cls", "v").collect()))
    assert len(got) == len(want) == 10
    for g, w in zip(got, want):
        assert g[:3] == w[:3] and g[3:] == pytest.approx(w[3:])


def packed_lzw(data: bytes) -> bytes:
    """TIFF's LZW by the book: the longest known string each time, a clear code first and whenever the table is full."""
    out, table = [(256, 9)], {bytes([i]): i for i in range(256)}
    size, held = 258, b""
    for i in range(len(data)):
        longer = data[i : i + 1] if not held else held + data[i : i + 1]
        if longer in table:
            held = longer
            continue
        out.append((table[held], max(9, size.bit_length())))
        table[longer], size, held = size, size + 1, data[i : i + 1]
        if size == 4094:
            out.append((256, 12))
            table, size = {bytes([i]): i for i in range(256)}, 258
    if held:
        out.append((table[held], max(9, size.bit_length())))
        size += 1
    out.append((257, max(9, size.bit_length())))
    bits = "".join(f"{code:0{width}b}" for code, width in out)
    return bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))


@pytest.mark.parametrize("n", [0, 1, 300, 40_000])
@pytest.mark.parametrize("kinds", [2, 256])
def test_lzw(n, kinds):
    data = np.random.default_rng(n).integers(0, kinds, n).astype(np.uint8).tobytes()
    assert rasters.unpack_lzw(packed_lzw(data)) == data
    with pytest.raises(ValueError, match="LZW"):
        rasters.unpack_lzw(b"\x00\x00\x00")


def test_predictors():
    x = np.random.default_rng(3).normal(size=(4, 5, 2)).astype("<f4")
    differences = np.diff(x.astype(">f4").view(np.uint8).reshape(4, 10, 4).transpose(0, 2, 1).reshape(4, 20, 2), axis=1, prepend=np.zeros((4, 1, 2), np.uint8)).astype(np.uint8)
    assert np.array_equal(rasters._cells(differences.tobytes(), x.dtype, 3, 4, 5, 2), x)
    codes = np.random.default_rng(4).integers(0, 60_000, (4, 5, 2)).astype("<u2")
    steps = np.diff(codes, axis=1, prepend=np.zeros((4, 1, 2), "<u2")).astype("<u2")
    assert np.array_equal(rasters._cells(steps.tobytes(), codes.dtype, 2, 4, 5, 2), codes)


def test_bigtiff():
    values = np.arange(12, dtype="<u2").reshape(3, 4)
    strip = packed_lzw(values.tobytes())
    tags = [(256, 4, 4), (257, 4, 3), (258, 3, 16), (259, 3, 5), (273, 16, 16), (277, 3, 1), (278, 4, 3), (279, 16, len(strip)), (339, 3, 1)]
    entries = b"".join(struct.pack("<HHQQ", t, k, 1, v) for t, k, v in tags)
    at = 16 + len(strip)
    data = b"II+\0" + struct.pack("<HHQ", 8, 0, at) + strip + struct.pack("<Q", len(tags)) + entries + bytes(8)
    back, grid, _ = rasters.decode_geotiff(data)
    assert np.array_equal(back[0], values) and (grid.width, grid.height) == (4, 3)


def test_geotiff_of_bands_with_holes(spark, tmp_path):
    g = Grid(0.0, 90.0, 30.0, 3, 5, "EPSG:32611")
    df = spark.createDataFrame([(0, 0, 1.0, 2.0), (4, 2, 3.0, None), (9, 9, 7.0, 7.0)], "row int, col int, a double, b double")
    sinks.write_geotiff(df, ["a", "b"], g, str(tmp_path / "ab.tif"), strip_rows=2)
    back, grid, _ = rasters.decode_geotiff((tmp_path / "ab.tif").read_bytes())
    assert grid == g and back[0, 0, 0] == 1 and back[1, 0, 0] == 2 and back[0, 4, 2] == 3 and np.isfinite(back).sum() == 3
    assert rasters.grid_of_file(spark, str(tmp_path / "ab.tif"))[0] == g
    got = rasters.read_geotiff(spark, str(tmp_path / "ab.tif"), ("a", "b")).filter("a is not null").collect()
    assert sorted((r.row, r.col, r.a, r.b) for r in got) == [(0, 0, 1.0, 2.0), (4, 2, 3.0, None)]
