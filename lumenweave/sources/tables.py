"""Tables and vectors: field measurements (CSV, xlsx), structures and perimeters (GeoJSON), scene catalogs (JSON)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.functions.projection import to_utm, zone_of
from lumenweave.operators.accuracy import DAMAGE
from lumenweave.operators.catalog import parse_time

#: The names under which columns of field measurements come, by what they hold.
SITE_COLUMNS = {
    "latitude": ("latitude", "lat", "latitude (wgs84, epsg:4326)"),
    "longitude": ("longitude", "lon", "long", "lng", "longitude (wgs84, epsg:4326)"),
    "date": ("date", "observation_date", "sampling_date", "obs_date", "sampling date (yyyymmdd)"),
    "lfmc_percent": ("lfmc_percent", "lfmc", "lfmc_value", "lfmc_%", "live_fuel_moisture", "lfmc value (%)"),
    "species": ("species", "species_name", "scientific_name", "species collected"),
    "site_name": ("site_name", "site", "sitename", "location_name", "location", "site name"),
    "vegetation_type": ("vegetation_type", "veg_type", "vegetation", "land_cover", "vegetation_class", "species functional type", "igbp land cover"),
}
SITE_SHEET = "LFMC data"


def canonical_columns(names: list[str]) -> dict[str, str]:
    """What columns are renamed to. Of several columns for one canonical name the alias that is listed first wins; case and margins are ignored."""
    places = {alias: (rank, canonical) for canonical, aliases in SITE_COLUMNS.items() for rank, alias in enumerate(aliases)}
    best: dict[str, tuple[int, str]] = {}
    for name in names:
        rank, canonical = places.get(name.strip().lower(), (0, ""))
        if canonical:
            best[canonical] = min(best.get(canonical, (len(places), "")), (rank, name))
    return {name: canonical for canonical, (_, name) in best.items() if name != canonical}


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """Field measurements with canonical columns and types; rows whose place, date or value can't be read are dropped."""
    raw = read_xlsx(spark, path, SITE_SHEET) if path.lower().endswith(".xlsx") else spark.read.option("header", True).option("multiLine", True).csv(path)
    df = raw.withColumnsRenamed(canonical_columns(raw.columns))
    missing = [c for c in ("latitude", "longitude", "date", "lfmc_percent") if c not in df.columns]
    if missing:
        raise ValueError(f"no column for {missing}")
    day = F.coalesce(parse_time(F.col("date")), F.try_to_timestamp("date", F.lit("yyyyMMdd")))
    typed = df.withColumns({c: F.col(c).try_cast("double") for c in ("latitude", "longitude", "lfmc_percent")} | {"date": day})
    return typed.na.drop(subset=["latitude", "longitude", "date", "lfmc_percent"])


def sheet_rows(content: bytes, sheet: str) -> list[list[str | None]]:
    """The cells of a named sheet (else the first) as text."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        sheets = ElementTree.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", ns)
        chosen = next((s for s in sheets if s.get("name") == sheet), sheets[0])
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = targets[chosen.get(f"{{{ns['r']}}}id")].lstrip("/")
        root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
    out = []
    for row in root.iter(f"{{{ns['m']}}}row"):
        cells: list[str | None] = []
        for c in row.findall("m:c", ns):
            letters = "".join(ch for ch in c.get("r", "") if ch.isalpha())
            col = 0
            for ch in letters:
                col = col * 26 + ord(ch) - 64
            cells += [None] * (max(col, len(cells) + 1) - 1 - len(cells))
            v, inline = c.find("m:v", ns), c.find("m:is", ns)
            text = "".join(t.text or "" for t in inline.iter(f"{{{ns['m']}}}t")) if inline is not None else v.text if v is not None else None
            cells.append(shared[int(text)] if c.get("t") == "s" and text is not None else text)
        out.append(cells)
    return out


def read_xlsx(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """A sheet as text columns named by its first row."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = sheet_rows(content, sheet)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))], names=["n", "cells"])

    rows = files.mapInArrow(run, "n long, cells array<string>")
    head = rows.filter("n = 0").first()
    if head is None:
        raise ValueError(f"no rows in {path}")
    return rows.filter("n > 0").select(*[F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(head.cells) if name])


def read_structures(spark: SparkSession, path: str, epsg: int = 32611, damage: str = "DAMAGE") -> DataFrame:
    """(properties..., damage, ordinal, lon, lat, x, y) of a GeoJSON file of points in WGS84; unknown categories are dropped."""
    zone_of(epsg)
    schema = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:array<double>>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    table = F.create_map(*[F.lit(x) for kv in zip(DAMAGE, range(len(DAMAGE))) for x in kv])
    named = F.try_element_at(F.col("f.properties"), F.lit(damage))
    held = f.filter(F.col("f.geometry.coordinates").isNotNull() & named.isNotNull()).select(
        F.col("f.properties").alias("properties"), named.alias("damage"), F.try_element_at(table, named).alias("ordinal"), F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat")
    )
    x, y = to_utm(F.col("lon"), F.col("lat"), epsg)
    return held.filter(F.col("ordinal").isNotNull()).withColumns({"x": x, "y": y})


def read_perimeters(spark: SparkSession, path: str) -> DataFrame:
    """(properties, part, ring) of polygons and multipolygons of a GeoJSON file; ring is an array of (x, y)."""
    schema = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f")).filter(F.col("f.geometry").isNotNull())
    text = F.col("f.geometry.coordinates")
    polygons = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json(text, "array<array<array<double>>>"))).otherwise(F.from_json(text, "array<array<array<array<double>>>>"))
    rings = f.select(F.col("f.properties").alias("properties"), F.posexplode(F.flatten(polygons)).alias("part", "r"))
    return rings.select("properties", "part", F.transform("r", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("ring"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(scene_id, datetime, bbox, assets) of item files of a static catalog, one JSON document a file."""
    schema = "id string, properties struct<datetime:string>, bbox array<double>, assets map<string,struct<href:string,size:bigint,`file:size`:bigint>>"
    raw = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    assets = F.transform_values("assets", lambda k, a: F.struct(a["href"].alias("href"), F.coalesce(a["file:size"], a["size"]).alias("size")))
    return raw.filter(F.col("id").isNotNull()).select(F.col("id").alias("scene_id"), parse_time(F.col("properties.datetime")).alias("datetime"), "bbox", assets.alias("assets"))
