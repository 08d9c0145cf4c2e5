"""Rasters: scenes as Parquet, GeoTIFF read and written without other libraries, class and fraction rasters.

Files are read through Spark's ``binaryFile`` and parsed on the executors, a file at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.functions.bands import ALIASES, Bands, at
from lumenweave.functions.missing import to_null
from lumenweave.operators.grid import Grid, align_classes, coarsen, coarsening_factor
from lumenweave.operators.severity import remap_codes

#: Names of fraction bands in other products.
FRACTION_NAMES = {
    "char": "char", "burn": "char", "burned": "char", "ash": "char", "pv": "pv", "gv": "pv", "vegetation": "pv", "green_vegetation": "pv", "npv": "npv",
    "non_photosynthetic_vegetation": "npv", "litter": "npv", "soil": "soil", "bare_soil": "soil", "rock": "soil", "shade": "shade", "shadow": "shade",
}
FRACTION_ORDER = ("char", "pv", "npv", "soil", "shade")


# --- Parquet scenes


def write_scene(df: DataFrame, path: str, bands: Bands, spectrum: str = "spectrum", tile: int = 256) -> None:
    """Pixels by scene and tile of rows, with the named bands as columns of their own: Parquet prunes columns, not array entries."""
    named = {f"b_{n.lower()}": at(F.col(spectrum), bands.nearest(w)) for n, w in ALIASES.items()}
    df.withColumns(named | {"tile": F.expr(f"cast(row div {tile} as int)")}).write.mode("overwrite").partitionBy("scene_id", "tile").parquet(path)


def read_scene(spark: SparkSession, path: str, names: Sequence[str] | None = None, rows: tuple[int, int] | None = None, tile: int = 256) -> DataFrame:
    """Pixels of a written scene: only the columns of the given bands, only the tiles of the given rows."""
    df = spark.read.parquet(path)
    if rows is not None:
        df = df.filter(F.col("tile").between(rows[0] // tile, (rows[1] - 1) // tile) & F.col("row").between(rows[0], rows[1] - 1))
    return df if names is None else df.select("scene_id", "row", "col", *[f"b_{n.lower()}" for n in names])


# --- GeoTIFF

_KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d", 16: "Q"}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 11: 4, 12: 8, 16: 8}


def encode_geotiff(bands: np.ndarray, grid: Grid, nodata: float | None = None, strip_rows: int = 64) -> bytes:
    """A GeoTIFF (deflate, planar bands, strips) of an array (bands, rows, columns) of float32, int16 or uint8."""
    n, h, _ = bands.shape
    little = bands.astype(bands.dtype.newbyteorder("<"))
    strips = [zlib.compress(little[b, r : r + strip_rows].tobytes(), 6) for b in range(n) for r in range(0, h, strip_rows)]
    return geotiff_of_strips(strips, n, bands.dtype, grid, nodata, strip_rows)


def geotiff_of_strips(strips: Sequence[bytes], n: int, dtype: np.dtype, grid: Grid, nodata: float | None = None, strip_rows: int = 64) -> bytes:
    """The file of deflated strips, those of the first of ``n`` bands first."""
    fmt = {"f": 3, "i": 2, "u": 1}[dtype.kind]
    epsg = int(grid.crs.rpartition(":")[2]) if grid.crs else 32767
    keys = (1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg)
    offsets, at_ = [], 8
    for s in strips:
        offsets.append(at_)
        at_ += len(s)
    tags: list[tuple[int, int, tuple | bytes]] = [
        (256, 4, (grid.width,)), (257, 4, (grid.height,)), (258, 3, (dtype.itemsize * 8,) * n), (259, 3, (8,)), (262, 3, (1,)), (273, 4, tuple(offsets)), (277, 3, (n,)), (278, 4, (strip_rows,)), (279, 4, tuple(map(len, strips))), (284, 3, (2 if n > 1 else 1,)), (339, 3, (fmt,) * n),
        (33550, 12, (grid.size, grid.size, 0.0)), (33922, 12, (0.0, 0.0, 0.0, grid.west, grid.north, 0.0)), (34735, 3, keys),
    ]
    if nodata is not None:
        tags.append((42113, 2, f"{nodata:g}\0".encode()))
    ifd = at_ + at_ % 2
    extra_at, entries, extra = ifd + 2 + 12 * len(tags) + 4, b"", b""
    for tag, kind, value in tags:
        raw = value if isinstance(value, bytes) else struct.pack(f"<{len(value)}{_KINDS[kind]}", *value)
        field = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", extra_at + len(extra))
        extra += b"" if len(raw) <= 4 else raw + b"\0" * (len(raw) % 2)
        entries += struct.pack("<HHI", tag, kind, len(value)) + field
    return b"II*\0" + struct.pack("<I", ifd) + b"".join(strips) + b"\0" * (at_ % 2) + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + extra


def geotiff_tags(data: bytes) -> tuple[str, dict[int, tuple | bytes]]:
    """Byte order and tags of the first image of a TIFF or BigTIFF file."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    version = struct.unpack(order + "H", data[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    word, count, head = ("I", "H", 2) if version == 42 else ("Q", "Q", 8)
    room = struct.calcsize(order + word)
    (ifd,) = struct.unpack(order + word, data[8:16] if version == 43 else data[4:8])
    tags: dict[int, tuple | bytes] = {}
    for i in range(struct.unpack(order + count, data[ifd : ifd + head])[0]):
        p = ifd + head + (4 + 2 * room) * i
        tag, kind = struct.unpack(order + "HH", data[p : p + 4])
        (n,) = struct.unpack(order + word, data[p + 4 : p + 4 + room])
        size, where = _SIZES.get(kind, 1) * n, p + 4 + room
        if size > room:
            (where,) = struct.unpack(order + word, data[where : where + room])
        raw = data[where : where + size]
        tags[tag] = raw if kind not in _KINDS or kind == 2 else struct.unpack(order + f"{n * len(_KINDS[kind])}{_KINDS[kind][0]}", raw)
    return order, tags


def geotiff_grid(tags: Mapping[int, tuple | bytes]) -> tuple[Grid, float | None]:
    """Grid and nodata by a GeoTIFF's tags."""
    scale, tie = tags.get(33550, (1.0, 1.0, 0.0)), tags.get(33922, (0.0,) * 6)
    keys = tags.get(34735, ())
    epsg = next((keys[i + 3] for i in range(4, len(keys), 4) if keys[i] in (3072, 2048)), None)
    nodata = float(bytes(tags[42113]).rstrip(b"\0 ")) if 42113 in tags else None
    return Grid(tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], tags[256][0], tags[257][0], f"EPSG:{epsg}" if epsg else None), nodata


def unpack_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, the highest bit first, 256 to begin anew and 257 at the end."""
    table: list[bytes] = []
    out, held, bits, width, last = [], 0, 0, 9, b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code > len(table) or (code == len(table) and not last):
            raise ValueError("broken LZW data")
        found = table[code] if code < len(table) else last + last[:1]
        out.append(found)
        if last:
            table.append(last + found[:1])
            # The writer widens its codes one entry before its table is full.
            width = min(12, max(9, (len(table) + 1).bit_length()))
        last = found
    return b"".join(out)


def _cells(raw: bytes, dtype: np.dtype, predictor: int, rows: int, cols: int, per_cell: int) -> np.ndarray:
    """(rows, cols, values) of an unpacked strip or tile: differences along rows are summed up again."""
    if predictor == 3:
        # Bytes of a row stand by significance, the highest first, as differences.
        planes = np.frombuffer(raw, np.uint8)[: rows * cols * per_cell * dtype.itemsize].reshape(rows, -1, per_cell)
        planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, cols * per_cell)
        return np.ascontiguousarray(np.moveaxis(planes, 1, 2)).view(dtype.newbyteorder(">")).reshape(rows, cols, per_cell)
    cell = np.frombuffer(raw, dtype)[: rows * cols * per_cell].reshape(rows, cols, per_cell)
    return np.cumsum(cell, axis=1, dtype=dtype) if predictor == 2 else cell


def decode_geotiff(data: bytes) -> tuple[np.ndarray, Grid, float | None]:
    """(bands, rows, columns), grid and nodata of a striped or tiled GeoTIFF or BigTIFF: raw, deflated or LZW, with any predictor."""
    order, tags = geotiff_tags(data)
    one = lambda t, default=None: tags[t][0] if t in tags else default
    w, h, n, packing, predictor = one(256), one(257), one(277, 1), one(259, 1), one(317, 1)
    unpack = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress}.get(packing)
    if unpack is None or predictor not in (1, 2, 3):
        raise ValueError(f"unknown compression {packing} or predictor {predictor}")
    dtype = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[one(339, 1)] }{one(258, 8) // 8}".replace(" ", ""))
    planar = one(284, 1) == 2
    tiled = 322 in tags
    bw, bh = (one(322), one(323)) if tiled else (w, min(one(278, h), h))
    offsets, counts = tags[324 if tiled else 273], tags[325 if tiled else 279]
    across, down = -(-w // bw), -(-h // bh)
    out = np.zeros((n, h, w), dtype)
    for k, (o, c) in enumerate(zip(offsets, counts)):
        b, k = divmod(k, across * down) if planar else (None, k)
        r, q = k // across * bh, k % across * bw
        rows = bh if tiled else min(bh, h - r)
        cell = _cells(unpack(data[o : o + c]), dtype, predictor, rows, bw, 1 if planar else n)[: h - r, : w - q]
        if planar:
            out[b, r : r + rows, q : q + bw] = cell[:, :, 0]
        else:
            out[:, r : r + rows, q : q + bw] = np.moveaxis(cell, 2, 0)
    return out, *geotiff_grid(tags)


def read_geotiff(spark: SparkSession, path: str, names: Sequence[str] = ("value",)) -> DataFrame:
    """(path, row, col, y, x, one column a band) of GeoTIFF files; nodata and NaN are NULL. A batch is a stretch of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data, g, nodata = decode_geotiff(content)
                for r in range(0, g.height, max(1, 200_000 // max(1, g.width))):
                    some = data[:, r : r + max(1, 200_000 // max(1, g.width))]
                    rows, cols = np.divmod(np.arange(some.shape[1] * g.width), g.width)
                    values = [np.where(v.ravel() == nodata, np.nan, v.ravel().astype(float)) if nodata is not None else v.ravel().astype(float) for v in some[: len(names)]]
                    y, x = g.north - (rows + r + 0.5) * g.size, g.west + (cols + 0.5) * g.size
                    yield pa.RecordBatch.from_arrays([pa.array([where] * len(rows)), pa.array((rows + r).astype(np.int32)), pa.array(cols.astype(np.int32)), pa.array(y), pa.array(x), *[pa.array(v, from_pandas=True) for v in values]], names=["path", "row", "col", "y", "x", *names])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, row int, col int, y double, x double, " + ", ".join(f"{n} double" for n in names))


def grid_of_file(spark: SparkSession, path: str) -> tuple[Grid, float | None]:
    """Grid and nodata of one GeoTIFF file: its tags are read in a task, so no pixel is decoded or sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                g, nodata = geotiff_grid(geotiff_tags(content)[1])
                yield pa.RecordBatch.from_pylist([{"west": g.west, "north": g.north, "size": g.size, "width": g.width, "height": g.height, "crs": g.crs, "nodata": nodata}], schema=fields)

    fields = pa.schema([("west", pa.float64()), ("north", pa.float64()), ("size", pa.float64()), ("width", pa.int32()), ("height", pa.int32()), ("crs", pa.string()), ("nodata", pa.float64())])
    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "west double, north double, size double, width int, height int, crs string, nodata double").first()
    if found is None:
        raise FileNotFoundError(path)
    return Grid(*found[:6]), found.nodata


def read_classes(spark: SparkSession, path: str, code_map: Mapping[int, int] | None = None, target: Grid | None = None, strict: bool = True) -> DataFrame:
    """(row, col, code) of a class raster with harmonized codes, -1 where there is none, on the target's cells if given."""
    grid, _ = grid_of_file(spark, path)
    coded = remap_codes(read_geotiff(spark, path, ("code",)).select("row", "col", "code"), "code", code_map, strict)
    return coded if target is None or target == grid else align_classes(coded, grid, target)


def read_fractions(spark: SparkSession, path: str, names: Sequence[str] | int, resolution: float = 30.0) -> tuple[DataFrame, Grid]:
    """(row, col, canonical fractions) of a fraction raster, coarsened to about ``resolution``, and its grid."""
    grid, _ = grid_of_file(spark, path)
    columns = fraction_columns(names)
    f = coarsening_factor(grid.size, resolution)
    df = read_geotiff(spark, path, columns)
    if f == 1:
        return df.select("row", "col", *columns), grid
    return coarsen(df, columns, f, f, grid.height, grid.width), Grid(grid.west, grid.north, grid.size * f, grid.width // f, grid.height // f, grid.crs)


def fraction_columns(names: Sequence[str] | int) -> list[str]:
    """Canonical names of a fraction product's bands, by alias; four or more unnamed ones in the usual order."""
    if isinstance(names, int):
        if names < 4:
            raise ValueError(f"{names} unnamed bands")
        return list(FRACTION_ORDER[:names])
    found = [FRACTION_NAMES.get(n.strip().lower()) for n in names]
    if not any(found):
        raise ValueError(f"no fraction among {list(names)}")
    return [f or n for f, n in zip(found, names)]


# --- grids of HDF5 scenes


def assignments(text: str) -> dict[str, list[str]]:
    """The ``name = value`` lines of metadata text, the first of each name; a list in parentheses gives several values."""
    found: dict[str, list[str]] = {}
    for line in text.splitlines():
        name, equals, value = line.partition("=")
        if equals:
            found.setdefault(name.strip(), [v.strip().strip('"') for v in value.strip().strip("()").split(",")])
    return found


def parse_grid_metadata(text: str) -> dict:
    """Dimensions, corners, zone, origin and projection of a grid's metadata text; an error without dimensions and corners."""
    held = assignments(text)

    def named(name: str, *kinds: type):
        values = held.get(name)
        return tuple(k(v) for k, v in zip(kinds, values, strict=True)) if values else (None,) * len(kinds)

    (width,), (height,), (zone,) = named("XDim", int), named("YDim", int), named("ZoneCode", int)
    west_north, east_south = named("UpperLeftPointMtrs", float, float), named("LowerRightMtrs", float, float)
    absent = [k for k, v in (("x_dim", width), ("y_dim", height), ("upper_left", west_north[0]), ("lower_right", east_south[0])) if v is None]
    if absent:
        raise ValueError(f"grid metadata lack {', '.join(absent)}")
    return {"x_dim": width, "y_dim": height, "zone": zone, "upper_left": west_north, "lower_right": east_south, "origin": named("GridOrigin", str)[0], "projection": named("Projection", str)[0]}


def grid_of_metadata(meta: Mapping) -> Grid:
    (ulx, uly), (lrx, _) = meta["upper_left"], meta["lower_right"]
    zone = meta.get("zone")
    return Grid(ulx, uly, (lrx - ulx) / meta["x_dim"], meta["x_dim"], meta["y_dim"], f"EPSG:{32600 + zone}" if zone and zone > 0 else None)


def from_fill(df: DataFrame, columns: Sequence[str], fill: float = -9999.0) -> DataFrame:
    """NULL for fill values, NaN and infinities."""
    return df.withColumns({c: to_null(F.col(c), fill) for c in columns})
