"""Spectral cubes in HDF5 and NetCDF-4 files: gridded scenes, swaths, airborne reflectance. Needs h5py on the executors.

The parsing works on any mapping of paths to arrays with ``attrs`` (an h5py file is one), block by block of rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumenweave.functions.bands import Bands
from lumenweave.functions.kernels import block_of_spectra
from lumenweave.sources.rasters import grid_of_metadata, parse_grid_metadata

#: Where cubes, quality fields, wavelengths and positions are found, in order of preference.
GRID_FIELDS, SWATH_FIELDS, SWATH_META, SWATH_PLACES = "HDFEOS/GRIDS/HYP/Data Fields", "HDFEOS/SWATHS/HYP/Data Fields", "HDFEOS/SWATHS/HYP/Metadata", "HDFEOS/SWATHS/HYP/Geolocation Fields"
FIELD_FOLDERS = (GRID_FIELDS, SWATH_FIELDS, SWATH_META, "Metadata", "")
GRID_TEXT = "HDFEOS INFORMATION/StructMetadata.0"
AIRBORNE_CUBES = ("reflectance/reflectance", "reflectance", "rfl", "Rfl", "surface_reflectance")
AIRBORNE_WAVELENGTHS = ("reflectance/wavelength", "sensor_band_parameters/wavelengths", "wavelength", "wavelengths", "bands")
FILLS = (-9999.0, -999.0)
SCHEMA = "path string, row int, col int, y double, x double, spectrum array<double>, cirrus byte, cloud byte"


def find_field(f, name: str):
    """A field by the usual folders, or None."""
    for folder in FIELD_FOLDERS:
        path = f"{folder}/{name}" if folder else name
        if path in f:
            return f[path]
    return None


def _attribute(x, names: Sequence[str], default=None):
    return next((np.asarray(x.attrs[n]) for n in names if n in x.attrs), default)


def bands_of(f) -> Bands:
    """Wavelengths, widths and good flags of a scene's cube; wavelengths are required."""
    cube = find_field(f, "surface_reflectance")
    cube = find_field(f, "toa_radiance") if cube is None else cube
    if cube is None:
        raise ValueError("no cube in the file")
    w = _attribute(cube, ("wavelengths",))
    if w is None:
        raise ValueError("the cube has no wavelengths")
    fwhm, good = _attribute(cube, ("fwhm",)), _attribute(cube, ("good_wavelengths",))
    return Bands(tuple(map(float, w)), None if fwhm is None else tuple(map(float, fwhm)), None if good is None else tuple(bool(g) for g in good))


def _covering(w: np.ndarray, low: float | None, high: float | None) -> slice:
    keep = np.flatnonzero((w >= (-np.inf if low is None else low)) & (w <= (np.inf if high is None else high)))
    if not len(keep):
        raise ValueError(f"no band between {low} and {high} nm")
    return slice(int(keep[0]), int(keep[-1]) + 1)


def _batch(where: str, start: int, cube: np.ndarray, y: np.ndarray, x: np.ndarray, flags: Sequence) -> pa.RecordBatch:
    """A batch of a block (bands, rows, columns) with its positions (rows x columns) and quality fields."""
    rows, cols = cube.shape[1:]
    r, c = np.divmod(np.arange(rows * cols), cols)
    held = [pa.nulls(rows * cols, pa.int8()) if q is None else pa.array(np.asarray(q).ravel().astype(np.int8)) for q in flags]
    spectra = block_of_spectra(cube.reshape(len(cube), -1).T)
    return pa.RecordBatch.from_arrays(
        [pa.array([where] * (rows * cols)), pa.array((r + start).astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(y.ravel().astype(float), from_pandas=True), pa.array(x.ravel().astype(float), from_pandas=True), spectra, *held],
        names=["path", "row", "col", "y", "x", "spectrum", "cirrus", "cloud"],
    )


def scene_blocks(f, where: str, low: float | None = None, high: float | None = None, block_rows: int = 64) -> Iterator[pa.RecordBatch]:
    """Pixels of a gridded scene (x, y in metres) or, where there is no grid, of a swath (x, y in degrees).

    Only the contiguous bands that cover the range are read.
    """
    bands = bands_of(f)
    gridded = f"{GRID_FIELDS}/surface_reflectance" in f
    cube = find_field(f, "surface_reflectance" if gridded else "toa_radiance")
    cube = find_field(f, "surface_reflectance") if cube is None else cube
    some = _covering(np.array(bands.wavelengths), low, high)
    fill = float(np.ravel(_attribute(cube, ("_FillValue",), -9999.0))[0])
    if gridded:
        text = f[GRID_TEXT][()]
        grid = grid_of_metadata(parse_grid_metadata(text.decode() if isinstance(text, bytes) else str(text)))
        height, width = grid.height, grid.width
    else:
        lat, lon = (f.get(f"{SWATH_PLACES}/{n}") if hasattr(f, "get") else None for n in ("Latitude", "Longitude"))
        if lat is None or lon is None:
            raise ValueError("the swath has no positions")
        height, width = cube.shape[1:]
    quality = [find_field(f, n) for n in ("beta_cirrus_mask", "beta_cloud_mask")]
    quality = [q if q is not None and tuple(q.shape) == (height, width) else None for q in quality]
    for r in range(0, height, block_rows):
        block = np.asarray(cube[some, r : r + block_rows], float)
        block = np.where((block == fill) | ~np.isfinite(block), np.nan, block)
        n = block.shape[1]
        if gridded:
            y = np.repeat(grid.north - (np.arange(r, r + n) + 0.5) * grid.size, width)
            x = np.tile(grid.west + (np.arange(width) + 0.5) * grid.size, n)
        else:
            y, x = np.asarray(lat[r : r + block_rows]), np.asarray(lon[r : r + block_rows])
        yield _batch(where, r, block, y, x, [None if q is None else q[r : r + block_rows] for q in quality])


def airborne_blocks(f, where: str, low: float | None = None, high: float | None = None, block_rows: int = 64) -> Iterator[pa.RecordBatch]:
    """Pixels of an airborne cube with easting and northing axes; bands may be its first or last axis."""
    cube = next((f[n] for n in AIRBORNE_CUBES if n in f and len(getattr(f[n], "shape", ())) == 3), None)
    w = next((np.asarray(f[n][()], float) for n in AIRBORNE_WAVELENGTHS if n in f and len(getattr(f[n], "shape", ())) == 1), None)
    if cube is None or w is None:
        raise ValueError("no reflectance cube or no wavelengths")
    w = w * 1000 if w.max() < 50 else w
    some, first = _covering(w, low, high), cube.shape[0] == len(w)
    if not first and cube.shape[2] != len(w):
        raise ValueError(f"no axis of {tuple(cube.shape)} has {len(w)} bands")
    height, width = cube.shape[1:] if first else cube.shape[:2]
    axis = lambda names, n: next((np.asarray(f[k][()], float) for k in names if k in f), np.arange(n, dtype=float))
    ys, xs = axis(("northing", "y", "lat"), height), axis(("easting", "x", "lon"), width)
    for r in range(0, height, block_rows):
        block = np.asarray(cube[some, r : r + block_rows] if first else cube[r : r + block_rows, :, some], float)
        block = block if first else np.moveaxis(block, 2, 0)
        block = np.where(np.isin(block, FILLS) | ~np.isfinite(block), np.nan, block)
        n = block.shape[1]
        yield _batch(where, r, block, np.repeat(ys[r : r + n], width), np.tile(xs, n), (None, None))


def _read(spark: SparkSession, path: str, blocks, low: float | None, high: float | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import h5py

        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with h5py.File(io.BytesIO(content), "r") as f:
                    yield from blocks(f, where, low, high)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def read_scenes(spark: SparkSession, path: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Pixels of scene files, gridded or swath, NULL for fill values."""
    return _read(spark, path, scene_blocks, low, high)


def read_airborne(spark: SparkSession, path: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Pixels of airborne reflectance files."""
    return _read(spark, path, airborne_blocks, low, high)


def read_bands(spark: SparkSession, path: str) -> Bands:
    """The band table of the first scene file at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import h5py

        for batch in batches:
            for content in batch.column(0).to_pylist():
                with h5py.File(io.BytesIO(content), "r") as f:
                    b = bands_of(f)
                kinds = (pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.bool_()))
                yield pa.RecordBatch.from_arrays([pa.array([None if v is None else list(v)], t) for v, t in zip((b.wavelengths, b.fwhm, b.good), kinds)], names=["w", "fwhm", "good"])

    r = spark.read.format("binaryFile").load(path).select("content").limit(1).mapInArrow(run, "w array<double>, fwhm array<double>, good array<boolean>").first()
    return Bands(tuple(r.w), None if r.fwhm is None else tuple(r.fwhm), None if r.good is None else tuple(r.good))
