"""Writers: products as Parquet and GeoTIFF, quicklooks as PNG, comparisons as CSV, results as JSON, reports as markdown."""

from __future__ import annotations

import json
import struct
import time
import zlib
from collections.abc import Callable, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.operators.aggregates import quicklook_range
from lumenweave.operators.display import STYLES, thumbnail
from lumenweave.operators.grid import Grid
from lumenweave.sources.rasters import geotiff_of_strips


def write_product(df: DataFrame, path: str) -> None:
    """(scene_id, product, row, col, value) as Parquet by scene and product."""
    df.write.mode("overwrite").partitionBy("scene_id", "product").parquet(path)


def collect_raster(df: DataFrame, value: str, rows: int, cols: int) -> np.ndarray:
    """One product's raster on the driver, NaN where it is missing. For rasters that are drawn or written whole."""
    out = np.full((rows, cols), np.nan, np.float32)
    t = df.select("row", "col", F.col(value).cast("float").alias("v")).toArrow()
    out[t["row"].to_numpy(), t["col"].to_numpy()] = t["v"].to_numpy()
    return out


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """One file, in any store that Spark can write."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        for at in range(0, len(data), 1 << 24):
            out.write(bytearray(data[at : at + (1 << 24)]))
    finally:
        out.close()


def write_geotiff(df: DataFrame, value: str | Sequence[str], grid: Grid, path: str, strip_rows: int = 64) -> None:
    """One product, or several as bands, as a deflated float32 GeoTIFF; cells without a row or value are NaN.

    Strips are filled and deflated in tasks, of which each holds one at a time; the driver sees deflated strips only.
    """
    names = [value] if isinstance(value, str) else list(value)
    down, width = -(-grid.height // strip_rows), grid.width

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        strip = int(rows["strip"].iloc[0])
        cells = np.full((len(names), min(strip_rows, grid.height - strip * strip_rows), width), np.nan, "<f4")
        for b in range(len(names)):
            cells[b, rows["row"] - strip * strip_rows, rows["col"]] = rows[f"v{b}"]
        return pd.DataFrame({"strip": strip, "band": range(len(names)), "data": [zlib.compress(c.tobytes(), 6) for c in cells]})

    inside = F.col("row").between(0, grid.height - 1) & F.col("col").between(0, width - 1)
    columns = [F.col(c).cast("float").alias(f"v{b}") for b, c in enumerate(names)]
    cells = df.filter(inside).select(F.expr(f"cast(row div {strip_rows} as int)").alias("strip"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *columns)
    found = {(r.band, r.strip): bytes(r.data) for r in cells.groupBy("strip").applyInPandas(run, "strip int, band int, data binary").toLocalIterator()}
    blank = lambda s: zlib.compress(np.full((min(strip_rows, grid.height - s * strip_rows), width), np.nan, "<f4").tobytes(), 6)
    strips = [found.get((b, s)) or blank(s) for b in range(len(names)) for s in range(down)]
    put(df.sparkSession, path, geotiff_of_strips(strips, len(names), np.dtype("<f4"), grid, float("nan"), strip_rows))


def png(grey: np.ndarray) -> bytes:
    """An 8-bit grey PNG."""
    h, w = grey.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + row.tobytes() for row in grey.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def write_quicklook(df: DataFrame, value: str, rows: int, cols: int, path: str, most: int = 512) -> None:
    """A quicklook stretched between the product's 2nd and 98th percentile, at most ``most`` cells a side."""
    low, high = quicklook_range(df, value).first()
    f = max(1, -(-max(rows, cols) // most))
    raster = collect_raster(thumbnail(df, value, rows, cols, most), value, -(-rows // f), -(-cols // f))
    scaled = np.clip((raster - (low or 0)) / max((high or 0) - (low or 0), 1e-6), 0, 1)
    put(df.sparkSession, path, png(np.nan_to_num(scaled) * 255))


def write_comparison(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # a handful of metrics


def write_results(results: dict, path: str) -> None:
    Path(path).write_text(json.dumps(results, indent=2, default=str))


def stage(log: list[dict], name: str) -> Callable:
    """Run a step, noting its time and, if it fails, its error; failures become rows of the report."""

    def wrap(fn: Callable) -> Callable:
        def run(*args, **kwargs):
            began, row = time.perf_counter(), {"stage": name, "status": "ok", "seconds": 0.0, "detail": ""}
            try:
                return fn(*args, **kwargs)
            except Exception as e:  # noqa: BLE001
                row |= {"status": "error", "detail": f"{type(e).__name__}: {e}"}
                return None
            finally:
                row["seconds"] = round(time.perf_counter() - began, 3)
                log.append(row)

        return run

    return wrap


def report(log: list[dict]) -> str:
    """The stages as a markdown table."""
    lines = [f"| {r['stage']} | {r['status']} | {r['seconds']:.1f} | {r['detail']} |" for r in log]
    return "\n".join(["| stage | status | seconds | detail |", "|---|---|---|---|", *lines])


def style_of(product: str):
    """How a product is shown; an unknown one is an error."""
    if product not in STYLES:
        raise KeyError(product)
    return STYLES[product]
