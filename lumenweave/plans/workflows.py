"""Chains of operators that belong together: products of scenes, severity with ground truth, cross-sensor validation.

Everything stays lazy until a result is asked for; scenes are rows of one table, so no step loops over them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweave.functions.bands import Bands, WATER_ZONES, sensor
from lumenweave.operators import accuracy, aggregates, grid, hull, indices, library, masks, severity, unmix
from lumenweave.operators.grid import Grid


def scene_products(pixels: DataFrame, bands: Bands, depths: bool = True) -> DataFrame:
    """Masked pixels with nbr, ndvi, ndwi, the water indices and, if asked for, absorption depths; one scan for all."""
    s = F.col("spectrum")
    flags = [c for c in ("cirrus", "cloud") if c in pixels.columns]
    keep = [masks.nodata_mask(s), masks.cloud_mask(*[F.col(c) for c in flags]), masks.water_mask(s, bands)]
    held = masks.apply_masks(pixels, keep)
    named = {"nbr": indices.nbr(s, bands), "ndvi": indices.ndvi(s, bands), "ndwi": indices.ndwi(s, bands)} | indices.water_indices(s, bands)
    out = held.withColumns(named)
    return hull.depths(out, bands) if depths else out


def fractions_by_scene_library(pixels: DataFrame, bands: Bands, n_bands: int = 10, least: int = 50, constraints: unmix.Constraints = unmix.Constraints()) -> DataFrame:
    """Fractions of a scene by the mean spectra of its own heuristic classes, on its most separating bands, without shade.

    The class means (a handful of spectra) are made by one aggregation over the scene and then travel to its pixels.
    """
    s = F.col("spectrum")
    classed = pixels.withColumn("cls", masks.heuristic_classes(indices.nbr(s, bands), indices.ndvi(s, bands), indices.ndwi(s, bands))).filter(F.col("cls").isNotNull() & masks.nodata_mask(s))
    means = aggregates.mean_spectra(classed, "cls", least=least, least_groups=2)
    own = means.select(F.concat(F.lit("own_"), "cls").alias("spectrum_id"), F.col("cls").alias("name"), F.col("cls").alias("category"), F.lit("scene").alias("source"), "spectrum")
    return _unmix_on(pixels, bands, own, bands, n_bands, constraints)


def _unmix_on(pixels: DataFrame, bands: Bands, lib: DataFrame, lib_bands: Bands, n_bands: int | None, constraints: unmix.Constraints, engine: str = "mesma") -> DataFrame:
    chosen = library.pick_bands(lib, len(lib_bands), n_bands) if n_bands else list(range(len(lib_bands)))
    some = lib.withColumn("spectrum", F.transform(F.array(*[F.lit(i) for i in chosen]), lambda i: F.get("spectrum", i)))
    at = unmix.nearest_library_bands(bands, lib_bands.take(chosen))
    others = sorted({r.category for r in some.select("category").distinct().collect()} - set(indices.CANONICAL))
    return indices.normalize_fractions(unmix.unmix(pixels, some, engine, constraints, positions=at), extras=others)


def severity_with_truth(products: DataFrame, truth: DataFrame, thresholds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pixels with their class by calibrated nbr thresholds, agreement with the truth) of rasters on one grid.

    ``truth`` is (row, col, code). The calibration has one row a class; its thresholds become literals.
    """
    both = products.select("row", "col", "nbr").join(truth.select("row", "col", "code"), ["row", "col"])
    held = (thresholds or severity.calibrate(both)).orderBy("code").collect()
    codes, cuts = [r.code for r in held], [r.threshold for r in held[:-1]]
    classed = both.withColumn("severity", severity.classify_nbr(F.col("nbr"), codes, cuts))
    return classed, accuracy.classified(classed, "severity", "code")


def simulate(pixels: DataFrame, source: Bands, name: str) -> tuple[DataFrame, Bands]:
    """The pixels as another sensor would see them."""
    target = sensor(name)
    weights = indices.response_weights(source, target.wavelengths, target.fwhm)
    return pixels.withColumn("spectrum", indices.resample(F.col("spectrum"), weights, clipped=True)), target


def sensor_demands(pixels: DataFrame, source: Bands, names: Sequence[str] = ("EMIT", "PRISMA", "SENTINEL2")) -> DataFrame:
    """(sensor, demand, n_valid, r2, rmse, mae, bias): how well simulated sensors give the native indices."""
    out = None
    for name in names:
        seen, bands = simulate(pixels, source, name)
        for demand, fn in (("nbr", indices.nbr), ("ndvi", indices.ndvi), ("ndwi", indices.ndwi)):
            a = pixels.select("row", "col", fn(F.col("spectrum"), source).alias("o"))
            b = seen.select("row", "col", fn(F.col("spectrum"), bands).alias("p"))
            one = accuracy.continuous(a.join(b, ["row", "col"]), "p", "o").select(F.lit(name).alias("sensor"), F.lit(demand).alias("demand"), "*")
            out = one if out is None else out.unionByName(one)
    return out


def cross_validate(reference: DataFrame, reference_bands: Bands, reference_grid: Grid, fractions: DataFrame, target: Grid, lib: DataFrame, lib_bands: Bands, constraints: unmix.Constraints = unmix.Constraints(), name: str = "char", least: int = 10) -> DataFrame:
    """Agreement of a fraction with that of a finer reference scene: the library on the reference's bands, unmixed there, coarsened.

    Water bands of the reference are left out. Fewer than ``least`` common pixels are an error.
    """
    good = reference_bands.usable(WATER_ZONES)
    kept = reference_bands.take(good)
    seen = reference.withColumn("spectrum", indices.clamp(F.transform(F.array(*[F.lit(i) for i in good]), lambda i: F.get("spectrum", i))))
    resampled = library.resample_library(lib, lib_bands, kept)
    fine = unmix.unmix(seen, resampled, "mesma", constraints)
    coarse = grid.aggregate_to_grid(fine, reference_grid, target, [name]).withColumnRenamed(name, "obs")
    pairs = fractions.select("row", "col", F.col(name).alias("pred")).join(coarse, ["row", "col"])
    out = accuracy.continuous(pairs, "pred", "obs")
    checked = F.when(F.col("n_valid") < least, F.raise_error(F.lit(f"fewer than {least} common pixels")).cast("long")).otherwise(F.col("n_valid"))
    return out.withColumn("n_valid", checked)


def date_series(scenes: Mapping[str, tuple[DataFrame, Grid]], lib: DataFrame, value: str = "char", **unmixing) -> DataFrame:
    """(ts, n, v_mean, v_std) of a fraction over all dates."""
    return aggregates.trajectory_stats(severity.trajectories(scenes, lib, **unmixing), ["ts"], value)
