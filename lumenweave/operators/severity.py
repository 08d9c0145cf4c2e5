"""Burn severity: thresholds, classes, calibration, trained models, multi-date trajectories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.functions.durable import numbered
from lumenweave.functions.missing import clip
from lumenweave.functions.quantiles import with_quantiles
from lumenweave.operators.accuracy import classified, continuous
from lumenweave.operators.grid import Grid, align
from lumenweave.operators.unmix import unmix

#: Edges of severity classes (a value on an edge is of the higher class), class maps of reference rasters.
CBI_EDGES = (0.10, 1.00, 1.50, 2.25)
DNBR_EDGES = (0.10, 0.27, 0.44, 0.66)
REFERENCE_CODES = {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4}
FIELD_CODES = {0: -1, 1: 1, 2: 2, 3: 3, 4: 4}
FEATURES = ("char", "pv", "npv", "soil")


def classes_by_edges(v: Column, edges: Sequence[float]) -> Column:
    """The number of edges that ``v`` reaches; NULL stays NULL."""
    return F.when(v.isNotNull(), sum((F.when(v >= e, 1).otherwise(0) for e in edges), F.lit(0)))


def dnbr_classes(dnbr: Column) -> Column:
    return classes_by_edges(dnbr, DNBR_EDGES)


def cbi_classes(cbi: Column) -> Column:
    return classes_by_edges(cbi, CBI_EDGES)


def calibrate(df: DataFrame, nbr: str = "nbr", code: str = "code", least: int = 50) -> DataFrame:
    """(code, n, v_median, threshold): exact medians of the classes of at least ``least`` pixels, and midpoints to the next.

    Fewer than two classes, or medians that don't fall with the code, are an error when the result is used. A class has
    one row after the aggregation, so the window is over a handful.
    """
    held = df.filter(F.col(nbr).isNotNull() & ~F.isnan(nbr) & (F.col(code) >= 0))
    counts = held.groupBy(code).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    medians = with_quantiles(counts, held, [nbr], [0.5], [code]).select(code, "n", F.col(f"q_{nbr}")[0].alias("v_median"))
    order, whole = Window.orderBy(code), Window.partitionBy(F.lit(0))
    after = F.lead("v_median").over(order)
    checked = (
        F.when(F.count("*").over(whole) < 2, F.raise_error(F.lit("fewer than two classes with enough pixels")))
        .when(after >= F.col("v_median"), F.raise_error(F.lit("class medians do not fall with severity")))
        .otherwise((F.col("v_median") + after) / 2)
    )
    return medians.withColumn("threshold", checked.cast("double")).select(code, "n", "v_median", "threshold")


def classify_nbr(nbr: Column, codes: Sequence[int], thresholds: Sequence[float]) -> Column:
    """The code at the number of (falling) thresholds that ``nbr`` is below; on one it is of the less severe class."""
    if len(codes) != len(thresholds) + 1:
        raise ValueError(f"{len(codes)} codes need {len(codes) - 1} thresholds")
    if any(b >= a for a, b in zip(thresholds, thresholds[1:])):
        raise ValueError("thresholds must fall")
    n = sum((F.when(nbr < t, 1).otherwise(0) for t in thresholds), F.lit(0))
    return F.when(nbr.isNotNull(), F.get(F.array(*[F.lit(int(c)) for c in codes]), n))


def remap_codes(df: DataFrame, code: str, code_map: Mapping[int, int] | None = None, strict: bool = True, nodata: int | None = None) -> DataFrame:
    """Codes by the reference's map updated by ``code_map``, all at once; NULL and ``nodata`` become -1.

    A code without an entry is an error if ``strict``, else it stays.
    """
    held = dict(REFERENCE_CODES) | dict(code_map or {})
    table = F.create_map(*[F.lit(int(x)) for kv in held.items() for x in kv])
    c = F.col(code).cast("int")
    found = F.try_element_at(table, c)
    rest = F.raise_error(F.concat(F.lit("no class for code "), c.cast("string"))).cast("int") if strict else c
    void = c.isNull() if nodata is None else c.isNull() | (c == nodata)
    return df.withColumn(code, F.when(void, -1).when(found.isNotNull(), found).otherwise(rest).cast("short"))


@dataclass
class Trained:
    """A fitted model and its cross-validated scores."""

    model: object
    kind: str
    scores: dict[str, float]
    n_samples: int
    features: tuple[str, ...] = FEATURES


def _assembled(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    held = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(target).cast("double").alias("label")).na.drop()
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(held)


def train_regressor(df: DataFrame, target: str, order: Sequence[str], trees: int = 200, folds: int = 5, seed: int = 42, features: Sequence[str] = FEATURES) -> Trained:
    """A forest for a continuous index; folds are contiguous in ``order``; r2 is the folds' mean, rmse from their mean error."""
    rows = numbered(df.select(*order, *features, target).na.drop(), *order, *features, target)
    n = rows.count()
    k = max(2, min(folds, n))
    rest, size = n % k, n // k
    edge = rest * (size + 1)
    fold = F.when(F.col("number") < edge, F.expr(f"number div {size + 1}")).otherwise(F.lit(rest) + F.expr(f"(number - {edge}) div {max(1, size)}"))
    data = rows.withColumn("fold", fold)
    maker = lambda: RandomForestRegressor(numTrees=trees, seed=seed, maxDepth=10)
    found = []
    for f in range(k):
        model = maker().fit(_assembled(data.filter(F.col("fold") != f), target, features))
        found.append(continuous(model.transform(_assembled(data.filter(F.col("fold") == f), target, features)), "prediction", "label").first())
    r2 = [s.r2 for s in found if s.r2 is not None]
    scores = {"r2": sum(r2) / len(r2) if r2 else float("nan"), "rmse": (sum(s.rmse**2 for s in found) / k) ** 0.5}
    return Trained(maker().fit(_assembled(data, target, features)), "regressor", scores, n, tuple(features))


def train_classifier(df: DataFrame, target: str, trees: int = 200, folds: int = 5, seed: int = 42, nodata: int = -1, features: Sequence[str] = FEATURES) -> Trained:
    """A forest for class codes; folds by hash within each class; accuracy, kappa and f1_macro over the pooled held-out predictions."""
    rows = df.filter(F.col(target).isNotNull() & (F.col(target) != nodata)).select(*features, target).na.drop()
    # A fold is a hash of the row, so classes are spread evenly without ordering any of them in one task.
    data = rows.withColumn("fold", F.pmod(F.xxhash64(*features, target, F.lit(seed)), F.lit(folds)))
    n = rows.count()
    maker = lambda: RandomForestClassifier(numTrees=trees, seed=seed, maxDepth=10)
    pooled = None
    for f in range(folds):
        held = data.filter(F.col("fold") == f)
        model = maker().fit(_assembled(data.filter(F.col("fold") != f), target, features))
        out = model.transform(_assembled(held, target, features)).select(F.col("prediction").cast("int").alias("pred"), F.col("label").cast("int").alias("obs"))
        pooled = out if pooled is None else pooled.unionByName(out)
    s = classified(pooled, "pred", "obs", None).first()
    return Trained(maker().fit(_assembled(data, target, features)), "classifier", {"accuracy": s.accuracy, "kappa": s.kappa, "f1_macro": s.f1_macro}, n, tuple(features))


def predict(df: DataFrame, trained: Trained) -> DataFrame:
    """``df`` with cbi and severity (regressor) or severity alone (classifier); NULL where a feature is missing."""
    ok = F.lit(True)
    for c in trained.features:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    filled = df.withColumns({f"_f_{c}": F.when(ok, F.col(c)).otherwise(0.0).cast("double") for c in trained.features})
    vector = VectorAssembler(inputCols=[f"_f_{c}" for c in trained.features], outputCol="features").transform(filled)
    out = trained.model.transform(vector)
    if trained.kind == "regressor":
        out = out.withColumn("cbi", F.when(ok, clip(F.col("prediction"), 0.0, 3.0))).withColumn("severity", cbi_classes(F.col("cbi")))
    else:
        out = out.withColumn("severity", F.when(ok, F.col("prediction").cast("int")))
    return out.drop("features", "prediction", "rawPrediction", "probability", *[f"_f_{c}" for c in trained.features])


def trajectories(scenes: Mapping[str, tuple[DataFrame, Grid]], library: DataFrame, spectrum: str = "spectrum", aligned: bool = True, **unmixing) -> DataFrame:
    """(ts, row, col, fractions, rmse): all dates' fractions on one grid.

    Nearest cells of spectra are the nearest cells of their fractions, so scenes on different grids are unmixed where they
    are and a handful of numbers a pixel travels to the common grid instead of a spectrum; others are unmixed together.
    """
    if not scenes:
        raise ValueError("no scenes given")

    def dated(k: str, df: DataFrame) -> DataFrame:
        return df.select("row", "col", spectrum).withColumn("key", F.lit(k)).withColumn("ts", F.try_to_timestamp(F.lit(k)))

    grids = {g for _, g in scenes.values()}
    if len(grids) > 1:
        if not aligned:
            raise ValueError("the scenes are on different grids")
        own = {k: (unmix(dated(k, df), library, spectrum=spectrum, **unmixing), g) for k, (df, g) in scenes.items()}
        order = next(iter(own.values()))[0].columns
        frames, _ = align(own, [c for c in order if c not in ("row", "col")])
        return reduce(DataFrame.unionByName, frames.values()).select(order)
    whole = reduce(DataFrame.unionByName, [dated(k, df) for k, (df, _) in scenes.items()])
    return unmix(whole, library, spectrum=spectrum, **unmixing)
