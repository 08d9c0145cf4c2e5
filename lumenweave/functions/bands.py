"""Band tables: small driver-side metadata that turn wavelengths into positions of spectrum arrays."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named bands (nm), zones of unusable bands (nm, both ends included), sensors.
ALIASES = {"BLUE": 470, "GREEN": 560, "RED": 660, "RED_EDGE": 705, "NIR": 860, "SWIR1": 1610, "SWIR2": 2200}
BAD_ZONES = ((0, 400), (1340, 1480), (1780, 1970), (2350, 2500))
WATER_ZONES = ((1340, 1440), (1780, 1970))
MULTISPECTRAL = {
    "B2": (490, 65), "B3": (560, 35), "B4": (665, 30), "B5": (705, 15), "B6": (740, 15),
    "B7": (783, 20), "B8": (842, 115), "B8A": (865, 20), "B11": (1610, 90), "B12": (2190, 180),
}
#: name: bands, first and last centre, width at half maximum (all nm but the first).
SPECTROMETERS = {"EMIT": (285, 381.0, 2493.0, 8.5), "PRISMA": (239, 400.0, 2505.0, 12.0)}


@dataclass(frozen=True)
class Bands:
    """Wavelengths (nm, ascending) of a spectrum array's entries, their widths and good flags if known."""

    wavelengths: tuple[float, ...]
    fwhm: tuple[float, ...] | None = None
    good: tuple[bool, ...] | None = None

    def __post_init__(self) -> None:
        for name, held in (("fwhm", self.fwhm), ("good", self.good)):
            if held is not None and len(held) != len(self.wavelengths):
                raise ValueError(f"{name} has {len(held)} entries for {len(self.wavelengths)} bands")

    def __len__(self) -> int:
        return len(self.wavelengths)

    def nearest(self, wavelength: float, tie: str = "larger") -> int:
        """Position of the nearest band; ``tie`` (larger or first) says which of two equally near."""
        if not self.wavelengths:
            raise ValueError("no bands")
        best = min(abs(w - wavelength) for w in self.wavelengths)
        near = [i for i, w in enumerate(self.wavelengths) if abs(w - wavelength) == best]
        return near[-1] if tie == "larger" else near[0]

    def within(self, low: float | None, high: float | None) -> list[int]:
        """Positions in the closed interval; both ends are needed and some band must lie in it."""
        if low is None or high is None:
            raise ValueError("both ends of the range are needed")
        found = [i for i, w in enumerate(self.wavelengths) if low <= w <= high]
        if not found:
            raise ValueError(f"no band between {low} and {high} nm")
        return found

    def usable(self, zones: Sequence[tuple[float, float]] | None = None, good: Sequence[bool] | None = None) -> list[int]:
        """Positions outside all zones (given ones replace the default) and flagged good (``good`` before own flags)."""
        flags = self.good if good is None else tuple(good)
        if flags is not None and len(flags) != len(self):
            raise ValueError(f"{len(flags)} flags for {len(self)} bands")
        zones = BAD_ZONES if zones is None else zones
        return [i for i, w in enumerate(self.wavelengths) if (flags is None or flags[i]) and not any(a <= w <= b for a, b in zones)]

    def take(self, at: Sequence[int]) -> Bands:
        pick = lambda xs: None if xs is None else tuple(xs[i] for i in at)
        return replace(self, wavelengths=pick(self.wavelengths), fwhm=pick(self.fwhm), good=pick(self.good))


def even(first: float, last: float, n: int, fwhm: float | None = None) -> Bands:
    step = (last - first) / (n - 1)
    return Bands(tuple(first + i * step for i in range(n)), None if fwhm is None else (fwhm,) * n)


def sensor(name: str) -> Bands:
    """The bands of a known sensor."""
    if name in SPECTROMETERS:
        n, first, last, fwhm = SPECTROMETERS[name]
        return even(first, last, n, fwhm)
    if name == "SENTINEL2":
        return Bands(tuple(float(c) for c, _ in MULTISPECTRAL.values()), tuple(float(w) for _, w in MULTISPECTRAL.values()))
    raise KeyError(name)


def at(spectrum: Column, i: int) -> Column:
    """Entry ``i`` (from 0 on) of a spectrum."""
    return F.get(spectrum, F.lit(i))


def take(spectrum: Column, positions: Sequence[int]) -> Column:
    """The entries at these positions: a slice where they follow each other, else an array of picks."""
    positions = list(positions)
    if positions and positions == list(range(positions[0], positions[0] + len(positions))):
        return F.slice(spectrum, positions[0] + 1, len(positions))
    if len(positions) > 64:
        table = F.array(*[F.lit(i) for i in positions])
        return F.transform(table, lambda i: F.get(spectrum, i))
    return F.array(*[at(spectrum, i) for i in positions])


def nearest_on_axis(axis: Sequence[float], v: float) -> int | None:
    """Position on a sorted axis within half a median step, the lower coordinate of two equally near; None outside."""
    up = list(axis) if len(axis) < 2 or axis[0] <= axis[-1] else list(axis)[::-1]
    steps = sorted(b - a for a, b in zip(up, up[1:]))
    half = (steps[(len(steps) - 1) // 2] + steps[len(steps) // 2]) / 4 if steps else 0.0
    if not up or v < up[0] - half or v > up[-1] + half:
        return None
    j = min(max(bisect_left(up, v), 1), len(up) - 1) if len(up) > 1 else 0
    k = j - 1 if j and v - up[j - 1] <= up[j] - v else j
    return k if up == list(axis) else len(up) - 1 - k
