"""Measures of tiles by registered functions (X2): a name, what it gives, and a function of a tile's pixels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from noctua.operators.stats import MAD_SIGMA

SCHEMA = "frame_id string, ty int, tx int, measure string, result map<string,double>, error string"


@dataclass(frozen=True)
class Measure:
    """fields: names of what `of` gives for a tile, a 2-D array whose missing pixels are NaN."""

    name: str
    fields: tuple[str, ...]
    of: Callable[[np.ndarray], tuple[float, ...]]


REGISTRY: dict[str, Measure] = {}


def register(name: str, *fields: str) -> Callable:
    """Add a function of a tile under a name; a name is taken once."""

    def add(of: Callable[[np.ndarray], tuple[float, ...]]) -> Callable:
        if name in REGISTRY:
            raise ValueError(f"the measure {name} exists")
        REGISTRY[name] = Measure(name, fields, of)
        return of

    return add


@register("local_noise", "median", "noise")
def local_noise(image: np.ndarray) -> tuple[float, float]:
    v = image[np.isfinite(image)]
    if not len(v):
        raise ValueError("no finite pixel")
    m = float(np.median(v))
    return m, MAD_SIGMA * float(np.median(np.abs(v - m)))


@register("gradient", "rows", "columns")
def gradient(image: np.ndarray) -> tuple[float, float]:
    """Mean steps from a row to the next and from a column to the next."""
    if min(image.shape) < 2:
        raise ValueError("fewer than two rows or columns")
    return float(np.mean(np.diff(image, axis=0))), float(np.mean(np.diff(image, axis=1)))


@register("extremes", "low", "high")
def extremes(image: np.ndarray) -> tuple[float, float]:
    v = image[np.isfinite(image)]
    if not len(v):
        raise ValueError("no finite pixel")
    return float(v.min()), float(v.max())


def measured(tiles: DataFrame, names: list[str]) -> DataFrame:
    """A row for each tile (frame_id, ty, tx, h, w, px) and measure: its results by name, or the error that it met.  An
    unknown name is an error at once; a tile that a measure cannot take is a row with error, and the others go on.

    The functions travel with the plan, so what was registered on the driver is known in the tasks."""
    chosen = [REGISTRY[n] for n in names if n in REGISTRY]
    if len(chosen) < len(names):
        raise ValueError(f"no such measure: {', '.join(sorted(set(names) - set(REGISTRY)))}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                for m in chosen:
                    try:
                        image = np.asarray(r.px, float).reshape(r.h, r.w)
                        result, error = dict(zip(m.fields, m.of(image), strict=True)), None
                    except Exception as e:  # noqa: BLE001  whatever a measure meets is its row's error
                        result, error = None, f"{type(e).__name__}: {e}"
                    rows.append((r.frame_id, r.ty, r.tx, m.name, result, error))
            yield pd.DataFrame(rows, columns=["frame_id", "ty", "tx", "measure", "result", "error"])

    return tiles.select("frame_id", "ty", "tx", "h", "w", "px").mapInPandas(run, SCHEMA)
