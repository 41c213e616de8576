"""Spectral index expressions (double arithmetic, truncated to whole hundredths)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def _hundredths(x: Column) -> Column:
    # bigint: the enhanced index has no bound when its denominator nears zero
    return (x * 100).cast("bigint")


def ndvi_index(nir: Column, red: Column) -> Column:
    ratio = (nir - red) / (nir + red + EPS)
    return _hundredths(F.greatest(F.least(ratio, F.lit(1.0)), F.lit(-1.0)))


def evi_index(nir: Column, red: Column, blue: Column) -> Column:
    return _hundredths((nir - red) * 2.5 / (nir + red * 6 - blue * 7.5 + 1 + EPS))


def difference_index(a: Column, b: Column) -> Column:
    """Truncated (a-b)/(a+b): water index for (nir, swir), built-up for (swir, nir)."""
    return _hundredths((a - b) / (a + b + EPS))


def index_columns(blue: Column, red: Column, nir: Column, swir: Column) -> list[Column]:
    """The four index channels in matrix order."""
    blue, red, nir, swir = (x.cast("double") for x in (blue, red, nir, swir))
    return [
        ndvi_index(nir, red),
        evi_index(nir, red, blue),
        difference_index(nir, swir),
        difference_index(swir, nir),
    ]


def ndvi(red: Column, nir: Column) -> Column:
    """Plain vegetation index; null when both bands are zero."""
    red, nir = red.cast("double"), nir.cast("double")
    return F.try_divide(nir - red, nir + red)


def ndvi_array(images: Column) -> Column:
    """Vegetation index per image of a packed series; images without signal vanish."""
    lit = F.filter(images, lambda o: (o["bands"][7] + o["bands"][3]) != 0)
    return F.transform(lit, lambda o: ndvi(o["bands"][3], o["bands"][7]))
