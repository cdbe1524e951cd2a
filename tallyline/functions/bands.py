"""Right-closed binning of discount rates."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band edges (low, high] and their labels.
BAND_EDGES = [-0.001, 0.0, 0.05, 0.10, 0.15, 0.20, 2.0]
BAND_LABELS = ["0%", "1-5%", "6-10%", "11-15%", "16-20%", "Más de 20%"]


def discount_band_ordinal(rate: Column, edges=BAND_EDGES) -> Column:
    """0-based number of the band (low, high] a rate lies in; NULL outside."""
    inside = (rate > edges[0]) & (rate <= edges[-1])
    # Counting the inner edges below the rate needs no branch per band.
    below = [(rate > edge).cast("int") for edge in edges[1:-1]]
    return F.when(inside, reduce(lambda a, b: a + b, below, F.lit(0)))


def discount_band(rate: Column, edges=BAND_EDGES, labels=BAND_LABELS) -> Column:
    """Label of the band a rate lies in; NULL outside all bands."""
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per band is needed")
    names = F.array(*[F.lit(label) for label in labels])
    return F.get(names, discount_band_ordinal(rate, edges))
