"""Column arithmetic that several operators share."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 where whole is 0."""
    return F.when(whole > 0, 100.0 * part / whole).otherwise(F.lit(0.0))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def growth_rate(early: Column, late: Column) -> Column:
    """Relative change in percent; from nothing it is 100, or 0 if nothing came."""
    return F.when(early == 0, F.when(late > 0, 100.0).otherwise(0.0)).otherwise((late - early) / early * 100.0)


def composite_confidence(extraction: Column, classification: Column, provenance: Column, normalization: Column) -> Column:
    return 0.35 * extraction + 0.25 * classification + 0.25 * provenance + 0.15 * normalization
