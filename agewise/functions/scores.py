"""Risk channels and their weighted sum. Each channel is 0 for a missing value and lies in 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the default configuration.
IMPACT = {"HIGH": 1.0, "MODERATE": 0.7, "LOW": 0.3, "MODIFIER": 0.1}
WEIGHTS = {"vep": 0.25, "alphagenome": 0.25, "alphamissense": 0.25, "gtex": 0.15, "epigenetic": 0.10}


def known(c: Column) -> Column:
    """NaN and null are missing; text that is no number too."""
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def clip01(c: Column) -> Column:
    return F.least(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def score_vep_impact(label: Column) -> Column:
    ladder = F.lit(0.0)
    for name, value in IMPACT.items():
        ladder = F.when(F.upper(F.trim(label)) == name, value).otherwise(ladder)
    return ladder


def score_alphagenome(df: DataFrame, abs_pct: str = "alphagenome_abs_perc_change", pct: str = "alphagenome_perc_change", diff: str = "alphagenome_diff") -> Column:
    """The source is chosen by the columns present, for the whole table."""
    if abs_pct in df.columns:
        return clip01(F.abs(known(F.col(abs_pct))) / 50)
    if pct in df.columns:
        return clip01(F.abs(known(F.col(pct))) / 50)
    return clip01(F.abs(known(F.col(diff)))) if diff in df.columns else F.lit(0.0)


def score_alphamissense(c: Column) -> Column:
    return clip01(known(c))


def score_gtex_eqtl(n: Column | None, p: Column | None) -> Column:
    parts = []
    if n is not None:
        x = F.coalesce(known(n), F.lit(0.0))
        parts.append(x / (x + 5))
    if p is not None:
        x = known(p)
        tail = -F.log10(F.least(F.greatest(x, F.lit(1e-300)), F.lit(1.0))) / 10
        parts.append(clip01(F.when(x.isNotNull(), tail)))
    return sum(parts[1:], parts[0]) / len(parts) if parts else F.lit(0.0)


def score_epigenetic(accel: Column) -> Column:
    return clip01(F.abs(known(accel)) / 10)


def composite_risk(channels: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weights are taken over their sum; a missing channel counts 0."""
    weights = weights or WEIGHTS
    whole = sum(weights.values())
    if whole <= 0:
        raise ValueError("weights must sum to more than 0")
    return sum((channels.get(k, F.lit(0.0)) * (w / whole) for k, w in weights.items()), F.lit(0.0))
