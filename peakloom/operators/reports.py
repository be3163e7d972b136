"""Comparison tables over scored models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def model_comparison(
    tables: Sequence[DataFrame], specs: Sequence[tuple[str, str, str]]
) -> DataFrame:
    """Metrics of all models side by side, restricted to the (anchor, model, label) specs."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    label = F.lit(None).cast("string")
    for anchor, model, name in specs:
        label = F.when((F.col("anchor") == anchor) & (F.col("model") == model), F.lit(name)).otherwise(label)
    return out.withColumn("label", label).where(F.col("label").isNotNull())
