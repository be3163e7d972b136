"""Chemical embeddings: lookup with fallback, classes, principal components, species profiles."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.plans.joins import lookup_join


def column_means(df: DataFrame, column: str) -> list[float]:
    """Element-wise mean of an array column (one vector reaches the driver)."""
    vec = df.select(array_to_vector(F.col(column)).alias("v"))
    return list(vec.select(Summarizer.mean(F.col("v")).alias("m")).first()["m"])


def attach_embeddings(
    compounds: DataFrame, embeddings: DataFrame, column: str = "embedding20", means: Sequence[float] | None = None
) -> DataFrame:
    """Centred embedding ``z`` per compound row; a compound without one sits at the mean (zeros).

    ``compounds`` holds chemical_id (null or -1: no chemical). ``z_source`` tells why zeros were
    used, so that missing chemicals and missing embeddings can be counted apart.
    """
    centre = list(means) if means is not None else column_means(embeddings, column)
    mid = F.array(*[F.lit(float(m)) for m in centre])
    centred = F.zip_with(F.col(column).cast("array<double>"), mid, lambda a, b: a - b)
    table = embeddings.select(F.col("chem_id").alias("chemical_id"), centred.alias("_z"))
    joined = lookup_join(compounds, table, ["chemical_id"], "left")
    known = F.coalesce(F.col("chemical_id") >= 0, F.lit(False))
    zeros = F.array(*[F.lit(0.0)] * len(centre))
    return joined.select(
        *compounds.columns, F.coalesce("_z", zeros).alias("z"),
        F.when(F.col("_z").isNotNull(), "embedding").when(known, "no embedding").otherwise("no chemical").alias("z_source"),
    )


# Rounds of k-means before a run counts as not converged.
ROUNDS = 1_000


def _k_means(data: DataFrame, k: int, seed: int):
    """k-means until no centre moves; warns when ``ROUNDS`` were not enough."""
    model = KMeans(k=k, seed=seed, maxIter=ROUNDS, tol=0.0).fit(data)
    if model.summary.numIter >= ROUNDS:
        warnings.warn(f"k-means did not converge in {ROUNDS} rounds", stacklevel=3)
    return model


def chemical_classes(embeddings: DataFrame, column: str, k: int = 32, seed: int = 42) -> tuple[DataFrame, float]:
    """(chem_id, compound_class) by k-means, and the clustering cost."""
    data = embeddings.select("chem_id", array_to_vector(F.col(column).cast("array<double>")).alias("features"))
    model = _k_means(data, k, seed)
    out = model.transform(data).select("chem_id", F.col("prediction").cast("long").alias("compound_class"))
    return out, model.summary.trainingCost


def species_clusters(runs: DataFrame, covariates: Sequence[str], n_clusters: int, species: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """(species, cluster) by k-means on standardised mean covariates.

    A species of the given dimension without runs sits at the column means; the number of clusters
    is kept between one and the number of species.
    """
    means = runs.groupBy("species").agg(*[F.avg(c).alias(c) for c in covariates])
    overall = means.agg(*[F.avg(c).alias(c) for c in covariates]).first()
    if species is not None:
        means = species.select("species").distinct().join(means, ["species"], "left")
    filled = means.withColumns({c: F.coalesce(c, F.lit(overall[c])) for c in covariates})
    n = filled.count()
    vec = filled.select("species", array_to_vector(F.array(*[F.col(c).cast("double") for c in covariates])).alias("raw"))
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(vec).transform(vec)
    k = max(1, min(n_clusters, n))
    if k == 1:
        return scaled.select("species", F.lit(0).cast("long").alias("cluster"))
    model = _k_means(scaled, k, seed)
    return model.transform(scaled).select("species", F.col("prediction").cast("long").alias("cluster"))


def whitened_components(df: DataFrame, column: str, k: int = 20, out: str = "embedding20") -> DataFrame:
    """First ``k`` principal components scaled to unit variance.

    Rows are centred before the projection, which MLlib's transform does not do.
    """
    vec = df.withColumn("_raw", array_to_vector(F.col(column).cast("array<double>")))
    centred = StandardScaler(inputCol="_raw", outputCol="_c", withMean=True, withStd=False).fit(vec).transform(vec)
    projected = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred).transform(centred)
    sd = projected.select(Summarizer.std(F.col("_p")).alias("s")).first()["s"]
    scale = F.array(*[F.lit(float(s) if s > 0 else 1.0) for s in sd])
    z = F.zip_with(vector_to_array("_p"), scale, lambda a, s: a / s)
    return projected.withColumn(out, z).drop("_raw", "_c", "_p")
