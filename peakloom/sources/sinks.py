"""Writers: sharded tables, models with their configuration, metrics and audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_sharded(
    df: DataFrame, path: str, partitions: Sequence[str], max_rows_per_file: int = 1_000_000
) -> None:
    """Zstd Parquet below partition folders with bounded files.

    Rebalancing lets the runtime split a hot partition value over several tasks and merge small
    ones, so neither a slow writer nor a file per task and value results.
    """
    (
        df.hint("rebalance", *[F.col(c) for c in partitions])
        .write.mode("overwrite")
        .option("maxRecordsPerFile", max_rows_per_file)
        .option("compression", "zstd")
        .partitionBy(*partitions)
        .parquet(path)
    )


def write_consolidated(df: DataFrame, path: str) -> None:
    """The same rows as one unpartitioned dataset."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_by_key(df: DataFrame, path: str, key: str) -> None:
    """One folder per key value, null keys dropped."""
    write_sharded(df.where(F.col(key).isNotNull()), path, [key])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, published by the commit protocol; an empty table keeps its header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_if_any(df: DataFrame, path: str) -> bool:
    """Write a small audit table unless it is empty; tells whether it was written."""
    if df.isEmpty():
        return False
    write_csv(df, path)
    return True


# Optional model fields and what stands in for them when absent.
MODEL_DEFAULTS: dict[str, str] = {
    "beta_cov": "CAST(NULL AS ARRAY<DOUBLE>)",
    "feature_center": "CAST(NULL AS ARRAY<DOUBLE>)",
    "feature_rotation": "CAST(NULL AS ARRAY<DOUBLE>)",
    "supercat_id": "CAST(-1 AS BIGINT)",
    "n_obs": "CAST(0 AS BIGINT)",
    "group_col": "'species_cluster'",
}


def save_model(model: DataFrame, path: str, config: Mapping[str, str]) -> None:
    """Coefficient table plus a one-row configuration table."""
    spark = model.sparkSession
    model.write.mode("overwrite").parquet(f"{path}/model")
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in config.items()])
    row.coalesce(1).write.mode("overwrite").json(f"{path}/config")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(coefficients, configuration); absent optional fields get their defaults."""
    model = spark.read.option("mergeSchema", "true").parquet(f"{path}/model")
    for name, default in MODEL_DEFAULTS.items():
        if name not in model.columns:
            model = model.withColumn(name, F.expr(default))
    return model, spark.read.json(f"{path}/config")


def save_training(
    model: DataFrame, path: str, config: Mapping[str, str], summary: DataFrame
) -> None:
    """Model, configuration and a one-row training summary below one run folder."""
    save_model(model, path, config)
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def write_metrics(path: str, overall: DataFrame, by_group: DataFrame, by_support: DataFrame) -> None:
    """Overall metrics as JSON, group and support tables as CSV."""
    overall.coalesce(1).write.mode("overwrite").json(f"{path}/overall")
    write_csv(by_group, f"{path}/by_group")
    write_csv(by_support, f"{path}/by_support")


def save_prior(prior: DataFrame, path: str) -> None:
    prior.write.mode("overwrite").parquet(path)


def load_prior(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
