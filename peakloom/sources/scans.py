"""Readers: partitioned peak tables, delimited files, run artifacts, model bundles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakloom.functions.values import (
    SUPPORT_EDGES,
    nested_value,
    support_labels,
    unpack_compound,
    unpack_group,
)
from peakloom.plans.joins import lookup_join

# -- peak tables -----------------------------------------------------------------------------


def scan_peaks(
    spark: SparkSession, root: str, columns: Sequence[str] | None = None, skip_corrupt: bool = False
) -> DataFrame:
    """A hive-partitioned peak table; partition values are columns, unread columns are not loaded."""
    df = spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower()).parquet(root)
    return df.select(*columns) if columns else df


def list_partitions(spark: SparkSession, root: str, keys: Sequence[str]) -> DataFrame:
    """Partition values below ``root`` with their row counts; reads no data column."""
    return spark.read.parquet(root).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def scan_partition(spark: SparkSession, root: str, **values: object) -> DataFrame:
    """One partition directory, with its partition values kept as columns."""
    path = "/".join([root.rstrip("/"), *[f"{k}={v}" for k, v in values.items()]])
    return spark.read.option("basePath", root).parquet(path)


def row_count(spark: SparkSession, path: str) -> DataFrame:
    """Number of rows; no column is read."""
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows"))


def scan_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    columns: Sequence[str] | None = None,
    separator: str = ",",
) -> DataFrame:
    """A delimited table with a header and a declared schema (no inference pass)."""
    df = spark.read.csv(path, header=True, schema=schema, sep=separator, enforceSchema=False)
    return df.select(*columns) if columns else df


def scan_csv_if_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that is only written when there is something to write; empty without it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return scan_csv(spark, path, schema)
    return spark.createDataFrame([], schema)


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Schema check that touches no data."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    return df


def scan_structures(spark: SparkSession, path: str) -> DataFrame:
    """Chemicals with a non-blank structure string, from a tab separated file."""
    df = scan_csv(spark, path, "chem_id BIGINT, smiles STRING", separator="\t")
    return df.where(F.length(F.trim("smiles")) > 0)


# -- relational source -------------------------------------------------------------------------


def jdbc_table(
    spark: SparkSession, url: str, name: str, key: str, lower: int, upper: int, parts: int,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """A relational table read in ``parts`` ranges of an integer key."""
    return spark.read.jdbc(
        url, name, column=key, lowerBound=lower, upperBound=upper, numPartitions=parts,
        properties=dict(properties or {}),
    )


def library_metadata(source: DataFrame, comp_ids: DataFrame) -> DataFrame:
    """(lib_id, comp_id, chemical_id) of the compounds in use, one row per (lib_id, comp_id)."""
    wanted = source.join(comp_ids.select("comp_id").distinct(), ["comp_id"], "left_semi")
    return wanted.groupBy("lib_id", "comp_id").agg(F.min("chemical_id").alias("chemical_id"))


# -- run artifacts -----------------------------------------------------------------------------

# Layout of a result file below a run folder. Models without optional features
# have no features_* level.
ARTIFACT_LAYOUT = r"/lib(\d+)/cap(\d+)(?:/features_([^/]+))?/([^/]+)/results/"

_METRICS = "rmse DOUBLE, mae DOUBLE, coverage_95 DOUBLE, pred_std_mean DOUBLE, interval_width_mean DOUBLE"
RESULT_SCHEMA = (
    f"group_col STRING, n_test BIGINT, n_used BIGINT, skipped_missing_group BIGINT, metrics STRUCT<{_METRICS.replace(' DOUBLE', ': DOUBLE')}>, "
    "support_metrics ARRAY<STRUCT<support_bin: STRING, n_groups: BIGINT, n_obs_test: BIGINT, "
    f"{_METRICS.replace(' DOUBLE', ': DOUBLE')}>>"
)


def _artifact_columns() -> list[Column]:
    path = F.col("_metadata.file_path")
    part = lambda i: F.regexp_extract(path, ARTIFACT_LAYOUT, i)
    return [
        part(1).try_cast("long").alias("lib"),
        part(2).try_cast("long").alias("cap"),
        F.coalesce(F.nullif(part(3), F.lit("")), F.lit("none")).alias("anchor"),
        part(4).alias("model"),
    ]


def scan_results(spark: SparkSession, run_root: str, multi_line: bool = True) -> DataFrame:
    """Result JSON below a run folder, with lib, cap, anchor and model taken from the path."""
    raw = (
        spark.read.schema(RESULT_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("multiLine", multi_line)
        .json(run_root)
    )
    return raw.select(*_artifact_columns(), "*").where(F.col("lib").isNotNull())


def result_metrics(results: DataFrame) -> DataFrame:
    """One row of overall metrics per result file."""
    return results.select(
        "lib", "cap", "anchor", "model", "group_col", "metrics.rmse", "metrics.mae",
        F.col("metrics.coverage_95").alias("cov95"), "metrics.pred_std_mean", "metrics.interval_width_mean",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_test", "n_used", "skipped_missing_group")],
    )


def support_metrics(results: DataFrame, edges: Sequence[int] = SUPPORT_EDGES) -> DataFrame:
    """One row per result file and support bin, with the bin's position for ordering."""
    labels = F.array(*[F.lit(x) for x in support_labels(edges)])
    return results.select("lib", "cap", "anchor", "model", F.explode("support_metrics").alias("m")).select(
        "lib", "cap", "anchor", "model", "m.support_bin",
        (F.array_position(labels, F.col("m.support_bin")) - 1).alias("bin_idx"),
        "m.n_groups", "m.n_obs_test", "m.rmse", "m.mae", F.col("m.coverage_95").alias("cov95"),
        "m.pred_std_mean", "m.interval_width_mean",
    )


def scan_train_minutes(spark: SparkSession, log_root: str) -> DataFrame:
    """Last reported ``elapsed_min`` of every training log, the log named by its path."""
    lines = spark.read.option("recursiveFileLookup", True).text(log_root)
    minutes = F.regexp_extract("value", r"elapsed_min[=:]\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    # position inside a file: block first, then the order in which the block is read
    at = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    log = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.train\.log", 1)
    found = lines.select(log.alias("log"), at.alias("at"), minutes.alias("minutes")).where("minutes IS NOT NULL")
    return found.groupBy("log").agg(F.max_by("minutes", "at").alias("train_elapsed_min"))


# Paths of a run summary and the columns they fill.
SUMMARY_PATHS: dict[str, tuple[str, ...]] = {
    "seed": ("config", "seed"),
    "threshold": ("config", "threshold"),
    "batch_size": ("config", "batch_size"),
    "rounds": ("config", "rounds"),
    "acquisition": ("config", "acquisition"),
    "lambda_fp": ("config", "lambda_fp"),
    "mass_error_ppm": ("config", "mass_error_ppm"),
    "decoy_fraction": ("config", "decoy_fraction"),
    "initial_labeled_fraction": ("config", "initial_labeled_fraction"),
    "n_peaks": ("dataset", "n_peaks"),
    "mean_candidates": ("dataset", "mean_candidates"),
    "naive_precision": ("naive", "metrics", "precision"),
    "naive_recall": ("naive", "metrics", "recall"),
    "al_clicks_to_target": ("active_learning", "clicks_to_target_recall"),
    "al_clicks_to_ratio": ("active_learning", "clicks_to_recall_ratio"),
    "al_final_annotations": ("active_learning", "final_annotations"),
    "al_precision": ("active_learning", "metrics", "precision"),
    "al_recall": ("active_learning", "metrics", "recall"),
    "al_f1": ("active_learning", "metrics", "f1"),
    "al_auc": ("active_learning", "recall_auc"),
    "rand_clicks_to_ratio": ("random", "clicks_to_recall_ratio"),
    "rand_final_annotations": ("random", "final_annotations"),
    "rand_precision": ("random", "metrics", "precision"),
    "rand_recall": ("random", "metrics", "recall"),
    "rand_f1": ("random", "metrics", "f1"),
}
_INTEGERS = {
    "seed", "batch_size", "rounds", "n_peaks", "clicks_to_target_recall", "clicks_to_recall_ratio", "final_annotations",
}


def _summary_schema() -> T.StructType:
    def build(paths: list[tuple[str, ...]]) -> T.StructType:
        fields: dict[str, list[tuple[str, ...]]] = {}
        for p in paths:
            fields.setdefault(p[0], []).append(p[1:])
        out = T.StructType()
        for name, rest in fields.items():
            deeper = [r for r in rest if r]
            if deeper:
                out.add(name, build(deeper))
            elif name == "acquisition":
                out.add(name, T.StringType())
            else:
                out.add(name, T.LongType() if name in _INTEGERS else T.DoubleType())
        return out

    return build(list(SUMMARY_PATHS.values()))


def scan_summaries(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Flat rows from nested run summaries; an absent path is null."""
    raw = spark.read.schema(_summary_schema()).option("multiLine", multi_line).json(path)
    return raw.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]+$", 1).alias("path"),
        *[nested_value(p[0], p[1:]).alias(name) for name, p in SUMMARY_PATHS.items()],
    )


def experiment_table(summaries: DataFrame) -> DataFrame:
    """All summaries in a stable order."""
    return summaries.orderBy("seed", "threshold", "path")


# -- model bundles -----------------------------------------------------------------------------

BUNDLE_LAYOUT = r"/supercategory_(\d+)_[^/]*/regression_(\d+)\.csv"
# Columns of a bundle file that are not features.
BUNDLE_RESERVED = ("comp_id", "b", "window", "name", "lib_id")
BUNDLE_REQUIRED = ("comp_id", "b", "window")


# One field behind its comma, in quotes or without.
_FIELD = r',("(?:[^"]|"")*"|[^,"]*)'


def csv_fields(line: Column) -> Column:
    """The fields of one CSV record as an array of strings; doubled quotes inside quotes are one."""
    inner = lambda x: F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_FIELD), F.lit(1))
    return F.transform(raw, lambda x: F.when(x.startswith('"'), inner(x)).otherwise(x))


def scan_bundle(spark: SparkSession, root: str, lib_id: int) -> DataFrame:
    """Fixed-window models as (supercategory, comp_id, b, window, feature, coef) rows.

    Feature columns differ between files. All files are one scan of lines: the line that names comp_id,
    b and window is the header of its file, joined to the other lines by path, and values are paired
    with names by position. A feature is a column that is not reserved and holds nothing but numbers in
    its file; empty fields are null coefficients. Files without the three names, and rows where one of
    them is empty, are left out; a feature that a file lacks has no rows for it.
    """
    try:
        text = spark.read.text(f"{root.rstrip('/')}/supercategory_*_*/regression_{lib_id}.csv")
    except AnalysisException as error:
        raise ValueError(f"no model files for library {lib_id} below {root}") from error
    lines = text.where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), csv_fields(F.col("value")).alias("fields"))
    named = F.lit(True)
    for name in BUNDLE_REQUIRED:
        named = named & F.array_contains("fields", name)
    headers = lines.where(named).groupBy("file").agg(F.min("fields").alias("names"))  # one row per file
    if headers.isEmpty():
        raise ValueError(f"no model files for library {lib_id} below {root}")
    rows = lookup_join(lines, headers, ["file"], "inner").where(F.col("fields") != F.col("names"))
    number = lambda name: F.get("fields", (F.array_position("names", name) - 1).cast("int")).try_cast("double")
    pair = F.explode(F.arrays_zip("names", "fields")).alias("pair")
    cells = rows.select(
        F.regexp_extract("file", BUNDLE_LAYOUT, 1).cast("long").alias("supercategory"), number("comp_id").cast("long").alias("comp_id"),
        number("b").alias("b"), number("window").alias("window"), pair,
    ).where(F.col("pair.names").isNotNull() & ~F.col("pair.names").isin(*BUNDLE_RESERVED))
    value = F.nullif(F.trim("pair.fields"), F.lit(""))
    cells = cells.select("supercategory", "comp_id", "b", "window", F.col("pair.names").alias("feature"), value.alias("value"), value.try_cast("double").alias("coef"))
    numeric = cells.groupBy("supercategory", "feature").agg(F.bool_and(F.col("value").isNull() | F.col("coef").isNotNull()).alias("ok")).where("ok")
    kept = cells.where("comp_id IS NOT NULL AND b IS NOT NULL AND window IS NOT NULL").drop("value")
    return lookup_join(kept, numeric.select("supercategory", "feature"), ["supercategory", "feature"], "left_semi")


def bundle_models(long: DataFrame) -> DataFrame:
    """One row per (supercategory, comp_id) with a feature to coefficient map."""
    return long.groupBy("supercategory", "comp_id", "b", "window").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "coef")))).alias("coefs")
    )


def scan_embeddings(
    spark: SparkSession, path: str, column: str = "embedding20", width: int = 20
) -> DataFrame:
    """Embeddings whose width is checked while they are read."""
    df = spark.read.parquet(path)
    ok = F.assert_true(F.size(column) == width, F.lit(f"{column} must have {width} values")).isNull()
    return df.where(ok)


def scan_diagnostics(spark: SparkSession, glob: str, task_glob: str | None = None) -> DataFrame:
    """Mixture diagnostics; every file must hold exactly one sample set and one library."""
    df = spark.read.parquet(glob)
    file = F.col("_metadata.file_path")
    bad = (
        df.groupBy(file.alias("file"))
        .agg(
            F.count_distinct("sample_set_id").alias("sets"),
            F.count_distinct("lib_id").alias("libs"),
        )
        .where("sets <> 1 OR libs <> 1")
        .take(5)
    )
    if bad:
        raise ValueError(f"files with several sample sets or libraries: {[r['file'] for r in bad]}")
    if task_glob is None:
        return df
    tasks = spark.read.parquet(task_glob)
    return df.join(tasks, ["sample_set_id", "lib_id", "comp_id"], "left")


def scan_cap_folders(
    spark: SparkSession, root: str, schema: str, preferred: str = "production"
) -> DataFrame:
    """Rows of ``cap<N>`` folders; per folder the preferred table when present, else the others.

    Folders whose number does not parse are skipped.
    """
    raw = spark.read.schema(schema).option("recursiveFileLookup", True).option("header", True).csv(root)
    path = F.col("_metadata.file_path")
    part = lambda i: F.regexp_extract(path, r"/lib(\d+)/cap([^/]+)/([^/]+)/", i)
    df = raw.select(
        part(1).try_cast("long").alias("lib"),
        part(2).try_cast("long").alias("cap"),
        part(3).alias("source"),
        "*",
    ).where(F.col("cap").isNotNull())
    choice = df.groupBy("lib", "cap").agg(
        F.min(F.struct((F.col("source") != preferred).alias("other"), "source")).alias("c")
    )
    return df.join(choice.select("lib", "cap", F.col("c.source").alias("source")), ["lib", "cap", "source"], "left_semi")


def support_map(df: DataFrame, edges: Sequence[int] = SUPPORT_EDGES) -> DataFrame:
    """(species_cluster, comp_id, support_bin, bin_idx) from packed or separate keys.

    Rows with an unknown bin label are dropped.
    """
    if "group_key" in df.columns:
        keyed = df.select(
            unpack_group("group_key").alias("species_cluster"),
            unpack_compound("group_key").alias("comp_id"), "support_bin",
        )
    elif {"species_cluster", "comp_id"} <= set(df.columns):
        keyed = df.select("species_cluster", "comp_id", "support_bin")
    else:
        raise ValueError("a support map needs group_key or (species_cluster, comp_id)")
    labels = F.array(*[F.lit(x) for x in support_labels(edges)])
    return keyed.withColumn("bin_idx", F.array_position(labels, F.col("support_bin")) - 1).where("bin_idx >= 0")


def support_map_bins(mapping: DataFrame) -> DataFrame:
    """Number of groups per bin."""
    return mapping.groupBy("support_bin", "bin_idx").agg(F.count(F.lit(1)).alias("n_groups"))
