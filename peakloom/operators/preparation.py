"""From raw peak rows to the production retention-time table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakloom.functions.values import clean, hash_fraction, hash_text, leading_integer, packed_key
from peakloom.plans.joins import lookup_join
from peakloom.plans.ordered import dense_codes
from peakloom.plans.topk import top_k_per_group

# Accepted compound states, the excluded sample type, predictor prefixes.
COMPLETE_STATES = ("Complete", "Complete - NFS")
EXCLUDED_SAMPLE_TYPE = "PRCS"
PREDICTOR_PREFIXES = ("IS", "ES", "RS")
UNMAPPED = -1


# -- filters and projections -----------------------------------------------------------------


def keep_usable(df: DataFrame) -> DataFrame:
    """Complete compounds only (null state dropped), processed samples removed (null type kept)."""
    if "cpd_status" in df.columns:
        df = df.where(F.col("cpd_status").isin(*COMPLETE_STATES))
    if "sample_type" in df.columns:
        df = df.where(~F.col("sample_type").eqNullSafe(EXCLUDED_SAMPLE_TYPE))
    return df


def standard_names(df: DataFrame) -> DataFrame:
    """``correct`` becomes comp_id; a batch column is provided, worksheet_id is kept beside it."""
    if "correct" in df.columns:
        df = df.withColumnRenamed("correct", "comp_id")
    if "batch" not in df.columns:
        for source in ("worksheet_id", "batch_pred"):
            if source in df.columns:
                return df.withColumn("batch", F.col(source))
    return df


def split_columns(columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """(metadata, predictors) in first-seen order."""
    seen = list(dict.fromkeys(columns))
    predictors = [c for c in seen if c.startswith(PREDICTOR_PREFIXES)]
    return [c for c in seen if c not in predictors], predictors


def unify(frames: Sequence[DataFrame]) -> DataFrame:
    """Union over differing schemas: metadata then predictors, absent columns null.

    Side columns of the predictor tables (``*_pred``, ``fit_scores``) are dropped.
    """
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    metadata, predictors = split_columns(out.columns)
    kept = [c for c in metadata if not c.endswith("_pred") and c != "fit_scores"]
    return out.select(*kept, *predictors)


def numeric_covariates(schema: T.StructType, reserved: Sequence[str]) -> list[str]:
    """Sorted names of numeric or boolean columns that are not reserved."""
    return sorted(
        f.name
        for f in schema.fields
        if f.name not in reserved and isinstance(f.dataType, (T.NumericType, T.BooleanType))
    )


# Columns of the production table; apex_rt is its target, never a covariate.
PRODUCTION_KEYS = (
    "sampleset_id", "worksheet_id", "task_id", "species", "species_cluster", "compound", "compound_class",
)
PRODUCTION_RESERVED = (
    *PRODUCTION_KEYS, "rt", "apex_rt", "sample_set_id", "comp_id", "chemical_id", "lib_id", "batch",
)


def production_rows(df: DataFrame, covariates: Sequence[str]) -> DataFrame:
    """Project attached rows onto the production schema."""
    id_of = {"sampleset_id": "sample_set_id", "compound": "chemical_id"}
    keys: list[Column] = []
    for name in PRODUCTION_KEYS:
        value = F.col(id_of.get(name, name)).cast("long")
        if name in ("compound", "compound_class"):
            value = F.coalesce(value, F.lit(UNMAPPED).cast("long"))
        keys.append(value.alias(name))
    extra = [F.col("comp_id").cast("long").alias("comp_id")] if "comp_id" in df.columns else []
    return df.select(
        *keys, *extra, F.col("apex_rt").cast("double").alias("rt"),
        *[F.col(c).cast("double").alias(c) for c in covariates],
    )


def model_features(columns: Sequence[str], optional: Sequence[str] = ()) -> list[str]:
    """Internal standards (required), reference standards, then the caller's optional features."""
    internal = sorted(c for c in columns if c.startswith("IS"))
    if not internal:
        raise ValueError("no IS* feature column")
    missing = [c for c in optional if c not in columns]
    if missing:
        raise ValueError(f"missing optional features {missing}")
    return [*internal, *sorted(c for c in columns if c.startswith("RS")), *optional]


def choose_optional_features(
    columns: Sequence[str], lib_id: int, *, per_library: Mapping[int, Sequence[str]] | None = None,
    use_all: bool = False,
) -> list[str]:
    """No optional features, a fixed subset per library, or every ES_* column."""
    if per_library is not None and use_all:
        raise ValueError("choose a per-library subset or all optional features, not both")
    if use_all:
        return sorted(c for c in columns if c.startswith("ES_"))
    if per_library is None:
        return []
    return [c for c in per_library.get(lib_id, ()) if c in columns]


def find_column(columns: Sequence[str], wanted: Sequence[str]) -> str:
    """First wanted name present, compared without case, surrounding blanks or inner blanks."""
    plain = {c.strip().lower().replace(" ", "_"): c for c in columns}
    for name in wanted:
        if (hit := plain.get(name.strip().lower().replace(" ", "_"))) is not None:
            return hit
    raise ValueError(f"none of {list(wanted)} among {list(columns)}")


def raw_species(df: DataFrame, lib_id: int, source_of: Mapping[int, str]) -> DataFrame:
    """Species text of a library; the source column differs by library."""
    if lib_id not in source_of:
        raise ValueError(f"no species column known for library {lib_id}")
    source = find_column(df.columns, [source_of[lib_id]])
    return df.withColumn("species_raw", F.col(source).cast("string"))


def fill_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Null and NaN features become zero."""
    return df.withColumns({f: clean(f) for f in features})


def mask_optional(df: DataFrame, optional: Sequence[str], applies: Column) -> DataFrame:
    """Optional features count only where ``applies``; elsewhere they are zero."""
    return df.withColumns({f: F.when(applies, clean(f)).otherwise(F.lit(0.0)) for f in optional})


def row_problems(df: DataFrame, required: Sequence[str], finite: Sequence[str]) -> DataFrame:
    """One row with the number of offending rows per rule; a single pass over the data."""
    missing = [c for c in [*required, *finite] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required],
        *[F.count_if(bad(c)).alias(f"not_finite_{c}") for c in finite],
    )


def require_valid_rows(df: DataFrame, required: Sequence[str], finite: Sequence[str]) -> DataFrame:
    """Return ``df`` unchanged, or raise naming the broken rules."""
    counts = row_problems(df, required, finite).first().asDict()
    broken = {k: v for k, v in counts.items() if k != "n_rows" and v}
    if broken:
        raise ValueError(f"invalid rows: {broken}")
    return df


def hold_out(df: DataFrame, keys: Sequence[str], fraction: float, seed: int, held: bool = False) -> DataFrame:
    """Rows whose key is outside (or inside) a seeded fraction of all keys; keys stay whole."""
    inside = hash_fraction(keys, seed) < F.lit(float(fraction))
    return df.where(inside if held else ~inside)


def exclude_clusters(df: DataFrame, clusters: Sequence[int], column: str = "species_cluster") -> DataFrame:
    return df.where(~F.col(column).isin(*clusters)) if clusters else df


def fold_rows(df: DataFrame, split: DataFrame, lib: int, fold: str = "test", require: bool = False) -> DataFrame:
    """Rows of the sample sets that the split table puts in ``fold`` for this library."""
    wanted = split.where((F.col("fold") == fold) & (F.col("lib") == lib)).select("sample_set_id").distinct()
    out = lookup_join(df, wanted, ["sample_set_id"], "left_semi")
    if require and out.isEmpty():
        raise ValueError(f"no {fold} rows for library {lib}")
    return out


def unseen_group_split(
    df: DataFrame, mode: str, fraction: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, held-out). ``species``: whole species are held out, as long as their cluster stays
    in training. ``pair``: (species, compound) pairs whose cluster and compound both stay."""
    unit = {"species": ["species"], "pair": ["species", "comp_id"]}.get(mode)
    if unit is None:
        raise ValueError(f"unknown mode {mode!r}")
    units = df.groupBy("species_cluster", *unit).agg(F.count(F.lit(1)).alias("_rows"))
    marked = units.withColumn("_held", hash_fraction(unit, seed) < F.lit(float(fraction)))
    remaining = marked.where(~F.col("_held"))
    guards = [["species_cluster"]] if mode == "species" else [["species_cluster"], ["comp_id"]]
    held = marked.where("_held")
    for on in guards:
        held = held.join(remaining.select(*on).distinct(), on, "left_semi")
    held = held.select(*unit)
    return lookup_join(df, held, unit, "left_anti"), lookup_join(df, held, unit, "left_semi")


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in a total order (a limit is the feature here)."""
    return df.orderBy(*order).limit(n)


def scored_only(df: DataFrame) -> DataFrame:
    """Groups that were scored: test rows present and an error known; one coverage column."""
    coverage = [c for c in ("coverage_window", "coverage_95") if c in df.columns]
    out = df.where((F.col("n_obs_test") > 0) & F.col("rmse").isNotNull() & ~F.isnan("rmse"))
    if coverage:
        out = out.withColumn("coverage", F.coalesce(*[F.col(c) for c in coverage])).drop(*coverage)
    return out


# -- joins -----------------------------------------------------------------------------------

RUN_KEYS = ("lib_id", "sample_set_id", "task_id", "species_matrix_type")


def merge_predictors(peaks: DataFrame, predictors: DataFrame) -> DataFrame:
    """Inner join of peaks and run predictors within one library."""
    clash = [c for c in predictors.columns if c in peaks.columns and c not in RUN_KEYS]
    return lookup_join(peaks, predictors.drop(*clash), list(RUN_KEYS), "inner")


def merge_training(peaks: DataFrame, predictors: DataFrame) -> DataFrame:
    """Filter, rename, join and order one raw peak table into the merged training table."""
    merged = merge_predictors(standard_names(keep_usable(peaks)), predictors)
    return unify([merged])


def attach_chemistry(
    df: DataFrame, lib_map: DataFrame, class_map: DataFrame, drop_unmapped: bool = False
) -> DataFrame:
    """comp_id to chemical to class; unmatched ids become -1, or their rows are dropped.

    Joins on (lib_id, comp_id) when both sides carry lib_id. Otherwise the map must belong to a
    single library.
    """
    on = ["comp_id"]
    if "lib_id" in df.columns and "lib_id" in lib_map.columns:
        on = ["lib_id", "comp_id"]
    elif "lib_id" in lib_map.columns:
        if len(lib_map.select("lib_id").distinct().take(2)) > 1:
            raise ValueError("library map covers several libraries but the rows have no lib_id")
        lib_map = lib_map.drop("lib_id")
    mapping = lib_map.select(*on, F.col("chemical_id").cast("long").alias("chemical_id"))
    classes = class_map.select(
        F.col("chem_id").cast("long").alias("chemical_id"),
        F.col("compound_class").cast("long").alias("compound_class"),
    )
    out = lookup_join(df, mapping, on, "left")
    out = lookup_join(out, classes, ["chemical_id"], "left")
    if drop_unmapped:
        return out.where(F.col("chemical_id").isNotNull() & F.col("compound_class").isNotNull())
    return out.withColumns(
        {c: F.coalesce(c, F.lit(UNMAPPED).cast("long")) for c in ("chemical_id", "compound_class")}
    )


def unmatched_keys(df: DataFrame, dim: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct keys of ``df`` that ``dim`` does not have."""
    return df.select(*on).distinct().join(dim.select(*on), list(on), "left_anti")


def require_match(df: DataFrame, dim: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join in which every row must find its key; the error names at most ten missing keys."""
    missing = unmatched_keys(df, dim, on).orderBy(*on).take(10)
    if missing:
        raise ValueError(f"unmapped keys: {[tuple(r) for r in missing]}")
    return lookup_join(df, dim, on, "left")


def known_class_compounds(lib_map: DataFrame, class_map: DataFrame) -> DataFrame:
    """Compounds whose chemical has a class."""
    known = class_map.where(F.col("compound_class").isNotNull()).select(F.col("chem_id").alias("chemical_id"))
    return lib_map.join(known, ["chemical_id"], "left_semi").select("lib_id", "comp_id").distinct()


def with_species(df: DataFrame, species_map: DataFrame) -> DataFrame:
    """Keep mapped sample sets and attach their species in the same join."""
    return lookup_join(df, species_map.select("sample_set_id", "species"), ["sample_set_id"], "inner")


def map_audit(df: DataFrame, species_map: DataFrame) -> DataFrame:
    """Sample sets without a map row, and map rows without data; one row per problem."""
    sets = df.select("sample_set_id").distinct()
    ids = species_map.select("sample_set_id").distinct()
    problem = lambda a, b, name: a.join(b, ["sample_set_id"], "left_anti").select(
        "sample_set_id", F.lit(name).alias("problem")
    )
    return problem(sets, ids, "not in map").unionByName(problem(ids, sets, "unused"))


def species_attributes(species_map: DataFrame, reference_group: int) -> DataFrame:
    """Derived attributes per sample set: group label, leading number, reference-group flag.

    Ids that are not integers are skipped; for repeated ids the largest label wins.
    """
    rows = species_map.select(
        F.col("sample_set_id").cast("string").try_cast("long").alias("sample_set_id"),
        F.col("species_group_raw").alias("group_label"),
        F.col("species_raw"),
    ).where(F.col("sample_set_id").isNotNull())
    one = rows.groupBy("sample_set_id").agg(
        F.max(F.struct("group_label", "species_raw")).alias("_r")
    )
    number = leading_integer("_r.group_label")
    return one.select(
        "sample_set_id", "_r.group_label", "_r.species_raw", number.alias("supercategory"),
        F.coalesce(number == reference_group, F.lit(False)).alias("is_reference_group"),
    )


def attach_supercategory(df: DataFrame, species_map: DataFrame) -> DataFrame:
    """Rows with the leading number of their group label; labels without one drop their rows."""
    numbers = (
        species_map.select("sample_set_id", leading_integer("species_group_raw").alias("supercategory"))
        .where(F.col("supercategory").isNotNull())
        .groupBy("sample_set_id").agg(F.max("supercategory").alias("supercategory"))
    )
    return lookup_join(df, numbers, ["sample_set_id"], "inner")


def attach_canonical(groups: DataFrame, canonical: DataFrame) -> DataFrame:
    """(chem_id, compound_class) of every group by compound, -1 when unknown."""
    out = lookup_join(groups, canonical.select("comp_id", "chem_id", "compound_class"), ["comp_id"], "left")
    return out.withColumns(
        {c: F.coalesce(c, F.lit(UNMAPPED).cast("long")) for c in ("chem_id", "compound_class")}
    )


def canonical_chemistry(df: DataFrame) -> DataFrame:
    """Most frequent (chem_id, compound_class) per compound, ties to the smallest pair.

    ``n_mappings`` above one marks a collision.
    """
    pairs = df.groupBy("comp_id", "chem_id", "compound_class").agg(F.count(F.lit(1)).alias("n_rows"))
    best = F.min(F.struct((-F.col("n_rows")).alias("n"), "chem_id", "compound_class"))
    return pairs.groupBy("comp_id").agg(
        best.alias("_b"), F.count(F.lit(1)).alias("n_mappings"), F.sum("n_rows").alias("n_rows")
    ).select("comp_id", "_b.chem_id", "_b.compound_class", "n_mappings", "n_rows")


def mapping_collisions(df: DataFrame) -> DataFrame:
    """Every (chem_id, compound_class) of the compounds that have more than one."""
    pairs = df.groupBy("comp_id", "chem_id", "compound_class").agg(F.count(F.lit(1)).alias("n_rows"))
    many = pairs.groupBy("comp_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("comp_id")
    return pairs.join(many, ["comp_id"], "left_semi")


def nesting_violations(df: DataFrame, child: str, parent: str) -> DataFrame:
    """Children with more than one parent."""
    return (
        df.groupBy(child)
        .agg(F.min(parent).alias("first_parent"), F.max(parent).alias("last_parent"))
        .where(F.col("first_parent") != F.col("last_parent"))
    )


def parents(df: DataFrame, child: str, parent: str) -> DataFrame:
    """The one parent per child; raises with examples when the columns are not nested."""
    bad = nesting_violations(df, child, parent).orderBy(child).take(5)
    if bad:
        raise ValueError(f"{child} is not nested in {parent}: {[tuple(r) for r in bad]}")
    return df.groupBy(child).agg(F.min(parent).alias(parent))


# -- sampling and coding -----------------------------------------------------------------------


def capped_sample(
    df: DataFrame, keys: Sequence[str], cap: int, row_key: Sequence[str | Column], seed: int = 42
) -> DataFrame:
    """At most ``cap`` rows per group, chosen by a seeded hash of the row's own key.

    The choice does not depend on partitioning; rows with a null key are dropped and every
    remaining group keeps at least one row.
    """
    if cap < 1:
        raise ValueError("cap must be at least 1")
    usable = df
    for k in keys:
        usable = usable.where(F.col(k).isNotNull())
    columns = df.columns
    marked = usable.withColumn("_pick", hash_text(row_key, seed))
    order = [F.col("_pick"), *[F.col(c) if isinstance(c, str) else c for c in row_key]]
    return top_k_per_group(marked, keys, order, cap, ["_pick"]).select(*columns)


def encode(df: DataFrame, column: str, code: str) -> DataFrame:
    """Attach dense codes of a column, in sorted order of its distinct values."""
    return lookup_join(df, dense_codes(df, column, code), [column], "left")


def with_packed_key(df: DataFrame, group: str, compound: str) -> DataFrame:
    return df.withColumn("group_key", packed_key(group, compound))


def lowest_count(df: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` rarest values of a key, ties by key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).orderBy("n_rows", key).limit(k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first in ``order`` (a total order keeps it deterministic)."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_r"))
    return picked.select(*keys, *[F.col("_r")[c].alias(c) for c in [*order, *rest]]).select(*df.columns)
