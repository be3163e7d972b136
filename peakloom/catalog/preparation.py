"""Catalogue queries: filters, projections, mapping joins, sampling and coding."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakloom.catalog.inputs import VIEWS, kept, table, view, with_views
from peakloom.catalog.registry import query, rounded
from peakloom.functions import values as V
from peakloom.operators import preparation as P
from peakloom.plans.ordered import dense_codes

PRICE_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "sampleset_id", "price_cents"]


def _obs(spark, sf):
    return view(spark, sf, "obs").withColumn("price_cents", F.round(F.col("l_extendedprice") * 100).cast("long"))


def hash_sql(keys, seed):
    parts = ", ".join(f"coalesce(CAST({k} AS VARCHAR), '~')" for k in keys)
    return f"md5(concat_ws('|', {parts}, '{seed}'))"


def fraction_sql(keys, seed):
    return f"(CAST('0x' || substr({hash_sql(keys, seed)}, 1, 12) AS BIGINT) / 281474976710656e0)"


USABLE = (
    "cpd_status IN ('Complete', 'Complete - NFS') AND (sample_type IS NULL OR sample_type <> 'PRCS')"
)


@query(
    "P1_status_filter",
    with_views(
        f"SELECT cpd_status, sample_type, count(*) AS n_rows FROM raw_peaks WHERE {USABLE} GROUP BY 1, 2",
        "raw_peaks",
    ),
)
def _(spark, sf):
    kept_rows = P.keep_usable(view(spark, sf, "raw_peaks"))
    return kept_rows.groupBy("cpd_status", "sample_type").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "P2_conditional_rename",
    with_views(
        "SELECT correct AS comp_id, worksheet_id, worksheet_id AS batch, count(*) AS n_rows FROM raw_peaks GROUP BY 1, 2, 3",
        "raw_peaks",
    ),
)
def _(spark, sf):
    df = P.standard_names(view(spark, sf, "raw_peaks"))
    return df.groupBy("comp_id", "worksheet_id", "batch").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "P4_schema_union",
    with_views(
        """SELECT lib_id, species_matrix_type, sample_set_id, task_id, IS1, IS2, CAST(NULL AS DOUBLE) AS RS1, ES_1
        FROM predictors WHERE lib_id < 2
        UNION ALL SELECT lib_id, species_matrix_type, sample_set_id, task_id, IS1, CAST(NULL AS DOUBLE), RS1, CAST(NULL AS DOUBLE)
        FROM predictors WHERE lib_id >= 2""",
        "predictors",
    ),
)
def _(spark, sf):
    p = view(spark, sf, "predictors")
    first = p.where("lib_id < 2").drop("RS1")
    second = p.where("lib_id >= 2").drop("IS2", "ES_1")
    return P.unify([first, second])


@query(
    "P6_production_projection",
    with_views(
        """, attached AS (
          SELECT r.*, m.chemical_id, c.compound_class FROM raw_peaks r
          LEFT JOIN lib_map m ON r.lib_id = m.lib_id AND r.correct = m.comp_id
          LEFT JOIN class_map c ON m.chemical_id = c.chem_id)
        SELECT a.sample_set_id AS sampleset_id, worksheet_id, task_id, s.species, s.species_cluster,
               coalesce(chemical_id, -1) AS compound, coalesce(compound_class, -1) AS compound_class,
               correct AS comp_id, apex_rt AS rt, fit_scores
        FROM attached a JOIN species_map s ON a.sample_set_id = s.sample_set_id""",
        "raw_peaks", "lib_map", "class_map", "species_map",
    ),
)
def _(spark, sf):
    peaks = P.standard_names(view(spark, sf, "raw_peaks"))
    attached = P.attach_chemistry(peaks, view(spark, sf, "lib_map"), view(spark, sf, "class_map"))
    species = view(spark, sf, "species_map").select("sample_set_id", "species", "species_cluster")
    mapped = P.require_match(attached, species, ["sample_set_id"])
    reserved = [*P.PRODUCTION_RESERVED, "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    return P.production_rows(mapped, P.numeric_covariates(mapped.schema, reserved))


@query(
    "P8_feature_cleanup",
    with_views(
        """SELECT species, count(*) AS n_rows, round(sum(coalesce(nullif(IS1, 7e0), 0e0)), 4) AS sum_is1
        FROM obs GROUP BY species""",
        "obs",
    ),
)
def _(spark, sf):
    # sevens play the unusable readings: half of them arrive as NaN, the others as NULL
    gappy = view(spark, sf, "obs").withColumn(
        "IS1",
        F.when(F.col("IS1") != 7, F.col("IS1")).when(F.col("RS1") > 0.05, F.lit(float("nan"))),
    )
    filled = P.fill_features(gappy, ["IS1"])
    out = filled.groupBy("species").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("IS1").alias("sum_is1"))
    return rounded(out, 4)


@query(
    "P9_conditional_zero_mask",
    with_views(
        """SELECT o.species_cluster, count(*) AS n_rows,
          round(sum(CASE WHEN m.species_group_raw LIKE '2 %' THEN ES_1 ELSE 0e0 END), 4) AS sum_es
        FROM obs o JOIN species_map m ON o.sampleset_id = m.sample_set_id GROUP BY 1""",
        "obs", "species_map",
    ),
)
def _(spark, sf):
    flags = P.species_attributes(view(spark, sf, "species_map"), reference_group=2)
    rows = view(spark, sf, "obs").withColumnRenamed("sampleset_id", "sample_set_id")
    rows = P.lookup_join(rows, flags.select("sample_set_id", "is_reference_group"), ["sample_set_id"], "left")
    masked = P.mask_optional(rows, ["ES_1"], F.coalesce("is_reference_group", F.lit(False)))
    out = masked.groupBy("species_cluster").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("ES_1").alias("sum_es"))
    return rounded(out, 4)


@query(
    "P10_row_validation",
    with_views(
        """SELECT count(*) AS n_rows,
           count(*) FILTER (WHERE chemical_id IS NULL) AS null_chemical_id,
           count(*) FILTER (WHERE apex_rt IS NULL OR isnan(apex_rt) OR isinf(apex_rt)) AS not_finite_apex_rt
        FROM raw_peaks r LEFT JOIN lib_map m ON r.lib_id = m.lib_id AND r.correct = m.comp_id""",
        "raw_peaks", "lib_map",
    ),
)
def _(spark, sf):
    peaks = P.standard_names(view(spark, sf, "raw_peaks"))
    rows = P.lookup_join(peaks, view(spark, sf, "lib_map"), ["lib_id", "comp_id"], "left")
    return P.row_problems(rows, ["chemical_id"], ["apex_rt"])


@query(
    "P11_hashed_hold_out",
    with_views(
        f"""SELECT species_cluster, comp_id, count(*) AS n_rows FROM obs
        WHERE NOT ({fraction_sql(['species_cluster', 'comp_id'], 42)} < 2e-1) GROUP BY 1, 2""",
        "obs",
    ),
)
def _(spark, sf):
    out = P.hold_out(view(spark, sf, "obs"), ["species_cluster", "comp_id"], 0.2, seed=42)
    return out.groupBy("species_cluster", "comp_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "P12_cluster_exclusion",
    with_views(
        "SELECT species_cluster, species, count(*) AS n_rows FROM obs WHERE species_cluster NOT IN (1, 3) GROUP BY 1, 2",
        "obs",
    ),
)
def _(spark, sf):
    out = P.exclude_clusters(view(spark, sf, "obs"), [1, 3])
    return out.groupBy("species_cluster", "species").agg(F.count(F.lit(1)).alias("n_rows"))


SPLIT_SQL = """SELECT s_suppkey AS sample_set_id, CAST(n_regionkey AS BIGINT) AS lib,
    CASE WHEN s_acctbal < 2e3 THEN 'test' ELSE 'train' END AS fold
    FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


def _split(spark, sf):
    s = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    return s.select(
        F.col("s_suppkey").alias("sample_set_id"), F.col("n_regionkey").cast("long").alias("lib"),
        F.when(F.col("s_acctbal") < 2000, "test").otherwise("train").alias("fold"),
    )


@query(
    "P13_test_fold_filter",
    with_views(
        f""", split AS ({SPLIT_SQL}) SELECT sample_set_id, task_id, count(*) AS n_rows FROM raw_peaks
        WHERE sample_set_id IN (SELECT sample_set_id FROM split WHERE fold = 'test' AND lib = 2) GROUP BY 1, 2""",
        "raw_peaks",
    ),
)
def _(spark, sf):
    rows = P.fold_rows(view(spark, sf, "raw_peaks"), _split(spark, sf), lib=2)
    return rows.groupBy("sample_set_id", "task_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "P16_species_source_column",
    with_views(
        """SELECT species_cluster, CASE WHEN species_cluster % 2 = 0 THEN species_raw ELSE species_group_raw END AS species_text,
        count(*) AS n_sets FROM species_map GROUP BY 1, 2""",
        "species_map",
    ),
)
def _(spark, sf):
    m = view(spark, sf, "species_map").withColumn("species_name", F.col("species_raw"))
    source = {lib: "species_group_raw" if lib % 2 else "Species Name" for lib in range(5)}
    parts = [P.raw_species(m.where(F.col("species_cluster") == lib), lib, source) for lib in source]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy("species_cluster", F.col("species_raw").alias("species_text")).agg(
        F.count(F.lit(1)).alias("n_sets")
    )


@query(
    "P19_ordered_row_limit",
    "SELECT DISTINCT p_partkey AS comp_id FROM part ORDER BY comp_id LIMIT 100",
)
def _(spark, sf):
    ids = table(spark, sf, "part").select(F.col("p_partkey").alias("comp_id")).distinct()
    return P.first_rows(ids, ["comp_id"], 100)


def _unseen_sql(mode):
    unit = "species" if mode == "species" else "species, comp_id"
    keys = unit.split(", ")
    guard = (
        "SELECT 1 FROM units r WHERE NOT r.held AND r.species_cluster = u.species_cluster"
        if mode == "species"
        else None
    )
    exists = (
        f"EXISTS ({guard})"
        if guard
        else "EXISTS (SELECT 1 FROM units r WHERE NOT r.held AND r.species_cluster = u.species_cluster) "
        "AND EXISTS (SELECT 1 FROM units r WHERE NOT r.held AND r.comp_id = u.comp_id)"
    )
    return with_views(
        f""", units AS (SELECT species_cluster, {unit}, count(*) AS n_rows, {fraction_sql(keys, 42)} < 2e-1 AS held
            FROM obs GROUP BY ALL)
        SELECT species_cluster, {unit}, n_rows, CASE WHEN held AND {exists} THEN 'held' ELSE 'train' END AS part FROM units u""",
        "obs",
    )


def _unseen(mode):
    unit = ["species"] if mode == "species" else ["species", "comp_id"]

    def run(spark, sf):
        train, held = P.unseen_group_split(view(spark, sf, "obs"), mode)
        count = lambda df, name: df.groupBy("species_cluster", *unit).agg(
            F.count(F.lit(1)).alias("n_rows")
        ).withColumn("part", F.lit(name))
        return count(train, "train").unionByName(count(held, "held"))

    return run


query("P20_unseen_species_split", _unseen_sql("species"))(_unseen("species"))
query("P20_unseen_pair_split", _unseen_sql("pair"))(_unseen("pair"))


# -- joins -----------------------------------------------------------------------------------


@query(
    "J1_predictor_merge",
    with_views(
        f"""SELECT r.lib_id, r.sample_set_id, r.task_id, r.species_matrix_type, l_orderkey, l_linenumber, l_partkey,
          l_extendedprice, r.worksheet_id, correct AS comp_id, cpd_status, sample_type, apex_rt, worksheet_id AS batch,
          IS1, IS2, RS1, ES_1
        FROM raw_peaks r JOIN predictors p ON r.lib_id = p.lib_id AND r.sample_set_id = p.sample_set_id
          AND r.task_id = p.task_id AND r.species_matrix_type = p.species_matrix_type WHERE {USABLE}""",
        "raw_peaks", "predictors",
    ),
)
def _(spark, sf):
    return P.merge_training(view(spark, sf, "raw_peaks"), view(spark, sf, "predictors"))


def _attach_sql(where):
    return with_views(
        f"""SELECT lib_id, comp_id, chemical_id, compound_class, count(*) AS n_rows FROM (
          SELECT r.lib_id, r.correct AS comp_id, {'m.chemical_id, c.compound_class' if where else
          'coalesce(m.chemical_id, -1) AS chemical_id, coalesce(c.compound_class, -1) AS compound_class'}
          FROM raw_peaks r LEFT JOIN lib_map m ON r.lib_id = m.lib_id AND r.correct = m.comp_id
          LEFT JOIN class_map c ON m.chemical_id = c.chem_id {where}) t GROUP BY 1, 2, 3, 4""",
        "raw_peaks", "lib_map", "class_map",
    )


def _attach(drop):
    def run(spark, sf):
        peaks = P.standard_names(view(spark, sf, "raw_peaks"))
        out = P.attach_chemistry(peaks, view(spark, sf, "lib_map"), view(spark, sf, "class_map"), drop)
        return out.groupBy("lib_id", "comp_id", "chemical_id", "compound_class").agg(
            F.count(F.lit(1)).alias("n_rows")
        )

    return run


query("J2_attach_chemistry_fill", _attach_sql(""))(_attach(False))
query(
    "J2_attach_chemistry_drop",
    _attach_sql("WHERE m.chemical_id IS NOT NULL AND c.compound_class IS NOT NULL"),
)(_attach(True))


@query(
    "J3_total_match_join",
    with_views(
        """SELECT r.sample_set_id, s.species, s.species_cluster, count(*) AS n_rows
        FROM raw_peaks r JOIN species_map s ON r.sample_set_id = s.sample_set_id GROUP BY 1, 2, 3""",
        "raw_peaks", "species_map",
    ),
)
def _(spark, sf):
    dim = view(spark, sf, "species_map").select("sample_set_id", "species", "species_cluster")
    rows = P.require_match(view(spark, sf, "raw_peaks"), dim, ["sample_set_id"])
    return rows.groupBy("sample_set_id", "species", "species_cluster").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "J4_known_class_compounds",
    with_views(
        """SELECT DISTINCT lib_id, comp_id FROM lib_map WHERE chemical_id IN
        (SELECT chem_id FROM class_map WHERE compound_class IS NOT NULL)""",
        "lib_map", "class_map",
    ),
)
def _(spark, sf):
    return P.known_class_compounds(view(spark, sf, "lib_map"), view(spark, sf, "class_map"))


@query(
    "J5_species_lookup_filter",
    with_views(
        """SELECT s.species, r.correct AS comp_id, count(*) AS n_rows FROM raw_peaks r
        JOIN species_map s ON r.sample_set_id = s.sample_set_id WHERE s.species_cluster <> 4 GROUP BY 1, 2""",
        "raw_peaks", "species_map",
    ),
)
def _(spark, sf):
    m = view(spark, sf, "species_map").where("species_cluster <> 4")
    rows = P.with_species(P.standard_names(view(spark, sf, "raw_peaks")), m)
    return rows.groupBy("species", "comp_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "J6_map_audit",
    with_views(
        """, m AS (SELECT sample_set_id FROM species_map WHERE species_cluster <> 4
             UNION ALL SELECT -1 - CAST(r_regionkey AS BIGINT) FROM region)
        SELECT DISTINCT sample_set_id, 'not in map' AS problem FROM raw_peaks WHERE sample_set_id NOT IN (SELECT sample_set_id FROM m)
        UNION ALL SELECT sample_set_id, 'unused' FROM m WHERE sample_set_id NOT IN (SELECT sample_set_id FROM raw_peaks)""",
        "raw_peaks", "species_map",
    ),
)
def _(spark, sf):
    m = view(spark, sf, "species_map").where("species_cluster <> 4").select("sample_set_id")
    extra = table(spark, sf, "region").selectExpr("-1 - CAST(r_regionkey AS BIGINT) AS sample_set_id")
    return P.map_audit(view(spark, sf, "raw_peaks"), m.unionByName(extra))


@query(
    "J9_supercategory_key",
    with_views(
        """SELECT CAST(regexp_extract(species_group_raw, '^\\s*(\\d+)', 1) AS BIGINT) AS supercategory, count(*) AS n_rows
        FROM raw_peaks r JOIN species_map s ON r.sample_set_id = s.sample_set_id
        WHERE regexp_extract(species_group_raw, '^\\s*(\\d+)', 1) <> '' GROUP BY 1""",
        "raw_peaks", "species_map",
    ),
)
def _(spark, sf):
    rows = P.attach_supercategory(view(spark, sf, "raw_peaks"), view(spark, sf, "species_map"))
    return rows.groupBy("supercategory").agg(F.count(F.lit(1)).alias("n_rows"))


CANONICAL_SQL = """, mapped AS (SELECT comp_id, compound AS chem_id, CAST(l_quantity AS BIGINT) % 3 AS compound_class
    FROM (SELECT comp_id, compound, IS1 AS l_quantity FROM obs) t),
  pairs AS (SELECT comp_id, chem_id, compound_class, count(*) AS n_rows FROM mapped GROUP BY 1, 2, 3),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY comp_id ORDER BY n_rows DESC, chem_id, compound_class) AS rn,
     count(*) OVER (PARTITION BY comp_id) AS n_mappings, CAST(sum(n_rows) OVER (PARTITION BY comp_id) AS BIGINT) AS total FROM pairs)"""


def _mapped(spark, sf):
    return view(spark, sf, "obs").select(
        "comp_id", F.col("compound").alias("chem_id"), (F.col("IS1").cast("long") % 3).alias("compound_class")
    )


@query(
    "A7_mode_per_compound",
    with_views(
        f"{CANONICAL_SQL} SELECT comp_id, chem_id, compound_class, n_mappings, total AS n_rows FROM ranked WHERE rn = 1",
        "obs",
    ),
)
def _(spark, sf):
    return P.canonical_chemistry(_mapped(spark, sf))


@query(
    "A7_mapping_collisions",
    with_views(
        f"{CANONICAL_SQL} SELECT comp_id, chem_id, compound_class, n_rows FROM ranked WHERE n_mappings > 1", "obs"
    ),
)
def _(spark, sf):
    return P.mapping_collisions(_mapped(spark, sf))


@query(
    "W3_most_frequent",
    """SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n,
       row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY 1, 2) t WHERE rn = 1""",
)
def _(spark, sf):
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "event_type", "n")).alias("b"))
    return best.select("user_id", "b.event_type", "b.n")


@query(
    "J17_canonical_metadata",
    with_views(
        f"""{CANONICAL_SQL}, best AS (SELECT comp_id, chem_id, compound_class FROM ranked WHERE rn = 1 AND chem_id < 15),
        g AS (SELECT DISTINCT species_cluster, comp_id FROM obs)
        SELECT g.species_cluster, g.comp_id, coalesce(chem_id, -1) AS chem_id, coalesce(compound_class, -1) AS compound_class
        FROM g LEFT JOIN best ON g.comp_id = best.comp_id""",
        "obs",
    ),
)
def _(spark, sf):
    canonical = P.canonical_chemistry(_mapped(spark, sf)).where("chem_id < 15")
    groups = view(spark, sf, "obs").select("species_cluster", "comp_id").distinct()
    return P.attach_canonical(groups, canonical)


@query(
    "J18_species_attributes",
    with_views(
        """SELECT sample_set_id, species_group_raw AS group_label, species_raw,
          TRY_CAST(regexp_extract(species_group_raw, '^\\s*(\\d+)', 1) AS BIGINT) AS supercategory,
          species_group_raw LIKE '2 %' AS is_reference_group FROM species_map""",
        "species_map",
    ),
)
def _(spark, sf):
    return P.species_attributes(view(spark, sf, "species_map"), reference_group=2)


@query("A6_nesting_check", "SELECT n_nationkey AS species, min(n_regionkey) AS species_cluster FROM nation GROUP BY 1")
def _(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("species"), F.col("n_regionkey").alias("species_cluster"))
    return P.parents(n, "species", "species_cluster")


@query(
    "A6_nesting_violations",
    with_views(
        """SELECT comp_id, min(species_cluster) AS first_parent, max(species_cluster) AS last_parent FROM obs
        GROUP BY 1 HAVING min(species_cluster) <> max(species_cluster)""",
        "obs",
    ),
)
def _(spark, sf):
    return P.nesting_violations(view(spark, sf, "obs"), "comp_id", "species_cluster")


# -- sampling, coding, distinct ----------------------------------------------------------------

_SAMPLE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "sampleset_id", PRICE_CENTS]


@query(
    "W1_capped_sample",
    with_views(
        f"""SELECT species, comp_id, l_orderkey, l_linenumber, l_partkey, sampleset_id, price_cents FROM (
          SELECT *, {PRICE_CENTS} AS price_cents, row_number() OVER (PARTITION BY species, comp_id
            ORDER BY {hash_sql(_SAMPLE_KEYS, 42)}, l_orderkey, l_linenumber, l_partkey, sampleset_id) AS rn FROM obs) t
        WHERE rn <= 5""",
        "obs",
    ),
)
def _(spark, sf):
    out = P.capped_sample(_obs(spark, sf), ["species", "comp_id"], 5, ROW_KEY)
    return out.select("species", "comp_id", *ROW_KEY)


@query(
    "W2_dense_codes",
    with_views(
        """SELECT species, comp_id, CAST(dense_rank() OVER (ORDER BY comp_id) - 1 AS BIGINT) AS code FROM
        (SELECT DISTINCT species, comp_id FROM obs) t""",
        "obs",
    ),
)
def _(spark, sf):
    pairs = view(spark, sf, "obs").select("species", "comp_id").distinct()
    return P.encode(pairs, "comp_id", "code")


@query(
    "D8_run_dimension",
    with_views(
        """SELECT sampleset_id, worksheet_id, task_id, min(species) AS species,
        CAST(row_number() OVER (ORDER BY sampleset_id, worksheet_id, task_id) - 1 AS BIGINT) AS run
        FROM obs GROUP BY 1, 2, 3""",
        "obs",
    ),
)
def _(spark, sf):
    from peakloom.plans.ordered import running_totals

    keys = ["sampleset_id", "worksheet_id", "task_id"]
    runs = view(spark, sf, "obs").groupBy(*keys).agg(F.min("species").alias("species"), F.lit(1).alias("_one"))
    return running_totals(runs, [], keys, {"_rank": "_one"}).select(
        *keys, "species", (F.col("_rank") - 1).cast("long").alias("run")
    )


@query(
    "W11_lowest_count",
    with_views("SELECT comp_id, count(*) AS n_rows FROM obs GROUP BY 1 ORDER BY n_rows, comp_id LIMIT 8", "obs"),
)
def _(spark, sf):
    return P.lowest_count(view(spark, sf, "obs"), "comp_id", 8)


@query(
    "W12_ordered_output",
    with_views("SELECT lib_id, comp_id, chemical_id FROM lib_map ORDER BY lib_id, comp_id", "lib_map"),
)
def _(spark, sf):
    return view(spark, sf, "lib_map").orderBy("lib_id", "comp_id")


@query(
    "U2_id_set_difference",
    """SELECT p_partkey AS comp_id FROM part EXCEPT SELECT event_id % 997 FROM events""",
)
def _(spark, sf):
    have = table(spark, sf, "events").selectExpr("event_id % 997 AS comp_id").distinct()
    ids = table(spark, sf, "part").select(F.col("p_partkey").alias("comp_id")).distinct()
    return ids.join(have, ["comp_id"], "left_anti")


@query(
    "U5_first_per_key",
    """SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
    FROM events) t WHERE rn = 1""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return P.first_per_key(e, ["user_id"], ["ts", "event_id"])


# -- scalar functions ----------------------------------------------------------------------------


@query(
    "F1_packed_key",
    with_views(
        """SELECT DISTINCT (species << 32) + comp_id AS group_key, species AS group_id, comp_id AS unpacked FROM obs""", "obs"
    ),
)
def _(spark, sf):
    pairs = view(spark, sf, "obs").select("species", "comp_id").distinct()
    keyed = P.with_packed_key(pairs, "species", "comp_id")
    return keyed.select(
        "group_key", V.unpack_group("group_key").alias("group_id"), V.unpack_compound("group_key").alias("unpacked")
    )


@query(
    "F8_matrix_category",
    with_views(
        """SELECT sample_set_id, CASE WHEN lower(species_group_raw) LIKE '%blood%' THEN 'blood'
          WHEN lower(species_group_raw) LIKE '%urine%' THEN 'urine'
          WHEN lower(species_group_raw) LIKE '%cells%' OR lower(species_group_raw) LIKE '%plants%' THEN 'cells'
          ELSE 'other' END AS category FROM species_map""",
        "species_map",
    ),
)
def _(spark, sf):
    return view(spark, sf, "species_map").select(
        "sample_set_id", V.matrix_category("species_group_raw").alias("category")
    )


@query(
    "F9_leading_integer",
    """SELECT p_partkey, TRY_CAST(regexp_extract(p_size || ' ' || p_name, '^\\s*(\\d+)', 1) AS BIGINT) AS number,
    TRY_CAST(regexp_extract('lib' || p_size || '_x', 'lib(\\d+)', 1) AS BIGINT) AS lib,
    TRY_CAST(regexp_extract(p_name, '^\\s*(\\d+)', 1) AS BIGINT) AS absent FROM part""",
)
def _(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey",
        V.leading_integer(F.concat_ws(" ", F.col("p_size").cast("string"), "p_name")).alias("number"),
        V.library_number(F.concat(F.lit("lib"), F.col("p_size").cast("string"), F.lit("_x"))).alias("lib"),
        V.leading_integer("p_name").alias("absent"),
    )


@query(
    "F10_F11_quadratic_features",
    with_views(
        """SELECT species, count(*) AS n_rows, round(sum(IS1*IS1), 3) AS sum_sq_is1, round(sum(RS1*RS1), 3) AS sum_sq_rs1,
        round(sum(IS1*RS1), 3) AS sum_is1_rs1 FROM obs GROUP BY 1""",
        "obs",
    ),
)
def _(spark, sf):
    obs = view(spark, sf, "obs")
    names = V.quadratic_names(["IS1", "RS1", "ES_1"])
    labels = dict(zip(names, ["sum_sq_is1", "sum_sq_rs1", "sum_is1_rs1"], strict=True))
    out = obs.groupBy("species").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.sum(V.feature_value(n, obs.columns)).alias(a) for n, a in labels.items()],
    )
    return rounded(out, 3)


@query(
    "F24_json_path_default",
    """SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k,
    coalesce(json_extract_string(props, '$.absent'), 'none') AS absent FROM events""",
)
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("p", F.from_json("props", "k BIGINT, absent STRING"))
    return e.select(
        "event_id", V.nested_value("p", ["k"], -1).alias("k"), V.nested_value("p", ["absent"], "none").alias("absent")
    )
