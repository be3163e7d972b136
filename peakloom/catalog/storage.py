"""Catalogue queries: sources and sinks, run on tables derived from the given ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakloom.catalog.inputs import kept, table, view, with_views
from peakloom.catalog.preparation import _mapped, CANONICAL_SQL
from peakloom.catalog.registry import query, rounded
from peakloom.functions import values as V
from peakloom.operators import preparation as P
from peakloom.plans.durable import scratch_path
from peakloom.sources import scans, sinks

_paths: dict[tuple[str, str, str], str] = {}


def _stored(spark, sf, name, write):
    """Folder of a derived file set, written once per session."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _paths:
        path = scratch_path(spark, name)
        write(path)
        _paths[key] = path
    return _paths[key]


def _peak_shards(spark, sf):
    return _stored(
        spark, sf, "peak_shards",
        lambda p: sinks.write_sharded(view(spark, sf, "raw_peaks"), p, ["lib_id", "species_matrix_type"]),
    )


def _predictor_shards(spark, sf):
    return _stored(
        spark, sf, "predictor_shards",
        lambda p: sinks.write_sharded(view(spark, sf, "predictors"), p, ["lib_id", "species_matrix_type"]),
    )


COUNT_BY_PARTITION = "SELECT CAST(lib_id AS INTEGER) AS lib_id, species_matrix_type, count(*) AS n_rows FROM {} GROUP BY 1, 2"


@query("S1_partition_discovery", with_views(COUNT_BY_PARTITION.format("raw_peaks"), "raw_peaks"))
def _(spark, sf):
    return scans.list_partitions(spark, _peak_shards(spark, sf), ["lib_id", "species_matrix_type"])


@query(
    "S2_scan_skipping_corrupt",
    with_views(
        "SELECT correct, count(*) AS n_rows, round(sum(apex_rt), 3) AS sum_rt FROM raw_peaks GROUP BY 1", "raw_peaks"
    ),
)
def _(spark, sf):
    """The tree holds a file that is no Parquet."""

    def write(path):
        # one write of the tree; a copy of the shards would be written and read a second time
        sinks.write_sharded(view(spark, sf, "raw_peaks"), path, ["lib_id", "species_matrix_type"])
        one = spark.read.parquet(path).select("lib_id", "species_matrix_type").first()
        broken = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/lib_id={one[0]}/species_matrix_type={one[1]}/zz-broken.parquet")
        out = broken.getFileSystem(spark._jsc.hadoopConfiguration()).create(broken)
        out.write(bytearray(b"this is no parquet file"))
        out.close()

    df = scans.scan_peaks(spark, _stored(spark, sf, "broken_tree", write), skip_corrupt=True)
    return rounded(df.groupBy("correct").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("apex_rt").alias("sum_rt")), 3)


@query(
    "S3_predictor_scan",
    with_views(
        """SELECT CAST(lib_id AS INTEGER) AS lib_id, species_matrix_type, sample_set_id, task_id, IS1, IS2, RS1, ES_1, rt_pred
        FROM predictors WHERE lib_id = 2""",
        "predictors",
    ),
)
def _(spark, sf):
    return scans.scan_partition(spark, _predictor_shards(spark, sf), lib_id=2)


@query(
    "S4_pruned_scan",
    with_views("SELECT DISTINCT sample_set_id, correct FROM raw_peaks", "raw_peaks"),
)
def _(spark, sf):
    return scans.scan_peaks(spark, _peak_shards(spark, sf), ["sample_set_id", "correct"]).distinct()


OBS_CSV = "species BIGINT, species_cluster BIGINT, comp_id BIGINT, IS1 DOUBLE, RS1 DOUBLE, rt DOUBLE"


def _obs_csv(spark, sf):
    cols = ["species", "species_cluster", "comp_id", "IS1", "RS1", "rt"]
    return _stored(spark, sf, "obs_csv", lambda p: sinks.write_csv(view(spark, sf, "obs").select(*cols), p))


@query(
    "S5_csv_scan",
    with_views(
        "SELECT species, comp_id, count(*) AS n_rows, round(sum(IS1), 3) AS sum_is1 FROM obs GROUP BY 1, 2", "obs"
    ),
)
def _(spark, sf):
    df = scans.scan_csv(spark, _obs_csv(spark, sf), OBS_CSV, ["species", "comp_id", "IS1"])
    scans.require_columns(df, ["species", "comp_id", "IS1"])
    return rounded(df.groupBy("species", "comp_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("IS1").alias("sum_is1")), 3)


@query("S7_structure_scan", "SELECT p_partkey AS chem_id, p_name AS smiles FROM part WHERE p_brand <> 'Brand#1'")
def _(spark, sf):
    rows = table(spark, sf, "part").selectExpr(
        "p_partkey AS chem_id", "CASE WHEN p_brand = 'Brand#1' THEN NULL ELSE p_name END AS smiles"
    )
    path = _stored(
        spark, sf, "structures",
        lambda p: rows.write.option("header", True).option("sep", "\t").csv(p),
    )
    return scans.scan_structures(spark, path)


@query(
    "S8_library_metadata",
    """SELECT CAST(p_size AS BIGINT) AS lib_id, p_partkey % 997 AS comp_id, min(p_partkey) AS chemical_id FROM part
    WHERE p_partkey % 997 IN (SELECT l_partkey FROM lineitem) GROUP BY 1, 2""",
)
def _(spark, sf):
    source = table(spark, sf, "part").selectExpr(
        "CAST(p_size AS BIGINT) AS lib_id", "p_partkey % 997 AS comp_id", "p_partkey AS chemical_id"
    )
    return scans.library_metadata(source, table(spark, sf, "lineitem").select(F.col("l_partkey").alias("comp_id")))


def _summaries(spark, sf):
    rows = (
        table(spark, sf, "events").groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("v"), F.count_if(F.col("event_type") == "error").alias("e"))
        .select(
            F.struct(F.col("user_id").alias("seed"), F.lit("hybrid").alias("acquisition")).alias("config"),
            F.struct(F.col("n").alias("n_peaks")).alias("dataset"),
            F.struct(F.struct(F.col("v").alias("precision")).alias("metrics")).alias("active_learning"),
            F.struct(F.when(F.col("e") > 15, F.col("e")).alias("clicks_to_recall_ratio")).alias("random"),
        )
    )
    return _stored(spark, sf, "summaries", lambda p: rows.write.json(p))


SUMMARY_SQL = """SELECT user_id AS seed, 'hybrid' AS acquisition, count(*) AS n_peaks, max(value) AS al_precision,
    CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 15 THEN count(*) FILTER (WHERE event_type = 'error') END AS rand_clicks_to_ratio,
    CAST(NULL AS DOUBLE) AS al_recall FROM events GROUP BY user_id"""
SUMMARY_COLUMNS = ["seed", "acquisition", "n_peaks", "al_precision", "rand_clicks_to_ratio", "al_recall"]


@query("S9_nested_json_scan", SUMMARY_SQL)
def _(spark, sf):
    return scans.scan_summaries(spark, _summaries(spark, sf), multi_line=False).select(*SUMMARY_COLUMNS)


@query("L5_experiment_table", SUMMARY_SQL + " ORDER BY seed")
def _(spark, sf):
    rows = scans.scan_summaries(spark, _summaries(spark, sf), multi_line=False)
    return scans.experiment_table(rows).select(*SUMMARY_COLUMNS)


def _results(spark, sf):
    """Result files of two models per library, as a run would leave them."""

    def write(path):
        obs = view(spark, sf, "obs")
        bins = obs.groupBy("species_cluster", "comp_id").agg(
            F.count(F.lit(1)).alias("n"), F.avg("IS1").alias("m"), F.max("rt").alias("x")
        ).withColumn("support_bin", V.support_bin("n"))
        by_bin = bins.groupBy("species_cluster", "support_bin").agg(
            F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_obs_test"), F.max("m").alias("rmse"), F.max("x").alias("mae")
        )
        both = by_bin.groupBy("species_cluster").agg(
            F.lit("species_cluster").alias("group_col"), F.sum("n_obs_test").alias("n_test"),
            F.struct(F.max("rmse").alias("rmse"), F.min("mae").alias("mae")).alias("metrics"),
            F.collect_list(F.struct("support_bin", "n_groups", "n_obs_test", "rmse", "mae")).alias("support_metrics"),
        ).persist()
        for lib in range(5):
            for folder in ("features_none/ridge", "baseline"):
                both.where(F.col("species_cluster") == lib).drop("species_cluster").coalesce(1).write.json(
                    f"{path}/lib{lib}/cap100/{folder}/results"
                )
        both.unpersist()

    return _stored(spark, sf, "results", write)


RESULT_BINS = """, bins AS (SELECT species_cluster AS lib, comp_id, count(*) AS n, avg(IS1) AS m, max(rt) AS x FROM obs GROUP BY 1, 2),
  by_bin AS (SELECT lib, CASE WHEN n <= 1 THEN 0 WHEN n <= 2 THEN 1 WHEN n <= 5 THEN 2 WHEN n <= 10 THEN 3 WHEN n <= 20 THEN 4
     WHEN n <= 50 THEN 5 WHEN n <= 100 THEN 6 ELSE 7 END AS bin_idx, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_obs_test,
     max(m) AS rmse, max(x) AS mae FROM bins GROUP BY 1, 2),
  kinds AS (SELECT 'ridge' AS model, CAST(100 AS BIGINT) AS cap UNION ALL SELECT 'baseline', 100)"""


@query(
    "S10_artifact_tree_scan",
    with_views(
        RESULT_BINS + """ SELECT lib, cap, 'none' AS anchor, model, 'species_cluster' AS group_col, CAST(sum(n_obs_test) AS BIGINT) AS n_test,
        round(max(rmse), 6) AS rmse, round(min(mae), 6) AS mae FROM by_bin, kinds GROUP BY 1, 2, 4""",
        "obs",
    ),
)
def _(spark, sf):
    m = scans.result_metrics(scans.scan_results(spark, _results(spark, sf), multi_line=False))
    return rounded(m.select("lib", "cap", "anchor", "model", "group_col", "n_test", "rmse", "mae"))


@query(
    "S11_support_metrics_explode",
    with_views(
        RESULT_BINS + """ SELECT lib, cap, 'none' AS anchor, model, CAST(bin_idx AS INTEGER) AS bin_idx, n_groups, n_obs_test,
        round(rmse, 6) AS rmse, round(mae, 6) AS mae FROM by_bin, kinds""",
        "obs",
    ),
)
def _(spark, sf):
    s = scans.support_metrics(scans.scan_results(spark, _results(spark, sf), multi_line=False))
    s = s.withColumn("bin_idx", F.col("bin_idx").cast("int"))
    return rounded(s.select("lib", "cap", "anchor", "model", "bin_idx", "n_groups", "n_obs_test", "rmse", "mae"))


@query(
    "R1_model_comparison",
    with_views(
        RESULT_BINS + """, t AS (SELECT lib, cap, 'none' AS anchor, model, CAST(sum(n_obs_test) AS BIGINT) AS n_test, max(rmse) AS rmse
          FROM by_bin, kinds GROUP BY 1, 2, 4)
        SELECT lib, cap, anchor, model, CASE model WHEN 'ridge' THEN 'Group ridge' ELSE 'Fixed window' END AS label, n_test, round(rmse, 6) AS rmse FROM t""",
        "obs",
    ),
)
def _(spark, sf):
    from peakloom.operators.reports import model_comparison

    m = scans.result_metrics(scans.scan_results(spark, _results(spark, sf), multi_line=False))
    ridge, base = m.where("model = 'ridge'"), m.where("model <> 'ridge'").drop("group_col")
    out = model_comparison([ridge, base], [("none", "ridge", "Group ridge"), ("none", "baseline", "Fixed window")])
    return rounded(out.select("lib", "cap", "anchor", "model", "label", "n_test", "rmse"))


@query(
    "S12_log_scan",
    """SELECT 'lib' || user_id || '_cap100' AS log, round(CAST(value AS DOUBLE), 2) AS train_elapsed_min FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_type <> 'error') t WHERE rn = 1""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    line = F.when(F.col("event_type") == "error", F.lit("no progress")).otherwise(
        F.concat(F.lit("step "), F.col("event_id").cast("string"), F.lit(" elapsed_min="), F.format_string("%.2f", "value"))
    )
    lines = e.select(
        F.concat(F.lit("lib"), F.col("user_id").cast("string"), F.lit("_cap100.train.log")).alias("log"), "event_id", line.alias("value")
    )
    path = _stored(
        spark, sf, "logs",
        lambda p: lines.repartition("log").sortWithinPartitions("log", "event_id").select("log", "value").write.partitionBy("log").text(p),
    )
    out = scans.scan_train_minutes(spark, path)
    return rounded(out.withColumn("log", F.regexp_replace("log", "^log=", "")), 2)


def _bundle(spark, sf):
    """Window models per supercategory from grouped means; the second one lacks a feature."""

    def write(path):
        g = view(spark, sf, "obs").groupBy("species_cluster", "comp_id").agg(
            F.avg("rt").alias("b"), (F.max("RS1") / 10).alias("window"),
            F.round(F.avg("IS1") / 1000, 6).alias("IS1"), F.round(F.avg("RS1"), 6).alias("RS1"), F.count(F.lit(1)).alias("n"),
        ).withColumn("window", F.when(F.col("n") > 30, F.col("window"))).persist()
        for s in range(1, 6):
            cols = ["comp_id", "b", "window", "IS1"] + (["RS1"] if s != 2 else [])
            g.where(F.col("species_cluster") == s - 1).select(*cols).coalesce(1).write.option("header", True).csv(
                f"{path}/supercategory_{s}_x/regression_7.csv"
            )
        g.unpersist()

    return _stored(spark, sf, "bundle", write)


BUNDLE_SQL = """, g AS (SELECT species_cluster + 1 AS supercategory, comp_id, avg(rt) AS b, max(RS1) / 10e0 AS win,
    round(avg(IS1) / 1000e0, 6) AS is1, round(avg(RS1), 6) AS rs1, count(*) AS n FROM obs GROUP BY 1, 2),
  bundle AS (SELECT supercategory, comp_id, b, win, is1, CASE WHEN supercategory <> 2 THEN rs1 END AS rs1 FROM g
    WHERE n > 30)"""


@query(
    "S13_model_bundle_scan",
    with_views(
        BUNDLE_SQL + """ SELECT supercategory, comp_id, round(b, 6) AS b, round(win, 6) AS "window", 'IS1' AS feature, is1 AS coef FROM bundle
        UNION ALL SELECT supercategory, comp_id, round(b, 6), round(win, 6), 'RS1', rs1 FROM bundle WHERE rs1 IS NOT NULL""",
        "obs",
    ),
)
def _(spark, sf):
    return rounded(scans.scan_bundle(spark, _bundle(spark, sf), 7))


@query("S15_embedding_scan", "SELECT vec_id, len(embedding) AS width, label FROM embeddings")
def _(spark, sf):
    df = scans.scan_embeddings(spark, f"{sf}/embeddings.parquet", "embedding", 64)
    return df.select("vec_id", F.size("embedding").cast("long").alias("width"), "label")


def _diagnostics(spark, sf):
    def write(path):
        obs = view(spark, sf, "obs")
        d = obs.groupBy("species", "comp_id").agg(F.avg("rt").alias("score")).selectExpr(
            "species AS sample_set_id", "1L AS lib_id", "comp_id", "score")
        # a folder per sample set, whose files still hold its number
        d.withColumn("set", F.col("sample_set_id")).repartition("set").write.partitionBy("set").parquet(f"{path}/compounds")
        obs.groupBy("species", "comp_id", "task_id").agg(F.count(F.lit(1)).alias("n")).selectExpr(
            "species AS sample_set_id", "1L AS lib_id", "comp_id", "task_id", "n").write.parquet(f"{path}/tasks")

    return _stored(spark, sf, "diagnostics", write)


@query(
    "S16_diagnostics_scan",
    with_views(
        """, c AS (SELECT species AS sample_set_id, comp_id, round(avg(rt), 6) AS score FROM obs GROUP BY 1, 2),
        t AS (SELECT species AS sample_set_id, comp_id, task_id, count(*) AS n FROM obs GROUP BY 1, 2, 3)
        SELECT c.sample_set_id, CAST(1 AS BIGINT) AS lib_id, c.comp_id, score, task_id, n FROM c
        LEFT JOIN t ON c.sample_set_id = t.sample_set_id AND c.comp_id = t.comp_id""",
        "obs",
    ),
)
def _(spark, sf):
    root = _diagnostics(spark, sf)
    return rounded(scans.scan_diagnostics(spark, f"{root}/compounds/set=*", f"{root}/tasks"))


@query(
    "S17_cap_folder_scan",
    with_views(
        """SELECT species_cluster AS lib, CAST(k.cap AS BIGINT) AS cap, count(*) AS n_rows, count(DISTINCT (species, comp_id)) AS n_pairs
        FROM (SELECT *, row_number() OVER (PARTITION BY species, comp_id ORDER BY l_orderkey, l_linenumber, l_partkey, sampleset_id, l_extendedprice) AS rn FROM obs) o
        JOIN (SELECT 5 AS cap UNION ALL SELECT 10) k ON rn <= k.cap GROUP BY 1, 2""",
        "obs",
    ),
)
def _(spark, sf):
    from peakloom.plans.topk import top_k_per_group

    order = ["l_orderkey", "l_linenumber", "l_partkey", "sampleset_id", "l_extendedprice"]

    def write(path):
        ranked = top_k_per_group(
            view(spark, sf, "obs"), ["species", "comp_id"], [F.col(c) for c in order], 10, order, rank="rn"
        ).persist()
        for lib in range(5):
            rows = ranked.where(F.col("species_cluster") == lib)
            for cap in (5, 10):
                out = rows.where(F.col("rn") <= cap).select("species", "comp_id")
                sinks.write_csv(out.coalesce(1), f"{path}/lib{lib}/cap{cap}/production")
            sinks.write_csv(rows.select("species", "comp_id").coalesce(1), f"{path}/lib{lib}/cap5/older")
            sinks.write_csv(rows.select("species", "comp_id").coalesce(1), f"{path}/lib{lib}/caplarge/production")
        ranked.unpersist()

    root = _stored(spark, sf, "caps", write)
    rows = scans.scan_cap_folders(spark, root, "species BIGINT, comp_id BIGINT")
    return rows.groupBy("lib", "cap").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("species", "comp_id").alias("n_pairs")
    )


@query(
    "S18_support_map_load",
    with_views(
        """SELECT bin_idx, count(*) AS n_groups FROM (SELECT CASE WHEN n <= 1 THEN 0 WHEN n <= 2 THEN 1 WHEN n <= 5 THEN 2
          WHEN n <= 10 THEN 3 WHEN n <= 20 THEN 4 WHEN n <= 50 THEN 5 WHEN n <= 100 THEN 6 ELSE 7 END AS bin_idx
          FROM (SELECT species, comp_id, count(*) AS n FROM obs GROUP BY 1, 2) a) b WHERE bin_idx <> 4 GROUP BY 1""",
        "obs",
    ),
)
def _(spark, sf):
    counts = view(spark, sf, "obs").groupBy(F.col("species").alias("species_cluster"), "comp_id").agg(F.count(F.lit(1)).alias("n"))
    labelled = counts.withColumn("support_bin", F.when(F.col("n").between(11, 20), "unknown").otherwise(V.support_bin("n")))
    packed = P.with_packed_key(labelled, "species_cluster", "comp_id").select("group_key", "support_bin")
    path = _stored(spark, sf, "support_map", lambda p: sinks.write_csv(packed, p))
    loaded = scans.support_map(scans.scan_csv(spark, path, "group_key BIGINT, support_bin STRING"))
    bins = scans.support_map_bins(loaded)
    return bins.select(F.col("bin_idx").cast("int").alias("bin_idx"), "n_groups")


# -- sinks -----------------------------------------------------------------------------------


@query(
    "K1_sharded_sink",
    with_views("SELECT lib_id, species_matrix_type, count(*) AS n_rows, round(sum(apex_rt), 3) AS sum_rt FROM raw_peaks GROUP BY 1, 2", "raw_peaks"),
)
def _(spark, sf):
    def write(path):
        sinks.write_sharded(view(spark, sf, "raw_peaks"), f"{path}/shards", ["species_matrix_type", "lib_id"], 500)
        sinks.write_consolidated(spark.read.parquet(f"{path}/shards"), f"{path}/all")

    df = spark.read.parquet(_stored(spark, sf, "merged", write) + "/all")
    out = df.groupBy(F.col("lib_id").cast("long").alias("lib_id"), "species_matrix_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("apex_rt").alias("sum_rt"))
    return rounded(out, 3)


@query(
    "K2_split_by_key_sink",
    with_views(
        "SELECT CAST(chemical_id AS INTEGER) AS chemical_id, lib_id, comp_id FROM lib_map WHERE chemical_id IS NOT NULL", "lib_map"
    ),
)
def _(spark, sf):
    path = _stored(spark, sf, "by_chemical", lambda p: sinks.write_by_key(view(spark, sf, "lib_map"), p, "chemical_id"))
    return spark.read.parquet(path)


@query("K3_csv_sink", with_views("SELECT comp_id, chemical_id, lib_id FROM lib_map", "lib_map"))
def _(spark, sf):
    cols = ["comp_id", "chemical_id", "lib_id"]
    path = _stored(spark, sf, "map_csv", lambda p: sinks.write_csv(view(spark, sf, "lib_map").select(*cols), p))
    return scans.scan_csv(spark, path, "comp_id BIGINT, chemical_id BIGINT, lib_id BIGINT")


@query(
    "K7_audit_sink",
    with_views(f"{CANONICAL_SQL} SELECT comp_id, chem_id, compound_class, n_rows FROM ranked WHERE n_mappings > 1", "obs"),
)
def _(spark, sf):
    path = _stored(spark, sf, "collisions", lambda p: sinks.write_if_any(P.mapping_collisions(_mapped(spark, sf)), p))
    return scans.scan_csv_if_any(spark, path, "comp_id BIGINT, chem_id BIGINT, compound_class BIGINT, n_rows BIGINT")
