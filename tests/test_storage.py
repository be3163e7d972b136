"""Readers, writers and preparation rules on small files."""

import json

import pytest
from pyspark.sql import functions as F

from peakloom.operators import preparation as P
from peakloom.operators.reports import model_comparison
from peakloom.sources import scans, sinks


def test_corrupt_files_are_skipped_on_request(spark, tmp_path):
    root = str(tmp_path / "peaks")
    sinks.write_sharded(spark.range(100).withColumn("lib_id", F.col("id") % 3), root, ["lib_id"], 10)
    (tmp_path / "peaks" / "lib_id=1" / "broken.parquet").write_bytes(b"PAR1 not a table PAR1")
    assert scans.scan_peaks(spark, root, skip_corrupt=True).count() == 100
    with pytest.raises(Exception):
        scans.scan_peaks(spark, root).select("id").collect()


def test_files_are_bounded(spark, tmp_path):
    root = str(tmp_path / "t")
    sinks.write_sharded(spark.range(100).withColumn("k", F.lit(1)), root, ["k"], 10)
    files = list((tmp_path / "t" / "k=1").glob("*.parquet"))
    assert len(files) >= 10 and all(spark.read.parquet(str(f)).count() <= 10 for f in files)


def test_empty_csv_keeps_its_header(spark, tmp_path):
    path = str(tmp_path / "empty")
    sinks.write_csv(spark.range(0).withColumn("name", F.lit("x")), path)
    text = "".join(p.read_text() for p in (tmp_path / "empty").glob("*.csv"))
    assert text.strip() == "id,name"
    assert scans.scan_csv(spark, path, "id long, name string").count() == 0


def test_audits_are_written_only_when_needed(spark, tmp_path):
    assert not sinks.write_if_any(spark.range(0), str(tmp_path / "a"))
    assert not (tmp_path / "a").exists()
    assert sinks.write_if_any(spark.range(2), str(tmp_path / "b"))


def test_model_defaults(spark, tmp_path):
    model = spark.createDataFrame([(1, 2, [0.1, 0.2])], "species long, comp_id long, beta_hat array<double>")
    sinks.save_model(model, str(tmp_path / "m"), {"features": "IS1", "group": "species"})
    loaded, config = scans_load(spark, tmp_path)
    row = loaded.first()
    assert row["supercat_id"] == -1 and row["beta_cov"] is None and row["group_col"] == "species_cluster"
    assert config.first()["features"] == "IS1"


def scans_load(spark, tmp_path):
    return sinks.load_model(spark, str(tmp_path / "m"))


def test_run_summary(spark, tmp_path):
    folder = tmp_path / "run1"
    folder.mkdir()
    (folder / "summary.json").write_text(json.dumps({
        "config": {"seed": 3, "threshold": 0.8, "acquisition": "hybrid"}, "dataset": {"n_peaks": 10, "mean_candidates": 2.5},
        "active_learning": {"metrics": {"precision": 0.8}}, "random": {"clicks_to_recall_ratio": 80}}, indent=1))
    row = scans.experiment_table(scans.scan_summaries(spark, f"{tmp_path}/*/summary.json")).first()
    assert row["al_precision"] == 0.8 and row["rand_clicks_to_ratio"] == 80 and row["al_recall"] is None
    assert row["seed"] == 3 and row["path"].endswith("/run1")


def test_result_tree(spark, tmp_path):
    doc = {"group_col": "species", "n_test": 4, "n_used": 3, "metrics": {"rmse": 0.5},
           "support_metrics": [{"support_bin": "3-5", "n_groups": 2, "rmse": 0.4}]}
    for sub in ("lib7/cap5/features_all/ridge/results", "lib7/cap5/plain/results", "other/ridge/results"):
        d = tmp_path / sub
        d.mkdir(parents=True)
        (d / "eval.json").write_text(json.dumps(doc, indent=2))
    res = scans.scan_results(spark, str(tmp_path))
    m = {(r["lib"], r["cap"], r["anchor"], r["model"]): r for r in scans.result_metrics(res).collect()}
    assert set(m) == {(7, 5, "all", "ridge"), (7, 5, "none", "plain")}
    assert m[(7, 5, "all", "ridge")]["skipped_missing_group"] == 0
    s = scans.support_metrics(res).collect()
    assert {r["bin_idx"] for r in s} == {2}
    table = model_comparison([scans.result_metrics(res)], [("all", "ridge", "A")])
    assert [r["label"] for r in table.collect()] == ["A"]


def test_train_minutes_take_the_last_line(spark, tmp_path):
    (tmp_path / "lib1_cap5.train.log").write_text("start\nstep elapsed_min=1.50\nelapsed_min=2.25 done\nbye\n")
    assert [tuple(r) for r in scans.scan_train_minutes(spark, str(tmp_path)).collect()] == [("lib1_cap5", 2.25)]


def test_embedding_width_is_checked(spark, tmp_path):
    path = str(tmp_path / "e")
    spark.createDataFrame([(1, [0.0] * 20), (2, [0.0] * 19)], "chem_id long, embedding20 array<float>").write.parquet(path)
    with pytest.raises(Exception, match="20 values"):
        scans.scan_embeddings(spark, path).collect()


def test_diagnostics_must_hold_one_sample_set(spark, tmp_path):
    spark.createDataFrame([(1, 1, 2), (2, 1, 3)], "sample_set_id long, lib_id long, comp_id long").coalesce(1).write.parquet(str(tmp_path / "d"))
    with pytest.raises(ValueError, match="several"):
        scans.scan_diagnostics(spark, str(tmp_path / "d"))


def test_support_map_accepts_both_forms(spark):
    a = spark.createDataFrame([(3 << 32 | 8, "3-5"), (1, "odd")], "group_key long, support_bin string")
    b = spark.createDataFrame([(3, 8, "3-5")], "species_cluster long, comp_id long, support_bin string")
    assert scans.support_map(a).collect() == scans.support_map(b).collect()
    with pytest.raises(ValueError):
        scans.support_map(b.drop("comp_id"))


def test_attach_needs_a_single_library_without_lib_id(spark):
    rows = spark.createDataFrame([(1,), (9,)], "comp_id long")
    classes = spark.createDataFrame([(5, 2)], "chem_id long, compound_class long")
    one = spark.createDataFrame([(7, 1, 5)], "lib_id long, comp_id long, chemical_id long")
    got = {r["comp_id"]: (r["chemical_id"], r["compound_class"]) for r in P.attach_chemistry(rows, one, classes).collect()}
    assert got == {1: (5, 2), 9: (-1, -1)}
    assert P.attach_chemistry(rows, one, classes, drop_unmapped=True).count() == 1
    two = one.unionByName(spark.createDataFrame([(8, 1, 6)], one.schema))
    with pytest.raises(ValueError, match="several libraries"):
        P.attach_chemistry(rows, two, classes)


def test_rules_that_raise(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "k long, x double")
    with pytest.raises(ValueError, match="not_finite_x"):
        P.require_valid_rows(df, ["k"], ["x"])
    with pytest.raises(ValueError, match="unmapped"):
        P.require_match(df, spark.createDataFrame([(1, "a")], "k long, n string"), ["k"])
    with pytest.raises(ValueError, match="not nested"):
        P.parents(spark.createDataFrame([(1, 1), (1, 2)], "c long, p long"), "c", "p")
    with pytest.raises(ValueError, match="IS"):
        P.model_features(["RS1"])
    with pytest.raises(ValueError, match="not both"):
        P.choose_optional_features(["ES_1"], 1, per_library={}, use_all=True)
    with pytest.raises(ValueError, match="library"):
        P.raw_species(df, 9, {1: "k"})
    split = spark.createDataFrame([("train", 1, 1)], "fold string, lib long, sample_set_id long")
    with pytest.raises(ValueError, match="no test rows"):
        P.fold_rows(df.withColumnRenamed("k", "sample_set_id"), split, 1, require=True)


def test_column_helpers(spark):
    assert P.split_columns(["a", "IS1", "b", "ES_x", "RS2", "a"]) == (["a", "b"], ["IS1", "ES_x", "RS2"])
    assert P.model_features(["RS1", "IS2", "IS1", "ES_1", "x"], ["ES_1"]) == ["IS1", "IS2", "RS1", "ES_1"]
    assert P.find_column(["Species Name", "x"], ["species_name"]) == "Species Name"
    schema = spark.createDataFrame([(1, 2.0, True, "s")], "b long, a double, c boolean, d string").schema
    assert P.numeric_covariates(schema, ["b"]) == ["a", "c"]
    assert P.choose_optional_features(["ES_2", "ES_1"], 3, use_all=True) == ["ES_1", "ES_2"]
    assert P.choose_optional_features(["ES_2"], 3, per_library={3: ["ES_1", "ES_2"]}) == ["ES_2"]


def test_unseen_pairs_keep_their_cluster_and_compound(spark):
    rows = [(s, s % 3, c) for s in range(12) for c in range(20)]
    df = spark.createDataFrame(rows, "species long, species_cluster long, comp_id long")
    for mode in ("species", "pair"):
        train, held = P.unseen_group_split(df, mode)
        assert train.count() + held.count() == len(rows) and held.count() > 0
        assert held.join(train, ["species_cluster"], "left_anti").count() == 0
        if mode == "pair":
            assert held.join(train, ["comp_id"], "left_anti").count() == 0
            assert held.join(train, ["species", "comp_id"], "left_semi").count() == 0
    with pytest.raises(ValueError):
        P.unseen_group_split(df, "cluster")


def test_shared_dir_comes_from_the_session(spark):
    from peakloom.plans.durable import scratch_path, shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(shared_dir(spark)) and scratch_path(spark, "x") != scratch_path(spark, "x")


def _bundle(root, name, lines, lib=7):
    folder = root / name
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"regression_{lib}.csv").write_text("\n".join(lines) + "\n")


def test_bundles_with_different_headers_are_one_scan(spark, tmp_path):
    root = tmp_path / "models"
    _bundle(root, "supercategory_1_blood", ['comp_id,b,window,IS1,"RS 1, late",name', "3,1.5,0.2,0.1,0.5,x", '4,2.5,,0.2,0.6,"y, z"', "5,3.5,0.4,,0.7,", ""])
    _bundle(root, "supercategory_2_cells", ["window,ES_1,note,comp_id,b,empty", "0.1,7e-1,good,3,1.0,", "0.3,0.9,12,9,2.0,"])
    _bundle(root, "supercategory_3_other", ["comp_id,b,IS1", "1,2,3"])  # no window
    _bundle(root, "supercategory_4_other", ["comp_id,b,window,IS1", "1,2,3,4"], lib=8)
    got = sorted(map(tuple, scans.scan_bundle(spark, str(root), 7).collect()), key=repr)
    want = [
        (1, 3, 1.5, 0.2, "IS1", 0.1), (1, 3, 1.5, 0.2, "RS 1, late", 0.5), (1, 5, 3.5, 0.4, "IS1", None), (1, 5, 3.5, 0.4, "RS 1, late", 0.7),
        (2, 3, 1.0, 0.1, "ES_1", 0.7), (2, 9, 2.0, 0.3, "ES_1", 0.9), (2, 3, 1.0, 0.1, "empty", None), (2, 9, 2.0, 0.3, "empty", None),
    ]
    assert sorted(((r[0], r[1], r[2], r[3], r[4], r[5]) for r in scans.scan_bundle(spark, str(root), 7).select("supercategory", "comp_id", "b", "window", "feature", "coef").collect()), key=repr) == sorted(want, key=repr) and len(got) == 8
    models = {(r["supercategory"], r["comp_id"]): r["coefs"] for r in scans.bundle_models(scans.scan_bundle(spark, str(root), 7)).collect()}
    assert models[1, 3].get("ES_1") is None and models[2, 9]["ES_1"] == 0.9
    for lib in (9, 70):
        with pytest.raises(ValueError):
            scans.scan_bundle(spark, str(root), lib)


def test_bundle_scan_takes_as_many_jobs_for_many_files(spark, tmp_path):
    def jobs(n):
        root = tmp_path / f"m{n}"
        for i in range(n):
            _bundle(root, f"supercategory_{i}_x", [f"comp_id,b,window,F{i}", f"{i},1,2,3"])
        group = f"bundle {n}"
        spark.sparkContext.setJobGroup(group, group)
        assert scans.scan_bundle(spark, str(root), 7).count() == n
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found

    assert jobs(2) == jobs(20) > 0


def test_the_broken_tree_is_written_once(spark, tmp_path, monkeypatch):
    from peakloom.catalog import load, storage

    spark.range(200).selectExpr(
        "id AS l_orderkey", "1 AS l_linenumber", "id % 50 AS l_partkey", "1D AS l_extendedprice", "id % 4 AS l_suppkey", "timestamp'2024-01-02' AS l_shipdate",
        "'A' AS l_returnflag", "0.01D AS l_tax", "id % 9 * 1D AS l_quantity", "0.02D AS l_discount",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(4).selectExpr("id AS s_suppkey", "cast(id % 2 AS int) AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(2).selectExpr("cast(id AS int) AS n_nationkey", "cast(id AS int) AS n_regionkey", "'x' AS n_name").write.parquet(f"{tmp_path}/nation.parquet")
    monkeypatch.setattr(storage, "_peak_shards", lambda *a: pytest.fail("a second copy of the rows"))
    got = {r["correct"]: r["n_rows"] for r in load()[0]["S2_scan_skipping_corrupt"](spark, str(tmp_path)).collect()}
    assert sum(got.values()) == 200 and got[0] == 8
