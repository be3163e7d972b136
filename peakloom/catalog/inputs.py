"""Domain tables derived from the given parquet tables.

Each view is one SELECT that means the same in Spark SQL and DuckDB, so the Spark queries and
their SQL twins read identical rows. Double literals carry an exponent because plain decimals
are DECIMAL in both engines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from peakloom.plans.durable import settled

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    # production retention-time rows; every lineitem row is one
    "obs": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       l_suppkey AS sampleset_id, CAST(year(l_shipdate) AS BIGINT) AS worksheet_id,
       CAST(month(l_shipdate) AS BIGINT) AS task_id,
       CAST(s_nationkey AS BIGINT) AS species, CAST(n_regionkey AS BIGINT) AS species_cluster,
       l_partkey % 40 AS comp_id, (l_partkey % 40) % 20 AS compound, (l_partkey % 40) % 4 AS compound_class,
       l_quantity AS IS1, l_discount AS RS1, l_tax AS ES_1,
       3e0 + 2e-2*(l_partkey % 40) + 1e-2*s_nationkey + 4e-3*l_quantity - 3e-1*l_discount + 2e-1*l_tax
         + 1e-7*l_extendedprice AS rt,
       CASE WHEN l_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS fold
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    # peak-level rows as they arrive, before the merge with run predictors
    "raw_peaks": """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
       CAST(n_regionkey AS BIGINT) AS lib_id, concat('matrix_', CAST(s_nationkey AS VARCHAR(9))) AS species_matrix_type,
       l_suppkey AS sample_set_id, CAST(month(l_shipdate) AS BIGINT) AS task_id,
       CAST(year(l_shipdate) AS BIGINT) AS worksheet_id, l_partkey % 40 AS correct,
       CASE l_returnflag WHEN 'A' THEN 'Complete' WHEN 'N' THEN 'Complete - NFS' ELSE NULL END AS cpd_status,
       CASE WHEN l_tax < 2e-2 THEN 'PRCS' WHEN l_tax < 5e-2 THEN 'EXP' ELSE NULL END AS sample_type,
       3e0 + 2e-2*(l_partkey % 40) + 4e-3*l_quantity AS apex_rt, l_discount AS fit_scores
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    # run predictors; runs without a well filled row have none
    "predictors": """
SELECT CAST(n_regionkey AS BIGINT) AS lib_id, l_suppkey AS sample_set_id, CAST(month(l_shipdate) AS BIGINT) AS task_id,
       concat('matrix_', CAST(s_nationkey AS VARCHAR(9))) AS species_matrix_type,
       5e0 + 1e-1*month(l_shipdate) + 1e-3*l_suppkey AS IS1, 9e0 - 2e-1*month(l_shipdate) AS IS2,
       2e0 + 1e-2*l_suppkey AS RS1, max(l_discount) AS ES_1, 7e0 AS rt_pred
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
GROUP BY n_regionkey, l_suppkey, month(l_shipdate), s_nationkey
HAVING max(l_quantity) > 45e0""",
    # compound to chemical, per library; some compounds have no chemical
    "lib_map": """
SELECT DISTINCT CAST(r_regionkey AS BIGINT) AS lib_id, p_partkey % 40 AS comp_id,
       nullif((p_partkey % 40) % 20, 7) AS chemical_id
FROM part JOIN region ON length(r_name) > 0""",
    # chemical to class; one chemical has no class
    "class_map": """
SELECT DISTINCT (p_partkey % 40) % 20 AS chem_id, nullif((p_partkey % 40) % 20, 11) % 4 AS compound_class
FROM part""",
    # sample set to species and cluster
    "species_map": """
SELECT s_suppkey AS sample_set_id, n_name AS species_raw,
       CASE n_regionkey WHEN 0 THEN '1 human blood' WHEN 1 THEN '2 mouse urine' WHEN 2 THEN '3 cells'
            WHEN 3 THEN '4 plants' ELSE 'other' END AS species_group_raw,
       CAST(n_nationkey AS BIGINT) AS species, CAST(n_regionkey AS BIGINT) AS species_cluster
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    # compound library: families of four near-isobars, every fourth compound is a decoy
    "library": """
SELECT p_partkey AS compound_id,
       1e2 + 1e-2*(((p_partkey - p_partkey % 4) * 7919) % 90001) + 1e-3*(p_partkey % 3) AS mass,
       p_partkey % 4 = 3 AS is_decoy
FROM part""",
    # predicted retention time per (species, compound)
    "rt_pred": """
SELECT s.species, p_partkey AS compound_id, 2e0 + 2e-1*(p_partkey % 50) + 5e-2*s.species AS rt_mean,
       1e-1 + 1e-2*(p_partkey % 5) AS rt_std
FROM part JOIN (SELECT DISTINCT user_id % 5 AS species FROM events) s ON s.species >= 0""",
    # every event is a peak: an ion of a known compound with mass and time jitter, or noise ('error')
    "peaks": """
SELECT event_id AS peak_id, user_id % 5 AS species,
       (1e2 + 1e-2*(((c - c % 4) * 7919) % 90001) + 1e-3*(c % 3)
          + CASE event_type WHEN 'click' THEN 219819e-4 WHEN 'purchase' THEN 100335e-5
                            WHEN 'signup' THEN -180106e-4 ELSE 0e0 END)
          * (1e0 + 1e-6*(24e-3*((event_id*7919) % 1000) - 12e0)) AS mass,
       2e0 + 2e-1*(c % 50) + 5e-2*(user_id % 5) + 6e-4*((event_id*104729) % 1000) - 3e-1 AS rt,
       1e4*(1e0 + value) AS intensity,
       CASE WHEN event_type = 'error' THEN NULL ELSE c END AS true_compound
FROM (SELECT *, event_id % (SELECT count(*) FROM part) AS c FROM events) e""",
}


def with_views(body: str, *names: str) -> str:
    """``body`` (a SELECT, or further ``name AS (...)`` expressions and a SELECT) after the views.

    A body that starts with ``,`` continues the list of common table expressions.
    """
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + " " + body.strip()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One domain table as a lazy DataFrame."""
    if name == "rt_pred":
        return _rt_pred(spark, sf_dir)
    if name == "lib_map":
        return _lib_map(spark, sf_dir)
    return run_sql(spark, sf_dir, VIEWS[name])


_TABLE_REF = re.compile(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b")


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run SQL over the given tables without registering session-wide names."""
    used = {m.group(2) for m in _TABLE_REF.finditer(sql)}
    return spark.sql(
        _TABLE_REF.sub(r"\1 {\2}", sql), **{t: table(spark, sf_dir, t) for t in sorted(used)}
    )


def _rt_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same rows as the view: the five species values are written out instead of being joined."""
    from pyspark.sql import functions as F

    return (
        table(spark, sf_dir, "part")
        .select("p_partkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("species"))
        .selectExpr(
            "species",
            "p_partkey AS compound_id",
            "2e0 + 2e-1*(p_partkey % 50) + 5e-2*species AS rt_mean",
            "1e-1 + 1e-2*(p_partkey % 5) AS rt_std",
        )
    )


def _lib_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same rows as the view, deduplicated before the five library ids are attached."""
    from pyspark.sql import functions as F

    return (
        table(spark, sf_dir, "part")
        .selectExpr("p_partkey % 40 AS comp_id", "nullif((p_partkey % 40) % 20, 7) AS chemical_id")
        .distinct()
        .select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("lib_id"), "comp_id", "chemical_id")
    )


_kept: dict[tuple[str, str, str], DataFrame] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A table several queries start from, written once per session to the shared folder. What ``build``
    has stored for it alone is removed."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = settled(build, keep=True)
    return _kept[key]


def is_kept(spark: SparkSession, sf_dir: str, name: str) -> bool:
    return (spark.sparkContext.applicationId, sf_dir, name) in _kept
