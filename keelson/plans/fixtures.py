"""Dependency-health views over the star-schema tables, once as DataFrames and once as SQL.

The SQL forms are common table expressions for the reference engine of the correctness check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Now" of every query: staleness, expiry and recency never read a clock.
TODAY = "2002-01-01"
KEY = ("scan_id", "part_id", "supp_id", "line_no")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("repository_id"),
            F.col("n_regionkey").alias("user_id"),
            F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("project_id"),
            F.col("c_mktsegment").alias("owner"),
            F.col("c_name").alias("name"),
            F.concat_ws("/", "c_mktsegment", "c_name").alias("full_name"),
        )
    )


def scan_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = F.substring("o_orderpriority", 1, 1).isin("1", "2")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("scan_id"),
        F.col("o_custkey").alias("repository_id"),
        F.to_date("o_orderdate").alias("created_on"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").when(urgent, "queued").otherwise("running").alias("status"),
        F.element_at(F.array(F.lit("v0_equal"), F.lit("v1"), F.lit("v2")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("formula_version"),
        F.when(F.col("o_orderkey") % 10 == 0, "corpus_scan").otherwise("live_scan").alias("data_source"),
    )


def occurrence(spark: SparkSession, sf_dir: str, named: bool = True, scans: DataFrame | None = None, how: str = "left_semi", together: bool = False) -> DataFrame:
    """One row per line item. Without ``named`` there are no names and reasons, and parts are not joined: each line has one.

    ``scans`` (scan_id and further columns) are joined to the bare lines, which are narrow, before names are.
    ``together``: the rows of a scan lie in one partition. Bare lines and names move there; what is derived from them comes after.
    """
    npm = F.col("l_suppkey") % 2 == 0
    vulnerable = F.col("l_quantity") <= 14
    deprecated = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_linenumber") <= 3)
    groups = F.array(*[F.lit(g) for g in ("runtime", "development", "optional", "peer", "build")])
    lines, names, more = table(spark, sf_dir, "lineitem"), [], []
    met = lambda rows: rows if scans is None else rows.join(scans.withColumnRenamed("scan_id", "l_orderkey"), "l_orderkey", how)
    if scans is not None:
        more = [] if how == "left_semi" else [c for c in scans.columns if c != "scan_id"]
    if not together:
        lines = met(lines)
    if named:
        lines = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        names = [
            F.concat(F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-")), F.lit("."), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("package_name"),
            F.when(deprecated, F.when(F.col("l_linenumber") == 1, "").otherwise(F.concat(F.lit("use "), "p_name", F.lit(" instead")))).alias("deprecation_reason"),
        ]
    if together:
        lines = met(lines.repartition("l_orderkey"))
    return (
        lines.select(
            *names,
            *more,
            F.col("l_orderkey").alias("scan_id"),
            F.col("l_partkey").alias("part_id"),
            F.col("l_suppkey").alias("supp_id"),
            F.col("l_linenumber").alias("line_no"),
            F.when(npm, "npm").otherwise("pypi").alias("ecosystem"),
            F.concat(F.lit("s"), F.col("l_suppkey"), F.when(npm, "/package.json").otherwise("/requirements.txt")).alias("manifest_path"),
            F.when(F.col("l_linenumber").between(1, 5), F.get(groups, F.col("l_linenumber") - 1)).otherwise("runtime").alias("dependency_group"),
            F.concat_ws(".", (F.col("l_partkey") % 5).cast("string"), (F.col("l_quantity").cast("int") % 10).cast("string"), F.col("l_linenumber").cast("string")).alias("resolved_version"),
            F.get(F.array(F.lit("lockfile"), F.lit("pinned"), F.lit("range_latest_approx")), F.col("l_linenumber") % 3).alias("resolution"),
            ((F.col("l_linenumber") == 5) & (F.col("l_quantity") > 25)).alias("is_unassessable"),
            deprecated.alias("is_deprecated"),
            F.when(vulnerable, F.col("l_quantity").cast("int")).otherwise(0).alias("vulnerability_count"),
            F.when(vulnerable & (F.col("l_linenumber") != 7), F.least(F.lit(100), (F.round(F.col("l_discount") * 100) * 10 + F.round(F.col("l_tax") * 100)).cast("int"))).alias("cvss_tenths"),
            F.when(F.col("l_linenumber") != 6, F.datediff(F.lit(TODAY).cast("date"), F.to_date("l_shipdate"))).alias("staleness_days"),
        )
    )


def advisory(spark: SparkSession, sf_dir: str, scans: DataFrame | None = None, together: bool = False) -> DataFrame:
    """One row per advisory of a line, of the given scans or of all; names are not needed, so parts are not joined."""
    rows = occurrence(spark, sf_dir, named=False, scans=scans, together=together).where("vulnerability_count > 0").select(*KEY, "cvss_tenths", F.explode(F.sequence(F.lit(1), "vulnerability_count")).alias("i"))
    return rows.select(
        *KEY,
        "i",
        F.concat_ws("-", F.lit("OSV"), F.col("part_id").cast("string"), F.col("i").cast("string")).alias("osv_id"),
        F.when(F.col("i") % 3 != 0, F.concat(F.lit("CVE-2024-"), (1000 + F.col("part_id") % 500 + F.col("i") % 2).cast("string"))).alias("cve_id"),
        F.when(F.col("cvss_tenths").isNotNull(), F.greatest(F.lit(0), F.col("cvss_tenths") - 7 * (F.col("i") - 1))).alias("cvss_tenths"),
    )


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = scan_run(spark, sf_dir).where("status = 'completed' AND scan_id % 4 = 0")
    status = F.when(F.col("scan_id") % 5 == 0, "failed").when(F.col("scan_id") % 5 == 1, "running").otherwise("completed")
    return done.select(F.col("scan_id").alias("report_id"), "scan_id", "repository_id", status.alias("status"))


def chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.join(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("doc_id") == F.col("vec_id")).select(
        F.col("vec_id").alias("chunk_id"), F.col("label").alias("package_key"), "text", F.col("embedding").alias("vector")
    )


SQL = {
    "repository": """
  SELECT c_custkey AS repository_id, n_regionkey AS user_id, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END AS project_id,
         c_mktsegment AS owner, c_name AS name, c_mktsegment || '/' || c_name AS full_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "scan_run": """
  SELECT o_orderkey AS scan_id, o_custkey AS repository_id, CAST(o_orderdate AS DATE) AS created_on,
         CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'failed'
              WHEN o_orderpriority[1] IN ('1', '2') THEN 'queued' ELSE 'running' END AS status,
         CASE o_orderkey % 3 WHEN 0 THEN 'v0_equal' WHEN 1 THEN 'v1' ELSE 'v2' END AS formula_version,
         CASE WHEN o_orderkey % 10 = 0 THEN 'corpus_scan' ELSE 'live_scan' END AS data_source
  FROM orders""",
    "occurrence": f"""
  SELECT l_orderkey AS scan_id, l_partkey AS part_id, l_suppkey AS supp_id, l_linenumber AS line_no,
         CASE WHEN l_suppkey % 2 = 0 THEN 'npm' ELSE 'pypi' END AS ecosystem,
         's' || l_suppkey::VARCHAR || CASE WHEN l_suppkey % 2 = 0 THEN '/package.json' ELSE '/requirements.txt' END AS manifest_path,
         replace(lower(p_brand), '#', '-') || '.' || replace(p_name, ' ', '_') AS package_name,
         CASE l_linenumber WHEN 2 THEN 'development' WHEN 3 THEN 'optional' WHEN 4 THEN 'peer' WHEN 5 THEN 'build' ELSE 'runtime' END AS dependency_group,
         (l_partkey % 5)::VARCHAR || '.' || (l_quantity::INT % 10)::VARCHAR || '.' || l_linenumber::VARCHAR AS resolved_version,
         CASE l_linenumber % 3 WHEN 0 THEN 'lockfile' WHEN 1 THEN 'pinned' ELSE 'range_latest_approx' END AS resolution,
         l_linenumber = 5 AND l_quantity > 25 AS is_unassessable,
         l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber <= 3 AS is_deprecated,
         CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber <= 3
              THEN CASE WHEN l_linenumber = 1 THEN '' ELSE 'use ' || p_name || ' instead' END END AS deprecation_reason,
         CASE WHEN l_quantity <= 14 THEN l_quantity::INT ELSE 0 END AS vulnerability_count,
         CASE WHEN l_quantity <= 14 AND l_linenumber <> 7 THEN least(100, (round(100 * l_discount) * 10 + round(100 * l_tax))::INT) END AS cvss_tenths,
         CASE WHEN l_linenumber <> 6 THEN date_diff('day', CAST(l_shipdate AS DATE), DATE '{TODAY}')::INT END AS staleness_days
  FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "advisory": """
  SELECT scan_id, part_id, supp_id, line_no, package_name, i::INT AS i, 'OSV-' || part_id::VARCHAR || '-' || i::VARCHAR AS osv_id,
         CASE WHEN i % 3 <> 0 THEN 'CVE-2024-' || (1000 + part_id % 500 + i % 2)::VARCHAR END AS cve_id,
         CASE WHEN cvss_tenths IS NOT NULL THEN greatest(0, cvss_tenths - 7 * (i - 1))::INT END AS cvss_tenths
  FROM (SELECT *, unnest(range(1, vulnerability_count + 1)) AS i FROM occurrence WHERE vulnerability_count > 0)""",
    "report": """
  SELECT scan_id AS report_id, scan_id, repository_id,
         CASE scan_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' ELSE 'completed' END AS status
  FROM scan_run WHERE status = 'completed' AND scan_id % 4 = 0""",
    "chunk": """
  SELECT vec_id AS chunk_id, label AS package_key, text, embedding AS vector
  FROM embeddings JOIN documents ON doc_id = vec_id""",
}
NEEDS = {"advisory": ("occurrence",), "report": ("scan_run",)}


def with_views(sql: str, *names: str) -> str:
    """``sql``, which begins with SELECT or with further expressions (name AS ...), over the named views."""
    wanted: list[str] = []
    for name in names:
        wanted += [n for n in (*NEEDS.get(name, ()), name) if n not in wanted]
    views = ",\n".join(f"{name} AS ({SQL[name]})" for name in wanted)
    body = sql.strip()
    return f"WITH {views}" + ("\n" if body.upper().startswith("SELECT") else ",\n") + body
