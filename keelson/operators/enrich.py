"""Registry facts, advisories and exploit probabilities joined to occurrences, with the failure policy.

A lookup is made once per distinct target. Failures are data: a package that is missing leaves its
occurrences unassessable, an ecosystem whose every lookup failed fails its scans, a failed advisory
batch fails the scans that needed it, and missing probabilities are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BATCH = 100


def targets(occurrences: DataFrame) -> DataFrame:
    return occurrences.where("unassessable_reason IS NULL").select("ecosystem", "name", "resolved_version").distinct()


def batches(found: DataFrame, *keys: str, size: int = BATCH) -> DataFrame:
    """Puts targets into batches of ``size`` at most: hashed into buckets of about that many, and what a bucket has beyond it goes on in further batches."""
    count = F.greatest(F.lit(1), F.ceil(F.lit(found.count()) / size)).cast("long")
    bucket = F.pmod(F.xxhash64(*keys), count)
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy(*keys)) - 1
    return found.withColumn("__bucket", bucket).withColumn("batch", F.col("__bucket") + count * F.floor(place / size)).drop("__bucket")


def with_facts(occurrences: DataFrame, facts: DataFrame) -> DataFrame:
    """Joins registry facts on (ecosystem, name, resolved_version); an unresolved version meets facts without one."""
    other = facts.select([F.col(c).alias(f"f_{c}") for c in facts.columns])
    same = (F.col("ecosystem") == F.col("f_ecosystem")) & (F.col("name") == F.col("f_name")) & F.col("resolved_version").eqNullSafe(F.col("f_resolved_version"))
    return occurrences.join(other, same, "left").drop("f_ecosystem", "f_name", "f_resolved_version")


def failed_ecosystems(facts: DataFrame) -> DataFrame:
    """Ecosystems where something was looked up and everything was unavailable."""
    counted = facts.groupBy("ecosystem").agg(F.count("*").alias("attempted"), F.count_if("unavailable").alias("unavailable"))
    return counted.where("attempted > 0 AND attempted = unavailable").select("ecosystem")


def exits(reason: Column, unavailable: Column, not_found: Column) -> Column:
    """Why an occurrence cannot be assessed: its own reason, then the registry's two."""
    return F.when(reason.isNotNull(), reason).when(F.coalesce(unavailable, F.lit(False)), "registry_unavailable").when(F.coalesce(not_found, F.lit(False)), "not_in_registry")


def asked_for_advisories(joined: DataFrame) -> DataFrame:
    """Occurrences that may be asked about: assessable, with facts of a package that was found and available, and with a version.

    The version is the resolved one, else the latest. ``joined``: as ``with_facts`` gives it.
    """
    version = F.coalesce(F.nullif("resolved_version", F.lit("")), F.nullif("f_latest_version", F.lit("")))
    known = F.col("f_unavailable").isNotNull() & ~F.coalesce("f_unavailable", F.lit(False)) & ~F.coalesce("f_not_found", F.lit(False))
    return joined.where(F.col("unassessable_reason").isNull() & known).withColumn("assessed_version", version).where("assessed_version IS NOT NULL")


def derived(joined: DataFrame) -> DataFrame:
    """Signals of each occurrence. Only a package that is not found keeps its version and resolution."""
    reason = exits(F.col("unassessable_reason"), F.col("f_unavailable"), F.col("f_not_found"))
    keeps = reason.isNull() | (reason == "not_in_registry")
    approx = reason.isNull() & F.col("resolution").isNull() & F.col("f_latest_version").isNotNull()
    return joined.select(
        *[c for c in joined.columns if c not in ("unassessable_reason", "resolved_version", "resolution") and not c.startswith("f_")],
        reason.alias("unassessable_reason"),
        reason.isNotNull().alias("is_unassessable"),
        F.when(keeps, F.when(approx, F.col("f_latest_version")).otherwise(F.col("resolved_version"))).alias("resolved_version"),
        F.when(keeps, F.when(approx, "range_latest_approx").otherwise(F.col("resolution"))).alias("resolution"),
        F.when(reason.isNull(), F.coalesce("f_is_deprecated", F.lit(False))).alias("is_deprecated"),
        F.when(reason.isNull(), F.col("f_staleness_days")).alias("staleness_days"),
    )


def advisories(occurrences: DataFrame, hits: DataFrame, documents: DataFrame, probabilities: DataFrame) -> DataFrame:
    """Advisory rows of assessable occurrences: ids by (name, version), then documents by id, then probabilities by CVE.

    An id without a document is dropped; a CVE without a probability keeps null, never 0.
    """
    able = occurrences.where("NOT is_unassessable AND resolved_version IS NOT NULL")
    ids = able.join(hits.dropDuplicates(["ecosystem", "name", "version", "osv_id"]).withColumnRenamed("version", "resolved_version"), ["ecosystem", "name", "resolved_version"])
    known = ids.join(documents.where("document IS NOT NULL").dropDuplicates(["osv_id"]), "osv_id")
    chance = probabilities.select(F.upper(F.trim("cve")).alias("cve_key"), "epss").where(F.col("cve_key").startswith("CVE-")).dropDuplicates(["cve_key"])
    return known.withColumn("cve_key", F.upper(F.trim("cve_id"))).join(chance, "cve_key", "left").drop("cve_key")


def failed_scans(scans: DataFrame, occurrences: DataFrame, ecosystems: DataFrame, lost_batches: DataFrame) -> DataFrame:
    """failure_reason per scan: no manifest rows, a registry down, or a lost advisory batch, in that order."""
    own = occurrences.groupBy("scan_id").agg(F.count("*").alias("n"))
    down = occurrences.join(ecosystems, "ecosystem", "left_semi").select("scan_id").distinct().withColumn("down", F.lit(True))
    lost = occurrences.join(lost_batches, ["ecosystem", "name"], "left_semi").select("scan_id").distinct().withColumn("lost", F.lit(True))
    joined = scans.join(own, "scan_id", "left").join(down, "scan_id", "left").join(lost, "scan_id", "left")
    return joined.select("scan_id", F.when(F.col("n").isNull(), "no_manifest").when(F.col("down"), "registry_unavailable").when(F.col("lost"), "advisories_unavailable").alias("failure_reason"))


def preferred_document(documents: DataFrame, key: str, most_bytes: int = 500_000) -> DataFrame:
    """The best of a repository's fetched documents by rank, and one of a closed set of reasons where there is none."""
    usable = F.col("body").isNotNull() & (F.octet_length("body") <= most_bytes)
    best = documents.groupBy(key).agg(F.min_by(F.when(usable, F.struct("path", "body")), F.when(usable, F.col("rank"))).alias("d"), F.bool_or(F.col("body").isNotNull()).alias("any"))
    return best.select(key, F.col("d.path").alias("path"), F.col("d.body").alias("body"), F.when(F.col("d").isNotNull(), F.lit(None)).when(F.col("any"), "documents_too_large").otherwise("no_documents").alias("reason"))


def numbered(rows: DataFrame, *keys: str, order: str) -> DataFrame:
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def answered(questions: Column, answers: Column) -> Column:
    """Questions with the answers at their places, as structs; a batch whose lengths differ fails the job."""
    told = F.concat(F.lit("questions and answers differ in number: "), F.size(questions).cast("string"), F.lit(", "), F.size(answers).cast("string"))
    pairs = F.zip_with(questions, answers, lambda q, a: F.struct(q.alias("question"), a.alias("answer")))
    return F.when(F.size(questions) == F.size(answers), pairs).otherwise(F.raise_error(told))
