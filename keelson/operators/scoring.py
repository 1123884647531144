"""Exact scoring of dependency occurrences.

A term is its weight times its normalised signal, rescaled over the weights whose signal is
present, rounded half up to cents. Weights, signals and cents are whole numbers, so a term is
one integer division that long arithmetic does exactly inside generated code; amounts leave
as decimals. Absent is not zero: an unknown staleness leaves the sum of weights, an unknown
severity with advisories counts as 5.0 and lowers confidence.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .weights import ACTIVE, EPSS, FOLDER, SIGNALS, usable_version, weight_table

PLACEHOLDER_TENTHS = 50
#: Exploit probabilities have five places.
EPSS_UNITS = 100_000


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def with_weights(rows: DataFrame, version: Column | str = ACTIVE, folder: Path = FOLDER, active: str = ACTIVE, needed: Column | None = None) -> DataFrame:
    """Joins each row's weight vector. A row (of those where they are ``needed``) whose ecosystem has none fails the job, as it must not score."""
    table = weight_table(rows.sparkSession, folder).withColumnRenamed("ecosystem", "w_ecosystem").withColumnRenamed("version", "w_version")
    wanted = usable_version(F.lit(version) if isinstance(version, str) else version, folder, active)
    held = rows.withColumn("used_version", wanted)
    # The weights are one row per version and ecosystem, whatever the data.
    joined = held.join(F.broadcast(table), (F.col("used_version") == F.col("w_version")) & (F.col("ecosystem") == F.col("w_ecosystem")), "left")
    lost = F.col("w_version").isNull() if needed is None else F.col("w_version").isNull() & needed
    weight = F.when(lost, F.raise_error(F.concat(F.lit("no weights for ecosystem "), F.coalesce("ecosystem", F.lit("null"))))).otherwise(F.col("w_deprecation"))
    return joined.withColumn("w_deprecation", weight.cast("long")).drop("w_version", "w_ecosystem")


def signal_columns(rows: DataFrame, *keys: str) -> DataFrame:
    """The measurements that a score needs, from rows of any table that has them; an unknown number of advisories is none."""
    return rows.select(*keys, "is_deprecated", "cvss_tenths", F.coalesce("vulnerability_count", F.lit(0)).alias("vulnerability_count"), "staleness_days")


def signals(epss: bool = False) -> dict[str, tuple[Column, Column]]:
    """Numerator and denominator of each normalised signal; a null numerator is an absent term.

    With ``epss``, for rows that have a column of that name, the exploit probability is one where the weights enable it.
    """
    chance = F.when(F.col("epss_enabled"), F.round(clamp(F.col("epss").cast("decimal(12,5)"), 0, 1) * EPSS_UNITS).cast("long")) if epss else None
    fifth = {EPSS: (F.when(F.col("epss").isNotNull(), chance), F.lit(EPSS_UNITS))} if epss else {}
    count = F.coalesce(F.col("vulnerability_count"), F.lit(0))
    severity = F.when(F.col("cvss_tenths").isNotNull(), clamp(F.col("cvss_tenths"), 0, 100)).when(count > 0, F.lit(PLACEHOLDER_TENTHS)).otherwise(F.lit(0))
    return {
        "deprecation": (F.col("is_deprecated").cast("int"), F.lit(1)),
        "severity": (severity, F.lit(100)),
        "count": (F.least(F.greatest(count, F.lit(0)), F.col("count_cap")), F.col("count_cap")),
        # least() and greatest() pass over nulls, so absence is kept apart.
        "staleness": (F.when(F.col("staleness_days").isNotNull(), F.least(F.greatest(F.col("staleness_days"), F.lit(0)), F.col("staleness_cap_days"))), F.col("staleness_cap_days")),
        **fifth,
    }


def reduced_confidence() -> Column:
    return F.col("cvss_tenths").isNull() & (F.coalesce(F.col("vulnerability_count"), F.lit(0)) > 0)


def term_cents(weight: Column, total: Column, top: Column, bottom: Column) -> Column:
    """100 * 100 * weight * top / (total * bottom), half up; 0 where no weight is left."""
    above, below = weight * top.cast("long") * 10_000, total * bottom.cast("long")
    return F.when(total > 0, F.call_function("div", 2 * above + below, 2 * below)).otherwise(F.lit(0).cast("long"))


def amount(cents: Column, kind: str) -> Column:
    return (cents.cast("decimal(12,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(kind)


def score_occurrences(rows: DataFrame, version: Column | str = ACTIVE, folder: Path = FOLDER, active: str = ACTIVE, keep: bool = False) -> DataFrame:
    """Adds points per term, penalty, score, redistributed and cvss_reduced_confidence to assessable rows.

    Unassessable rows are left out or, with ``keep``, stay in the same pass with null for all of these. Rows with a column ``epss`` get
    the term of the exploit probability under weights that enable it; where it is unknown, its weight goes to the rest.
    """
    able = ~F.col("is_unassessable")
    held = with_weights(rows.where("is_unassessable IS NOT NULL"), version, folder, active, able) if keep else with_weights(rows.where(able), version, folder, active)
    own = (lambda c: F.when(able, c)) if keep else (lambda c: c)
    has_epss = "epss" in rows.columns
    parts = signals(has_epss)
    total = F.lit(0).cast("long")
    for s in parts:
        total = total + F.when(parts[s][0].isNotNull(), F.col(f"w_{s}")).otherwise(F.lit(0))
    held = held.withColumn("w_total", total)
    cents = {s: F.when(parts[s][0].isNotNull(), term_cents(F.col(f"w_{s}"), F.col("w_total"), *parts[s])) for s in parts}
    held = held.withColumns({f"cents_{s}": c for s, c in cents.items()})
    added = F.lit(0).cast("long")
    for s in parts:
        added = added + F.coalesce(f"cents_{s}", F.lit(0))
    held = held.withColumn("penalty_cents", F.least(F.greatest(added, F.lit(0)), F.lit(10_000)))
    return held.withColumns(
        {
            **{f"points_{s}": own(amount(F.col(f"cents_{s}"), "decimal(7,2)")) for s in parts},
            "penalty": own(amount(F.col("penalty_cents"), "decimal(5,2)")),
            "score": own(amount(F.lit(10_000) - F.col("penalty_cents"), "decimal(5,2)")),
            "redistributed": own(F.col("staleness_days").isNull() | (F.col("epss_enabled") & (F.col("epss").isNull() if has_epss else F.lit(True)))),
            "cvss_reduced_confidence": own(reduced_confidence()),
        }
    )


def flag_reasons() -> Column:
    """deprecated, vulnerable, stale, in that order, whichever hold."""
    stale = F.coalesce(F.col("staleness_days") >= F.col("stale_flag_days"), F.lit(False))
    return F.filter(
        F.array(F.when(F.col("is_deprecated"), "deprecated"), F.when(F.coalesce(F.col("vulnerability_count"), F.lit(0)) > 0, "vulnerable"), F.when(stale, "stale")),
        lambda x: x.isNotNull(),
    )


def is_flagged() -> Column:
    return F.size(flag_reasons()) > 0


def term_breakdown(scored: DataFrame, *keys: str) -> DataFrame:
    """Long form: one row per present term, in canonical order, with raw and normalised value, weight and points."""
    parts = signals()
    raw = {"deprecation": F.col("is_deprecated").cast("int"), "severity": F.col("cvss_tenths"), "count": F.coalesce(F.col("vulnerability_count"), F.lit(0)), "staleness": F.col("staleness_days")}
    terms = [
        F.when(
            parts[s][0].isNotNull(),
            F.struct(
                F.lit(n).alias("term_order"),
                F.lit(s).alias("signal"),
                raw[s].cast("int").alias("raw_value"),
                F.bround((parts[s][0].cast("decimal(10,0)") / parts[s][1].cast("decimal(10,0)")).cast("decimal(20,10)"), 4).cast("decimal(6,4)").alias("normalised"),
                F.bround((F.col(f"w_{s}").cast("decimal(10,0)") / F.col("w_total").cast("decimal(10,0)")).cast("decimal(20,10)"), 4).cast("decimal(6,4)").alias("weight"),
                F.col(f"points_{s}").alias("points"),
            ),
        )
        for n, s in enumerate(SIGNALS)
    ]
    return scored.select(*keys, F.explode(F.filter(F.array(*terms), lambda t: t.isNotNull())).alias("t")).select(*keys, "t.*")


def omitted_terms(scored: DataFrame, *keys: str) -> DataFrame:
    """Signals with a weight but no term, and why."""
    return scored.where(F.col("staleness_days").isNull()).select(*keys, F.lit("staleness").alias("signal"), F.lit("no_release_date").alias("reason"))


def matches_stored(recomputed: Column, stored: Column) -> Column:
    return F.coalesce(recomputed == stored, F.lit(False))
