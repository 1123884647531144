"""Version grammars as columns: parsing, ordering, exact pins, latest, and how far behind.

A parsed version is a struct; sort keys are structs and arrays that Spark compares field by
field, so ordering, maxima and joins need no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .advisories import instant

# The published grammars.
SEMVER = r"^v?(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-((?:0|[1-9]\d*|\d*[A-Za-z-][0-9A-Za-z-]*)(?:\.(?:0|[1-9]\d*|\d*[A-Za-z-][0-9A-Za-z-]*))*))?(?:\+([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?$"
PEP440 = r"(?i)^v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?([0-9]+)?)?(?:-([0-9]+)|[-_.]?(post|rev|r)[-_.]?([0-9]+)?)?([-_.]?dev([0-9]+)?)?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?$"
PRE_LETTERS = {"alpha": "a", "a": "a", "beta": "b", "b": "b", "c": "rc", "pre": "rc", "preview": "rc", "rc": "rc"}


def _number(text: Column) -> Column:
    return text.try_cast("decimal(38,0)")


def semver(raw: Column) -> Column:
    """struct<major, minor, patch, release, ids>: the sort key itself; null if it is no version.

    ``release`` is 1 for releases, which outrank their prereleases; identifiers are structs of
    (is text, number, text), so numbers rank below text and compare by value.
    """
    raw = F.trim(raw)
    part = lambda n: F.regexp_extract(raw, SEMVER, n)
    ids = F.when(part(4) == "", F.expr("CAST(array() AS array<struct<is_text: int, number: decimal(38,0), text: string>>)")).otherwise(
        F.transform(
            F.split(part(4), r"\."),
            lambda x: F.struct(
                F.when(x.rlike("^[0-9]+$"), 0).otherwise(1).alias("is_text"),
                F.when(x.rlike("^[0-9]+$"), _number(x)).otherwise(F.lit(0).cast("decimal(38,0)")).alias("number"),
                F.when(x.rlike("^[0-9]+$"), "").otherwise(x).alias("text"),
            ),
        )
    )
    parsed = F.struct(_number(part(1)).alias("major"), _number(part(2)).alias("minor"), _number(part(3)).alias("patch"), F.when(part(4) == "", 1).otherwise(0).alias("release"), ids.alias("ids"))
    return F.when(raw.rlike(SEMVER), parsed)


def semver_pin(specifier: Column) -> Column:
    """The exact version that a specifier pins, or null: one leading = and v may stand before it."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(specifier), r"^=\s*", ""), r"^v", "")
    return F.when(bare.rlike(SEMVER), bare)


def pep440(raw: Column) -> Column:
    """struct<epoch, release, pre, post, dev>: the sort key; null if it is no version.

    Trailing zeros of the release do not count. Absent parts sort by constants: a missing
    prerelease is above every one (below, if the version is only a dev release), a missing post
    below, a missing dev above. The local part plays no role.
    """
    raw = F.trim(raw)
    part = lambda n: F.regexp_extract(raw, PEP440, n)
    or_zero = lambda text: F.coalesce(_number(text), F.lit(0).cast("decimal(38,0)"))
    minus, zero, one = (F.lit(x).cast("int") for x in (-1, 0, 1))
    nothing = F.lit(0).cast("decimal(38,0)")
    letters = F.create_map(*[x for pair in PRE_LETTERS.items() for x in map(F.lit, pair)])
    numbers = F.transform(F.split(F.regexp_replace(part(2), r"(?:\.0+)+$", ""), r"\."), _number)
    has_pre, has_post, has_dev = part(3) != "", (part(5) != "") | (part(6) != ""), part(8) != ""
    key = lambda order, text, number: F.struct(order.alias("order"), text.alias("text"), number.alias("number"))
    pre = F.when(has_pre, key(zero, F.element_at(letters, F.lower(part(3))), or_zero(part(4)))).when(~has_post & has_dev, key(minus, F.lit(""), nothing)).otherwise(key(one, F.lit(""), nothing))
    post = F.when(has_post, F.struct(zero.alias("order"), F.when(part(5) != "", _number(part(5))).otherwise(or_zero(part(7))).alias("number"))).otherwise(F.struct(minus.alias("order"), nothing.alias("number")))
    dev = F.when(has_dev, F.struct(zero.alias("order"), or_zero(part(9)).alias("number"))).otherwise(F.struct(one.alias("order"), nothing.alias("number")))
    return F.when(raw.rlike(PEP440), F.struct(or_zero(part(1)).alias("epoch"), numbers.alias("release"), pre.alias("pre"), post.alias("post"), dev.alias("dev")))


def pep440_stable(raw: Column) -> Column:
    key = pep440(raw)
    return (key["pre"]["order"] == 1) & (key["dev"]["order"] == 1)


def pep440_pin(specifier: Column) -> Column:
    """The version after == or ===, if that is all there is and it has no wildcard."""
    bare = F.trim(F.regexp_replace(F.trim(specifier), r"^={2,3}", ""))
    return F.when(F.trim(specifier).rlike(r"^={2,3}[^=]") & ~specifier.rlike(r"[,*]") & bare.rlike(PEP440), bare)


def normalised_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(name), "[-_.]+", "-"))


def latest(releases: DataFrame, ecosystem: str, *keys: str, version: str = "version") -> DataFrame:
    """Per key the highest stable version, or the highest prerelease where none is stable."""
    raw = F.col(version)
    key = semver(raw) if ecosystem == "npm" else pep440(raw)
    stable = key["release"] == 1 if ecosystem == "npm" else pep440_stable(raw)
    ranked = releases.withColumn("__key", key).where("__key IS NOT NULL").withColumn("__stable", stable)
    return ranked.groupBy(*keys).agg(F.max_by(raw, F.struct("__stable", "__key")).alias("latest_version"))


def latest_release_time(times: Column, latest_version: Column, published: Column) -> Column:
    """The time of the latest version, else the newest time of a published one; entries that are no version never count."""
    named = instant(F.try_element_at(times, latest_version))
    others = F.transform(F.filter(F.map_entries(times), lambda e: F.array_contains(published, e["key"])), lambda e: instant(e["value"]))
    return F.coalesce(named, F.array_max(others))


def falling(number: Column) -> Column:
    """Text of a whole number, not negative, that sorts the greater number first: length and digits, nine for zero and so on. A number beyond 38 digits (null) is last."""
    digits = number.cast("string")
    return F.coalesce(F.translate(F.concat(F.lpad(F.length(digits).cast("string"), 2, "0"), digits), "0123456789", "9876543210"), F.lit(":"))


def with_release(rows: DataFrame, raw: str, ecosystem: str) -> DataFrame:
    """Adds ``release`` (struct<major, minor, patch>; null if it is no version of its ecosystem), ``falling``
    (the same numbers as text that sorts the greater first) and ``stable``.

    Parts that a PyPI release lacks are zero. Each distinct spelling is parsed once: packages share most of theirs.
    """
    npm, pypi = F.col(ecosystem) == "npm", F.col(ecosystem) == "pypi"
    # What is parsed depends on the count, so that no filter on it moves below the grouping and parses every row.
    spellings = rows.where(F.col(raw).isNotNull()).groupBy(ecosystem, raw).agg(F.count("*").alias("__n"))
    once = F.when(F.col("__n") > 0, F.col(raw))
    parsed = spellings.withColumns({"__npm": F.when(npm, semver(once)), "__pypi": F.when(pypi, pep440(once))})
    nothing = F.lit(0).cast("decimal(38,0)")
    part = lambda n, name: F.when(npm, F.col(f"__npm.{name}")).otherwise(F.coalesce(F.get("__pypi.release", F.lit(n)), nothing)).alias(name)
    triple = F.when(F.col("__npm").isNotNull() | F.col("__pypi").isNotNull(), F.struct(part(0, "major"), part(1, "minor"), part(2, "patch")))
    stable = F.when(npm, F.col("__npm.release") == 1).otherwise((F.col("__pypi.pre.order") == 1) & (F.col("__pypi.dev.order") == 1))
    spelled = parsed.select(ecosystem, raw, triple.alias("release"), F.coalesce(stable, F.lit(False)).alias("stable"))
    texts = F.when(F.col("release").isNotNull(), F.struct(*[falling(F.col(f"release.{c}")).alias(c) for c in ("major", "minor", "patch")]))
    spelled = spelled.withColumn("falling", texts)
    return rows.join(spelled, [ecosystem, raw], "left").select(*rows.columns, "release", "falling", F.coalesce("stable", F.lit(False)).alias("stable"))


def behind(own: DataFrame, releases: DataFrame, *package: str, version: str = "version", resolved: str = "resolved", ecosystem: str = "ecosystem") -> DataFrame:
    """The rows of ``own`` with behind_major, behind_minor and behind_patch: distinct published majors above
    the resolved version, minors above it within its major, patches above it within its minor; stable
    releases only, each ecosystem by its own grammar. Where nothing is known or parsed they are 0.

    ``package`` names the columns, the ecosystem among them or not, that ``own`` and ``releases`` (a row
    per release, repeated or not, parsed by ``with_release`` already or not) share. Versions never meet
    releases one by one: the distinct numbers of both stand in one falling order for each package, and the
    published ones ahead of a number are counted there, all three counts in one sort. A package's distinct
    versions are one task's.
    """
    on = list(dict.fromkeys((*package, ecosystem)))
    levels = ["__major", "__minor", "__patch"]
    flat = [F.col(f"falling.{c[2:]}").alias(c) for c in levels]
    asked = with_release(own.select(*on, resolved).distinct(), resolved, ecosystem).where("release.major IS NOT NULL AND release.minor IS NOT NULL AND release.patch IS NOT NULL").select(*on, resolved, *flat)
    parsed = releases if "falling" in releases.columns else with_release(releases.select(*on, version).distinct(), version, ecosystem)
    stable = parsed.where("stable").select(*on, *flat)
    points = stable.withColumns({"__is_out": F.lit(1), "__asked": F.lit(0)}).unionByName(asked.select(*on, *levels, F.lit(0).alias("__is_out"), F.lit(1).alias("__asked")))
    counted = points.repartition(*on).groupBy(*on, *levels).agg(F.max("__is_out").alias("__is_out"), F.max("__asked").alias("__asked"))
    # At each level the first published row of a number stands for it; the count so far leaves out the row's own number.
    mark = F.col("__is_out")
    for depth in (2, 1, 0):
        so_far = F.sum("__mark").over(Window.partitionBy(*on, *levels[:depth]).orderBy(*levels[depth:]).rowsBetween(Window.unboundedPreceding, 0))
        counted = counted.withColumn("__mark", mark).withColumn("__so_far", so_far)
        own_number = F.col("__is_out") if depth == 2 else F.when(F.col("__below") > 0, 1).otherwise(0)
        counted = counted.withColumn(f"behind_{levels[depth][2:]}", F.col("__so_far") - own_number).withColumn("__below", F.col("__so_far"))
        mark = F.when((F.col("__mark") == 1) & (F.col("__so_far") == 1), 1).otherwise(0)
    counts = [f"behind_{c[2:]}" for c in levels]
    found = asked.join(counted.where("__asked = 1").select(*on, *levels, *counts), [*on, *levels]).select(*on, resolved, *counts)
    joined = own.join(found, [*on, resolved], "left")
    return joined.select(*own.columns, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])
