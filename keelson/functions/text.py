"""Small text and display functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token shapes that must not be shown.
SECRETS = (r"gh[pousr]_[A-Za-z0-9]{16,}", r"github_pat_[A-Za-z0-9_]{20,}", r"gAAAAA[A-Za-z0-9_\-=]{20,}")
REDACTED = "[REDACTED]"
OWNER = r"[A-Za-z0-9](?:[A-Za-z0-9]|-(?=[A-Za-z0-9])){0,38}"
NAME = r"[A-Za-z0-9._-]{1,100}"


def redact(text: Column) -> Column:
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, REDACTED)
    return text


def slug(text: Column, fallback: str = "report") -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-"), r"^[-.]+|[-.]+$", "")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(fallback))


def utc_stamp(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def percent_encoded(text: Column) -> Column:
    """A text as one segment of an address: all but letters, digits and -._~ as bytes of UTF-8 in hex."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def tree_address(owner: Column, name: Column, branch: Column, api: str = "https://api.github.com") -> Column:
    return F.concat(F.lit(f"{api}/repos/"), percent_encoded(owner), F.lit("/"), percent_encoded(name), F.lit("/git/trees/"), percent_encoded(branch))


def blob_address(owner: Column, name: Column, sha: Column, api: str = "https://api.github.com") -> Column:
    return F.concat(F.lit(f"{api}/repos/"), percent_encoded(owner), F.lit("/"), percent_encoded(name), F.lit("/git/blobs/"), percent_encoded(sha))


def table_cell(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), r"\r?\n", " ")


def quoted(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), lambda line: F.rtrim(F.concat(F.lit("> "), line))), "\n")


def listed(words: Column) -> Column:
    """a; a and b; a, b and c."""
    n = F.size(words)
    return (
        F.when(n == 0, "")
        .when(n == 1, F.get(words, F.lit(0)))
        .otherwise(F.concat(F.array_join(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(words, -1)))
    )


def relative_time(moment: Column, now: Column) -> Column:
    """just now, so many minutes, hours or days, and from a week on the date; each step rounds the one before.

    A moment to come is now, and an unknown one is a dash.
    """
    rounded = lambda x: F.floor(x + 0.5).cast("long")
    seconds = F.greatest(F.lit(0), rounded((F.unix_micros(now) - F.unix_micros(moment)) / 1e6))
    minutes = rounded(seconds / 60)
    hours = rounded(minutes / 60)
    days = rounded(hours / 24)
    said = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit} ago"))
    return (
        F.when(moment.isNull(), "\u2014")
        .when(seconds < 60, "just now")
        .when(minutes < 60, said(minutes, "min"))
        .when(hours < 24, said(hours, "h"))
        .when(days < 7, said(days, "d"))
        .otherwise(F.date_format(moment, "d MMM yyyy"))
    )


def strip_emphasis(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"`([^`]*)`", "$1"), r"(\*\*|__|\*|_)(.+?)\1", "$2")


def markdown_blocks(text: Column) -> Column:
    """Paragraphs and lists: runs of lines between blank ones, each with its kind."""
    pieces = F.filter(F.split(text, r"\n\s*\n"), lambda b: F.trim(b) != "")
    return F.transform(pieces, lambda b: F.struct(F.when(F.trim(b).rlike(r"^[-*]\s"), "list").otherwise("paragraph").alias("kind"), strip_emphasis(F.trim(b)).alias("text")))


def chunk_id(sha: Column, path: Column, text: Column) -> Column:
    nul = F.lit("\x00")
    return F.substring(F.sha2(F.concat(sha, nul, path, nul, text), 256), 1, 12)


def version_tag(version: Column) -> Column:
    return F.coalesce(F.trim(version), F.lit(""))


def staleness_days(released: Column, now: Column) -> Column:
    """Whole elapsed days, never below zero; unknown stays unknown."""
    elapsed = F.floor((F.unix_timestamp(now) - F.unix_timestamp(released)) / 86400).cast("int")
    return F.when(released.isNotNull(), F.greatest(F.lit(0), elapsed))


def access_level(owner: Column, user: Column, admin: Column, push: Column) -> Column:
    return F.when((owner != "") & (F.lower(owner) == F.lower(user)), "owner").when(admin, "collaborator").when(push, "write")


def repository_path(raw: Column) -> Column:
    """Parts of the path of a pasted link (browser, ssh, .git, deep or bare form); null for another host."""
    text = F.trim(raw)
    bare = F.regexp_replace(text, r"^/+", "")
    path = (
        F.when(text.rlike(r"(?i)^git@github\.com:.+$"), F.regexp_replace(text, r"(?i)^git@github\.com:", ""))
        .when(text.rlike(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?(?:www\.)?github\.com(?::\d+)?(?:/|$)"), F.regexp_replace(text, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?(?:www\.)?github\.com(?::\d+)?", ""))
        .when(bare.rlike(r"(?i)^(?:www\.)?github\.com/"), F.regexp_replace(bare, r"(?i)^(?:www\.)?github\.com", ""))
        .when(~text.contains("://"), bare)
    )
    return F.filter(F.split(F.regexp_replace(path, r"[?#].*$", ""), "/"), lambda x: x != "")


def repository_at(parts: Column) -> Column:
    """struct<owner, name> of the parts of a link's path; null for anything else. It uses them many times, so rows should hold them as a column."""
    owner, name = F.get(parts, F.lit(0)), F.regexp_replace(F.get(parts, F.lit(1)), r"\.git$", "")
    good = owner.rlike(f"^{OWNER}$") & name.rlike(f"^{NAME}$") & ~name.isin(".", "..")
    return F.when(good, F.struct(owner.alias("owner"), name.alias("name")))


def repository_of(raw: Column) -> Column:
    """struct<owner, name> of a pasted link; null for anything else."""
    return repository_at(repository_path(raw))


def fix_sentence(kind: Column, package: Column, target: Column, replacement: Column) -> Column:
    return (
        F.when((kind == "upgrade") & target.isNotNull(), F.concat(F.lit("Upgrade "), package, F.lit(" to "), target))
        .when(kind == "upgrade", F.concat(F.lit("Upgrade "), package))
        .when((kind == "replace") & replacement.isNotNull(), F.concat(F.lit("Replace "), package, F.lit(" with "), replacement))
        .when(kind == "replace", F.concat(F.lit("Replace "), package))
        .when(kind == "remove", F.concat(F.lit("Remove "), package))
        .otherwise(F.concat(F.lit("Investigate "), package))
    )


def npm_deprecation(value: Column) -> Column:
    """struct<is_deprecated, reason> of a document's field (a variant): false and null are none, text is kept, the rest is ''."""
    kind = F.schema_of_variant(value)
    none = value.isNull() | (kind == "VOID") | ((kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == F.lit(False)))
    reason = F.when(~none, F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).otherwise(""))
    return F.struct((~none).alias("is_deprecated"), reason.alias("reason"))


# Fixed value: the published classifier.
INACTIVE = "Development Status :: 7 - Inactive"


def pypi_deprecation(files: Column, classifiers: Column) -> Column:
    """struct<is_deprecated, reason>: all of at least one file yanked, or the inactive classifier."""
    yanked = (F.size(files) > 0) & F.forall(files, lambda f: F.coalesce(f["yanked"], F.lit(False)))
    why = F.get(F.filter(F.transform(files, lambda f: f["yanked_reason"]), lambda r: F.coalesce(r, F.lit("")) != ""), F.lit(0))
    inactive = F.coalesce(F.array_contains(classifiers, INACTIVE), F.lit(False))
    reason = F.when(yanked, F.coalesce(why, F.when(inactive, INACTIVE), F.lit(""))).when(inactive, INACTIVE)
    return F.struct((yanked | inactive).alias("is_deprecated"), reason.alias("reason"))


def release_time(files: Column) -> Column:
    return F.array_max(F.transform(files, lambda f: F.coalesce(f["upload_time_iso_8601"], f["upload_time"]).try_cast("timestamp")))


# Keys of links to the source, the most telling first.
SOURCE_KEYS = ("source", "source code", "repository", "code", "github", "homepage", "home")


def source_link(urls: Column, home_page: Column) -> Column:
    """The preferred entry of a free-form map of links, whatever the case of its key, else the home page.

    Blank links do not count; of several spellings of one key the last counts.
    """
    filled = F.filter(F.map_entries(urls), lambda e: F.trim(F.coalesce(e["value"], F.lit(""))) != "")
    named = lambda k: F.try_element_at(F.filter(filled, lambda e: F.lower(F.trim(e["key"])) == k), F.lit(-1))["value"]
    return F.coalesce(*[F.trim(named(k)) for k in SOURCE_KEYS], F.nullif(F.trim(home_page), F.lit("")))
