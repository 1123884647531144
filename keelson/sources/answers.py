"""What an answer of a remote service means: one word for each, from its status, headers and size.

The words are those that staged answers carry in ``status`` (registries, documents, trees). Nothing is fetched here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = ("ok", "unauthorized", "not_found", "conflict", "forbidden", "rate_limited", "too_large", "client_error", "unavailable")


def header(headers: Column, name: str) -> Column:
    """A header's value, its name in whatever case; the last of several."""
    found = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.trim(F.try_element_at(found, F.lit(-1))["value"])


def retry_after(headers: Column) -> Column:
    """Seconds to wait, where the service says a number; less than none is none, and a date is not read."""
    seconds = header(headers, "retry-after").try_cast("double")
    return F.greatest(seconds, F.when(seconds.isNotNull(), F.lit(0.0)))


def is_rate_limited(code: Column, headers: Column) -> Column:
    """429, or a 403 that says that nothing is left or how long to wait."""
    spent = F.coalesce(header(headers, "x-ratelimit-remaining") == "0", F.lit(False))
    return F.coalesce((code == 429) | ((code == 403) & (spent | header(headers, "retry-after").isNotNull())), F.lit(False))


def status_word(code: Column, headers: Column, size: Column, most: Column | int) -> Column:
    """One of ``WORDS``. A body over the cap is too large, as soon as its declared length says so; no status is a failed transport."""
    cap = most if isinstance(most, Column) else F.lit(most)
    declared = header(headers, "content-length").try_cast("long")
    large = F.coalesce(F.greatest(F.coalesce(declared, F.lit(0)), F.coalesce(size, F.lit(0))) > cap, F.lit(False))
    return (
        F.when(code.isNull(), "unavailable")
        .when(is_rate_limited(code, headers), "rate_limited")
        .when(code >= 500, "unavailable")
        .when(code == 401, "unauthorized")
        .when(code == 404, "not_found")
        .when(code == 409, "conflict")
        .when(code == 403, "forbidden")
        .when(code >= 400, "client_error")
        .when(code >= 300, "unavailable")
        .when(large, "too_large")
        .otherwise("ok")
    )
