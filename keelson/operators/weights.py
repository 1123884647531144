"""Versioned weight sets: a folder of YAML files, checked strictly, as small DataFrames.

They are configuration: a handful of rows whose number does not follow the data, so they are
literals or broadcast sides of joins.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import cache
from logging import getLogger
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = getLogger(__name__)
FOLDER = Path(__file__).resolve().parent.parent / "weights"
ACTIVE = "v2"
SIGNALS = ("deprecation", "severity", "count", "staleness")
#: A fifth signal that a weight file may enable, the same weight for each ecosystem.
EPSS = "epss"
ECOSYSTEMS = ("npm", "pypi")
#: Weights are whole multiples of it, so that scores are exact in integers.
UNIT = Decimal("0.0001")


class WeightsError(ValueError):
    """A weight file that must not be used."""


@dataclass(frozen=True)
class WeightSet:
    version: str
    weights: dict[str, dict[str, Decimal]]
    count_cap: int
    staleness_cap_days: int
    stale_flag_days: int
    safe_min: int
    medium_min: int
    decay: Decimal
    max_terms: int
    epss_enabled: bool
    epss_weight: Decimal


def check(found: WeightSet, tag: str) -> WeightSet:
    """Raises ``WeightsError`` with every broken rule."""
    wrong = []
    if found.version != tag:
        wrong.append(f"version {found.version!r} does not match the file {tag!r}")
    for name in ("count_cap", "staleness_cap_days", "stale_flag_days", "max_terms"):
        if not isinstance(value := getattr(found, name), int) or isinstance(value, bool) or value <= 0:
            wrong.append(f"{name} must be a positive integer")
    if not 0 <= found.medium_min < found.safe_min <= 100:
        wrong.append("thresholds must satisfy 0 <= medium_min < safe_min <= 100")
    if not 0 < found.decay <= 1:
        wrong.append("decay must lie in (0, 1]")
    if set(found.weights) != set(ECOSYSTEMS):
        wrong.append("weights must name each ecosystem")
    if not found.epss_enabled and found.epss_weight != 0:
        wrong.append("a disabled signal must have weight 0")
    for ecosystem, row in found.weights.items():
        if set(row) != set(SIGNALS):
            wrong.append(f"{ecosystem} must name exactly the four signals")
        if any(w < 0 for w in row.values()) or found.epss_weight < 0:
            wrong.append(f"{ecosystem} has a negative weight")
        if any(w % UNIT for w in (*row.values(), found.epss_weight)):
            wrong.append(f"{ecosystem} has a weight finer than {UNIT}")
        if abs(sum(row.values()) + found.epss_weight - 1) > Decimal("0.001"):
            wrong.append(f"{ecosystem} must sum to 1")
    if wrong:
        raise WeightsError("; ".join(wrong))
    return found


def parse(document: dict, tag: str) -> WeightSet:
    try:
        return check(
            WeightSet(
                str(document["version"]),
                {e: {s: Decimal(str(w)) for s, w in row.items()} for e, row in document["weights"].items()},
                document["caps"]["count"],
                document["caps"]["staleness_days"],
                document["stale_flag_days"],
                document["thresholds"]["safe_min"],
                document["thresholds"]["medium_min"],
                Decimal(str(document["rollup"]["decay"])),
                document["rollup"]["max_terms"],
                bool(document["epss"]["enabled"]),
                Decimal(str(document["epss"]["weight"])),
            ),
            tag,
        )
    except (KeyError, TypeError, AttributeError, ArithmeticError) as error:
        raise WeightsError(f"{tag}: {error}") from error


@cache
def load(version: str, folder: Path = FOLDER) -> WeightSet:
    import yaml

    path = folder / f"{version}.yaml"
    if not path.is_file():
        raise WeightsError(f"no weight file for {version!r}")
    try:
        document = yaml.safe_load(path.read_text())
    except (OSError, UnicodeDecodeError, yaml.YAMLError) as error:
        raise WeightsError(f"{version}: {error}") from error
    return parse(document, version)


@cache
def versions(folder: Path = FOLDER) -> tuple[str, ...]:
    """The versions whose files can be loaded; a broken file is named in the log and counts as absent."""
    found = []
    for path in sorted(folder.glob("*.yaml")):
        try:
            found.append(load(path.stem, folder).version)
        except WeightsError as error:
            LOG.warning("weight file left out: %s", error)
    return tuple(found)


def weight_table(spark: SparkSession, folder: Path = FOLDER) -> DataFrame:
    """One row per version and ecosystem: the weights in units of ``UNIT`` (that of the exploit probability is 0
    where it is not enabled), caps and flags."""
    rows = [
        (s.version, e, *[int(row[x] / UNIT) for x in SIGNALS], int(s.epss_weight / UNIT), s.epss_enabled, s.count_cap, s.staleness_cap_days, s.stale_flag_days)
        for s in (load(v, folder) for v in versions(folder))
        for e, row in s.weights.items()
    ]
    kinds = ", ".join(f"w_{x} long" for x in (*SIGNALS, EPSS))
    return spark.createDataFrame(rows, f"version string, ecosystem string, {kinds}, epss_enabled boolean, count_cap int, staleness_cap_days int, stale_flag_days int")


def threshold_table(spark: SparkSession) -> DataFrame:
    rows = [(s.version, s.safe_min, s.medium_min) for s in map(load, versions())]
    return spark.createDataFrame(rows, "version string, safe_min int, medium_min int")


def factor_table(spark: SparkSession) -> DataFrame:
    """Exact powers of each version's decay, one row per kept rank."""
    rows = [(s.version, k, s.decay**k) for s in map(load, versions()) for k in range(s.max_terms)]
    return spark.createDataFrame(rows, "version string, rank int, factor decimal(20,19)")


def usable_version(version, folder: Path = FOLDER, active: str = ACTIVE):
    """A scan's own version where a file for it can be loaded, else the active one."""
    return F.when(version.isin(*versions(folder)), version).otherwise(F.lit(active))


#: Weight sets that are compared with the shipped ones and never used for a stored score.
TRIAL = FOLDER / "trial"
