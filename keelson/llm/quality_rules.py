"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one
bit per failed rule; a versioned policy is a mask over those bits, so that applying a
policy, comparing two, or asking what a rule alone removes never reads a text again.

Defined results: a null or empty text has no words, fails ``few_words`` and is not kept.
Repeated rows stay repeated. Columns of the input other than the id and the text do not
reach the ledger, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SYMBOLS = b"#*$%&|<>"
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_marks long, longest_word long"


@dataclass(frozen=True)
class Rule:
    """``fails`` is a predicate over the measurements, given by name; ``bit`` never changes once published."""

    name: str
    bit: int
    fails: Callable[[Callable[[str], Column]], Column]

    @property
    def mask(self) -> int:
        return 1 << self.bit


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    def mask(self, rules: Sequence[Rule]) -> int:
        by_name = {r.name: r.mask for r in rules}
        return sum(by_name[name] for name in self.rules)


RULES = (
    Rule("few_words", 0, lambda m: m("n_words") < 50),
    Rule("repeated_trigrams", 1, lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
    Rule("symbol_heavy", 2, lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("duplicate_lines", 3, lambda m: (m("n_dup_lines") >= 3) & (100 * m("n_dup_lines") > 30 * m("n_lines"))),
    Rule("short_words", 4, lambda m: m("word_chars") < 2 * m("n_words")),
    Rule("mark_heavy", 5, lambda m: 2 * m("n_marks") > m("word_chars")),
    Rule("one_long_word", 6, lambda m: (m("longest_word") > 1000) & (2 * m("longest_word") > m("word_chars"))),
)
BASE = ("few_words", "repeated_trigrams")
POLICIES = (
    Policy("v0_base", BASE),
    Policy("v1_lines", (*BASE, "duplicate_lines")),
    Policy("v2_full", tuple(r.name for r in RULES)),
)
PRODUCTION = POLICIES[-1]


def repeated_words(words: Sequence[bytes]) -> int:
    """Words inside three-word windows that occur twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    distinct = set(windows)
    if len(distinct) == len(windows):
        return 0
    seen: set = set()
    twice = {w for w in windows if w in seen or seen.add(w)}
    covered, end = 0, 0
    for i, window in enumerate(windows):
        if window in twice:
            covered += i + 3 - max(end, i)
            end = i + 3
    return covered


def measure(text: bytes | None) -> tuple[int, ...]:
    text = text or b""
    words = text.split()
    joined = b"".join(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(joined.decode("utf-8", "replace")),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(joined) - len(joined.translate(None, MARKS)),
        max(map(len, words), default=0),
    )


def _measure_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [field.split()[0] for field in MEASURES.split(", ")]
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        found = list(zip(*map(measure, texts))) or [()] * len(names)
        columns = [pa.array(values, pa.int64()) for values in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])


def failure_bits(rules: Sequence[Rule] = RULES, prefix: str = "") -> Column:
    """The bits of the rules that fail, from measurements in columns of their name after ``prefix``."""
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(rule.fails(lambda name: F.col(prefix + name)), F.lit(rule.mask).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def build_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per input row: the id, every measurement and ``failure_bits``. No shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    measured = rows.mapInArrow(_measure_batches, f"doc_id long, {MEASURES}")
    return measured.withColumn("failure_bits", failure_bits(rules))


def apply_policy(ledger: DataFrame, policy: Policy = PRODUCTION, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Adds ``kept``: no bit of the policy's mask is set."""
    return ledger.withColumn("kept", F.col("failure_bits").bitwiseAND(F.lit(policy.mask(rules))) == 0)


def with_ablation(ledger: DataFrame, policy: Policy = PRODUCTION, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Adds ``kept``, ``only_rule`` (the rule that alone rejects the row, if one does) and ``n_only`` (rows that it alone rejects).

    The totals are one row a rule, so they are broadcast.
    """
    held = F.col("failure_bits").bitwiseAND(F.lit(policy.mask(rules)))
    alone = F.coalesce(*[F.when(held == r.mask, F.lit(r.name)) for r in rules if r.name in policy.rules])
    totals = ablation(ledger, [policy], rules).select(F.col("rule").alias("only_rule"), "n_only")
    return apply_policy(ledger, policy, rules).withColumn("only_rule", alone).join(F.broadcast(totals), "only_rule", "left")


def ablation(ledger: DataFrame, policies: Sequence[Policy] = POLICIES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per policy and rule: documents that fail it, and documents that only it rejects.

    The ledger is first reduced to one row per bit pattern (at most 2 to the number of
    rules), with partial aggregation before the exchange.
    """
    patterns = ledger.groupBy("failure_bits").agg(F.count("*").alias("n"))
    masks = F.explode(
        F.array(
            *[
                F.struct(F.lit(p.version).alias("policy"), F.lit(p.mask(rules)).cast("long").alias("mask"), F.lit(r.name).alias("rule"), F.lit(r.mask).cast("long").alias("bit"))
                for p in policies
                for r in rules
                if r.name in p.rules
            ]
        )
    )
    held = F.col("failure_bits").bitwiseAND(F.col("x.mask"))
    return (
        patterns.withColumn("x", masks)
        .groupBy(F.col("x.policy").alias("policy"), F.col("x.rule").alias("rule"))
        .agg(
            F.sum(F.when(held.bitwiseAND(F.col("x.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(held == F.col("x.bit"), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(held != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
            F.sum("n").alias("n_documents"),
            F.bit_or(held).alias("bits_seen"),
        )
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", policy: Policy = PRODUCTION, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The input rows, every column, that the policy keeps; texts pass through unchanged, and columns may have any name."""
    schema = docs.schema
    at = schema.fieldNames().index(text_col)
    names = [field.split()[0] for field in MEASURES.split(", ")]
    prefix = "__m_"
    while any(c.lower().startswith(prefix) for c in schema.fieldNames()):
        prefix += "_"
    flags = [prefix + name for name in names]

    def with_measures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*map(measure, batch.column(at).cast(pa.binary()).to_pylist()))) or [()] * len(names)
            columns = [pa.array(values, pa.int64()) for values in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *flags])

    wide = T.StructType([*schema.fields, *[T.StructField(flag, T.LongType()) for flag in flags]])
    measured = docs.mapInArrow(with_measures, wide)
    kept = failure_bits(rules, prefix).bitwiseAND(F.lit(policy.mask(rules))) == 0
    return measured.where(kept).select(*[F.col(f"`{c}`") for c in schema.fieldNames()])
