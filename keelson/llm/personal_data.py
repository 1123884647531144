"""Personal data by weak supervision, in DataFrame functions alone.

Fixed patterns give the base spans of four kinds: email, ip, card, phone. Looser patterns give
candidates (further phones and cards, spelled-out emails, identity numbers, names, secrets). Five
labelers vote for, against or not at all on each candidate: its form, a checksum or range, a
gazetteer, the words before it (at most ``CONTEXT`` code points, back to the previous candidate),
and its make-up. None of them repeats the pattern that found the candidate. Texts are matched
once; bases and judged candidates go to a table. Its vote patterns are counted,
expectation-maximisation estimates each labeler's reliability from the counts (a bounded
number of patterns, whatever the table), and a logistic span classifier is trained on the
resulting probabilities. Candidates that it accepts are added; base spans always stay.

A match is located through the texts between matches: running sums of the lengths of gaps and
matches are code-point positions. The sums take the logarithm of the number of matches in passes
over an array, patterns start only where a run starts and repeat possessively, and no text is cut
by position but within a chunk: n code points cost n log n at most. This changes no match.

Defined results: a null or empty text has no spans. Every row is judged on its own, so repeated
rows agree. Columns of the input keep their values; added names start with ``__pii``.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# The base patterns, each led by a test that a run of its characters starts here.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("name", "secret", "ssn")
KINDS = (*BASE_KINDS, *ADDED_KINDS)

LOOSE = {
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![0-9A-Z])|(?:[Pp]assword|[Pp]asswd|[Pp]wd|[Ss]ecret|[Tt]oken|[Aa]pi[_-]?[Kk]ey)\x20{0,2}[=:]\x20{0,2}\"?[A-Za-z0-9+/_-]{8,}+\"?)",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?[(\[](?:dot|DOT)[)\]]\x20?|\.)[A-Za-z]{2,}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{2,4}\)\x20?|0[0-9]{1,4}[\x20/-]|[0-9]{3}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9]{13,15}+(?![0-9])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sra?)\.?\x20\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++)?",
}
CANDIDATE = "|".join(f"(?:{p})" for p in LOOSE.values())
#: A text without any of these holds no candidate; most texts stop here.
HINT = r"[0-9@]|AKIA|[Pp]ass|[Pp]wd|[Ss]ecret|[Tt]oken|[Kk]ey|[(\[](?:at|AT)[)\]]|Mr|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sr"

# Gazetteers and cue words.
NAMES = "Alice Anna Antonio Carlos Carmen Charles Claire David Elena Emma George Hans Henri Ines Jack James Jean Johann John Jorge Jose Juan Julia Jürgen Karl Klaus Laura Louis Lucas Luis Luisa Maria Marie Mark Martin Mary Michael Michel Miguel Nina Paul Pedro Peter Petra Pierre Rafael Robert Sara Sofia Sophie Thomas Ursula William Wolfgang Bauer Becker Bernard Brown Davis Dubois Durand Fernandez Fischer Garcia Gonzalez Hernandez Hoffmann Johnson Jones Klein Koch Lambert Laurent Lefebvre Lopez Martinez Meyer Miller Moreau Moreno Müller Perez Richter Rodriguez Roux Sanchez Schmidt Schneider Schulz Simon Smith Taylor Torres Wagner Weber Williams Wilson".split()
NO_NAMES = "President Minister Speaker Chairman Secretary Director Mayor Judge General King Queen House January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
ENDINGS = "com org net edu gov info io de fr es uk eu".split()
RESERVED = "example invalid localhost test".split()
KEY_HEADS = "AKIA ASIA ghp_ gho_ github_pat_ glpat- sk_ pk_ xoxb- xoxp- AIza".split()
PLACEHOLDERS = "changeme example placeholder password yourpassword secret xxxx 12345678 00000000 abcdefgh redacted undefined".split()
SAMPLES = "371449635398431 378282246310005 378734493671000 30569309025904 38520000023237 078-05-1120 219-09-9999 123-45-6789".split()
CUES = r"(?i)(?:phone|tel|call|fax|mobile|contact|e-?mail|mail|write|card|visa|credit|account|ssn|social|security|password|token|secret|key|login|name|dear|by|signed|user)\W{0,4}$"
AGAINST = r"(?i)(?:version|v|page|pp|isbn|issn|section|chapter|figure|fig|table|vol|no|article|order|invoice|part|model|build)\W{0,3}$"
CONTEXT = 40
CHUNK = 4096

LABELERS = ("form", "check", "gazetteer", "context", "makeup")
ROUNDS = 40
FAR = 1 << 62


def long(value: int) -> Column:
    return F.lit(value).cast("long")


def scan(values: Column, combine: Callable[[Column, Column], Column], neutral: Column) -> Column:
    """Running ``combine`` over an array of longs: each pass doubles the reach, as many as the array needs."""
    reaches = F.filter(F.array(*[F.lit(1 << n) for n in range(31)]), lambda reach: reach < F.size(values))

    def double(held: Column, reach: Column) -> Column:
        moved = F.slice(F.concat(F.array_repeat(neutral, reach), held), F.lit(1), F.size(held))
        return F.zip_with(held, moved, lambda a, b: combine(a, b))

    return F.aggregate(reaches, values, double)


def before_each(values: Column, first: Column) -> Column:
    """The array moved on by one place."""
    return F.slice(F.concat(F.array(first), values), F.lit(1), F.size(values))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found, gap>>: leftmost non-overlapping matches, in code points, end exclusive, and the text since the one before."""
    pairs = F.filter(
        F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, found: F.struct(gap.alias("gap"), found.alias("found"))),
        lambda x: x["found"].isNotNull(),
    )
    length = lambda x: F.length(x).cast("long")

    def placed(pairs: Column) -> Column:
        ends = scan(F.transform(pairs, lambda x: length(x["gap"]) + length(x["found"])), lambda a, b: a + b, long(0))
        return F.zip_with(pairs, ends, lambda x, end: F.struct((end - length(x["found"])).alias("start"), end.alias("end"), x["found"].alias("found"), x["gap"].alias("gap")))

    return bound(pairs, placed)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of 13 to 19 digits passes the Luhn check; others do not."""

    def term(i: Column) -> Column:
        digit = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)

    total = F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), lambda sum_, i: sum_ + term(i))
    return F.when(F.length(number).between(13, 19), total % 10 == 0).otherwise(False)


def valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return found.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(digits(found)).between(16, 19) & luhn(digits(found))
    if kind == "phone":
        return F.length(digits(found)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end>> of the four kinds, by kind as listed and then by start."""

    def of(kind: str, pattern: str, needs: str) -> Column:
        some = F.when(text.rlike(needs), F.filter(matches(text, pattern), lambda x: valid(kind, x["found"])))
        spans = F.transform(some, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
        return F.coalesce(spans, F.expr("CAST(array() AS array<struct<kind: string, start: bigint, end: bigint>>)"))

    return F.concat(of("email", EMAIL, "@"), of("ip", IP, r"[0-9]\.[0-9]"), of("card", CARD, "[0-9][ -]?[0-9]"), of("phone", PHONE, r"\+[0-9]"))


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def any_of(words: Iterable[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def judged(x: Column) -> Column:
    """A candidate with its kind, the five votes and the binned features of the classifier."""
    found = x["found"]
    kind = F.coalesce(*[F.when(found.rlike(f"^(?:{pattern})$"), F.lit(name)) for name, pattern in LOOSE.items()], F.lit("other"))
    number = digits(found)
    before = F.right(x["gap"], F.lit(CONTEXT))
    distinct = F.size(F.array_distinct(F.split(found, "")))
    value = F.regexp_replace(F.regexp_replace(found, r"^[^=:]*[=:]\x20*", ""), '"', "")
    by_kind = lambda **votes: F.coalesce(*[F.when(kind == name, vote(*pair)) for name, pair in votes.items()], F.lit(0))
    return F.struct(
        kind.alias("kind"),
        x["start"].alias("start"),
        x["end"].alias("end"),
        F.array(
            by_kind(
                secret=(F.length(value) >= 16, (F.length(value) < 10) | value.rlike("^[a-z]+$")),
                email=(found.rlike(r"[(\[](?:dot|DOT)"), found.rlike(r"[)\]]\x20?[0-9-]+(?:\.|\x20?[(\[])")),
                phone=(found.rlike(r"^\(|^0"), found.rlike(r"^[0-9]+\.[0-9]+\.")),
                card=(number.rlike("^(?:3[0-9]|4|5[1-5]|6)"), number.rlike("^[0127-9]")),
                name=(found.rlike(r"\p{Lu}\p{Ll}+\x20\p{Lu}"), F.length(found) > 40),
            ),
            by_kind(
                card=(luhn(number), ~luhn(number)),
                ssn=(found.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"), found.rlike("^(?:000|666|9)|-00-|-0000$")),
                phone=(F.length(number).between(9, 12), ~F.length(number).between(8, 15)),
                secret=(value.rlike("[0-9]") & value.rlike("[A-Za-z]"), ~value.rlike("[0-9]")),
            ),
            by_kind(
                name=(found.rlike(rf"\b{any_of(NAMES)}\b"), found.rlike(rf"\b{any_of(NO_NAMES)}\b")),
                email=(found.rlike(rf"(?i)\b{any_of(ENDINGS)}$"), found.rlike(rf"(?i)\b{any_of(RESERVED)}\b")),
                secret=(value.rlike(f"^{any_of(KEY_HEADS)}"), value.rlike(f"(?i){any_of(PLACEHOLDERS)}")),
                card=(F.lit(False), number.isin(*SAMPLES)),
                ssn=(F.lit(False), found.isin(*SAMPLES)),
            ),
            vote(before.rlike(CUES), before.rlike(AGAINST)),
            vote((distinct >= 8) & (kind != "card"), distinct <= 3),
        ).alias("votes"),
        F.array(
            F.concat(F.lit("kind="), kind),
            F.concat(F.lit("length="), F.least(F.floor(F.length(found) / 8), F.lit(6)).cast("string")),
            F.concat(F.lit("digits="), F.floor(F.length(number) * 4 / F.length(found)).cast("string")),
            F.concat(F.lit("distinct="), F.least(F.floor(distinct / 4), F.lit(5)).cast("string")),
            F.concat(F.lit("check="), F.when(kind == "card", luhn(number).cast("string")).otherwise("none")),
            F.concat(F.lit("cue="), vote(before.rlike(CUES), before.rlike(AGAINST)).cast("string")),
        ).alias("features"),
    )


def outside(loose: Column, base: Column) -> Column:
    """The candidates that overlap no base span: by start, none before ends later, none after begins earlier."""
    mark = lambda at, own: lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(own).alias("own"), at(x).alias("x"))
    none = F.lit(None).cast("struct<start: bigint, end: bigint, found: string, gap: string>")

    def free(all_: Column) -> Column:
        ends = before_each(scan(F.transform(all_, lambda x: F.when(x["own"], long(0)).otherwise(x["end"])), F.greatest, long(0)), long(0))
        starts = scan(F.reverse(F.transform(all_, lambda x: F.when(x["own"], long(FAR)).otherwise(x["start"]))), F.least, long(FAR))
        clear = F.zip_with(ends, F.reverse(starts), lambda end, start: F.struct(end.alias("end"), start.alias("start")))
        kept = F.zip_with(all_, clear, lambda x, gap: F.when(x["own"] & (gap["end"] <= x["start"]) & (gap["start"] >= x["end"]), x["x"]))
        return F.filter(kept, lambda x: x.isNotNull())

    spans = F.sort_array(F.concat(F.transform(loose, mark(lambda x: x, True)), F.transform(base, mark(lambda _: none, False))))
    return F.when((F.size(base) == 0) | (F.size(loose) == 0), loose).otherwise(bound(spans, free))


def candidates(loose: Column, base: Column) -> Column:
    """Candidates outside the base spans, each judged."""
    # A number of a card's length whose checksum fails is no card, whatever surrounds it.
    able = F.filter(outside(loose, base), lambda x: ~x["found"].rlike("^[0-9]{13,15}$") | luhn(x["found"]))
    return F.transform(able, judged)


@dataclass(frozen=True)
class SpanModel:
    reliabilities: dict[str, tuple[float, float]]  # labeler: P(for | private), P(against | not private)
    bias: float
    weights: dict[str, float]

    def accepts(self, features: Column) -> Column:
        if not self.weights:
            return F.lit(False)
        table = F.create_map(*[F.lit(x) for pair in sorted(self.weights.items()) for x in pair])
        total = F.aggregate(features, F.lit(self.bias), lambda sum_, f: sum_ + F.coalesce(F.element_at(table, f), F.lit(0.0)))
        return total > 0


Pattern = tuple[tuple[int, ...], tuple[str, ...], int]


def reliabilities(patterns: list[Pattern], rounds: int = ROUNDS) -> tuple[dict[str, tuple[float, float]], list[float]]:
    """Expectation-maximisation over vote patterns; also each pattern's probability of being private.

    Votes are independent given the truth; an abstention says nothing. Pseudo-counts (8 right to
    2 wrong) keep a labeler that hardly votes, or a table with few candidates, well defined.
    """
    right = {name: (0.8, 0.8) for name in LABELERS}
    prior, posterior = 0.5, []
    for _ in range(rounds):
        posterior = []
        for votes, _, _ in patterns:
            odds = math.log(prior / (1 - prior))
            for name, v in zip(LABELERS, votes):
                yes, no = right[name]
                odds += math.log(yes / (1 - no)) if v > 0 else math.log((1 - yes) / no) if v < 0 else 0.0
            posterior.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        total = sum(n for *_, n in patterns)
        prior = (2 + sum(p * n for p, (*_, n) in zip(posterior, patterns))) / (4 + total)
        for at, name in enumerate(LABELERS):
            hit = [2.0, 2.0, 2.0, 2.0]  # for and private, against and private, against and not, for and not
            for p, (votes, _, n) in zip(posterior, patterns):
                if votes[at] > 0:
                    hit[0] += p * n
                    hit[3] += (1 - p) * n
                elif votes[at] < 0:
                    hit[1] += p * n
                    hit[2] += (1 - p) * n
            # At least as good as chance, so that the two labels cannot swap.
            right[name] = (max(0.5, (hit[0] + 6) / (hit[0] + hit[1] + 6)), max(0.5, (hit[2] + 6) / (hit[2] + hit[3] + 6)))
            right[name] = tuple(min(x, 0.99) for x in right[name])
    return right, posterior


def span_classifier(patterns: list[Pattern], posterior: list[float], steps: int = 300, rate: float = 2.0, ridge: float = 1e-3) -> tuple[float, dict[str, float]]:
    """Logistic regression on the binned features with the probabilities as soft labels; log counts weigh."""
    weights: dict[str, float] = defaultdict(float)
    bias = 0.0
    heft = [math.log1p(n) for *_, n in patterns]
    total = sum(heft) or 1.0
    for _ in range(steps):
        slope: dict[str, float] = defaultdict(float)
        lean = 0.0
        for (_, features, _), p, w in zip(patterns, posterior, heft):
            z = bias + sum(weights[f] for f in features)
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * w / total
            lean += error
            for f in features:
                slope[f] += error
        bias -= rate * lean
        for f, s in slope.items():
            weights[f] -= rate * (s + ridge * weights[f])
    return bias, dict(weights)


def train(patterns: Iterable[Pattern]) -> SpanModel:
    ordered = sorted(patterns)
    if not ordered:
        return SpanModel({}, 0.0, {})
    right, posterior = reliabilities(ordered)
    bias, weights = span_classifier(ordered, posterior)
    return SpanModel(right, bias, weights)


def matched(docs: DataFrame, text_col: str = "text", columns: Sequence[str] | None = None) -> DataFrame:
    """The rows with ``__pii_base`` and the judged ``__pii_candidates``; ``columns``: those of the input to carry along (all)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    loose = F.coalesce(F.when(text.rlike(HINT), matches(text, CANDIDATE)), F.expr("CAST(array() AS array<struct<start: bigint, end: bigint, found: string, gap: string>>)"))
    found = docs.withColumn("__pii_base", base_spans(text)).withColumn("__pii_loose", loose)
    kept = [F.col(f"`{c}`") for c in (docs.columns if columns is None else columns)]
    return found.select(*kept, "__pii_base", candidates(F.col("__pii_loose"), F.col("__pii_base")).alias("__pii_candidates"))


def fit(found: DataFrame) -> SpanModel:
    """Counts the vote patterns of all candidates of ``matched`` rows; the distinct patterns are few by construction."""
    counted = found.select(F.explode("__pii_candidates").alias("x")).groupBy("x.votes", "x.features").count().collect()
    return train((tuple(r["votes"]), tuple(r["features"]), r["count"]) for r in counted)


def annotate(docs: DataFrame, text_col: str = "text", model: SpanModel | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """The input rows (``columns`` of them) with ``__pii_base`` and ``__pii_spans`` (base and added, by kind and start)."""
    found = matched(docs, text_col, columns)
    if model is None:
        found = written(found, "private")
        model = fit(found)
    added = F.filter("__pii_candidates", lambda x: model.accepts(x["features"]))
    rank = F.create_map(*[x for n, k in enumerate(KINDS) for x in (F.lit(k), F.lit(n))])
    keyed = lambda x: F.struct(F.coalesce(F.element_at(rank, x["kind"]), F.lit(99)).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))
    return found.withColumn("__pii_spans", F.sort_array(F.concat(F.transform("__pii_base", keyed), F.transform(added, keyed)))).drop("__pii_candidates")


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", model: SpanModel | None = None) -> DataFrame:
    """The input rows and columns, with each span of the text replaced by its kind in angle brackets.

    Where spans overlap, the first one's mark stands for all that they cover. A null text stays null.
    """
    found = annotate(docs, text_col, model)
    text = F.col(text_col).cast("string")

    def cut(chunks: Column, start: Column, end: Column) -> Column:
        """Code points [start, end) of a text in chunks of ``CHUNK``."""
        first = F.floor(start / CHUNK)
        some = F.array_join(F.slice(chunks, (first + 1).cast("int"), (F.floor(end / CHUNK) - first + 1).cast("int")), "")
        return F.substring(some, (start - first * CHUNK + 1).cast("int"), (end - start).cast("int"))

    def cleaned(held: Column) -> Column:
        spans, chunks = held["spans"], held["chunks"]

        def joined(reached: Column) -> Column:
            heads = F.filter(F.zip_with(spans, before_each(reached, long(0)), lambda x, open_: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), open_.alias("open"))), lambda x: x["start"] >= x["open"])
            marked = F.transform(heads, lambda x: F.concat(cut(chunks, x["open"], x["start"]), F.lit("<"), F.upper(x["kind"]), F.lit(">")))
            return F.concat(F.array_join(marked, ""), cut(chunks, F.element_at(reached, -1), held["length"]))

        return bound(scan(F.transform(spans, lambda x: x["end"]), F.greatest, long(0)), joined)

    by_start = F.array_sort(F.transform("__pii_spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    held = F.struct(by_start.alias("spans"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("chunks"), F.length(text).cast("long").alias("length"))
    clean = F.when(F.size("__pii_spans") == 0, text).otherwise(bound(held, cleaned))
    return found.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
