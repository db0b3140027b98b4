"""Personal data by weak supervision, in DataFrame expressions only.

Regular expressions propose candidate spans. Four labelers vote on each (for, against, silent): the strictness of
the expression, a gazetteer (endings of domains, issuers, number ranges, countries), cue words in the text before it, and
the variety of its characters. Votes, kind and length of all candidates of the corpus are counted by pattern, a table
bounded by the number of possible patterns; expectation-maximisation over it estimates how reliable each labeler is and
how likely each pattern is personal data. Those probabilities train the final classifier, a logistic regression on
votes, kind and length, whose weights enter the last pass as constants. Base spans always stay; other candidates
that overlap none and reach the threshold are added.

Positions come from splitting a text at a pattern: the pieces between matches and the matches give all offsets,
in code points, end exclusive. Possessive and look-behind forms of the patterns keep the work linear in the text.
Null and empty texts have no spans. Order: start, then kind as listed, then end.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
BASE_KINDS = 4
CONTEXT = 48
BLOCK = 128
THRESHOLD = 0.5

PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Every second digit from the right counts double, by its digit sum; the total is a multiple of ten."""
    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(F.filter(each, lambda v: v.isNotNull()), F.lit(0), lambda a, v: a + v) % 10 == 0


def card(s: Column) -> Column:
    n = digits(s)
    return F.length(n).between(14, 19) & luhn(n)


@dataclass(frozen=True)
class Proposal:
    """A kind of candidate: pattern, a cheap test that a text must pass first, and what a match must satisfy."""

    kind: int
    base: bool
    pattern: str
    first: Callable[[], Column]
    holds: Callable[[Column], Column]


def _number() -> Column:
    return F.col("_digit")


def _always(s: Column) -> Column:
    return F.lit(True)


PROPOSALS = (
    Proposal(0, True, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda: F.contains("_text", F.lit("@")), _always),
    Proposal(1, True, r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _number, lambda s: s.rlike(rf"^(?:{PART}\.){{3}}{PART}$")),
    Proposal(2, True, r"[0-9](?:[ -]?[0-9])++", _number, card),
    Proposal(3, True, r"\+[0-9][ ().0-9-]+[0-9]", lambda: _number() & F.contains("_text", F.lit("+")), lambda s: F.length(digits(s)).between(10, 15)),
    Proposal(0, False, r"[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?: ?(?:[\[(](?:dot|DOT)[\])]|\.) ?[A-Za-z0-9-]++)++", lambda: F.col("_text").rlike(r"[\[(](?:at|AT)[\])]"), _always),
    Proposal(3, False, r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-]*[0-9])", _number, _always),
    Proposal(4, False, r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda: _number() & F.contains("_text", F.lit("-")), _always),
    Proposal(5, False, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])", _number, _always),
)

# What the gazetteer knows and what surrounds real ones, as patterns over the match and over the text before it.
KNOWN = (r"(?i)[. \])](?:com|org|net|edu|gov|int|info|biz|io|de|fr|es|it|uk|nl|at|ch|be|pl|se|eu|us|ca|mx|br|jp|cn|in|au)$",
         r"^(?!0\.|10\.|127\.|22[4-9]\.|23[0-9]\.|24[0-9]\.|25[0-5]\.)", r"^[ -]?(?:4|5[1-5]|2[2-7]|3[47]|6011|65)", r"^(?:\+[1-9]|\(?[2-9][0-9]{2})",
         r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)", r"^(?:AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|HU|IE|IT|LU|NL|NO|PL|PT|RO|SE|SK)")
CUES = (r"(?i)\b(?:e-?mail|mail|contact|write|correo|courriel|schreib)", r"(?i)\b(?:ip|host|server|login|address|client)", r"(?i)\b(?:card|visa|credit|karte|carte|tarjeta|pay)",
        r"(?i)\b(?:phone|tel|call|mobile|fax|ruf|appel|llam)", r"(?i)\b(?:ssn|social security)", r"(?i)\b(?:iban|account|konto|compte|cuenta)")
AGAINST = r"(?i)\b(?:version|isbn|issn|order|invoice|page|section|chapter|figure|serial)\W*$"


def located(docs: DataFrame, text: str) -> DataFrame:
    """docs with _spans: every candidate with kind, start, end, base, its characters and those before it."""
    d = docs.withColumn("_text", text_of(text)).withColumn("_digit", F.col("_text").rlike("[0-9]"))
    add = lambda a, v: a + v
    each = range(len(PROPOSALS))
    some = lambda n, value: F.when(F.size(f"_hit{n}") > 0, value)
    d = d.withColumns({f"_hit{n}": F.when(p.first(), F.regexp_extract_all("_text", F.lit(p.pattern), F.lit(0))) for n, p in enumerate(PROPOSALS)})
    d = d.withColumns({f"_gap{n}": some(n, F.split("_text", p.pattern, -1)) for n, p in enumerate(PROPOSALS)})
    d = d.withColumns({f"_len{n}": some(n, F.zip_with(F.slice(f"_gap{n}", F.lit(1), F.size(f"_hit{n}")), f"_hit{n}", lambda g, h: F.char_length(g) + F.char_length(h))) for n in each})
    # lengths by blocks, then the blocks before each: an offset needs two short sums

    def blocks(n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(f"_len{n}") / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(f"_len{n}", b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), add))

    def sums(n: int) -> Column:
        return F.transform(f"_block{n}", lambda x, b: F.aggregate(F.slice(f"_block{n}", F.lit(1), b), F.lit(0), add))

    def placed(n: int, p: Proposal) -> Column:
        def span(h: Column, i: Column) -> Column:
            gap, b = F.get(f"_gap{n}", i), F.floor(i / BLOCK).cast("int")
            start = F.get(f"_sum{n}", b) + F.aggregate(F.slice(f"_len{n}", b * BLOCK + 1, i - b * BLOCK), F.lit(0), add) + F.char_length(gap)
            return F.struct(start.alias("start"), F.lit(p.kind).alias("kind"), (start + F.char_length(h)).alias("end"), F.lit(p.base).alias("base"), h.alias("match"), F.right(gap, F.lit(CONTEXT)).alias("before"))

        return F.coalesce(F.filter(F.transform(f"_hit{n}", span), lambda s: p.holds(s.match)), F.array().cast("array<struct<start:int,kind:int,end:int,base:boolean,match:string,before:string>>"))

    # lengths by blocks, then the blocks before each: an offset needs two short sums
    d = d.withColumns({f"_block{n}": some(n, blocks(n)) for n in each})
    d = d.withColumns({f"_sum{n}": sums(n) for n in each})
    d = d.withColumn("_all", F.concat(*[placed(n, p) for n, p in enumerate(PROPOSALS)]))
    d = d.withColumn("_base", F.filter("_all", lambda s: s.base))
    free = F.filter("_all", lambda s: ~s.base & ~F.exists("_base", lambda o: (o.start < s.end) & (s.start < o.end)))
    return d.withColumn("_spans", F.array_sort(F.concat("_base", free))).select(*docs.columns, "_spans")


def _by_kind(kind: Column, patterns: tuple[str, ...], s: Column) -> Column:
    out = F.lit(False)
    for k, p in enumerate(patterns):
        out = F.when(kind == k, s.rlike(p)).otherwise(out)
    return out


def votes(s: Column) -> list[Column]:
    """The labelers, each -1, 0 or 1."""
    distinct = F.size(F.array_distinct(F.split(F.regexp_replace(s.match, "[^A-Za-z0-9]", ""), "")))
    return [F.when(s.base, 1).otherwise(0),
            F.when(_by_kind(s.kind, KNOWN, s.match), 1).otherwise(-1),
            F.when(s.before.rlike(AGAINST), -1).when(_by_kind(s.kind, CUES, s.before), 1).otherwise(0),
            F.when(distinct >= 5, 1).when(distinct >= 3, 0).otherwise(-1)]


LABELERS = 4


def size_class(s: Column) -> Column:
    n = F.char_length(s.match)
    return F.when(n < 10, 0).when(n < 16, 1).when(n < 28, 2).otherwise(3)


@dataclass(frozen=True)
class Model:
    """Weights of the final classifier, and the reliabilities found on the way (kind -> labeler -> vote -> chance)."""

    intercept: float
    kinds: tuple[float, ...]
    sizes: tuple[float, ...]
    votes: tuple[tuple[float, float, float], ...]
    reliable: tuple

    def probability(self, s: Column) -> Column:
        def pick(table, at: Column) -> Column:
            return F.get(F.array(*[F.lit(float(x)) for x in table]), at)

        z = F.lit(self.intercept) + pick(self.kinds, s.kind) + pick(self.sizes, size_class(s))
        for table, v in zip(self.votes, votes(s)):
            z = z + pick(table, v + 1)
        return 1 / (1 + F.exp(-z))


def aggregated(rows: list[tuple], rounds: int = 60) -> tuple[dict[tuple, float], tuple]:
    """Chance of each pattern (kind, size, votes...) to be personal data, by expectation-maximisation per kind.

    A labeler has a distribution over its three votes for either truth, smoothed towards one better than chance; the
    start is the majority. rows: patterns with their count last.
    """
    chance, reliable = {}, []
    for kind in range(len(KINDS)):
        own = [(r[:-1], r[2:-1], r[-1]) for r in rows if r[0] == kind]
        belief = {p: 1 / (1 + math.exp(-sum(v))) for p, v, _ in own}
        prior, tables = 0.5, []
        for _ in range(rounds if own else 0):
            n = sum(c for _, _, c in own)
            hits = sum(belief[p] * c for p, _, c in own)
            prior = (hits + 1) / (n + 2)
            tables = []
            for j in range(LABELERS):
                yes, no = [1.0, 2.0, 3.0], [3.0, 2.0, 1.0]
                for p, v, c in own:
                    yes[v[j] + 1] += belief[p] * c
                    no[v[j] + 1] += (1 - belief[p]) * c
                tables.append(([x / sum(yes) for x in yes], [x / sum(no) for x in no]))
            for p, v, _ in own:
                z = math.log(prior / (1 - prior)) + sum(math.log(tables[j][0][x + 1] / tables[j][1][x + 1]) for j, x in enumerate(v))
                belief[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        chance |= belief
        reliable.append(tuple((tuple(a), tuple(b)) for a, b in tables))
    return chance, tuple(reliable)


def trained(rows: list[tuple], rounds: int = 400) -> Model:
    """The classifier, by gradient steps on the patterns, weighted by the root of their counts."""
    chance, reliable = aggregated(rows)
    sizes = [len(KINDS), 4, *[3] * LABELERS]
    weights, intercept = [[0.0] * n for n in sizes], 0.0
    total = sum(math.sqrt(r[-1]) for r in rows)
    for _ in range(rounds if rows else 0):
        grads, g0 = [[0.0] * n for n in sizes], 0.0
        for r in rows:
            at = [r[0], r[1], *(v + 1 for v in r[2:-1])]
            z = intercept + sum(w[i] for w, i in zip(weights, at))
            e = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - chance[r[:-1]]) * math.sqrt(r[-1]) / total
            g0 += e
            for g, i in zip(grads, at):
                g[i] += e
        intercept -= 0.8 * g0
        weights = [[w * (1 - 1e-4) - 0.8 * g for w, g in zip(ws, gs)] for ws, gs in zip(weights, grads)]
    return Model(intercept, tuple(weights[0]), tuple(weights[1]), tuple(map(tuple, weights[2:])), reliable)


def patterns(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, size, votes..., n): counts of all candidates by pattern; at most kinds x 4 x 3^labelers rows."""
    # outer, as the filter that Spark infers for a plain explode would evaluate the whole expression once more per level
    s = located(docs.select(F.col(text).alias("text")), "text").select(F.explode_outer("_spans").alias("s")).where("s is not null")
    c = F.col("s")
    keys = {"kind": c.kind, "size": size_class(c), **{f"v{j}": v for j, v in enumerate(votes(c))}}
    return s.select(*[k.cast("int").alias(n) for n, k in keys.items()]).groupBy(*keys).agg(F.count("*").alias("n"))


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Counts over all rows. The bounded table of patterns reaches the driver, in a fixed order."""
    return trained(sorted(tuple(int(x) for x in r) for r in patterns(docs, text).collect()))


def spans(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD, name: str = "spans") -> DataFrame:
    """docs with an array of (start, kind, end, base, score), base spans and those the classifier adds."""
    d = located(docs, text)
    scored = F.transform("_spans", lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end"), s.base.alias("base"), model.probability(s).alias("score")))
    return d.withColumn("_spans", F.when(F.size("_spans") > 0, scored)).withColumn(
        name, F.coalesce(F.filter("_spans", lambda s: s.base | (s.score >= threshold)), F.array().cast("array<struct<start:int,kind:int,end:int,base:boolean,score:double>>"))).drop("_spans")


def joined(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def masked(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; overlapping spans by one. Null texts stay null."""
    found = spans(docs, model, text, name="_found")
    empty = F.array().cast("array<struct<start:int,end:int,kind:int>>")

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.when((F.size(acc) > 0) & (s.start < F.get(acc, F.size(acc) - 1).end), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last.start.alias("start"), F.greatest(last.end, s.end).alias("end"), last.kind.alias("kind"))))) \
            .otherwise(F.concat(acc, F.array(F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind")))))

    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    d = found.withColumn("_merged", F.when(F.size("_found") > 0, F.aggregate("_found", empty, merge)))
    pieces = F.transform("_merged", lambda s, i: F.concat(
        F.substring(F.col(text), F.when(i > 0, F.get("_merged", i - 1).end).otherwise(0) + 1, s.start - F.when(i > 0, F.get("_merged", i - 1).end).otherwise(0)), F.get(names, s.kind)))
    rest = F.substring(F.col(text), F.element_at("_merged", -1).end + 1, F.char_length(text))
    return d.withColumn(text, F.when(F.size("_merged") > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col(text))).select(*docs.columns)
