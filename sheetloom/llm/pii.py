"""Personal data by weak supervision, in DataFrame functions only.

Strict patterns give the base spans, which always stay. Looser patterns, and one for secrets such as access tokens, give further
candidates. For every candidate and base span five labelers vote or abstain: its form (a pattern), its checksum or mixture, a
gazetteer of trigger words before it, a list of words that speak against it, and how it stands in its surroundings. None of them
tells base spans from further ones. Expectation-maximisation over the counts of vote patterns (a bounded table,
counted over all documents) estimates for each kind how reliable each labeler is; its posteriors train a logistic span classifier on
the votes and on features of the span (length, share of digits, the characters beside it), which decides on the further candidates.

Positions of all matches come from the lengths of matches and of the gaps between them, added up in blocks, and texts are cut in
blocks, so a text with many matches costs little more than its length. The patterns are possessive and start only
where a run starts or the last match ended, so they match what the plain patterns match, in linear time and without deep recursion.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import boxed, materialize

#: The kinds of base spans, then that of further spans only.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # whole chains of digits; those of other lengths than 16 to 19 never count, so they aren't matched
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
FURTHER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[(\[](?:dot|DOT)[)\]]|\.)\x20?[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?<![0-9A-Fa-f:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Fa-f:.])",
    "card": r"(?<![0-9])(?:[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+().-])(?<![0-9]\x20)(?:(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}|00[1-9][0-9]{0,2}[.\x20-][0-9]{2,4}(?:[.\x20-]?[0-9]{2,4}){2,3})(?![0-9A-Za-z-])(?!\x20[0-9])",
    "secret": r"(?<![A-Za-z0-9_+/=.@-])(?=[A-Za-z_+/=-]{0,127}[0-9])(?=[0-9_+/=-]{0,127}[A-Za-z])[A-Za-z0-9_+/=-]{20,128}+(?![A-Za-z0-9_+/=@-])",
}
#: What a text with digits needs for any match; cheaper than the pattern. Mails alone can do without digits, but not without an @ or a bracket.
NEEDS = {
    "email": ("@", r"[(\[](?:at|AT)[)\]]"), "ip": (r"[0-9]\.[0-9]", r"[0-9A-Fa-f]:[0-9A-Fa-f:]"), "card": (r"[0-9](?:[\x20-]?[0-9]){14}", r"[0-9](?:[\x20-]?[0-9]){14}"),
    "phone": (r"\+[0-9]", r"[0-9]{3}\)?[.\x20-][0-9]{3}[.\x20-][0-9]{4}|00[1-9][0-9]{0,2}[.\x20-]"), "secret": ("", r"[A-Za-z0-9_+/=-]{20}"),
}
#: Forms that speak for a kind, and against it.
FORM = {
    "email": (r"(?i)(?:\.|\x20?[(\[]dot[)\]]\x20?)(?:com|org|net|edu|gov|info|biz|io|de|fr|es|it|uk|us|eu|ch|at|nl)$", r"\.[0-9]+$"),
    "ip": (r"^(?:1?[0-9]{1,2}|2[0-4][0-9]|25[0-5])(?:\.(?:1?[0-9]{1,2}|2[0-4][0-9]|25[0-5])){3}$|^(?:[0-9A-Fa-f]{1,4}:){7}|^(?:2[0-9a-fA-F]{3}|f[cde][0-9a-f]{2}):", r"^0\.|^[0-9]{1,2}:[0-9]{2}:"),
    "card": (r"^(?:4|5[1-5]|2[2-7]|3[47]|35|36|6011|64|65)", r"^[01789]|^(?:5[06789]|3[0-3])"),
    "phone": (r"^\+|^00|^\(?[2-9]", r"^\(?1"),
    "secret": (r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})$|^(?:AKIA|ASIA|AIza|ghp_|gho_|github_pat_|glpat-|sk-|sk_|pk_|xox[abps]-|eyJ)", r"^[A-Z]?[a-z]+(?:[-_/+=][A-Z]?[a-z]+)+[-_/+=]?[0-9]{1,4}$"),
}
GAZETTEER = {
    "email": "e-?mail|mail|contact|write|address|correo|courriel|kontakt",
    "ip": "ip|host|server|client|address|login|gateway|from",
    "card": "card|visa|amex|mastercard|credit|debit|payment|tarjeta|carte|karte",
    "phone": "phone|tel|call|mobile|cell|fax|text|whatsapp|telefon|t[eé]l[eé]fono|t[eé]l[eé]phone|handy",
    "secret": "token|secret|key|apikey|password|passwd|pwd|credential|bearer|auth|authorization|access",
}
_NUMBERED = "version|ver|v|isbn|order|invoice|serial|part|sku|page|price|usd|eur|section|figure|ratio|score|hash|uuid|tracking"
AGAINST = {k: _NUMBERED + "|token" for k in BASE_KINDS} | {"secret": "hash|uuid|commit|sha1|sha256|md5|checksum|digest|etag|revision|id|href|src|url|file|path|image"}
CONTEXT = 24
LABELERS = 5
ABSTAIN = -1
#: What expectation-maximisation starts from and is held to with the weight of this share of the spans: each labeler's chances to vote yes
#: and no on personal data, and on other text. The last two labelers but one vote on one side only; a card's checksum is nearly certain.
TRUST = 0.1
CHANCES = (((0.5, 0.25), (0.25, 0.5)), ((0.6, 0.15), (0.15, 0.6)), ((0.3, 0.0), (0.05, 0.0)), ((0.0, 0.01), (0.0, 0.4)), ((0.6, 0.2), (0.4, 0.4)))
CHECKSUM = ((0.97, 0.01), (0.1, 0.88))
BLOCK = 128
SPAN = "struct<kind:int,start:int,stop:int,further:boolean,votes:array<int>,marks:array<int>>"
#: How many values each mark (feature) of a span has: length, share of digits, the character before, the one after.
MARKS = (4, 3, 4, 4)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0))).otherwise(
        F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0)) + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    """Whether a match of the base pattern counts."""
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3) & F.forall(
            F.split(x, r"\."), lambda p: F.coalesce(F.regexp_replace(F.right(F.concat(F.lit("000"), p), F.lit(4)), "^0+(?=.)", "").try_cast("int"), F.lit(999)) <= 255
        )
    if kind == "card":
        n = F.length(_digits(x))
        return n.between(16, 19) & F.when(n.between(16, 19), luhn(_digits(x))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(ABSTAIN)


def _votes(kind: str, x: Column, before: Column, after: Column) -> Column:
    digits, (good, bad) = _digits(x), FORM[kind]
    if kind == "card":
        mixture = _vote(luhn(digits), ~luhn(digits))
        form = _vote(digits.rlike(good), digits.rlike(bad))
    else:
        form = _vote(x.rlike(good), x.rlike(bad))
        if kind == "email":
            mixture = _vote(x.rlike(r"[A-Za-z]{2,}\x20?[@(\[]"), ~x.rlike("[A-Za-z]"))
        elif kind == "phone":
            mixture = _vote(F.length(digits).between(10, 13) & ~digits.rlike(r"([0-9])\1{6}"), F.length(digits) < 9)
        elif kind == "ip":
            mixture = _vote(~x.rlike(r"^(?:0|127|255)\.|(?:\.0){2}$"), x.rlike(r"^([0-9]+)\.\1\.\1\.\1$"))
        else:
            mixture = _vote(x.rlike(r"(?:[0-9]+[A-Za-z]+){4}"), ~x.rlike(r"(?:[0-9]+[A-Za-z_+/=-]+){2}"))
    told = F.lower(before)
    return F.array(
        form,
        mixture,
        _vote(told.rlike(rf"(?:^|[^a-z])(?:{GAZETTEER[kind]})[^a-z]*$"), F.lit(False)),
        _vote(F.lit(False), told.rlike(rf"(?:^|[^a-z])(?:{AGAINST[kind]})[^a-z]*$|[$€£/#]$")),
        _vote(before.rlike(r"(?:^|[\s(\[:,;<=\"'])$") & after.rlike(r"^(?:$|[\s)\].,;:!?>\"'|])"), before.rlike(r"[\w@/-]$") | after.rlike(r"^[\w@/=-]")),
    )


def _marks(x: Column, before: Column, after: Column) -> Column:
    share = F.length(_digits(x)) / F.length(x)
    beside = lambda c, quote: F.when(c.rlike(quote), 2).when(c.rlike(r"\s"), 1).when(c == "", 0).otherwise(3)
    n = F.length(x)
    return F.array(
        F.when(n < 12, 0).when(n < 18, 1).when(n < 30, 2).otherwise(3), F.when(share < 0.2, 0).when(share < 0.8, 1).otherwise(2),
        beside(F.right(before, F.lit(1)), "[\"'`(\\[<=:]"), beside(after, "[\"'`)\\]>.,;:!?]"),
    )


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _lesser(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _bound(value: Column, use) -> Column:
    """``use(value)``, an array, with the value worked out once: as a lambda's variable, not as an expression in each place."""
    return F.flatten(F.transform(F.array(value), use))


def _blocks(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))


def running(values: Column, kind: str, zero, op) -> Column:
    """For each value what ``op`` makes of ``zero`` and all values before it; added up by blocks, so the cost is about n * BLOCK."""
    zero = F.lit(zero).cast(kind)

    def whole(v):
        return F.transform(_blocks(F.size(v)), lambda b: F.aggregate(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)), zero, op))

    def within(part, base):
        return F.transform(part, lambda _, i: F.aggregate(F.slice(part, 1, i), base, op))

    def each(v, sums):
        # a block and what stands before it, as a pair that the inner steps share
        pairs = F.transform(sums, lambda _, b: F.struct(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)).alias("part"), F.aggregate(F.slice(sums, 1, b), zero, op).alias("base")))
        return F.flatten(F.transform(pairs, lambda x: within(x["part"], x["base"])))

    return _bound(values, lambda v: _bound(whole(v), lambda sums: each(v, sums)))


def cut(text: Column, starts: Column, lengths: Column) -> Column:
    """The pieces of a text at ascending starts: each is cut from a stretch of ``BLOCK`` pieces, not from the whole text."""

    def stretch(own):
        first, last = own[0]["at"], F.element_at(own, -1)
        return F.struct(own.alias("own"), first.alias("first"), text.substr(first + 1, last["at"] + last["n"] - first).alias("part"))

    def each(all_):
        parts = F.transform(F.transform(_blocks(F.size(all_)), lambda b: F.slice(all_, b * BLOCK + 1, F.lit(BLOCK))), stretch)
        return F.flatten(F.transform(parts, lambda x: F.transform(x["own"], lambda y: x["part"].substr(y["at"] - x["first"] + 1, y["n"]))))

    return _bound(F.arrays_zip(starts.alias("at"), lengths.alias("n")), each)


def _candidates(kind: str, further: bool, matches: Column, gaps: Column, starts: Column) -> Column:
    """The spans of one pattern: matches, the gaps around them, and for each the length of all before it."""

    def voted(k):
        x, gap, following = F.get(matches, k), F.get(gaps, k), F.get(gaps, k + 1)
        before = F.right(F.when(F.length(gap) < CONTEXT, F.concat(F.coalesce(F.get(matches, k - 1), F.lit("")), gap)).otherwise(gap), F.lit(CONTEXT))
        after = F.when(following != "", F.left(following, F.lit(1))).otherwise(F.left(F.coalesce(F.get(matches, k + 1), F.lit("")), F.lit(1)))
        start = F.get(starts, k) + F.length(gap)
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), (start + F.length(x)).alias("stop"), F.lit(further).alias("further"),
            _votes(kind, x, before, after).alias("votes"), _marks(x, before, after).alias("marks"),
        ).cast(SPAN)

    order = F.when(F.size(matches) > 0, F.sequence(F.lit(0), F.size(matches) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(order if further else F.filter(order, lambda k: _valid(kind, F.get(matches, k))), voted)


def with_spans(rows: DataFrame, text: str = "text") -> DataFrame:
    """The given columns and ``spans``: all base spans and the further candidates that none of them overlaps, with votes and marks.

    A candidate's context is the gap before it, and the match of its own pattern before that.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<string>")
    jobs = [(k, further, (FURTHER if further else BASE)[k], NEEDS[k][further]) for further in (False, True) for k in (KINDS if further else BASE_KINDS)]
    rows = rows.withColumn("_digits", t.rlike("[0-9]"))
    bracket = t.contains("[") | t.contains("(")
    may = lambda kind, further, need: (bracket & t.rlike(need) if further else t.contains("@")) if kind == "email" else F.col("_digits") & t.rlike(need)
    found = rows.select("*", *[
        F.when(may(k, further, need), F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none).alias(f"_m{i}") for i, (k, further, p, need) in enumerate(jobs)
    ])
    gaps = found.select("*", *[F.when(F.size(f"_m{i}") > 0, F.split(t, p, -1)).otherwise(none).alias(f"_g{i}") for i, (_, _, p, _) in enumerate(jobs)])
    starts = gaps.select("*", *[
        F.when(F.size(f"_m{i}") > 0, running(F.zip_with(f"_m{i}", F.slice(F.col(f"_g{i}"), 1, F.size(f"_m{i}")), lambda m, g: F.length(m) + F.length(g)), "int", 0, lambda a, x: a + x))
        .otherwise(F.array().cast("array<int>")).alias(f"_s{i}") for i in range(len(jobs))
    ])
    spans = [_candidates(kind, further, *(F.col(f"_{c}{i}") for c in "mgs")) for i, (kind, further, _, _) in enumerate(jobs)]
    n = len(BASE_KINDS)
    kept = [c for c in rows.columns if c != "_digits"]
    both = starts.select(*kept, F.concat(*spans[:n]).alias("_base"), F.concat(*spans[n:]).alias("_further"))
    return both.select(*kept, F.when((F.size("_base") > 0) & (F.size("_further") > 0), _alone(F.concat("_base", "_further"))).otherwise(F.concat("_base", "_further")).alias("spans"))


def _alone(spans: Column) -> Column:
    """Base spans, and further candidates that no base span overlaps: none before reaches into them, and none behind starts in them."""
    far = 1 << 30

    def kept(x, stops, starts):
        marked = F.transform(x, lambda y, i: F.when(~y["further"] | ((F.get(stops, i) <= y["start"]) & (F.get(starts, i) >= y["stop"])), y))
        return F.filter(marked, lambda y: y.isNotNull())

    def judged(x):
        stops = running(F.transform(x, lambda y: F.when(y["further"], 0).otherwise(y["stop"])), "int", 0, _larger)
        starts = F.reverse(running(F.reverse(F.transform(x, lambda y: F.when(y["further"], far).otherwise(y["start"]))), "int", far, _lesser))
        return _bound(stops, lambda before: _bound(starts, lambda behind: kept(x, before, behind)))

    by_start = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("at"), x["further"].alias("late"), x.alias("x"))))
    return _bound(F.transform(by_start, lambda x: x["x"]), judged)


def estimate_reliabilities(patterns: dict[tuple[int, ...], int], rounds: int = 60) -> dict[tuple[int, ...], float]:
    """Posterior that a span is personal data, for each (kind, vote, ...) pattern, by expectation-maximisation.

    Labelers are independent given the truth; each has its own chances to vote yes, no or abstain, by kind, with ``CHANCES`` as
    their prior, so that the two sides can't change places.
    """
    votes = (ABSTAIN, 0, 1)
    posterior = {}
    for kind in sorted({p[0] for p in patterns}):
        chances = [CHECKSUM if kind == KINDS.index("card") and k == 1 else c for k, c in enumerate(CHANCES)]
        start = [{(y, v): max(1e-3, {1: yes, 0: no, ABSTAIN: 1 - yes - no}[v]) for y, (yes, no) in ((1, right), (0, wrong)) for v in votes} for right, wrong in chances]
        own = {p: n for p, n in patterns.items() if p[0] == kind}
        total, prior, rates, belief = sum(own.values()), 0.5, start, {}
        for _ in range(rounds):
            for p in own:
                odds = math.log(prior) - math.log(1 - prior) + sum(math.log(r[1, v]) - math.log(r[0, v]) for r, v in zip(rates, p[1:], strict=True))
                belief[p] = 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))
            held = 2 + TRUST * total
            prior = (sum(n * belief[p] for p, n in own.items()) + held / 2) / (total + held)
            rates = []
            for k, first in enumerate(start, 1):
                table = {key: held * x for key, x in first.items()}
                for p, n in own.items():
                    table[1, p[k]] += n * belief[p]
                    table[0, p[k]] += n * (1 - belief[p])
                sums = {y: sum(table[y, v] for v in votes) for y in (0, 1)}
                rates.append({(y, v): c / sums[y] for (y, v), c in table.items()})
        posterior |= belief
    return posterior


class SpanClassifier:
    """Logistic regression by kind on one-hot votes (yes, no) and marks, trained on the posteriors as soft labels."""

    def __init__(self, patterns: dict[tuple[int, ...], int], posterior: dict[tuple[int, ...], float], rounds: int = 300, rate: float = 2.0, decay: float = 1e-3):
        """``patterns``: counts of (kind, votes, marks); they weigh by the logarithm of their counts. ``posterior`` is by (kind, votes)."""
        self.weights = {k: np.zeros(1 + 2 * LABELERS + sum(MARKS)) for k in range(len(KINDS))}
        for kind in sorted({p[0] for p in patterns}):
            own = sorted(p for p in patterns if p[0] == kind)
            x = np.array([self.one_hot(p) for p in own])
            y, n = np.array([posterior[p[: 1 + LABELERS]] for p in own]), np.log1p([patterns[p] for p in own])
            w = self.weights[kind]
            for _ in range(rounds):
                p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
                w -= rate * (x.T @ (n / n.sum() * (p - y)) + decay * w)

    @staticmethod
    def one_hot(pattern: tuple[int, ...]) -> list[float]:
        votes, marks = pattern[1 : 1 + LABELERS], pattern[1 + LABELERS :]
        return [1.0, *(float(v == side) for v in votes for side in (1, 0)), *(float(m == k) for m, size in zip(marks, MARKS, strict=True) for k in range(size))]

    def accepts(self, x: Column) -> Column:
        """Whether a span's odds are even or better; computed in one order, so that all executors agree."""
        parts = []
        for at in range(1 + 2 * LABELERS + sum(MARKS)):
            weight = F.element_at(F.array(*[F.lit(float(self.weights[k][at])) for k in range(len(KINDS))]), x["kind"] + 1)
            if at == 0:
                parts.append(weight)
            elif at <= 2 * LABELERS:
                parts.append(F.when(x["votes"][(at - 1) // 2] == (at % 2), weight).otherwise(0.0))
            else:
                mark, value = next((m, at - 1 - 2 * LABELERS - sum(MARKS[:m])) for m in range(len(MARKS)) if at - 1 - 2 * LABELERS < sum(MARKS[: m + 1]))
                parts.append(F.when(x["marks"][mark] == value, weight).otherwise(0.0))
        return F.aggregate(F.array(*parts), F.lit(0.0), lambda a, w: a + w) >= 0


def fit(spans: DataFrame) -> SpanClassifier:
    """The span classifier, from the patterns of all spans in column ``spans``: at most kinds x 3**labelers x marks counts, some hundreds in practice."""
    each = spans.select(F.explode("spans").alias("s")).groupBy(F.col("s.kind").alias("kind"), F.col("s.votes").alias("votes"), F.col("s.marks").alias("marks")).agg(F.count("*").alias("n"))
    patterns = {(r.kind, *r.votes, *r.marks): r.n for r in each.collect()}
    votes: dict[tuple[int, ...], int] = {}
    for p, n in patterns.items():
        votes[p[: 1 + LABELERS]] = votes.get(p[: 1 + LABELERS], 0) + n
    return SpanClassifier(patterns, estimate_reliabilities(votes))


def _decided(spans: Column, model: SpanClassifier) -> Column:
    kept = F.filter(spans, lambda x: ~x["further"] | model.accepts(x))
    return F.array_sort(F.transform(kept, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), x["further"].alias("further"))))


def _told(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["stop"])), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, ``spans`` (all spans) and n_further for every row.

    Spans are kind:start:end in code points, end exclusive, ordered by kind as in ``KINDS`` and start. A null or
    empty text has none; repeated rows and null ids are kept; an empty table gives an empty table; other columns are not
    looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = materialize(with_spans(rows).select("doc_id", "spans"), "pii-spans")
    model = fit(found)
    decided = found.select("doc_id", _decided(F.col("spans"), model).alias("all"))
    base = F.filter("all", lambda x: ~x["further"])
    counts = [F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)]
    return decided.select("doc_id", *counts, F.sha2(_told(base), 256).alias("base_sha256"), _told(F.col("all")).alias("spans"), F.size(F.filter("all", lambda x: x["further"])).cast("long").alias("n_further"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind, such as <EMAIL>; an n_chars column follows the text.

    Spans that overlap are replaced together, by the kind of the first one, at one start of the longest. Other columns stay as they are, and
    so does a text without spans.
    """
    # the texts are searched once: rows and their spans are one table, from which the classifier's counts and the new texts come
    boxes = boxed(docs, text=F.col("text").cast("string"))
    searched = materialize(with_spans(boxes).select("row", "spans"), "pii-rows")
    decided = F.transform(_decided(F.col("spans"), fit(searched)), lambda x: F.struct(x["start"].alias("start"), (-x["stop"]).alias("less"), x["kind"].alias("kind")))
    found = searched.select("row", F.col("row").getField("text").cast("string").alias("text"), F.array_sort(decided).alias("spans"))
    reach = F.when(F.size("spans") > 0, running(F.transform("spans", lambda x: -x["less"]), "int", 0, _larger)).otherwise(F.array().cast("array<int>"))
    found = found.select("row", "text", "spans", reach.alias("reach"))
    order = F.when(F.size("spans") > 0, F.sequence(F.lit(0), F.size("spans") - 1)).otherwise(F.array().cast("array<int>"))
    heads = F.filter(order, lambda i: F.get("spans", i)["start"] >= F.get("reach", i))  # a span that none before it reaches
    found = found.select("row", "text", "spans", "reach", heads.alias("heads"))
    end = F.greatest(-F.element_at("spans", -1)["less"], F.element_at("reach", -1))
    # a gap lies before each head, from where the spans before it end, and behind the last span
    starts = F.concat(F.transform("heads", lambda i: F.get("reach", i)), F.array(end))
    stops = F.concat(F.transform("heads", lambda i: F.get("spans", i)["start"]), F.array(F.length("text")))
    marks = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    gaps = cut(F.col("text"), starts, F.zip_with(starts, stops, lambda a, b: b - a))
    kinds = F.concat(F.transform("heads", lambda i: F.element_at(marks, F.get("spans", i)["kind"] + 1)), F.array(F.lit("")))
    made = F.when(F.size("spans") > 0, F.array_join(F.zip_with(gaps, kinds, lambda gap, kind: F.concat(gap, kind)), ""))
    changed = found.select("row", made.alias("made"))
    columns = []
    for f in docs.schema:
        old = F.col("row").getField(f.name)
        new = {"text": F.col("made"), "n_chars": F.length("made")}.get(f.name)
        columns.append((old if new is None else F.when(F.col("made").isNotNull(), new.cast(f.dataType)).otherwise(old)).alias(f.name))
    return changed.select(*columns)
