"""Personal data by weak supervision, with DataFrame functions only.

Patterns propose candidate spans.  Labelers (patterns, gazetteers, context) vote
+1, 0 or -1 on each.  Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is and how likely each pattern is personal
data.  A logistic classifier of spans is then trained on those probabilities; it
decides about the candidates beyond the base spans, which always stay.

The counts are over all candidates of all documents; a vote pattern is one of
3^labelers x kinds, so what reaches the driver has a fixed bound.

Defined results: a null or empty text has no span; ids may be null or repeat,
each row is judged alone; equal spans of one kind count once in the lists; other
columns are ignored, or kept by :func:`redact`, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm import common, spans

KINDS = ["email", "ip", "card", "phone"]
LOCAL = "A-Za-z0-9._%+-"

# A match begins where the last one ended or where its first run of characters
# begins; other starts inside a run cannot succeed where that one failed, so
# these find the same leftmost matches without trying each start of a long run.
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# The whole run of digits, if it has 12 to 19 of them.
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
# Looser shapes, which only the classifier can accept.
MASKED_EMAIL = r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?[\[(] ?at ?[\])] ?[a-z0-9-]{1,63}+(?: ?[\[(] ?dot ?[\])] ?[a-z0-9-]{1,63}+|\.[a-z0-9-]{1,63}+){1,8}+"
PLUS_PHONE = r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{2,4})(?:[ .-][0-9]{3,4}){2}(?![0-9])"
LOCAL_PHONE = r"(?<![0-9+.(-])(?<![0-9] )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"

PROVIDERS = "gmail|yahoo|hotmail|outlook|icloud|proton|protonmail|gmx|web|mail|aol|live|orange|free"
ENDINGS = "com|org|net|edu|gov|io|de|fr|es|it|uk|us|ch|at|nl|be|eu|info|biz"
CALLING_CODES = "1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
ISSUERS = "^(4|5[1-5]|2[2-7]|3[47]|6011|65|35|30[0-5]|36|38)"
NEAR = {
    "email": "mail|contact|write|reach|kontakt|correo|courriel|address",
    "ip": r"\bip\b|host|server|addr|login|from|client",
    "card": "card|visa|master|amex|credit|karte|carte|tarjeta|pay",
    "phone": "tel|phone|call|mobile|fax|ring|anruf|telefon|movil",
}
AGAINST = r"version|release|\bv$|section|chapter|isbn|issn|figure|fig\.|table|serial|order no|part no|invoice"
LABELERS = ("strict", "gazetteer", "context", "against", "shape")


def _luhn(number: Column) -> Column:
    """Whether digits pass the Luhn check."""

    def step(acc: Column, c: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.struct(
            (acc["sum"] + F.when(acc["odd"], twice).otherwise(d)).alias("sum"), (~acc["odd"]).alias("odd")
        )

    start = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd"))
    return F.aggregate(F.split(F.reverse(number), ""), start, step, lambda acc: acc["sum"] % 10 == 0)


def _octets(text: Column) -> Column:
    small = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
    return F.forall(
        F.split(text, r"\."),
        lambda p: small(p) & (F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(999)) <= 255),
    )


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, F.lit(1))
    return (out.when(no, F.lit(-1)) if no is not None else out).otherwise(F.lit(0)).cast("int")


def _votes(s: Column, strict: int) -> Column:
    """Votes on a span, in the order of :data:`LABELERS`."""
    kind, text, before = s["kind"], s["text"], F.lower(s["before"])
    number = spans.digits(text)
    same = F.length(F.regexp_replace(number, r"^(.)\1*", "")) == 0
    gazetteer = (
        F.when(kind == "email", _vote(text.rlike(rf"(?i)[@.](?:{PROVIDERS})[0-9]*\.|[.\])] ?(?:{ENDINGS})$")))
        .when(kind == "ip", _vote(~text.rlike(r"^(0|127|255)\."), text.rlike(r"^(0|127|255)\.")))
        .when(kind == "card", _vote(number.rlike(ISSUERS), ~number.rlike(ISSUERS)))
        .otherwise(_vote(text.rlike(rf"^\+({CALLING_CODES})|^\(?[2-9]"), text.rlike(r"^\(?0")))
    )
    near = F.lit(False)
    for k, words in NEAR.items():
        near = near | ((kind == k) & before.rlike(words))
    shape = (
        F.when(kind == "email", _vote(F.length(text) <= 64, F.length(text) > 120))
        .when(kind == "ip", _vote(text.rlike(r"^[1-9][0-9]{1,2}\."), text.rlike(r"^[0-9]\.[0-9]\.[0-9]\.[0-9]$")))
        .otherwise(_vote(~same & text.rlike("[ ().-]"), same | number.rlike("0123456789|1234567890")))
    )
    return F.struct(
        F.lit(strict).alias("strict"),
        gazetteer.alias("gazetteer"),
        _vote(near).alias("context"),
        F.when(before.rlike(AGAINST), F.lit(-1)).otherwise(F.lit(0)).alias("against"),
        shape.alias("shape"),
    )


def _judged(found: Column, strict: int) -> Column:
    """``strict``: 1 for base spans, 0 for well-formed looser shapes, -1 for the rest."""
    return F.transform(
        found,
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(strict == 1).alias("base"), _votes(s, strict).alias("votes")),
    )


def _unlike(others: Column):
    return lambda s: ~F.exists(others, lambda o: (o["start"] == s["start"]) & (o["end"] == s["end"]))


def with_candidates(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the candidate spans of a text, with votes, as column ``out``."""
    t = F.col(text)
    digit = t.rlike("[0-9]")
    rules = {
        "email": ("email", EMAIL, F.contains(t, F.lit("@"))),
        "ip": ("ip", IP, digit),
        "card": ("card", CARD, digit),
        "phone": ("phone", PHONE, F.contains(t, F.lit("+"))),
        "masked": ("email", MASKED_EMAIL, F.contains(F.lower(t), F.lit("at"))),
        "plus": ("phone", PLUS_PHONE, F.contains(t, F.lit("+"))),
        "local": ("phone", LOCAL_PHONE, digit),
    }
    names = dict(zip(rules, common.fresh(df, *[f"{r}_spans" for r in rules])))
    found = spans.with_spans(df, text, {names[r]: rule for r, rule in rules.items()})
    size = lambda s: F.length(spans.digits(s["text"]))
    col = {r: F.col(n) for r, n in names.items()}
    kept = {
        "email": col["email"],
        "ip": F.filter(col["ip"], lambda s: _octets(s["text"])),
        "card": F.filter(col["card"], lambda s: _luhn(spans.digits(s["text"]))),
        "phone": F.filter(col["phone"], lambda s: size(s).between(9, 15)),
    }
    parts = [_judged(kept[r], 1) for r in KINDS]
    # a looser span that equals a base span of its kind adds nothing
    for r in ("masked", "plus", "local"):
        same = kept["email" if r == "masked" else "phone"]
        col[r] = F.filter(col[r], _unlike(same))
    parts += [_judged(col[r], 0) for r in ("masked", "plus", "local")]
    parts.append(_judged(F.filter(col["phone"], lambda s: size(s).between(7, 8)), -1))
    return found.select("*", F.concat(*parts).alias(out)).drop(*names.values())


@dataclass(frozen=True)
class Model:
    """Labeler reliabilities and the span classifier fitted to them."""

    prior: dict[str, float]
    accuracy: dict[str, tuple[float, float]]
    weights: dict[str, float]

    def score(self, kind: Column, votes: Column) -> Column:
        total = F.lit(self.weights["bias"])
        for k in KINDS:
            total = total + F.when(kind == k, F.lit(self.weights[k])).otherwise(F.lit(0.0))
        for name in LABELERS:
            for v in (1, -1):
                total = total + F.when(votes[name] == v, F.lit(self.weights[f"{name}:{v}"])).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(candidates: DataFrame, column: str, rounds: int = 30) -> Model:
    """Estimate reliabilities from the vote patterns of all candidates."""
    span = F.explode(column).alias("s")
    counts = (
        candidates.select(span)
        .groupBy(F.col("s.kind").alias("kind"), *[F.col(f"s.votes.{n}").alias(n) for n in LABELERS])
        .agg(F.count(F.lit(1)).alias("n"))
    )
    patterns = sorted((r["kind"], tuple(r[n] for n in LABELERS), r["n"]) for r in counts.collect())
    return fit_patterns(patterns, rounds)


def fit_patterns(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 30) -> Model:
    """The model of (kind, votes, count) rows; without rows, its starting point."""
    prior = dict.fromkeys(KINDS, 0.7)
    right = {n: (0.8, 0.8) for n in LABELERS}  # chance of a right vote, if it votes, on yes and on no
    posterior: list[float] = []
    for _ in range(rounds):
        posterior = []
        for kind, votes, _n in patterns:
            yes, no = math.log(prior[kind]), math.log(1 - prior[kind])
            for name, v in zip(LABELERS, votes):
                a, b = right[name]
                if v:
                    yes += math.log(a if v > 0 else 1 - a)
                    no += math.log(b if v < 0 else 1 - b)
            posterior.append(1 / (1 + math.exp(min(50.0, no - yes))))
        for k in KINDS:  # smoothed by a few imagined candidates of the starting belief
            rows = [(p, n) for (kind, _, n), p in zip(patterns, posterior) if kind == k]
            total = sum(n for _, n in rows)
            prior[k] = (sum(p * n for p, n in rows) + 7) / (total + 10)
        for i, name in enumerate(LABELERS):
            hit = [8.0, 10.0, 8.0, 10.0]
            for (_, votes, n), p in zip(patterns, posterior):
                if votes[i]:
                    hit[0] += p * n * (votes[i] > 0)
                    hit[1] += p * n
                    hit[2] += (1 - p) * n * (votes[i] < 0)
                    hit[3] += (1 - p) * n
            # a labeler is taken to be better than chance, which names the classes
            right[name] = tuple(min(0.99, max(0.55, x)) for x in (hit[0] / hit[1], hit[2] / hit[3]))
    return Model(dict(prior), dict(right), _train(patterns, posterior))


def _train(patterns, posterior, steps: int = 300, rate: float = 0.5) -> dict[str, float]:
    """Logistic regression on the probabilities, weighted by log counts."""
    names = ["bias", *KINDS, *[f"{n}:{v}" for n in LABELERS for v in (1, -1)]]
    weights = dict.fromkeys(names, 0.0)
    if not patterns:
        return weights
    rows = []
    for (kind, votes, n), p in zip(patterns, posterior):
        on = ["bias", kind, *[f"{name}:{v}" for name, v in zip(LABELERS, votes) if v]]
        rows.append((on, p, math.log1p(n)))
    total = sum(w for _, _, w in rows)
    for _ in range(steps):
        slope = dict.fromkeys(names, 0.0)
        for on, p, w in rows:
            z = sum(weights[f] for f in on)
            miss = w * (1 / (1 + math.exp(-max(-50.0, min(50.0, z)))) - p) / total
            for f in on:
                slope[f] += miss
        for f in names:
            weights[f] -= rate * (slope[f] + 1e-4 * weights[f])
    return weights


def accepted(column: str | Column, model: Model, threshold: float = 0.5) -> Column:
    """Base spans, and the other candidates that the classifier takes."""
    found = F.col(column) if isinstance(column, str) else column
    return F.filter(found, lambda s: s["base"] | (model.score(s["kind"], s["votes"]) >= threshold))


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest of the base spans and all spans of each text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), common.text_of(text_col).alias("body"))
    found = common.materialize(with_candidates(rows, "body", "found").drop("body"), "pii-candidates")
    model = fit(found, "found")
    base = F.filter("found", lambda s: s["base"])
    every = accepted("found", model)

    def of(kind: str):
        return lambda s: s["base"] & (s["kind"] == kind)

    return found.select(
        "doc_id",
        *[F.size(F.filter("found", of(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(spans.listed(base, KINDS).cast("binary"), 256).alias("base_sha256"),
        spans.listed(every, KINDS).alias("spans"),
        (F.size(every) - F.size(base)).cast("long").alias("n_added"),
    )


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with every accepted span replaced by its kind in brackets.

    Overlapping spans become one, named by the first.  A null text stays null.
    """
    body, found, keep = common.fresh(docs, "body", "found", "keep")
    rows = docs.withColumn(body, common.text_of(text_col))
    votes = common.materialize(
        with_candidates(rows.select(body), body, found).where(F.size(found) > 0).select(found), "pii-votes"
    )
    model = fit(votes, found)
    rows = with_candidates(rows, body, found).withColumn(
        keep,
        F.array_sort(F.transform(accepted(found, model), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))),
    )

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(F.col(body), acc["at"] + 1, s["start"] - acc["at"])
        out = F.concat(acc["out"], before, F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], out).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(
        keep, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(body), acc["at"] + 1, F.length(body)))
    )
    clean = F.when(F.size(keep) > 0, clean).otherwise(F.col(text_col))
    return rows.select(*[clean.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def op2_personal_data(spark, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents"))
