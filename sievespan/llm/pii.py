"""Personal data: spans found by rules, weighed by weak supervision.

Patterns propose spans. Base spans follow fixed rules and always stay. For each
other span five labelers vote for, against or not at all: two on its form, a
gazetteer, one on the words before it, one on what stands around it. Expectation
maximisation estimates from all votes how reliable each labeler is for a kind,
and how likely each pattern of votes means personal data. A logistic model over
kind and votes, fitted to these, is the final classifier of spans.

What reaches the driver are counts by kind and pattern of votes, at most
``len(KINDS) * 3 ** len(LABELERS)`` rows whatever the input.

Only DataFrame functions are used on texts, and each row is judged where it
stands: a null text counts as empty and has no spans, repeated rows get the
same spans, other columns pass through. Patterns are possessive where they
repeat, so long runs of digits or letters take linear time.
"""

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "ssn", "iban", "secret", "name"]
LABELERS = ["form", "detail", "gazetteer", "context", "edges"]
BEFORE = 32     # characters before a span that the context labeler reads
CHUNK = 256     # spans added up at once

# Base patterns as the contract of the query states them, written so that they
# find the same spans in linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
FIRST_NAMES = ("James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan "
               "Joseph Jessica Thomas Sarah Charles Karen Anna Peter Paul Maria Laura Daniel Martin Julia Hans Klaus "
               "Sophie Pierre Marie Jean Carlos Ana Juan Carmen Jose Lucia Pablo Elena Marco Giulia").split()
EXTRA = {
    "phone": r"(?<![0-9A-Za-z+().-])(?<!\+[0-9]{1,3}[ .-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,}+"
              r"|(?:password|passwd|secret|token|api_?key)=[^\s,;]{6,}+)(?![0-9A-Za-z])",
    "name": r"(?<![A-Za-z])(?:(?:Mr|Mrs|Ms|Dr)\.? |(?:" + "|".join(FIRST_NAMES) + r") )[A-Z][a-z]{1,20}(?![A-Za-z])",
}
CONTEXT = {
    "email": r"(?i)e-?mail|contact|mailto|write to",
    "ip": r"(?i)\bip\b|address|host|server",
    "card": r"(?i)card|visa|credit|payment|account",
    "phone": r"(?i)phone|tel|call|mobile|fax|cell",
    "ssn": r"(?i)ssn|social security|tax",
    "iban": r"(?i)iban|bank|account|konto|cuenta",
    "secret": r"(?i)key|token|password|secret|login",
    "name": r"(?i)dear|contact|name|by|from|signed",
}
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|io|de|fr|es|it|uk|eu|info)$",
    "ip": r"^(?!0\.|127\.|255\.)",
    "card": r"^[3-6]",
    "phone": r"^(?:\+(?:1|33|34|39|44|49)|\(?[2-9])",
    "ssn": r"^(?!000|666|9)",
    "iban": r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
    "secret": r"^(?:AKIA|gh[pousr]_|sk-|password=|passwd=)",
    "name": "^(?:" + "|".join(FIRST_NAMES) + r")\b",
}
DETAIL = {    # a closer look at the form
    "email": r"^[^.].*[^.]@[^-].*\.[A-Za-z]{2,}$",
    "ip": r"^[1-9][0-9]{0,2}(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
    "card": r"^[0-9]{4}([ -]?)(?:[0-9]{4}\1){2}[0-9]{1,7}$",
    "phone": r"[0-9]{3}[ .-]?[0-9]{4}$",
    "ssn": r"^[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "iban": r"^[A-Z]{2}[0-9]{2} ?(?:[A-Z0-9] ?){11,30}$",
    "secret": r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]",
    "name": r" [A-Z][a-z]{2,}$",
}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
SPAN = "struct<start: bigint, rank: int, kind: string, end: bigint, base: boolean, votes: array<int>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, zero: Column, step) -> Column:
    """For each value what ``step`` makes of all earlier ones; ``step`` is a sum or a maximum.

    In chunks, because an array that grows by one value at a time is copied each time.
    """
    def before(part, start):
        empty = F.array().cast("array<bigint>")
        return F.aggregate(part, F.struct(start.alias("at"), empty.alias("out")), lambda acc, x: F.struct(
            step(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    def chunked(v):
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")),
                            lambda c: F.slice(v, c * CHUNK + 1, F.lit(CHUNK)))
        def joined(p):
            totals = F.transform(p, lambda x: F.aggregate(x, zero, step))
            return _let(before(totals, zero), lambda starts: F.flatten(F.transform(
                p, lambda x, i: before(x, F.get(starts, i)))))
        return _let(parts, joined)

    return F.when(F.size(values) > 0, _let(values, chunked)).otherwise(F.array().cast("array<bigint>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + _let(
        F.substring(digits, n - i + 1, F.lit(1)).cast("int") * (2 - i % 2),
        lambda v: v - F.when(v > 9, 9).otherwise(0)))
    return total % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    """Whether a match of a base pattern is a base span."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(OCTETS)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return _let(_digits(value), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1 for, -1 against (where ``no``; everywhere else if not given), 0 not at all."""
    against = F.lit(-1) if no is None else F.when(no, -1).otherwise(0)
    return F.when(yes, 1).otherwise(against).cast("int")


def _votes(kind: str, value: Column, before: Column, after: Column, base: Column) -> Column:
    n = F.length(value)
    bounds = {"email": (6, 80), "ip": (7, 15), "card": (13, 23), "phone": (10, 20), "ssn": (11, 11),
              "iban": (15, 42), "secret": (14, 200), "name": (5, 40)}[kind]
    clean = ~before.rlike(r"[0-9A-Za-z]$") & ~after.rlike(r"^[0-9A-Za-z@]")
    return F.array(
        _vote(base | n.between(*bounds)),
        _vote(value.rlike(DETAIL[kind])),
        _vote(value.rlike(GAZETTEER[kind]), F.lit(kind in ("ip", "card", "ssn"))),
        _vote(before.rlike(CONTEXT[kind]), F.lit(False)),
        _vote(clean),
    )


def _spans(text: Column, kind: str, pattern: str, base: bool) -> Column:
    """Spans of one pattern with their votes; base ones fail the check or are base spans."""
    rank = KINDS.index(kind)

    def of(found):
        def with_gaps(gaps):
            lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found,
                                 lambda g, m: (F.length(g) + F.length(m)).cast("bigint"))
            starts = _running(lengths, F.lit(0).cast("bigint"), lambda a, b: a + b)

            def span(at, i):
                value, gap = F.get(found, i), F.get(gaps, i)
                start = at + F.length(gap)
                keep = _passes(kind, value) if base else F.lit(False)
                return F.struct(
                    start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
                    (start + F.length(value)).alias("end"), keep.alias("base"),
                    _votes(kind, value, F.right(gap, F.lit(BEFORE)), F.left(F.get(gaps, i + 1), F.lit(1)), keep).alias("votes"))
            spans = F.transform(starts, span)
            return F.filter(spans, lambda s: s["base"]) if base else spans
        return F.when(F.size(found) > 0, _let(F.split(text, pattern, -1), with_gaps)).otherwise(
            F.array().cast(f"array<{SPAN}>"))
    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


def proposals(text: Column) -> Column:
    """All spans that a pattern proposes: start and end in characters from 0 (end
    exclusive), kind, whether it is a base span, and the labelers' votes."""
    whole = F.coalesce(text, F.lit(""))
    parts = [_spans(whole, k, p, True) for k, p in PATTERNS.items()]
    parts += [_spans(whole, k, p, False) for k, p in EXTRA.items()]
    return F.concat(*parts)


class Model(NamedTuple):
    """Logistic weights of the final classifier."""
    kinds: dict[str, float]
    votes: list[float]
    bias: float

    def score(self, span: Column) -> Column:
        z = F.lit(self.bias)
        kind = F.lit(0.0)
        for name, weight in self.kinds.items():
            kind = F.when(span["kind"] == name, weight).otherwise(kind)
        z = z + kind
        for j, weight in enumerate(self.votes):
            z = z + F.get(span["votes"], F.lit(j)) * weight
        return 1 / (1 + F.exp(-z))


def vote_counts(docs: DataFrame, text: str = "text") -> list[tuple[str, tuple[int, ...], int]]:
    """How often each kind got each pattern of votes, over all rows."""
    spans = docs.select(F.explode(proposals(F.col(text))).alias("s"))
    counts = spans.groupBy("s.kind", "s.votes").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "votes").collect()
    return [(r["kind"], tuple(r["votes"]), r["n"]) for r in counts]


def reliabilities(counts: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> list[float]:
    """For each entry the probability that it is personal data, by expectation
    maximisation over kinds and labelers, started from the majority of votes."""
    posterior = np.array([1 / (1 + np.exp(-sum(v))) for _, v, _ in counts])
    weight = np.array([n for *_, n in counts], float)
    kinds = np.array([KINDS.index(k) for k, *_ in counts])
    votes = np.array([v for _, v, _ in counts], int).reshape(len(counts), -1) + 1
    for _ in range(rounds):
        log_odds = np.zeros(len(counts))
        for kind in np.unique(kinds):
            own = kinds == kind
            yes, no = weight[own] * posterior[own], weight[own] * (1 - posterior[own])
            log_odds[own] = np.log((yes.sum() + 1) / (no.sum() + 1))
            for j in range(votes.shape[1]):
                # smoothed, and no labeler is held to be worse than chance
                rate = [(np.bincount(votes[own, j], w, 3) + prior) / (w.sum() + prior.sum()) for w, prior in (
                    (yes, np.array([1.0, 1.0, 2.0])), (no, np.array([2.0, 1.0, 1.0])))]
                log_odds[own] += np.log(rate[0] / rate[1])[votes[own, j]]
        posterior = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
    return posterior.tolist()


def train(docs: DataFrame, text: str = "text", rounds: int = 50, ridge: float = 1.0) -> Model:
    """The span classifier fitted to the estimated labels of all proposed spans (Newton steps)."""
    counts = vote_counts(docs, text)
    if not counts:    # nothing was learned, nothing is added
        return Model(dict.fromkeys(KINDS, 0.0), [0.0] * len(LABELERS), -1.0)
    x = np.array([[1.0, *[float(k == kind) for k in KINDS], *votes] for kind, votes, _ in counts]).reshape(
        len(counts), 1 + len(KINDS) + len(LABELERS))
    y, weight = np.array(reliabilities(counts, rounds)), np.array([n for *_, n in counts], float)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        w -= np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + ridge * np.eye(len(w)), gradient)
    return Model(dict(zip(KINDS, w[1:1 + len(KINDS)].tolist())), w[1 + len(KINDS):].tolist(), float(w[0]))


def find(docs: DataFrame, text: str = "text", name: str = "pii", model: Model | None = None,
         threshold: float = 0.5) -> DataFrame:
    """``docs`` with column ``name``: the spans that stay, by start and kind.

    The model is trained on ``docs`` if none is given.
    """
    model = model or train(docs, text)
    stays = F.filter(proposals(F.col(text)), lambda s: s["base"] | (model.score(s) >= threshold))
    return docs.withColumn(name, F.array_sort(stays))


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind; spans that overlap become one."""
    whole = F.coalesce(text, F.lit(""))
    zero = F.lit(0).cast("bigint")

    def of(s):
        ends = F.transform(s, lambda x: x["end"])
        last = F.array_max(ends)

        def pieces(done):    # done: how far the spans before reach
            parts = F.zip_with(s, done, lambda x, d: F.when(x["start"] >= d, F.concat(
                F.substring(whole, (d + 1).cast("int"), (x["start"] - d).cast("int")),
                F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(""))
            return F.concat(F.array_join(parts, ""), F.substring(whole, (last + 1).cast("int"), F.length(whole)))
        return F.when(F.size(s) == 0, whole).otherwise(_let(_running(ends, zero, lambda a, b: F.greatest(a, b)), pieces))
    return F.when(text.isNull(), None).otherwise(_let(spans, of))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the spans in ``text`` replaced."""
    found = find(docs, text, "_pii")
    return found.withColumn(text, redacted(F.col(text), F.col("_pii"))).drop("_pii")
