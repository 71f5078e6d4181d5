"""Personal data by weak supervision, in DataFrame expressions only.

Patterns with checks give the base spans.  Wider candidates (names, numbers, secrets)
are put to a vote of labelers: shapes, a gazetteer and words nearby.  Expectation
maximisation over the counts of vote patterns estimates how reliable each labeler
is; its posteriors train a logistic regression on features of the spans, whose weights
become a column expression.  Candidates that it accepts are added to the base spans.

Offsets come from the pieces between matches, in one pass over the text.  Only counts
of distinct vote and feature patterns reach the driver: at most 3 kinds, 3^6 votes
and 2^8 features, of any corpus.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from refweave.functions.text import pieces, text_between
from refweave.llm.common import lower_ascii, text_of, with_matches

KINDS = ["email", "ip", "card", "phone", "name", "number", "secret"]
BASE = KINDS[:4]
ADDED = ["_base", "_candidates", "spans"]  # columns

# Possessive, and begun at the end of the last match or where no earlier start can match:
# the same matches as the plain patterns, in linear time and without recursion.
_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
_PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text has if the pattern matches anywhere in it; cheap, and most texts have none.
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]{2}|[0-9][ -][0-9]", "phone": r"\+[0-9]"}
_TOKEN = "A-Za-z0-9_/+="
_CANDIDATE = "|".join([
    # A run without letters and digits, such as a line of dashes, is none; digits may come late or not at all.
    rf"(?<![{_TOKEN}-])(?=[_/+=-]*+[A-Za-z0-9])[{_TOKEN}-]{{20,}}+",
    r"(?<![0-9.+])[0-9](?:[ .-]?[0-9]){6,}+",
    r"(?<!\p{L})\p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++)++(?!\p{L})",
])

# Words that speak for or against personal data.
_NAMES = (
    "adam alice amelia anna anne antonio barbara carlos carmen charles chloe christian claire daniel david elena "
    "elizabeth emily emma eric eva felix francois george hans helen henry ivan jack james jane jean jennifer jessica "
    "john jose juan julia karl kevin klaus laura linda lisa louis lucas lucia luis maria marie mark martin mary "
    "matthew max michael michel miguel monica nicolas olivia oscar paul pedro peter philip pierre rachel richard "
    "robert rosa ruth samuel sandra sara sarah simon sofia sophie stefan stephen susan thomas victor walter william"
).split()
_TITLES = "mr|mrs|ms|dr|prof|herr|frau|monsieur|madame|senor|senora|sir|dear"
_CUES = {
    "name": rf"(?:\b(?:{_TITLES})\b\.?|name(?: is|:)?|signed|sincerely|regards|contact|author)\W*$",
    "number": r"(?:phone|tel|telephone|mobile|call|fax|ssn|passport|account|iban|card|id|dob|licen[cs]e no)\W{0,8}$",
    "secret": r"(?:token|key|secret|password|passwd|pwd|auth|bearer|credential)s?\W{0,8}$",
}
_AGAINST = r"(?:version|page|pages|isbn|issn|doi|commit|sha|md5|hash|order|chapter|figure|table|year|http|www|step)\W{0,8}$"
_NEAR = 40  # characters looked at before a candidate

LABELERS = ["shape", "strict_shape", "gazetteer", "cue", "against", "assigned"]
FEATURES = ["is_number", "is_secret", "long", "mixed", "listed", "cued", "denied", "quoted"]


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return (total + F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)).cast("int")

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return x.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        digits = _digits(x)
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    return F.lit(True)


def _span(kind: Column | str, start: Column, length: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), start.cast("int").alias("start"), (start + length).cast("int").alias("end"))


def _valid_spans(kind: str, found: Column) -> Column:
    good = F.filter(found, lambda f: _valid(kind, f["x"]))
    return F.transform(good, lambda f: _span(kind, f["start"], F.length(f["x"])))


def _votes(kind: Column, x: Column, before: Column, after: Column) -> Column:
    """A struct of votes: 1 personal, 0 not, -1 no opinion."""

    def vote(yes: Column, no: Column | None = None) -> Column:
        out = F.when(yes, 1)
        return (out.when(no, 0) if no is not None else out).otherwise(-1)

    name, number, secret = (kind == k for k in ("name", "number", "secret"))
    words = F.split(lower_ascii(x), " ")
    mixed = x.rlike("[0-9]") & x.rlike("[A-Za-z]")
    return F.struct(
        vote(
            (number & F.length(_digits(x)).between(9, 15)) | (secret & mixed) | (name & (F.size(words) == 2)),
            (number & (F.length(_digits(x)) > 19)) | (name & (F.size(words) > 4)),
        ).alias("shape"),
        vote(
            (number & x.rlike(r"^[0-9]{3}[ .-][0-9]{2,3}[ .-][0-9]{4}$")) | (secret & x.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$")),
            (number & x.rlike(r"\..*\.")) | (secret & x.rlike("[/=-].*[/=-].*[/=-]")),
        ).alias("strict_shape"),
        vote(name & F.arrays_overlap(words, F.array(*map(F.lit, _NAMES))), name).alias("gazetteer"),
        vote(_cued(kind, before)).alias("cue"),
        vote(F.lit(False), before.rlike(_AGAINST)).alias("against"),
        vote(before.rlike("[=:]\\W{0,3}$") | after.rlike("^[\"']")).alias("assigned"),
    )


def _cued(kind: Column, before: Column) -> Column:
    return reduce(lambda a, b: a | b, [(kind == k) & before.rlike(p) for k, p in _CUES.items()])


def _features(kind: Column, x: Column, before: Column, after: Column) -> Column:
    return F.struct(
        (kind == "number").alias("is_number"),
        (kind == "secret").alias("is_secret"),
        (F.length(x) >= 30).alias("long"),
        (x.rlike("[0-9]") & x.rlike("[A-Za-z]")).alias("mixed"),
        F.arrays_overlap(F.split(lower_ascii(x), " "), F.array(*map(F.lit, _NAMES))).alias("listed"),
        _cued(kind, before).alias("cued"),
        before.rlike(_AGAINST).alias("denied"),
        (before.rlike("[=:]\\W{0,3}$") | after.rlike("^[\"']")).alias("quoted"),
    )


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``_base`` (spans, by kind and start) and ``_candidates`` (span, votes, features).

    A null text is empty.  Columns of these names are replaced.
    """
    columns = [c for c in df.columns if c not in ("_base", "_candidates")]
    out = df.select(F.struct(*columns).alias("_in"), text_of(text).alias("_t"))
    for kind, pattern in _PATTERNS.items():
        hint = F.contains("_t", F.lit("@")) if kind == "email" else F.col("_t").rlike(_HINTS[kind])
        out = with_matches(out, f"_{kind}", "_t", pattern, hint)
    out = out.withColumn("_base", F.concat(*[_valid_spans(kind, F.col(f"_{kind}")) for kind in BASE]))
    out = with_matches(out.select("_in", "_t", "_base"), "_wide", "_t", _CANDIDATE, F.lit(True))
    kind = lambda x: F.when(x.rlike(r"^\p{Lu}\p{Ll}+ "), "name").when(x.rlike("^[0-9 .-]+$"), "number").otherwise("secret")
    raw = F.transform(
        "_wide",
        lambda f: F.struct(
            _span(kind(f["x"]), f["start"], F.length(f["x"])).alias("span"),
            f["x"].alias("x"),
            lower_ascii(F.right(f["before"], F.lit(_NEAR))).alias("before"),
            F.left(f["after"], F.lit(4)).alias("after"),
        ),
    )
    apart = lambda c: ~F.exists("_base", lambda b: (b["start"] < c["span"]["end"]) & (c["span"]["start"] < b["end"]))
    parts = lambda c: (c["span"]["kind"], c["x"], c["before"], c["after"])
    # A long word without a digit is only put to the vote where something announces a secret.
    said = lambda c: (c["span"]["kind"] != "secret") | c["x"].rlike("[0-9]") | _cued(c["span"]["kind"], c["before"])
    out = out.withColumn("_raw", F.filter(raw, lambda c: apart(c) & said(c)))
    return out.select(
        "_in.*",
        "_base",
        F.transform("_raw", lambda c: F.struct(c["span"].alias("span"), _votes(*parts(c)).alias("votes"), _features(*parts(c)).alias("features"))).alias("_candidates"),
    )


def reliabilities(patterns: Sequence[tuple[str, tuple[int, ...], float]], rounds: int = 30) -> list[float]:
    """Posterior of "personal" for each ``(kind, votes, count)``, by expectation maximisation.

    Two classes; a labeler votes 1, 0 or not at all with probabilities of its own for each class,
    independent of the others.  Begins with the share of votes in favour, so that classes keep their sense.
    """

    def share(votes: tuple[int, ...]) -> float:
        cast = [v for v in votes if v >= 0]
        return (1 + sum(cast)) / (2 + len(cast)) if cast else 0.2

    posterior = [share(v) for _, v, _ in patterns]
    for _ in range(rounds):
        prior: dict[str, list[float]] = {}
        rates: dict[tuple[int, int, int], float] = {}
        totals = [0.0, 0.0]
        for (kind, votes, n), p in zip(patterns, posterior, strict=True):
            own = prior.setdefault(kind, [1.0, 1.0])
            for y, weight in ((0, n * (1 - p)), (1, n * p)):
                own[y] += weight
                totals[y] += weight
                for j, v in enumerate(votes):
                    rates[j, v, y] = rates.get((j, v, y), 0.0) + weight
        posterior = []
        for kind, votes, _ in patterns:
            log = [math.log(prior[kind][y] / sum(prior[kind])) for y in (0, 1)]
            for j, v in enumerate(votes):
                for y in (0, 1):
                    log[y] += math.log((rates.get((j, v, y), 0.0) + 1) / (totals[y] + 3))
            posterior.append(1 / (1 + math.exp(min(700, log[0] - log[1]))))
    return posterior


def fit(rows: Sequence[tuple[tuple[bool, ...], float, float]], steps: int = 400, penalty: float = 1e-3) -> list[float]:
    """Logistic regression on ``(features, target, count)``; the last weight is the constant."""
    total = sum(n for _, _, n in rows) or 1.0
    xs = [([*map(float, f), 1.0], y, n / total) for f, y, n in rows]
    width = len(FEATURES) + 1
    w, before = [0.0] * width, [0.0] * width
    rate = 4.0 / width
    for step in range(steps):
        ahead = [a + step / (step + 3) * (a - b) for a, b in zip(w, before, strict=True)]
        slope = [penalty * a for a in ahead[:-1]] + [0.0]
        for x, y, n in xs:
            z = sum(a * b for a, b in zip(ahead, x, strict=True))
            error = n * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y)
            slope = [s + error * b for s, b in zip(slope, x, strict=True)]
        before, w = w, [a - rate * s for a, s in zip(ahead, slope, strict=True)]
    return w


def learn(found: DataFrame) -> list[float] | None:
    """Weights of the span classifier from :func:`find`'s candidates; none without candidates."""
    spread = found.select(F.explode("_candidates").alias("c")).select(
        F.col("c.span.kind").alias("kind"), F.col("c.votes").alias("votes"), F.col("c.features").alias("features")
    )
    rows = spread.groupBy("kind", "votes", "features").agg(F.count("*").alias("n")).orderBy("kind", "votes", "features").collect()
    if not rows:
        return None
    posterior = reliabilities([(r.kind, tuple(r.votes), float(r.n)) for r in rows])
    return fit([(tuple(bool(x) for x in r.features), p, float(r.n)) for r, p in zip(rows, posterior, strict=True)])


def decide(found: DataFrame, weights: list[float] | None) -> DataFrame:
    """:func:`find`'s rows with ``spans`` instead of candidates: base ones, then accepted ones by kind and start."""
    if weights is None:
        return found.withColumn("spans", F.col("_base")).drop("_candidates")

    def accepted(c: Column) -> Column:
        logit = reduce(lambda a, b: a + b, [F.when(c["features"][f], w).otherwise(0.0) for f, w in zip(FEATURES, weights[:-1], strict=True)])
        return logit + weights[-1] > 0

    added = F.transform(F.filter("_candidates", accepted), lambda c: c["span"])
    return found.withColumn("spans", F.concat("_base", F.array_sort(added))).drop("_candidates")


def span_string(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``df`` with each span of the text replaced by its kind in brackets; overlapping spans count as one.

    Null stays null, and a text without spans stays as it is.
    """
    ordered = F.array_sort(
        F.transform("_s", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )

    def merge(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when(s["start"] < last["end"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(wider))).otherwise(
            F.concat(done, F.array(s))
        )

    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    some = F.size(spans) > 0
    out = df.select(F.struct(*df.columns).alias("_in"), F.col(text).alias("_t"), some.alias("_some"), F.col(spans).alias("_s"))
    out = out.withColumn("_apart", F.when(F.col("_some"), F.aggregate(ordered, none, merge)).otherwise(none))
    out = out.withColumn("_cut", F.when(F.col("_some"), pieces(F.col("_t"))).otherwise(F.array().cast("array<string>")))
    # Where the kept text before each span, and after the last one, begins.
    begins = F.concat(F.array(F.lit(0)), F.transform("_apart", lambda s: s["end"]))
    zipped = F.arrays_zip(F.col("_apart").alias("s"), F.slice(begins, F.lit(1), F.size("_apart")).alias("begin"))
    kept = F.transform(
        zipped,
        lambda z: F.concat(text_between(F.col("_cut"), z["begin"], z["s"]["start"]), F.lit("["), F.upper(z["s"]["kind"]), F.lit("]")),
    )
    tail = text_between(F.col("_cut"), F.element_at(begins, -1), F.length("_t"))
    clean = F.when(F.col("_some"), F.concat(F.array_join(kept, ""), tail)).otherwise(F.col("_t"))
    columns = [clean.alias(c) if c == text else F.col(f"_in.`{c}`") for c in df.columns]
    return out.select(*columns)


def report(found: DataFrame, key: str) -> DataFrame:
    """Counts and spans per row of :func:`decide`'s result."""
    kinds = F.transform("_base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in BASE]
    return found.select(
        key, *counts, F.sha2(span_string(F.col("_base")), 256).alias("base_sha256"), span_string(F.col("spans")).alias("spans")
    )
