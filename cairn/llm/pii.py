"""Personal data by weak supervision, in DataFrame functions only.

Candidate spans come from patterns: the four base kinds (email, ip, card, phone), which are always
reported when valid, and wider kinds (written-out emails, local phone numbers, social security
numbers, IBANs, titled names), which are reported only if the final classifier accepts them.

Four labelers vote on each candidate with 1, -1 or 0 (no opinion): a strict regular expression,
a gazetteer (top-level domains, calling codes, issuer prefixes, country codes, first names),
cue words before it, and contrary words before it. The counts of vote patterns for each kind (a
bounded table) go to expectation-maximisation, which estimates each labeler's reliability and
each pattern's probability. Those train a logistic classifier over the span's votes, kind, length and
digits, which is applied as a column expression.

Offsets are code points, ends are exclusive; matches are leftmost and do not overlap within a kind.

Edge cases: null and empty text have no spans. Repeated rows are each reported. Extra columns are
ignored. An empty table, or one without wider candidates, leaves the base spans.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import shared_dir, stored, table

# Gazetteers and cue words.
TLDS = "com org net edu gov info biz io eu de fr es uk us at ch it nl be pl ru cn jp br in ca au example test".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 61 62 63 64 65 66 81 82 84 86 90 91 92".split()
ISSUERS = "34 37 4 51 52 53 54 55 6011 62 65 35 36 38".split()
IBAN_COUNTRIES = "AT BE CH CZ DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split()
FIRST_NAMES = "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Anna Maria Peter Paul Hans Klaus Juan Carlos Jean Pierre Marie Sophie Laura Thomas Martin".split()
CUES = {
    "email": "mail|contact|write|reach|kontakt|courriel|correo",
    "ip": "\\bip\\b|host|server|address|from|login|client",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|fax|mobile|anruf|appel|llam",
    "email_words": "mail|contact|write|reach|kontakt|courriel|correo",
    "phone_local": "phone|tel|call|fax|mobile|anruf|appel|llam",
    "ssn": "ssn|social security|insurance",
    "iban": "iban|account|konto|compte|cuenta",
    "name": "name|dear|from|signed|regards|author|contact",
}
CONTRARY = "version|isbn|order|invoice|build|sha|uuid|serial|page|chapter|section|figure|commit"

Spans = Column


def _any(values: list[str]) -> str:
    return "(?:" + "|".join(values) + ")"


@dataclass(frozen=True)
class Kind:
    name: str
    #: A cheap test that any text with a match passes.
    quick: str
    pattern: str
    valid: Callable[[Column], Column]
    strict: str
    gazetteer: str
    base: bool = False


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: F.ascii(c) - 48)
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _card(m: Column) -> Column:
    d = F.translate(m, " -", "")
    return F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False)


def _ip(m: Column) -> Column:
    # leading zeros allowed: a part is at most 255
    return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.(?!$)|$)){4}$")


def _phone(m: Column) -> Column:
    return F.length(_digits(m)).between(10, 15)


_LOCAL = "A-Za-z0-9._%+-"
KINDS = [
    # \G lets a match start right behind the last one; elsewhere only a run's first character can
    Kind("email", "@", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++", lambda m: F.lit(True), r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}$", rf"(?i)\.{_any(TLDS)}$", True),
    Kind("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _ip, r"^(?!0)[0-9]{1,3}(?:\.[0-9]{1,3}){3}$", r"^(?:10|127|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168|[1-9][0-9]?|1[0-9][0-9]|2[0-2][0-9])\.", True),
    Kind("card", "[0-9][ -]?[0-9]", r"[0-9](?:[\x20-]?[0-9])++", _card, r"^(?:[0-9]{4}[ -]?){3}[0-9]{4}$|^3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}$", rf"^{_any(ISSUERS)}", True),
    Kind("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", _phone, r"^\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{3,4}$", rf"^\+{_any(CALLING)}", True),
    Kind("email_words", r"(?i)[ \[(]at[ \])]", r"(?i)(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?[\[( ]at[\]) ] ?[A-Za-z0-9-]++ ?[\[( ]dot[\]) ] ?[A-Za-z]{2,24}(?![A-Za-z])", lambda m: F.lit(True), r"(?i)^[a-z0-9._-]+ ?[\[(]at[\])] ?[a-z0-9-]+ ?[\[(]dot[\])] ?[a-z]+$", rf"(?i){_any(TLDS)}$"),
    Kind("phone_local", "[0-9]{3}[ .-][0-9]{4}", r"(?<![0-9+().-])(?<!\+[0-9] )\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])", lambda m: F.lit(True), r"^\([0-9]{3}\) [0-9]{3}-[0-9]{4}$", r"^\(?(?:[2-9][0-8][0-9])"),
    Kind("ssn", "[0-9]-[0-9]{2}-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda m: F.lit(True), r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", r"^[0-7]"),
    Kind("iban", "[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda m: F.length(_digits(m)) >= 10, r"^[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,4})?$|^[A-Z]{2}[0-9]{13,30}$", rf"^{_any(IBAN_COUNTRIES)}"),
    Kind("name", r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.? [A-Z]", r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?", lambda m: F.lit(True), r"\. [A-Z][a-z]{2,} [A-Z][a-z]{2,}$", rf"\b{_any(FIRST_NAMES)}\b"),
]
NAMES = [k.name for k in KINDS]
LABELERS = ("strict", "gazetteer", "cue", "contrary")
_SPAN = "array<struct<start:int,kind:int,end:int,strict:int,gazetteer:int,cue:int,contrary:int,size:int,digits:int>>"


def _vote(test: Column, no: int = -1) -> Column:
    return F.when(test, 1).otherwise(no)


def _spans(text: Column, k: int) -> Column:
    """Valid spans of KINDS[k]: gaps and matches alternate, so running lengths are positions."""
    kind = KINDS[k]
    gaps, found = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pairs = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g")))

    def step(acc: Column, x: Column) -> Column:
        m, context = x["m"], F.lower(F.right(x["g"], F.lit(48)))
        start = acc["at"] + F.length(x["g"])
        size, digits = F.length(m), F.length(_digits(m))
        span = F.struct(
            start.alias("start"), F.lit(k).alias("kind"), (start + size).alias("end"),
            _vote(m.rlike(kind.strict)).alias("strict"), _vote(m.rlike(kind.gazetteer)).alias("gazetteer"),
            _vote(context.rlike(CUES[kind.name]), 0).alias("cue"), F.when(context.rlike(CONTRARY), -1).otherwise(0).alias("contrary"),
            F.least(F.floor(size / 8).cast("int"), F.lit(5)).alias("size"), F.floor(4 * digits / size).cast("int").alias("digits"),
        )
        return F.struct((start + size).alias("at"), F.when(kind.valid(m), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).cast(_SPAN).alias("out"))

    none = F.array().cast(_SPAN)
    all_ = F.aggregate(F.filter(pairs, lambda x: x["m"].isNotNull()), F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(kind.quick), all_).otherwise(none)


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id and candidate spans of the whole text, by start and kind."""
    text = F.coalesce("text", F.lit(""))
    found = F.concat(*[_spans(text, k) for k in range(len(KINDS))])
    return documents.select("doc_id", F.array_sort(found).alias("spans"))


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], steps: int = 50) -> tuple[dict, dict]:
    """Expectation-maximisation over (kind, votes, count).

    Gives each (kind, votes)'s probability of being personal data, and each labeler's
    (rate of yes on true spans, rate of yes on false spans). Labelers are taken as independent given the truth.
    """
    n = len(LABELERS)
    rate = [[0.8, 0.3] for _ in range(n)]
    prior: dict[int, float] = {}
    post: dict[tuple[int, tuple[int, ...]], float] = {}
    for _ in range(steps):
        for kind, votes, _c in patterns:
            p = prior.get(kind, 0.5)
            yes, no = math.log(p), math.log(1 - p)
            for (t, f), v in zip(rate, votes):
                if v:
                    yes += math.log(t if v > 0 else 1 - t)
                    no += math.log(f if v > 0 else 1 - f)
            post[kind, votes] = 1 / (1 + math.exp(min(700, no - yes)))
        for kind in {k for k, *_ in patterns}:
            own = [(post[k, v], c) for k, v, c in patterns if k == kind]
            prior[kind] = (sum(p * c for p, c in own) + 1) / (sum(c for _, c in own) + 2)
        for j in range(n):
            seen = [(post[k, v], v[j], c) for k, v, c in patterns if v[j]]
            t, f = sum(p * c for p, _, c in seen), sum((1 - p) * c for p, _, c in seen)
            # two imagined spans that speak for the labeler keep its sign and keep rates inside (0, 1)
            rate[j] = [(sum(p * c for p, v, c in seen if v > 0) + 1.6) / (t + 2), (sum((1 - p) * c for p, v, c in seen if v > 0) + 0.6) / (f + 2)]
            rate[j] = [min(max(r, 0.02), 0.98) for r in rate[j]]
    return post, dict(zip(LABELERS, rate))


_FEATURES = ["strict", "gazetteer", "cue", "contrary", "size", "digits"]


def classifier(rows: list[dict], post: dict, steps: int = 300) -> dict[tuple[str, int], float]:
    """Weights of a logistic model over (feature, value), from soft labels of counted feature patterns."""
    weights: dict[tuple[str, int], float] = {("bias", 0): 0.0}
    keyed = []
    for r in rows:
        keys = [("bias", 0), ("kind", r["kind"]), *((f, r[f]) for f in _FEATURES)]
        keyed.append((keys, post[r["kind"], tuple(r[v] for v in LABELERS)], r["n"]))
        weights.update(dict.fromkeys(keys, 0.0))
    total = sum(n for *_, n in keyed) or 1
    for _ in range(steps):
        grad = dict.fromkeys(weights, 0.0)
        for keys, p, n in keyed:
            q = 1 / (1 + math.exp(-max(-30, min(30, sum(weights[k] for k in keys)))))
            for k in keys:
                grad[k] += n / total * (p - q)
        for k, g in grad.items():
            weights[k] += 2.0 * (g - 1e-4 * weights[k])
    return weights


def _score(span: Column, weights: dict[tuple[str, int], float]) -> Column:
    total = F.lit(weights.get(("bias", 0), 0.0))
    for f in ["kind", *_FEATURES]:
        values = [(v, w) for (g, v), w in weights.items() if g == f]
        if values:
            case = F.lit(0.0)
            for v, w in values:
                case = F.when(span[f] == v, F.lit(w)).otherwise(case)
            total = total + case
    return 1 / (1 + F.exp(-total))


def find(documents: DataFrame, threshold: float = 0.7, where: str | None = None) -> DataFrame:
    """doc_id and spans (start, kind number, end, base) that are reported, by start and kind."""
    spark = documents.sparkSession
    held = stored(candidates(documents), where or shared_dir(spark))
    counted = held.select(F.explode("spans").alias("s")).select("s.*").groupBy("kind", *_FEATURES).agg(F.count("*").alias("n"))
    rows = [r.asDict() for r in counted.collect()]  # at most 9 kinds x 24 vote patterns x 30 shapes
    rows.sort(key=lambda r: [r[c] for c in ("kind", *_FEATURES)])
    by: dict[tuple[int, tuple[int, ...]], int] = {}
    for r in rows:
        key = r["kind"], tuple(r[v] for v in LABELERS)
        by[key] = by.get(key, 0) + r["n"]
    post, _ = reliabilities([(k, v, c) for (k, v), c in by.items()])
    weights = classifier(rows, post)
    base = sum(k.base for k in KINDS)
    good = F.filter("spans", lambda s: (s["kind"] < base) | (_score(s, weights) >= threshold))
    return held.select("doc_id", F.transform(good, lambda s: F.struct(s["start"], s["kind"], s["end"], (s["kind"] < base).alias("base"))).alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(n) for n in NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = {f"n_{KINDS[k].name}": of(k) for k in range(4)}
    return found.withColumns(counts).select("doc_id", *counts, F.sha2(_joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def brute(text: str | None) -> tuple:
    """The base digest by Python's re, for tests."""
    import hashlib
    import re

    text = text or ""
    luhn = lambda d: sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0
    tests = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[ -]", "", m)) <= 19 and luhn(d)),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    spans = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(tests) for m in re.finditer(p, text) if ok(m[0]))
    digest = ",".join(f"{NAMES[k]}:{s}:{e}" for s, k, e in spans)
    return (*[sum(s[1] == k for s in spans) for k in range(4)], hashlib.sha256(digest.encode()).hexdigest())
