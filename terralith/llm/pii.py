"""Personal data with Spark expressions only: base patterns plus a weakly supervised classifier.

Base spans (email, ip, card, phone) follow fixed patterns and always stay. Weaker candidates
(national telephone numbers, social-security numbers, bank accounts, names after a title) are
voted on, together with the base spans, by five labelers: shape, checksum or plausibility,
gazetteer, words before, and counter-indications. Spans are grouped by kind, votes and length
class, so what reaches the driver is a small table of counts whose size does not depend on the
corpus. On it expectation-maximisation estimates each labeler's reliability, and a logistic span
classifier is fitted to the posterior; the fitted weights go back into the plan as literals.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import materialise, table, text_or_empty
from terralith.llm.spans import apart, count_kind, cut, find, let, ordered, pieces_of

# Fixed values of the base kinds. The look-behinds and possessive quantifiers only keep a
# failing search from restarting inside a run; they match exactly what the plain forms match:
# email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+),
# card [0-9]([\x20-]?[0-9])+, phone \+[0-9][\x20().0-9-]+[0-9].
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
BASE = ["email", "ip", "card", "phone"]
# Candidates that the classifier decides on.
TEL = r"(?<![0-9A-Za-z+().-])(?:\([0-9]{3}\)\x20|0[0-9]{2,4}[\x20/-]|[0-9]{3}-)[0-9]{3}[\x20-]?[0-9]{3,5}(?![0-9A-Za-z-])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
NAME = r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20\p{Lu}\p{Ll}+(?:\x20\p{Lu}\p{Ll}+)?"
WEAK = ["tel", "ssn", "iban", "name"]
KINDS = BASE + WEAK
# Gazetteers and cue words.
DOMAINS = "com org net edu gov io de fr es uk eu info"
COUNTRIES = "1 7 30 31 32 33 34 39 41 43 44 45 46 47 48 49 52 54 55 61 81 82 86 90 91 351 353 358 420"
GIVEN = "Anna Anne Carlos Carmen David Elena Emma Hans Jean John José Juan Karl Laura Louis Maria Marie Mary Michael Paul Peter Pierre Robert Sarah Thomas"
ACCOUNTS = "AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE"
CUES = {
    "email": r"e-?mail|contact|write|@",
    "ip": r"\bip\b|host|server|address|login",
    "card": r"card|visa|master|amex|kredit|tarjeta|carte",
    "phone": r"phone|call|tel|fax|mobile",
    "tel": r"phone|call|tel|fax|mobile|ruf",
    "ssn": r"ssn|social|security|tax",
    "iban": r"iban|account|konto|cuenta|compte|bank",
    "name": r"dear|by|from|signed|contact|name",
}
AGAINST = r"(?:version|isbn|issn|page|chapter|section|invoice|order|part|serial|model|no\.|v)[\x20:#.]*$"
WINDOW = 24
LABELERS = 5


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(F.split(_digits(m), ""))
    each = F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, v: a + v) % 10 == 0


def _mod97(m: Column) -> Column:
    """IBAN check: four leading characters to the end, letters as 10 to 35, remainder 1."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97) == 1


def base_spans(text: Column) -> Column:
    """email, ip, card and phone spans of one text."""
    n = lambda m: F.length(_digits(m))
    email = find(text, "email", EMAIL, F.contains(text, F.lit("@")))
    ip = find(text, "ip", IP, text.rlike(r"[0-9]\.[0-9]"), lambda m: m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
    card = find(text, "card", CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), lambda m: F.when(n(m).between(12, 19), _luhn(m)).otherwise(False))
    phone = find(text, "phone", PHONE, F.contains(text, F.lit("+")), lambda m: n(m).between(9, 15))
    return F.concat(email, ip, card, phone)


def weak_spans(text: Column) -> Column:
    """Candidates of the kinds that only the classifier can accept."""
    digits = text.rlike(r"[0-9]{2}[-\x20/)]+[0-9]{2}")
    return F.concat(
        find(text, "tel", TEL, digits),
        find(text, "ssn", SSN, digits),
        find(text, "iban", IBAN, text.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}")),
        find(text, "name", NAME, text.rlike(r"(?:Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20")),
    )


def _in(value: Column, words: str) -> Column:
    return value.isin(*words.split())


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _labelled(text: Column, spans: Column) -> Column:
    """The spans with their five votes (1 for, -1 against, 0 abstains) and their length class."""
    before = lambda pieces, x: F.lower(F.array_join(cut(pieces, F.greatest(x["s"] - WINDOW, F.lit(0)), x["s"]), ""))
    voted = let(pieces_of(text), lambda pieces: F.transform(spans, lambda x: let(before(pieces, x), lambda b: _votes(x, b))))
    return F.when(F.size(spans) > 0, voted).otherwise(F.array().cast(_VOTED))


_VOTED = "array<struct<kind:string,s:int,e:int,votes:array<int>,len:int>>"


def _votes(x: Column, before: Column) -> Column:
    kind, m = x["kind"], x["m"]
    n = F.length(_digits(m))
    never = F.lit(False)
    shape = F.when(kind == "email", _vote(m.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}$"), ~m.rlike(r"\.[A-Za-z]{2,}$")))
    shape = shape.when(kind.isin("card"), _vote(m.rlike(r"^[0-9]{4}([ -]?[0-9]{4}){3}$"), never)).when(kind.isin("phone", "tel"), _vote(n.between(9, 13), n < 8))
    shape = shape.when(kind == "ssn", _vote(~m.rlike("^(000|666|9)"), m.rlike("^(000|666|9)|-00-|-0000$"))).otherwise(0)
    check = F.when(kind == "card", _vote(_luhn(m), ~_luhn(m))).when(kind == "iban", _vote(_mod97(m), ~_mod97(m)))
    check = check.when(kind == "ip", _vote(never, m.rlike(r"^0|^127\.|\.0\.0\.|^[0-9]\.[0-9]\.[0-9]\.[0-9]$"))).otherwise(0)
    code = lambda k: F.substring(_digits(m), 1, k)
    gazette = F.when(kind == "email", _vote(_in(F.lower(F.substring_index(m, ".", -1)), DOMAINS), never))
    gazette = gazette.when(kind == "phone", _vote(_in(code(1), COUNTRIES) | _in(code(2), COUNTRIES) | _in(code(3), COUNTRIES), m.rlike(r"^\+0")))
    gazette = gazette.when(kind == "iban", _vote(_in(F.substring(m, 1, 2), ACCOUNTS), ~_in(F.substring(m, 1, 2), ACCOUNTS)))
    gazette = gazette.when(kind == "name", _vote(F.exists(F.split(m, r"[\x20.]+"), lambda w: _in(w, GIVEN)), never)).otherwise(0)
    context = F.lit(0)
    for k, cue in CUES.items():
        context = F.when((kind == k) & before.rlike(cue), 1).otherwise(context)
    against = F.when(before.rlike(AGAINST), -1).otherwise(0)
    return F.struct(
        kind.alias("kind"),
        x["s"].alias("s"),
        x["e"].alias("e"),
        F.array(*[v.cast("int") for v in (shape, check, gazette, context, against)]).alias("votes"),
        F.least(F.lit(3), F.floor(F.log2((x["e"] - x["s"]).cast("double")) / 1.5).cast("int")).alias("len"),
    )


def estimate(groups: list[tuple[str, tuple[int, ...], int, int]], rounds: int = 40) -> tuple[dict, list[float]]:
    """EM over (kind, votes, length class, count) groups.

    Returns the probability of each (kind, votes) of being personal data, and each labeler's
    estimated reliability. A labeler that votes is right with its reliability in either class
    (one-coin model, Beta(8, 2) prior); the share of true spans is estimated by kind, with a
    Beta(2, 2) prior.
    """
    right = [0.8] * LABELERS
    share = {k: 0.5 for k, *_ in groups}
    post = {}
    for _ in range(rounds):
        for kind, votes, _len, _n in groups:
            odds = log(share[kind] / (1 - share[kind]))
            odds += sum(v * log(r / (1 - r)) for v, r in zip(votes, right, strict=True))
            post[kind, votes] = 1 / (1 + exp(-max(-30.0, min(30.0, odds))))
        hit, all_ = [8.0] * LABELERS, [10.0] * LABELERS
        true, of = dict.fromkeys(share, 2.0), dict.fromkeys(share, 4.0)
        for kind, votes, _len, n in groups:
            p = post[kind, votes]
            true[kind] += n * p
            of[kind] += n
            for i, v in enumerate(votes):
                if v:
                    hit[i] += n * (p if v > 0 else 1 - p)
                    all_[i] += n
        right = [min(0.99, max(0.51, h / a)) for h, a in zip(hit, all_, strict=True)]
        share = {k: min(0.98, max(0.02, true[k] / of[k])) for k in share}
    return post, right


def _features(kind: str, votes: tuple[int, ...], length: int) -> list[float]:
    return [1.0, *[float(kind == k) for k in KINDS], *map(float, votes), *[float(length == i) for i in range(4)]]


def fit(groups: list[tuple[str, tuple[int, ...], int, int]], steps: int = 300, ridge: float = 1e-3) -> list[float]:
    """Weights of the logistic span classifier, fitted to the EM posterior of the groups."""
    post, _ = estimate(groups)
    total = sum(n for *_, n in groups) or 1
    rows = [(_features(k, v, ln), post[k, v], n / total) for k, v, ln, n in groups]
    w = [0.0] * (1 + len(KINDS) + LABELERS + 4)
    for _ in range(steps):
        grad = [ridge * x for x in w]
        for x, y, n in rows:
            p = 1 / (1 + exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x, strict=True))))))
            for i, v in enumerate(x):
                if v:
                    grad[i] += n * (p - y) * v
        w = [a - 2.0 * g for a, g in zip(w, grad, strict=True)]
    return w


def _score(x: Column, w: list[float]) -> Column:
    kinds = F.create_map(*[y for i, k in enumerate(KINDS) for y in (F.lit(k), F.lit(w[1 + i]))])
    at = 1 + len(KINDS)
    votes = F.array(*[F.lit(v) for v in w[at : at + LABELERS]])
    lens = F.array(*[F.lit(v) for v in w[at + LABELERS :]])
    total = F.aggregate(F.zip_with(x["votes"], votes, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, v: a + v)
    return F.lit(w[0]) + F.element_at(kinds, x["kind"]) + total + F.element_at(lens, x["len"] + 1)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, base, extra), arrays of spans (kind, s, e).

    Null text is empty and has no span; repeated rows give equal rows; other columns, whatever
    their names, are not read; an empty table gives an empty result. Time grows with the length
    of a text and the number of its spans.
    """
    src = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    found = src.select("id", "text", base_spans(F.col("text")).alias("base"), weak_spans(F.col("text")).alias("weak"))
    found = found.select("id", "text", "base", apart(F.col("weak"), F.col("base")).alias("weak"))
    held = materialise(found.select("id", _labelled(F.col("text"), F.col("base")).alias("base"), _labelled(F.col("text"), F.col("weak")).alias("weak")))
    counted = held.select(F.explode(F.concat("base", "weak")).alias("x")).groupBy("x.kind", "x.votes", "x.len").count().collect()
    groups = [(r["kind"], tuple(r["votes"]), r["len"], r["count"]) for r in counted]
    weights = fit(sorted(groups))
    plain = lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))
    accepted = F.filter("weak", lambda x: _score(x, weights) >= 0.0)
    return held.select("id", F.transform("base", plain).alias("base"), F.transform(accepted, plain).alias("extra"))


def op8_pii(spark, sf_dir):
    """Contract query over all ``documents``."""
    rows = scan(table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"),
        *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(ordered(F.col("base"), KINDS), 256).alias("base_sha256"),
        ordered(F.concat("base", "extra"), KINDS).alias("spans"),
    )
