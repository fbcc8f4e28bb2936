"""Personal data by weak supervision, with DataFrame functions only (operator 3).

Candidates are found in every whole text: e-mail addresses, IP addresses, card numbers and international phone numbers,
which always are spans, and national phone numbers, identity numbers and titled names, which the method has to accept.
Four labelers vote on each candidate or abstain: a regex labeler on its form; a gazetteer labeler on lists of top-level
domains, calling codes, card issuers, given and family names, and of reserved, test and example values; a context labeler on
the words before it, in the corpus's four languages; and one on other candidates in the text. Spark counts the vote
patterns, of which there are some thousands at most whatever the corpus, and they come to the driver in one job. There,
expectation maximisation estimates how reliable the labelers are, and the posteriors train the final span classifier:
weights of log odds for kind, votes and features of the span, from posterior-weighted counts. It scores every span.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeframe.llm.common import cut

KINDS = ("email", "ip", "card", "phone", "national", "identity", "name")
BASE = 4
LABELERS = ("form", "gazetteer", "context", "company")
ROUNDS = 10

# Where a match can only start at the start of a run, a look-behind keeps long runs from being tried at each place;
# \G lets a match start right after the last. Repeated groups are possessive: they match the same, and the JVM takes them
# in a loop, where it would recurse once for each repetition of others and overflow its stack on long runs.
_PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señor|Señora)\.?\x20\p{Lu}[\p{L}'-]+(?:\x20\p{Lu}[\p{L}'-]+)?",
)
#: What a text must hold for a pattern to be tried; each is implied by the pattern and its check.
_GUARDS = ("@", r"[0-9]\.[0-9]+\.[0-9]", r"[0-9](?:[\x20-]?[0-9]){11}", "+", r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señor|Señora)\.?\x20\p{Lu}")
_TITLES = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señor|Señora)"
# Fixed values, plain lists of what is known: the gazetteer, by kind.
_DOMAINS = "com org net edu gov mil int info biz io dev app ai co me tv eu uk us ca au nz ie de at ch li nl be lu fr es pt it gr pl cz sk hu ro bg hr si rs dk se no fi is ee lv lt ua ru tr il in cn jp kr tw hk sg my th vn id ph br ar cl pe mx za ng ke eg ma".split()
_CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 220 221 225 233 234 237 254 255 256 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 377 380 381 382 385 386 387 389 420 421 423 502 503 504 505 506 507 509 591 592 593 595 598 852 853 855 856 880 886 960 961 962 963 964 965 966 967 968 971 972 973 974 975 976 977 992 993 994 995 996 998".split()
_ISSUERS = r"^(?:4[0-9]{12}(?:[0-9]{3})?(?:[0-9]{3})?|(?:5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720)[0-9]*|3[47][0-9]{13}|6(?:011|4[4-9]|5)[0-9]{12,15}|3(?:0[0-5]|[68])[0-9]{12}|35[0-9]{14})$"
_TEST_CARDS = "4111111111111111 4242424242424242 4012888888881881 4000056655665556 5555555555554444 5105105105105100 2223003122003222 378282246310005 371449635398431 6011111111111117 6011000990139424 3056930009020004 30569309025904 38520000023237 3530111333300000 3566002020360505".split()
_RESERVED = r"^(?:0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|^169\.254\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|^192\.168\.|^192\.0\.2\.|^198\.51\.100\.|^198\.1[89]\.|^203\.0\.113\.|^1\.1\.1\.1$|^1\.0\.0\.1$|^8\.8\.[84]\.[84]$|^9\.9\.9\.9$"
_EXAMPLE_MAIL = r"(?i)@(?:[^@]*\.)?example\.(?:com|org|net|edu)$|\.(?:test|example|invalid|localhost)$|@test\.|^no-?reply@|^donotreply@"
_NUMBERING = r"^\(?[2-9][0-8][0-9]\)?[\x20.-][2-9]"
_FICTION = r"555[\x20.-]?01[0-9]{2}$"
_VOID_IDENTITY = r"^(?:000|666|9)|^[0-9]{3}-00|-0000$|^078-05-1120$|^219-09-9999$|^123-45-6789$"
_NAMES = """james john robert michael william david richard joseph thomas charles mary patricia jennifer linda elizabeth barbara susan jessica sarah karen
anna emma lucas paul peter hans klaus wolfgang jürgen ursula monika petra sabine heike andrea stefan markus jean pierre michel philippe alain nicolas marie nathalie isabelle
sylvie catherine martine françoise sophie camille juan josé antonio manuel francisco luis carlos javier miguel carmen maría ana isabel dolores pilar teresa lucía
smith johnson williams brown jones miller davis wilson taylor anderson thompson white harris clark lewis walker young king wright hill
müller schmidt schneider fischer weber meyer wagner becker schulz hoffmann koch bauer richter klein wolf schröder neumann schwarz zimmermann braun
martin bernard dubois thomas robert richard petit durand leroy moreau simon laurent lefebvre michel garcia roux fournier girard bonnet dupont
garcía rodríguez gonzález fernández lópez martínez sánchez pérez gómez jiménez ruiz hernández díaz moreno muñoz álvarez romero alonso gutiérrez navarro""".split()
_NOBODY = r"(?i)\b(?:john|jane)\x20(?:doe|roe)$|\bmax(?:ine)?\x20muster|\bmustermann$|\bjean\x20dupont$|\bjuan\x20pérez$"
#: What speaks for personal data when it stands just before, and what against it, in English, German, French and Spanish.
_BEFORE = """e-?mails? mail contact reach write call phone telephone tel fax mobile cell card visa mastercard amex credit payment paid iban account ip server host address ssn social id dear signed sincerely named
kontakt schreiben schreib ruf anruf telefon handy mobil karte kreditkarte konto zahlung adresse anschrift rechner ausweis lieber liebe geehrter geehrte gezeichnet name
courriel contacter écrivez écrire appelez appeler téléphone portable carte bancaire paiement compte adresse serveur sécurité cher chère signé nom
correo contacto escriba escribir llame llamar teléfono móvil tarjeta crédito pago cuenta dirección servidor seguridad dni nie estimado estimada firmado nombre""".split()
_NOT_BEFORE = """version versions v ver release build section chapter page figure table item part order invoice isbn issn doi rfc
fassung ausgabe abschnitt kapitel seite abbildung tabelle artikel teil bestellung rechnung
édition révision section chapitre page tableau pièce commande facture référence
versión edición sección capítulo página figura tabla artículo pieza pedido factura referencia""".split()


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(dict.fromkeys(words)) + ")"


_SPOKEN_FOR = rf"(?iu)(?<!\p{{L}}){_any(_BEFORE)}(?!\p{{L}})[^\p{{L}}]{{0,6}}(?:\p{{L}}{{1,8}}[^\p{{L}}]{{1,4}}){{0,2}}$"
_SPOKEN_AGAINST = rf"(?iu)(?<!\p{{L}}){_any(_NOT_BEFORE)}[^\p{{L}}]{{0,6}}$"
CONTEXT = 40


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)

    def add(total, i):
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return n.between(12, 19) & F.when(n.between(12, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


def _octets(value: Column) -> Column:
    def fits(part):
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(value, r"\."), fits)


_CHECKS: tuple[Callable[[Column], Column] | None, ...] = (None, _octets, _luhn, lambda v: F.length(_digits(v)).between(9, 15), None, None, None)
#: What the regex labeler takes for a well-formed value.
_FORMS = (r"^[A-Za-z0-9][^@]*@[^@]*\.[A-Za-z]{2,}$", r"^(?!0)[0-9]+(\.(?:0|[1-9][0-9]*)){3}$", r"^[3-6]", r"^\+[1-9]", r"^\(?[2-9]", r"^(?!000|666|9)", r"\x20\p{Lu}[\p{L}'-]+\x20\p{Lu}")


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as an array of (start, end, value), in code points, end exclusive."""
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def add(acc, x):
        a = acc["at"] + F.char_length(x["gap"])
        b = a + F.char_length(x["value"])
        item = F.struct(a.alias("start"), b.alias("end"), x["value"].alias("value"))
        return F.struct(b.alias("at"), F.array_append(acc["out"], item).alias("out"))

    return F.aggregate(F.filter(pieces, lambda x: x["value"].isNotNull()), start, add, lambda acc: acc["out"])


def _known(kind: int, value: Column) -> Column:
    """The gazetteer's vote: 1 for what its lists hold, 0 for what they hold as reserved, test or example, else -1."""
    digits = _digits(value)
    against, speaks = {
        "email": (value.rlike(_EXAMPLE_MAIL), value.rlike(rf"(?i)\.{_any(_DOMAINS)}$")),
        "ip": (value.rlike(_RESERVED), F.lit(False)),
        "card": (digits.isin(_TEST_CARDS), digits.rlike(_ISSUERS)),
        "phone": (value.rlike(_FICTION), digits.rlike(f"^{_any(_CALLING_CODES)}")),
        "national": (value.rlike(_FICTION), value.rlike(_NUMBERING)),
        "identity": (value.rlike(_VOID_IDENTITY), F.lit(False)),
        "name": (value.rlike(_NOBODY), value.rlike(rf"(?iu)\x20{_any(_NAMES)}(?!\p{{L}})")),
    }[KINDS[kind]]
    return F.when(against, 0).when(speaks, 1).otherwise(-1)


def _said(before: Column) -> Column:
    """The context's vote, by the words just before."""
    return F.when(before.rlike(_SPOKEN_AGAINST), 0).when(before.rlike(_SPOKEN_FOR), 1).otherwise(-1)


def _candidates(text: Column, kind: int) -> Column:
    guard = F.contains(text, F.lit(_GUARDS[kind])) if len(_GUARDS[kind]) == 1 else text.rlike(_GUARDS[kind])
    found, check = matches(text, _PATTERNS[kind]), _CHECKS[kind]
    if check is not None:
        found = F.filter(found, lambda x: check(x["value"]))

    def labelled(x):
        value = x["value"]
        before = F.substr(text, F.greatest(x["start"] - CONTEXT, F.lit(0)) + 1, F.least(x["start"], F.lit(CONTEXT)))
        share = F.length(_digits(value)) / F.length(value)
        return F.struct(
            x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), F.when(value.rlike(_FORMS[kind]), 1).otherwise(0).alias("form"), _known(kind, value).alias("gazetteer"), _said(before).alias("context"),
            F.when(F.length(value) < 12, 0).when(F.length(value) < 20, 1).otherwise(2).alias("length"), F.when(share < 0.3, 0).when(share < 0.8, 1).otherwise(2).alias("digits"),
        )

    empty = F.array().cast("array<struct<start:int,kind:int,end:int,form:int,gazetteer:int,context:int,length:int,digits:int>>")
    return F.when(guard, F.transform(found, labelled)).otherwise(empty)


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def _sum(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


#: Features of the span that the classifier weighs beside the votes, with their values.
FEATURES = {"kind": range(len(KINDS)), "length": range(3), "digits": range(3)} | {name: (-1, 0, 1) for name in LABELERS}


def _odds(p: float) -> float:
    return min(max(p, 1e-4), 1 - 1e-4)


def posterior(share: float, rates: dict[str, tuple[float, float]], row: dict) -> float:
    """Probability that a candidate with these votes is personal data; abstentions say nothing."""
    total = _logit(share)
    for name, (a, b) in rates.items():
        a, b = _odds(a), _odds(b)
        total += math.log(a / b) if row[name] == 1 else math.log((1 - a) / (1 - b)) if row[name] == 0 else 0.0
    return 1 / (1 + math.exp(-total))


def reliabilities(patterns: list[dict], rounds: int = ROUNDS) -> tuple[float, dict[str, tuple[float, float]]]:
    """EM over vote patterns with their numbers n: the share of personal data, and of each labeler how often it votes 1,
    given either class, among its votes.

    Starts from labelers that are right in 80 of 100 votes; a pseudo-count of one keeps them off 0 and 1.
    """
    share, rates = 0.7, {name: (0.8, 0.2) for name in LABELERS}
    n = sum(row["n"] for row in patterns)
    for _ in range(rounds if n else 0):
        post = [posterior(share, rates, row) for row in patterns]
        share = (sum(row["n"] * p for row, p in zip(patterns, post)) + 1) / (n + 2)
        for name in LABELERS:
            said = [(row["n"], row[name], p) for row, p in zip(patterns, post) if row[name] >= 0]
            rates[name] = tuple((sum(m * w(p) for m, vote, p in said if vote == 1) + prior) / (sum(m * w(p) for m, _, p in said) + 1) for w, prior in ((lambda p: p, 0.8), (lambda p: 1 - p, 0.2)))
    return share, rates


def train(patterns: list[dict], share: float, rates: dict[str, tuple[float, float]]) -> tuple[float, dict[str, dict[int, float]]]:
    """The final classifier: an offset and a log-odds weight for each value of each feature, from posterior-weighted counts."""
    post = [posterior(share, rates, row) for row in patterns]
    yes, no = sum(row["n"] * p for row, p in zip(patterns, post)), sum(row["n"] * (1 - p) for row, p in zip(patterns, post))
    weights = {}
    for name, values in FEATURES.items():
        held = {v: [1.0, 1.0] for v in values}
        for row, p in zip(patterns, post):
            held[row[name]][0] += row["n"] * p
            held[row[name]][1] += row["n"] * (1 - p)
        weights[name] = {v: math.log(a / (yes + len(held))) - math.log(b / (no + len(held))) for v, (a, b) in held.items()}
    return math.log((yes + 1) / (no + 1)), weights


def score(offset: float, weights: dict[str, dict[int, float]], of: Callable[[str], Column]) -> Column:
    """The classifier's probability as an expression over a span's fields."""
    odds = [F.lit(offset)]
    for name, held in weights.items():
        part = None
        for v, w in held.items():
            part = F.when(of(name) == v, w) if part is None else part.when(of(name) == v, w)
        odds.append(part.otherwise(0.0))
    return 1 / (1 + F.exp(-_sum(odds)))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Personal data in every whole text: one row per input row.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of these four kinds' spans, joined as kind:start:end),
    spans (these and the accepted further ones), n_spans, n_sure (of all candidates, those that the classifier scores 0.5
    or more: a base span with a reserved or example value usually isn't one).
    Null and empty texts have no spans. Nothing is looked up by doc_id, so repeated rows and null ids are kept as they
    are; other columns don't matter. Very long texts are matched whole. An empty table gives an empty result, and without candidates nothing is trained.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", F.concat(*(_candidates(text, k) for k in range(len(KINDS)))).alias("x"))
    covered = lambda c: F.exists("x", lambda b: (b["kind"] < BASE) & (b["start"] < c["end"]) & (c["start"] < b["end"]))
    found = found.select("doc_id", F.filter("x", lambda c: (c["kind"] < BASE) | ~covered(c)).alias("x"))
    found = cut(found.select("doc_id", F.transform(F.array_sort("x"), lambda c: c.withField("company", F.when(F.size("x") > 1, 1).otherwise(-1))).alias("x")))
    patterns = found.select(F.explode("x").alias("c")).select("c.*").groupBy(*FEATURES).agg(F.count("*").alias("n"))
    patterns = [row.asDict() for row in patterns.orderBy(*FEATURES).collect()]  # a row for each pattern there is: thousands at most
    offset, weights = train(patterns, *reliabilities(patterns))
    scored = F.transform("x", lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), score(offset, weights, lambda name: c[name]).alias("score")))
    scored = found.select("doc_id", scored.alias("x"))
    kinds = F.array(*map(F.lit, KINDS))
    named = lambda spans: F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.element_at(kinds, c["kind"] + 1), c["start"], c["end"])), ",")
    count = lambda k: F.size(F.filter("x", lambda c: c["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    counts = [count(k) for k in range(BASE)]
    base, taken = F.filter("x", lambda c: c["kind"] < BASE), F.filter("x", lambda c: (c["kind"] < BASE) | (c["score"] >= 0.5))
    return scored.select("doc_id", *counts, F.sha2(named(base), 256).alias("base_sha256"), named(taken).alias("spans"), F.size(taken).cast("long").alias("n_spans"), F.size(F.filter("x", lambda c: c["score"] >= 0.5)).cast("long").alias("n_sure"))
