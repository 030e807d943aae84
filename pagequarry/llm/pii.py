"""PII by weak supervision, in DataFrame functions only.

Base spans come from fixed patterns (leftmost, non-overlapping per kind; failing matches dropped).  Beside them candidates are
proposed by looser patterns (masked addresses, phone numbers without a plus, dotted cards, defanged addresses of hosts, long mixed
strings), by gazetteers (given names and titles, street words) and by context (what follows ``password =`` and the like),
among them the kinds secret, iban, name and address, which have no base.  Four labelers vote -1, 0 or 1 on every base span and candidate: the shape
pattern, a gazetteer, cue words before it, and its length or checksum.  Expectation-maximisation over the histogram
of votes - at most kinds x 81 x 4 rows a side, all that reaches the driver - estimates each labeler's
reliability; a logistic classifier of the votes and two plain features of the span (a digit, mixed case) is then trained on the posteriors and
decides on the candidates, as an expression in the plan.  Base spans stay; a candidate is added if it overlaps none.

Patterns use possessive runs behind a look-behind, so that long runs of word characters or digits are
scanned once; a failing run can't match from a later character of it, so matches are unchanged.  Spans are gathered in
blocks, so that work grows with a text's length also where it is long and full of matches.

Null text counts as empty: no spans.  Offsets are code points, ends exclusive.  One row per row, repeated rows alike; an empty table gives
no rows and learns nothing.  Columns of the input keep their names; none may begin with ``_pii_``.  The text is read twice and never written.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.text import let

KINDS = ("email", "ip", "card", "phone", "secret", "iban", "name", "address")
BASE = KINDS[:4]
#: \G: where the last match ended in the middle of a run, the rest of the run is searched as well.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no valid span of the kind.
NEEDS = {"email": r"@[A-Za-z0-9-]++\.", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9][\x20().0-9-]"}

TOP_LEVEL = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at", "us", "ca", "au", "jp", "in", "br", "mx", "ar", "be", "pl", "se", "no", "dk", "fi", "pt", "ie", "nz", "cn", "ru", "kr", "co", "biz", "dev", "app", "me", "tv", "ai", "example")
GIVEN = (
    "James|Mary|John|Patricia|Robert|Jennifer|Michael|Linda|William|Elizabeth|David|Barbara|Richard|Susan|Joseph|Jessica|Thomas|Sarah|Charles|Karen|"
    "Daniel|Nancy|Matthew|Lisa|Anthony|Betty|Mark|Margaret|Steven|Sandra|Paul|Ashley|Andrew|Emily|Joshua|Donna|Kevin|Michelle|Brian|Carol|George|Amanda|"
    "Hans|Peter|Wolfgang|Klaus|Jürgen|Dieter|Uwe|Stefan|Andreas|Sabine|Monika|Petra|Ursula|Renate|Heike|Birgit|Anja|Katrin|"
    "Jean|Pierre|Michel|André|Philippe|Alain|Jacques|Marie|Nathalie|Isabelle|Sylvie|Catherine|Françoise|Élodie|Camille|"
    "José|Antonio|Manuel|Francisco|Juan|Carlos|Jesús|Javier|Miguel|María|Carmen|Ana|Isabel|Dolores|Pilar|Teresa|Lucía|Elena"
)
TITLES = r"(?:Mrs?|Ms|Dr|Prof|Sir|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra?|Don|Doña)\.?"
STREET = "Street|Road|Avenue|Lane|Boulevard|Drive|Court|Square|Terrace|Highway|Parkway"
STRASSE = "straße|strasse|weg|platz|allee|gasse|ufer|ring"
RUE = "rue|avenue|boulevard|place|quai|impasse|calle|avenida|plaza|paseo|camino"
PARTICLES = "(?:de|la|le|los|las|des|del|du)"
KEYS = r"(?:passwor[dt]|passwd|passphrase|pwd|token|secret|credential|api[_-]?key|access[_-]?key|private[_-]?key|contraseña|mot de passe|kennwort)"

#: What proposes candidates of a kind, and what a text must have to hold any.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:\x20?(?:\(at\)|\[at\]|\{at\})\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}(?:(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}){1,4}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\x20\.\x20|\[dot\])[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9./])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+.(-])\(?[0-9]{2,4}\)?[\x20.-]{1,2}[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,3}(?![0-9])",
    "secret": rf"(?<=(?i:{KEYS})[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?)[^\s\"':=]{{6,256}}|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{24,512}}(?![A-Za-z0-9+/_-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": rf"(?<!\p{{L}})(?=\p{{Lu}})(?:{TITLES}\x20(?:\p{{Lu}}\p{{L}}{{1,30}}\x20)?|(?:{GIVEN})\x20(?:\p{{Lu}}\.\x20)?)\p{{Lu}}\p{{L}}{{1,30}}(?!\p{{L}})",
    "address": rf"(?<![0-9])[0-9]{{1,5}}(?:\x20(?:\p{{Lu}}\p{{L}}{{1,30}}\x20){{1,3}}(?:{STREET})|,?\x20(?:{RUE})\x20(?:{PARTICLES}\x20){{0,2}}\p{{Lu}}\p{{L}}{{1,30}})(?!\p{{L}})|(?<!\p{{L}})(?:(?=\p{{Lu}})\p{{Lu}}\p{{Ll}}{{1,40}}(?:{STRASSE})|(?:{RUE})\x20(?:{PARTICLES}\x20){{0,2}}\p{{Lu}}\p{{L}}{{1,30}},?)\x20[0-9]{{1,4}}(?![0-9])",
}
LOOSE_NEEDS = {
    "email": r"\(at\)|\[at\]|\{at\}|\x20at\x20[A-Za-z0-9-]{1,63}(?:\x20?\.|\x20?[(\[]dot[)\]]|\x20dot\x20)",
    "ip": r"[0-9](?:\[\.\]|\(\.\)|\x20\.\x20|\[dot\])[0-9]",
    "card": r"[0-9]{4}[./_][0-9]{4}[./_][0-9]{4}",
    "phone": r"[0-9]{2,4}\)?[\x20.-]{1,2}[0-9]{2,4}[\x20.-][0-9]{2}",
    "secret": rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{24}}|[:=](?<=(?i:{KEYS})[\"']?\s{{0,3}}[:=])",
    "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}",
    # two capitalised words in a row
    "name": r"(?<!\p{L})\p{Lu}\p{L}++\.?\x20\p{Lu}[\p{L}.]",
    # a number before a capitalised word or a word for a street, or behind the name of one
    "address": rf"(?<![0-9])[0-9]{{1,5}}+,?\x20(?:\p{{Lu}}\p{{L}}|(?:{RUE})\x20)|\x20[0-9](?<=(?:{STRASSE}|(?:{RUE})\x20[\p{{L}}\x20]{{2,48}},?)\x20[0-9])",
}
CUES = {
    "email": "mail|contact|write|reach|address|adresse|correo|courriel|schreib",
    "ip": r"\bip\b|host|server|address|login|connect|serveur|servidor",
    "card": "card|visa|master|amex|credit|carte|karte|tarjeta|payment",
    "phone": "phone|tel|call|fax|mobile|cell|ring|whatsapp|numero|anruf|dial",
    "secret": KEYS + r"|auth|bearer|\bkey|login",
    "iban": "iban|bank|konto|account|compte|cuenta|transfer|bic",
    "name": "name|contact|dear|regards|author|by|from|sincerely|patient|client|kunde|nom|nombre",
    "address": "address|adresse|direcci|anschrift|live|located|ship|deliver|wohn|domicil",
}
AGAINST = "isbn|invoice|order|version|serial|ticket|item|page|ref|sku|part|date|rechnung|factura|commit|sha|md5|uuid|digest|checksum"
#: Gazetteers, by kind: what speaks for a span and what against it.
LISTED = {
    "email": (r"(?i:[^A-Za-z](?:" + "|".join(TOP_LEVEL) + r"))$", r"[A-Za-z]$"),
    "ip": (r"^(?:10|127|172|192)[^0-9]", None),
    "card": (r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))", r"^[017-9]"),
    "phone": (r"^(?:\+|00|0[1-9]|1[ .-]|\()", None),
    "secret": (r"^(?:sk-|pk-|gh[pousr]_|AKIA|ASIA|xox[abp]-|eyJ|AIza|ya29|glpat-|[0-9a-f]{32}$|[0-9a-f]{40}$|[0-9a-f]{64}$)", r"^[A-Za-z]+(?:[/_-][A-Za-z]+)*$"),
    "iban": (r"^(?:AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM)", r"."),
    "name": (rf"^(?:{GIVEN})|^{TITLES}\x20", None),
    "address": (rf"(?:{STREET})$|(?:{STRASSE})\x20|^(?:[0-9]{{1,4}},?\x20)?(?:{RUE})\x20", None),
}
SHAPES = {
    "email": (r"@|\((?:at|dot)\)|\[(?:at|dot)\]|\{at\}|\x20dot\x20|\x20at\x20[^\x20]+\.[a-z]{2,}$", r"\x20at\x20.*\.\x20"),
    "ip": (r"^[0-9]++(?:\.[0-9]++){3}$|\[\.\]|\[dot\]", r"\x20\.\x20"),
    "card": (r"^[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}$|^[0-9]{4}[.][0-9]{4}[.]", r"/"),
    "phone": (r"^\+|^\([0-9]{3}\)[\x20-][0-9]{3}-[0-9]{4}$|^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$", r"^[12][0-9]{3}[.-][0-9]{2}[.-][0-9]{2}$"),
    "secret": (r"[0-9][A-Za-z]++[0-9]++[A-Za-z]", r"^[^0-9]*$|^[0-9]+$|[_/-][a-z]{3,}[_/-]"),
    "iban": (r"^[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){3,7}", None),
    "name": (r"^\p{Lu}\p{Ll}+\.?\x20\p{Lu}\p{Ll}+$|^\p{Lu}\p{Ll}+\x20\p{Lu}\.\x20\p{Lu}\p{Ll}+$", None),
    "address": (r"[0-9]", None),
}
LENGTHS = {"email": (8, 80), "ip": (7, 24), "card": (14, 23), "phone": (10, 22), "secret": (16, 128), "iban": (15, 42), "name": (5, 40), "address": (8, 60)}

SPAN = "struct<s:int,e:int>"
VOTED = "struct<s:int,e:int,v:array<int>>"
BLOCK = 256


def valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, r"[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda x: F.length(F.regexp_replace(x, "^0+", "")) <= 3) & F.forall(F.split(m, r"\."), lambda x: F.coalesce(F.right(F.concat(F.lit("000"), x), F.lit(3)).cast("int"), F.lit(999)) <= 255)
    if kind == "card":
        n = F.length(digits)
        return n.between(14, 19) & F.when(n.between(14, 19), luhn_sum(digits) % 10 == 0).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def luhn_sum(digits: Column) -> Column:
    """From the last digit on, every other one is doubled, less 9 above 9."""
    n = F.length(digits)
    at = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    return F.aggregate(at, F.lit(0), lambda acc, i: acc + luhn(F.substr(digits, i, F.lit(1)).cast("int"), (n - i) % 2))


def luhn(d: Column, odd: Column) -> Column:
    return F.coalesce(F.when(odd == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d), F.lit(0))


def checksum97(m: Column) -> Column:
    """The number that an account code's characters make, its first four put last, modulo 97."""
    c = F.split(F.regexp_replace(m, " ", ""), "")
    turned = F.concat(F.slice(c, F.lit(5), F.greatest(F.size(c) - 4, F.lit(0))), F.slice(c, F.lit(1), F.lit(4)))
    return F.aggregate(turned, F.lit(0), lambda a, x: F.when(x.rlike("[0-9]"), (a * 10 + F.ascii(x) - 48) % 97).otherwise((a * 100 + F.ascii(x) - 55) % 97))


def folded(items: Column, step, kind: str) -> Column:
    """The non-null items that step(at, x) -> (new at, item) gives in order, ``at`` from 0: a fold of folds over blocks, so that no long array is copied for each item."""
    none = F.array().cast(f"array<{kind}>")

    def inner(at: Column, block: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            now, item = step(acc["at"], x)
            return let(item.cast(kind), lambda i: F.struct(now.cast("int").alias("at"), F.when(i.isNotNull(), F.array_append(acc["out"], i)).otherwise(acc["out"]).cast(f"array<{kind}>").alias("out")))

        return F.aggregate(block, F.struct(at.cast("int").alias("at"), none.alias("out")), one)

    def outer(acc: Column, block: Column) -> Column:
        return let(inner(acc["at"], block), lambda r: F.struct(r["at"].alias("at"), F.array_append(acc["out"], r["out"]).cast(f"array<array<{kind}>>").alias("out")))

    def whole(it: Column) -> Column:
        last = F.greatest(F.ceil(F.size(it) / F.lit(BLOCK)).cast("int") - 1, F.lit(0))
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(it, b * BLOCK + 1, F.lit(BLOCK)))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.aggregate(blocks, begin, outer, lambda acc: F.flatten(acc["out"]))

    return let(items, whole)


def located(text: Column, pattern: str, needs: str, item, kind: str) -> Column:
    """item(start, end, match, gap before) of each match that it doesn't return null for."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("g"), found.alias("m"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        s = at + F.length(x["g"])
        e = s + F.coalesce(F.length(x["m"]), F.lit(0))
        return e, F.when(x["m"].isNotNull(), item(s, e, x["m"], x["g"]))

    return F.when(F.coalesce(F.regexp_like(text, F.lit(needs)), F.lit(False)), folded(zipped, step, kind)).otherwise(F.array().cast(f"array<{kind}>"))


def sign(yes: Column, no: Column | None = None) -> Column:
    return (F.when(yes, 1) if no is None else F.when(yes, 1).when(no, -1)).otherwise(0)


def matches(m: Column, both: tuple[str, str | None]) -> Column:
    return sign(F.regexp_like(m, F.lit(both[0])), None if both[1] is None else F.regexp_like(m, F.lit(both[1])))


def votes(kind: str, m: Column, gap: Column) -> list[Column]:
    """The labelers - shape, gazetteer, context, length or checksum - and two features of the span: a digit, mixed case."""
    digits = F.length(F.regexp_replace(m, r"[^0-9]", ""))
    near = F.right(gap, F.lit(48))
    context = sign(F.regexp_like(near, F.lit(f"(?i)(?:{CUES[kind]})")), F.regexp_like(near, F.lit(f"(?i)(?:{AGAINST})")))
    low, high = LENGTHS[kind]
    size = sign(F.length(m).between(low, high), F.length(m) > 2 * high)
    if kind == "phone":
        size = sign(digits.between(10, 15), (digits < 9) | (digits > 15))
    if kind == "card":
        size = sign(digits.between(14, 19) & (luhn_sum(F.regexp_replace(m, r"[^0-9]", "")) % 10 == 0), F.lit(True))
    if kind == "iban":
        size = sign(checksum97(m) == 1, F.lit(True))
    return [matches(m, SHAPES[kind]), matches(m, LISTED[kind]), context, size, sign(digits > 0), sign(F.regexp_like(m, F.lit(r"\p{Lu}")) & F.regexp_like(m, F.lit(r"\p{Ll}")))]


def spot(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with base spans with votes (_pii_email ...), and candidates with votes (_pii_loose_email ...) that overlap no base span."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    voted = lambda kind, check: lambda s, e, m, g: F.when(check(m), F.struct(s.alias("s"), e.alias("e"), F.array(*votes(kind, m, g)).alias("v")))
    out = docs.withColumns({f"_pii_{k}": located(text, PATTERNS[k], NEEDS[k], voted(k, lambda m, k=k: valid(k, m)), VOTED) for k in BASE})
    loose = {f"_pii_loose_{k}": located(text, LOOSE[k], LOOSE_NEEDS[k], voted(k, lambda m: F.lit(True)), VOTED) for k in KINDS}
    out = out.withColumn("_pii_base", F.array_sort(F.concat(*[named(f"_pii_{k}", k) for k in BASE]))).withColumns(loose)
    apart = lambda x: ~F.exists("_pii_base", lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
    return out.withColumns({f"_pii_loose_{k}": F.when(F.size(f"_pii_loose_{k}") > 0, F.filter(f"_pii_loose_{k}", apart)).otherwise(F.col(f"_pii_loose_{k}")) for k in KINDS})


def named(column: str, kind: str, test=None) -> Column:
    spans = F.col(column) if test is None else F.filter(column, test)
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind")))


LABELERS = 4


def estimate(rows: list[tuple[str, tuple[int, ...], bool, int]], rounds: int = 60) -> dict[str, tuple[list[float], float]]:
    """EM over (kind, votes and features, is base, count), then a logistic classifier of votes and features, per kind: weights and bias.

    Labelers (the first LABELERS entries) are independent given the label, each with a table of vote by label, smoothed.  Base spans hold label 1.
    """
    out = {}
    for kind in sorted({r[0] for r in rows}):
        own = [(v, base, n) for k, v, base, n in rows if k == kind]
        width = min(LABELERS, len(own[0][0]))
        post = [1.0 if base else 1 / (1 + math.exp(-1.5 * sum(v[:width]) + 0.75)) for v, base, _ in own]
        for _ in range(rounds):
            pi = [1.0, 1.0]
            table = [[[1.0, 1.0] for _ in range(3)] for _ in range(width)]
            for (v, _, n), q in zip(own, post, strict=True):
                for y, w in ((1, n * q), (0, n * (1 - q))):
                    pi[y] += w
                    for j, x in enumerate(v[:width]):
                        table[j][x + 1][y] += w
            for j in range(width):
                for y in (0, 1):
                    total = sum(table[j][x][y] for x in range(3))
                    for x in range(3):
                        table[j][x][y] /= total
            new = []
            for v, base, _ in own:
                odds = math.log(pi[1] / pi[0]) + sum(math.log(table[j][x + 1][1] / table[j][x + 1][0]) for j, x in enumerate(v[:width]))
                new.append(1.0 if base else 1 / (1 + math.exp(-max(-30, min(30, odds)))))
            post = new
        # from a fair start: each labeler counts alike, two votes must outweigh
        w, b, total = [1.0] * width + [0.0] * (len(own[0][0]) - width), -0.75, sum(n for *_, n in own)
        start, first = list(w), b
        for _ in range(400):
            gw, gb = [0.01 * (x - y) for x, y in zip(w, start, strict=True)], 0.01 * (b - first)
            for (v, _, n), q in zip(own, post, strict=True):
                d = (1 / (1 + math.exp(-b - sum(a * x for a, x in zip(w, v, strict=True)))) - q) * n / total
                gb += d
                for j, x in enumerate(v):
                    gw[j] += d * x
            w, b = [a - g for a, g in zip(w, gw, strict=True)], b - gb
        out[kind] = (w, b)
    return out


def classifier(w: list[float], b: float):
    """The trained decision on a candidate."""

    def accept(x: Column) -> Column:
        odds = F.lit(b)
        for j, a in enumerate(w):
            odds = odds + F.lit(a) * x["v"][j]
        return odds >= 0

    return accept


def of_kind(kind: str):
    return lambda x: x["kind"] == kind


def pii_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_pii_base`` and ``_pii_spans``: arrays of (s, k, e, kind) in order of start, then kind as listed."""
    seen = spot(docs, text_col)
    # one pass for the histogram, one for the spans: nothing is written between
    ballot = lambda k, base: lambda x: F.struct(F.lit(k).alias("kind"), x["v"].alias("v"), F.lit(base).alias("base"))
    every = [F.transform(f"_pii_{k}", ballot(k, True)) for k in BASE] + [F.transform(f"_pii_loose_{k}", ballot(k, False)) for k in KINDS]
    hist = seen.select(F.explode(F.concat(*every)).alias("x")).select("x.*").groupBy("kind", "v", "base").agg(F.count("*").alias("n"))
    rows = sorted((r.kind, tuple(r.v), r.base, r.n) for r in hist.collect())
    model = estimate(rows)
    added = []
    for k in KINDS:
        if k in model:
            added.append(named(f"_pii_loose_{k}", k, classifier(*model[k])))
    out = seen.withColumn("_pii_spans", F.array_sort(F.concat("_pii_base", *added)))
    return out.drop(*[f"_pii_{k}" for k in BASE], *[f"_pii_loose_{k}" for k in KINDS])


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans, n_spans (base and added)."""
    found = pii_spans(docs.selectExpr("cast(doc_id as bigint) doc_id", "text")).select("doc_id", "_pii_base", "_pii_spans")
    counts = [F.size(F.filter("_pii_base", of_kind(k))).cast("bigint").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined("_pii_base").cast("binary"), 256).alias("base_sha256"), joined("_pii_spans").alias("spans"), F.size("_pii_spans").cast("bigint").alias("n_spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span (overlapping ones as one) replaced by its kind in brackets; null text stays null."""
    columns = docs.columns
    found = pii_spans(docs, text_col)
    text = F.col(f"`{text_col}`")

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        piece = F.concat(F.substr(text, at + 1, x["s"] - at), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.greatest(at, x["e"]), F.when(x["s"] >= at, piece)

    end = F.array_max(F.transform("_pii_spans", lambda x: x["e"]))
    whole = F.concat(F.array_join(folded(F.col("_pii_spans"), step, "string"), ""), F.substr(text, end + 1, F.length(text)))
    clean = F.when(F.size("_pii_spans") > 0, whole).otherwise(text)
    return found.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in columns])
