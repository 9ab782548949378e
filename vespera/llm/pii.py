"""Personal data and secrets in text, with DataFrame functions only.

Regular expressions propose spans, checks confirm them (Luhn for cards, mod 97 for IBANs, octets for IP
addresses, digit counts for phones, a mix of many characters for secrets), and whole context words on
either side raise a span's score. Spans of the kinds in LEAST count only from that score on: a long
string after = or : is a secret if a word nearby says so. Offsets count code points; the end is
exclusive. Each pattern gives its leftmost matches that don't overlap; a match that its check refuses
is dropped and not tried again.

The patterns are possessive, and look for a start only where a run of their characters begins or the last
match ended, so the work grows with the text's length whatever it holds. That changes no match: inside a
run, a later start fails wherever the run's first one does.

Null texts are read as empty. Rows are independent, so repeated rows get equal results. Input columns that
clash with the operator's are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vespera.llm.common import unused, without

#: Encloses matches while they are located; its own occurrences in a text are read as STAND_IN, which no pattern has either.
MARK, STAND_IN = "\x01", "\x02"
#: kind -> pattern, text that must occur (contains) or pattern that must match for the kind to be looked for, context words.
PATTERNS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "e-?mail|mail|contact|write|kontakt|correo|courriel"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", "ip|hosts?|servers?|address|login|adresse"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None, "cards?|visa|credit|payment|karte|tarjeta|carte"),
    "phone": (r"\+[0-9][\x20().0-9-]++(?<=[0-9])|\+[0-9][\x20().0-9-]+[0-9]", "+", "phone|telephone|call|tel|mobile|fax|telefon|teléfono|téléphone"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", None, "iban|account|bank|konto|cuenta|compte"),
    "secret": (r"(?<=[=:][\x20\"']{0,3})[A-Za-z0-9+/_-]{20,}+(?![A-Za-z0-9=])", None, "token|secret|password|passwd|credentials?|(?:api|access|private|auth)[_ -]?key|key|passwort|contraseña|schlüssel"),
}
KINDS = tuple(PATTERNS)
BASE = KINDS[:4]
COLUMNS = ("pii",)
#: Score of a span by how firmly its check confirms it, and what a context word within NEAR code points on either side adds.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.85, "phone": 0.7, "iban": 0.95, "secret": 0.5}
CONTEXT_BONUS, NEAR = 0.1, 40
#: Least score of spans of the kinds that are not base kinds.
LEAST = {"iban": 0.95, "secret": 0.6}
#: Segments are located in groups of this size: work stays in proportion to their number times this.
GROUP = 1024


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    value = lambda i: F.ascii(F.substr(digits, n - i, F.lit(1))) - 48  # noqa: E731  i places from the right
    double = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 1, double(value(i))).otherwise(value(i)))
    return total % 10 == 0


def _mod97(s: Column) -> Column:
    plain = F.replace(s, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    step = lambda acc, c: F.when(c >= 65, (acc * 100 + (c - 55)) % 97).otherwise((acc * 10 + (c - 48)) % 97)
    rest = F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), lambda acc, i: step(acc, F.ascii(F.substr(turned, i, F.lit(1)))))
    return F.length(plain).between(15, 34) & (rest == 1)


def _confirmed(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda part: F.length(F.ltrim(part, F.lit("0"))) <= 3) & F.forall(
            F.split(s, r"\."), lambda part: F.coalesce(F.substr(F.ltrim(part, F.lit("0")), F.lit(1), F.lit(4)).try_cast("int"), F.lit(0)) <= 255
        )
    if kind == "card":
        return F.length(_digits(s)).between(16, 19) & _luhn(_digits(s))
    if kind == "phone":
        return F.length(_digits(s)).between(8, 15)
    if kind == "iban":
        return _mod97(s)
    if kind == "secret":
        return s.rlike("[0-9]") & s.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(s, ""))) >= 10)
    return F.lit(True)


def _wanted(kind: str, t: Column) -> Column:
    if kind == "card":
        return t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")
    if kind == "iban":
        return t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}")
    if kind == "secret":
        return t.rlike(r"[=:][\x20\"']{0,3}[A-Za-z0-9+/_-]{20}")
    return t.contains(PATTERNS[kind][1])


def _starts(lengths: Column) -> Column:
    """Where each of some consecutive segments begins: sums over groups first, then inside each."""
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / GROUP).cast("int")), lambda g: F.slice(lengths, g * GROUP + 1, GROUP))
    total = lambda part: F.aggregate(part, F.lit(0), lambda acc, n: acc + n)
    run = lambda values, first: F.aggregate(values, F.array(first), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
    placed = F.zip_with(groups, run(F.transform(groups, total), F.lit(0)), lambda part, base: F.struct(part.alias("part"), base.alias("base")))
    placed = F.filter(placed, lambda z: z["part"].isNotNull())  # the sums end with the whole length, which begins nothing
    return F.flatten(F.transform(placed, lambda z: F.slice(run(z["part"], z["base"]), 1, F.size(z["part"]))))


def _spans(kind: str, cut: Column, starts: Column) -> Column:
    """array of struct(kind, start, end, score) of a kind's confirmed matches, which are every other segment of cut.

    Context is looked for in the NEAR code points before and after a match, which may reach over the matches next to it.
    """
    piece = lambda i: F.coalesce(F.get(cut, i), F.lit(""))
    odd = F.filter(F.sequence(F.lit(0), F.size(cut) - 1), lambda i: (i % 2 == 1) & _confirmed(kind, piece(i)))
    before = lambda i: F.right(F.concat(F.right(piece(i - 3), F.lit(NEAR)), F.right(piece(i - 2), F.lit(NEAR)), F.right(piece(i - 1), F.lit(NEAR))), F.lit(NEAR))
    after = lambda i: F.left(F.concat(F.left(piece(i + 1), F.lit(NEAR)), F.left(piece(i + 2), F.lit(NEAR)), F.left(piece(i + 3), F.lit(NEAR))), F.lit(NEAR))
    words = rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{PATTERNS[kind][2]})(?![\p{{L}}\p{{N}}])"
    near = lambda i: F.concat(before(i), F.lit("\n"), after(i)).rlike(words)
    score = lambda i: F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(near(i), CONTEXT_BONUS).otherwise(0.0))
    at = lambda i: F.get(starts, i).cast("long")
    spans = F.transform(odd, lambda i: F.struct(F.lit(kind).alias("kind"), at(i).alias("start"), (at(i) + F.length(piece(i))).alias("end"), score(i).alias("score")))
    if kind in LEAST:
        spans = F.filter(spans, lambda s: s["score"] >= LEAST[kind])
    return F.coalesce(spans, _none())


def find_pii(docs: DataFrame, text: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """docs with pii: array of struct(kind, start, end, score) by kind as listed, then start.

    Each step is a projection of its own, so that a text is cut once for each kind that it may hold.
    """
    out = without(docs, COLUMNS)
    names = out.columns
    t = unused(out, "pii_text")
    at = {(what, k): unused(out, f"pii_{what}_{k}") for what in ("cut", "len", "at") for k in kinds}
    out = out.withColumn(t, F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(MARK), F.lit(STAND_IN)))
    cut = lambda k: F.split(F.regexp_replace(t, PATTERNS[k][0], f"{MARK}$0{MARK}"), MARK)
    out = out.withColumns({at["cut", k]: F.when(_wanted(k, F.col(t)), cut(k)) for k in kinds})
    out = out.withColumns({at["len", k]: F.when(F.size(at["cut", k]) > 1, F.transform(at["cut", k], F.length)) for k in kinds})
    out = out.withColumns({at["at", k]: F.when(F.col(at["len", k]).isNotNull(), _starts(F.col(at["len", k]))) for k in kinds})
    spans = [F.when(F.col(at["at", k]).isNotNull(), _spans(k, F.col(at["cut", k]), F.col(at["at", k]))).otherwise(_none()) for k in kinds]
    return out.select(*names, F.concat(*spans).alias("pii"))


def _none() -> Column:
    return F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def redact(docs: DataFrame, text: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """docs with every confirmed span of text replaced by its kind in brackets; where spans overlap, the earlier and longer one names all."""
    out = find_pii(docs, text, kinds)
    order = F.array_sort("pii", lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise((b["end"] - a["end"]).cast("int")))
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))
    step = lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
        F.concat(acc["done"], F.substr(F.col(text), (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int")), F.when(s["start"] >= acc["at"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise("")).alias("done"),
        s["end"].alias("at")))
    done = F.aggregate(order, start, step, lambda acc: F.concat(acc["done"], F.substr(F.col(text), (acc["at"] + 1).cast("int"))))
    return out.withColumn(text, F.when(F.col(text).isNull() | (F.size("pii") == 0), F.col(text)).otherwise(done)).drop("pii")
