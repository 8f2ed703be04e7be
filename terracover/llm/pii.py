"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust the score.

Column expressions only; no Python runs on the rows. Spans are (kind, start, end) in code points, end
exclusive. Base kinds: email, ip, card (Luhn) and phone, leftmost and non-overlapping per kind, failing
matches dropped. Added kinds: iban (mod-97, at any group's end) and ssn, which needs a context word before
it, or on either side where texts are redacted.

Positions come from one pass per kind: `\\G(gap)(match)` from the end of the last match, so that gap
and match lengths add up. Lookbehinds keep a pattern from being tried again inside a run of its own
characters, and possessive groups keep Java's matcher from recursing. Folds gather their results block by
block, and stretches of a text are cut from short pieces of it, so that texts of many spans cost (but for
one reference a block of BLOCK spans) linear time.

Defined results: null and empty texts have no spans; the sha-256 of no base spans is that of the empty
string; repeated rows each appear; a null doc_id appears as it is; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracover.llm.common import fresh

# The base kinds in the contract's order, with their patterns.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# A chain of digits with single blanks or hyphens between; the chains of 12 to 19 digits only.
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
# The head of an IBAN; its groups of four follow, the last may be shorter.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9]{4} ?[A-Z0-9]{4})"
IBAN_ENDS = [rf"^[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n}}}{last}(?![A-Za-z0-9])" for n in range(7, 1, -1) for last in ("(?: ?[A-Z0-9]{1,3})", "")]
IBAN_REACH = 48
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = ("email", "ip", "card", "phone")
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN}
#: A cheap test that any text with a match of the kind passes.
HINTS = {"email": "@", "phone": "+"}
#: Score of a confirmed span, what a context word adds, and the words.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT_GAIN = 0.3
CONTEXT = {
    "email": r"mail|contact|write|schreib|écri|correo",
    "ip": r"\bip\b|address|host|server|adresse|dirección",
    "card": r"card|visa|credit|payment|karte|carte|tarjeta",
    "phone": r"phone|call|tel|fax|mobile|anruf|appel|llam",
    "iban": r"iban|bank|account|konto|compte|cuenta",
    "ssn": r"ssn|social|security|tax id",
}
#: Characters before a span that are searched for context words; added kinds below ADDED_MIN are dropped.
WINDOW = 48
ADDED_MIN = 0.6
#: Items that a fold gathers at once, and the characters of a text's pieces (as a power of two).
BLOCK = 256
PIECE_BITS = 9


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x worked out once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def _scan(items: Column, first: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """array<kind>: what step emits for each item; step(state, item) gives the next state (int) and what is emitted.

    An array that grows is copied with every item, so items go in blocks: each block's first state is found
    in a fold of its own, and then the blocks are worked off by themselves.
    """
    last = lambda v: F.greatest(F.ceil(F.size(v) / BLOCK).cast("int") - 1, F.lit(0))
    blocks = _once(items, lambda v: F.transform(F.sequence(F.lit(0), last(v)), lambda k: F.slice(v, k * BLOCK + 1, BLOCK)))

    def on(acc: Column, block: Column) -> Column:
        state = F.aggregate(block, acc["state"], lambda at, x: step(at, x)[0])
        return F.struct(state.alias("state"), F.array_append(acc["starts"], acc["state"]).alias("starts"))

    def inner(acc: Column, x: Column) -> Column:
        state, out = step(acc["state"], x)
        return F.struct(state.alias("state"), F.array_append(acc["out"], out).alias("out"))

    def worked(b: Column) -> Column:
        starts = F.aggregate(b, F.struct(first.alias("state"), _none("int").alias("starts")), on, lambda acc: acc["starts"])
        return F.flatten(F.zip_with(b, starts, lambda x, at: F.aggregate(x, F.struct(at.alias("state"), _none(kind).alias("out")), inner, lambda acc: acc["out"])))

    return _once(blocks, worked)


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << PIECE_BITS}}}"), F.lit(0))


def _stretch(pieces: Column, start: Column, n: Column) -> Column:
    """The n characters of the text from a place on, cut from the pieces that hold them."""
    first, last = F.shiftright(start, PIECE_BITS), F.shiftright(start + n, PIECE_BITS)
    return F.substr(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), start - F.shiftleft(first, PIECE_BITS) + 1, n)


def _chars(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit("."), F.lit(0))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """12 to 19 digits whose Luhn sum is a multiple of ten."""
    rev = F.reverse(_digits(x))
    each = F.transform(_chars(rev), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)))
    return F.length(rev).between(12, 19) & (F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0)


def _octets(x: Column) -> Column:
    """Every dotted part is at most 255; leading zeros do not count."""
    value = lambda p: F.coalesce(F.concat(F.lit("0"), F.regexp_replace(p, "^0+", "")).try_cast("int"), F.lit(999))
    return F.forall(F.split(x, r"\."), lambda p: value(p) <= 255)


def _mod97(x: Column) -> Column:
    """ISO 7064: the first four characters moved to the end, letters as 10 to 35, remainder 1."""
    plain = F.replace(x, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.length(plain).between(15, 34) & (F.aggregate(_chars(moved), F.lit(0), step) == 1)


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "card":
        return _luhn(m)
    if kind == "ip":
        return _octets(m)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


_MATCH = "struct<start:int,end:int,m:string,near:string>"


def _ibans(pieces: Column, heads: Column) -> Column:
    """The heads' longest spans that end at a group's end and pass mod-97, leftmost and non-overlapping.

    A word of capitals after an IBAN looks like one more group, so every group's end is tried.
    """

    def longest(s: Column) -> Column:
        ahead = _stretch(pieces, s["start"], F.lit(IBAN_REACH))
        return F.get(F.filter(_once(ahead, lambda x: F.array(*(F.regexp_extract(x, e, 0) for e in IBAN_ENDS))), _mod97), F.lit(0))

    whole = F.transform(heads, lambda s: F.struct(s["start"].alias("start"), longest(s).alias("m"), s["near"].alias("near")))
    spans = F.transform(
        F.filter(whole, lambda s: s["m"].isNotNull()), lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["m"])).alias("end"), s["m"].alias("m"), s["near"].alias("near"))
    )
    free = lambda at, s: s["start"] >= at
    return F.filter(_scan(spans, F.lit(0), lambda at, s: (F.when(free(at, s), s["end"]).otherwise(at), F.when(free(at, s), s)), _MATCH), lambda s: s.isNotNull())


def _around(pieces: Column, s: Column) -> Column:
    """The WINDOW characters before a span and those after it."""
    before = _stretch(pieces, F.greatest(s["start"] - WINDOW, F.lit(0)), F.least(s["start"], F.lit(WINDOW)))
    return F.concat(before, F.lit(" "), _stretch(pieces, s["end"], F.lit(WINDOW)))


def _found(text: Column, kind: str, around: bool) -> Column:
    """array<struct<start, ord, end, kind, score>> of the confirmed spans of one kind."""
    pattern = rf"\G((?s:.*?))({PATTERNS[kind]})"
    gaps, matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["g"])
        end = start + F.length(x["m"])
        return end, F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"), F.right(x["g"], F.lit(WINDOW)).alias("near"))

    all_ = _scan(F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("g"), m.alias("m"))), F.lit(0), step, _MATCH)

    def scored(ok: Column, pieces: Column | None) -> Column:
        near = lambda s: s["near"] if pieces is None else _around(pieces, s)
        score = lambda s: F.lit(SCORES[kind]) + F.when(F.lower(near(s)).rlike(CONTEXT[kind]), CONTEXT_GAIN).otherwise(0.0)
        return F.transform(ok, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("ord"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.least(F.lit(1.0), score(s)).alias("score")))

    def cut(matched: Column) -> Column:
        """With the text's pieces, where there is any match."""
        confirmed = lambda p: _ibans(p, matched) if kind == "iban" else F.filter(matched, lambda s: _confirmed(kind, s["m"]))
        return F.when(F.size(matched) > 0, _once(_pieces(text), lambda p: scored(confirmed(p), p if around else None))).otherwise(F.expr(_NONE))

    spans = _once(all_, cut) if around or kind == "iban" else scored(F.filter(all_, lambda s: _confirmed(kind, s["m"])), None)
    return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= ADDED_MIN)


_NONE = "cast(array() as array<struct<start:int,ord:int,end:int,kind:string,score:double>>)"


def spans(text: Column, around: bool = False) -> Column:
    """All spans of a text by start, then kind: array<struct<start, ord, end, kind, score>>.

    Context words count from the previous match of the kind on, as in the SQL twin; with `around`, anywhere
    in the WINDOW before a span or after it.
    """
    none = F.expr(_NONE)
    digit = text.rlike("[0-9]")
    parts = []
    for kind in KINDS:
        hint = text.contains(HINTS[kind]) if kind in HINTS else digit
        parts.append(F.when(hint, _found(text, kind, around)).otherwise(none))
    return F.when(digit | text.contains("@"), F.array_sort(F.concat(*parts))).otherwise(none)


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id and found, the array of spans of the whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", spans(text).alias("found"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans, n_iban, n_ssn, scores (kind:start:score)."""
    f = F.col("found")
    count = lambda kind: F.size(F.filter(f, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    scores = F.array_join(F.transform(f, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), F.format_number(s["score"], 2))), ",")
    base = F.filter(f, lambda s: s["kind"].isin(*BASE))
    return find(docs).select(
        "doc_id", *(count(k) for k in BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(f).alias("spans"), count("iban"), count("ssn"), scores.alias("scores")
    )


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; n_chars follows where it exists.

    Context words count on both sides. Overlapping spans become one mask, that of the first. Texts without a
    span stay as they are.
    """
    text, name = F.coalesce(F.col("text").cast("string"), F.lit("")), fresh(docs, "found")
    found = F.col(name)
    free = lambda at, s: s["start"] >= at
    masks = _scan(
        found, F.lit(0), lambda at, s: (F.greatest(at, s["end"]), F.when(free(at, s), F.struct(at.alias("at"), s["start"].alias("start"), s["kind"].alias("kind")))), "struct<at:int,start:int,kind:string>"
    )
    last = F.array_max(F.transform(found, lambda s: s["end"]))

    def masked(pieces: Column) -> Column:
        parts = F.transform(F.filter(masks, lambda m: m.isNotNull()), lambda m: F.concat(_stretch(pieces, m["at"], m["start"] - m["at"]), F.lit("["), F.upper(m["kind"]), F.lit("]")))
        return F.array_join(F.concat(parts, F.array(_stretch(pieces, last, F.length(text) - last))), "")

    out = docs.withColumn(name, spans(text, around=True)).withColumn("text", F.when(F.size(found) > 0, _once(_pieces(text), masked)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        changed = F.length("text").cast(dict(docs.dtypes)["n_chars"])
        out = out.withColumn("n_chars", F.when(F.size(found) > 0, changed).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
