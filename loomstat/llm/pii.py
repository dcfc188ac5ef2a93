"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score.

DataFrame functions only. A pattern's matches and the pieces of text between them (two regular
expression passes, taken only by texts that pass a cheap test) give all positions by running
sums of lengths, in code points. Patterns are written so that a scan stays linear on long runs
of like characters: possessive where that changes no match, and starting only where a run
starts or the last match ended. Running sums go by stretches, and what lies around spans or
between them is taken from the text's blocks, so that the time of a text grows with its length
and its spans alone.

Kinds, in order. Base kinds, which always stay: ``email``; ``ip`` (parts at most 255); ``card``
(13 to 19 digits, Luhn); ``phone`` (9 to 15 digits). Further kinds, which stay with a score of at
least ``THRESHOLD``: ``iban`` (mod-97 confirms), ``ssn`` and ``secret`` (long hexadecimal strings),
both of which need a context word nearby.

Edge cases: a null text counts as empty and has no spans; repeated rows are searched each; a
null doc_id stays null; an empty table gives no rows; other columns, whatever their names, are
not carried by ``query`` and are kept by ``found`` and ``redacted``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, let, table

#: Code points on each side of a span in which context words count.
NEAR = 48
#: Score from which a span of a further kind stays.
THRESHOLD = 0.6
#: What a context word nearby adds.
CONTEXT = 0.4

#: Places of a running fold that are gathered in one array before it joins the others; code points of a block of text.
STRETCH, BLOCK = 128, 256

_SPAN = "array<struct<start:int,end:int,match:string>>"


@dataclass(frozen=True)
class Kind:
    """``gate``: holds for every text with a match. ``valid``: what a match must fulfil. ``prior``: score without context."""

    name: str
    pattern: str
    gate: Callable[[Column], Column]
    valid: Callable[[Column], Column] = lambda m: F.lit(True)
    prior: float = 0.6
    words: str = ""


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _number_of_digits(match: Column, least: int, most: int) -> Column:
    return F.length(_digits(match)).between(least, most)


def luhn(match: Column) -> Column:
    """Whether the digits pass Luhn's check."""

    def checked(digits: Column) -> Column:
        at = F.sequence(F.lit(1), F.length(digits))
        value = lambda k: F.substring(digits, k, F.lit(1)).cast("int")
        doubled = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
        one = lambda k: F.when(k % 2 == 0, doubled(value(k))).otherwise(value(k))
        return F.aggregate(at, F.lit(0), lambda total, k: total + one(k)) % 10 == 0

    return let(F.reverse(_digits(match)), checked)


def mod97(match: Column) -> Column:
    """Whether an account number's check digits hold: its first four characters moved to its end, letters from A = 10, it is 1 modulo 97."""

    def checked(signs: Column) -> Column:
        moved = F.concat(F.substring(signs, F.lit(5), F.length(signs)), F.substring(signs, 1, 4))

        def step(rest: Column, sign: Column) -> Column:
            letter = F.ascii(sign) - 55
            return F.when(sign.between("A", "Z"), (rest * 100 + letter) % 97).otherwise((rest * 10 + F.ascii(sign) - 48) % 97)

        return F.aggregate(F.split(moved, "(?!^)(?!$)"), F.lit(0), step) == 1

    return let(F.regexp_replace(match, "[^A-Z0-9]", ""), checked)


_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_NAME = r"[A-Za-z0-9._%+-]"
#: Signs of an account number, by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_SIGNS_END = "(?![A-Za-z0-9])"
_KNOWN_IBAN = "(?:" + "|".join(rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items()) + ")" + _SIGNS_END
#: Of other countries, as many words as fit, but none with which a known one starts.
_OTHER_IBAN = rf"[A-Z]{{2}}[0-9]{{2}}(?:(?:\x20(?!{_KNOWN_IBAN}))?[A-Z0-9]){{11,30}}{_SIGNS_END}"

BASE = (
    Kind("email", rf"(?:\G|(?<!{_NAME})){_NAME}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@")), words="mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]")), lambda m: F.rlike(m, F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")), words=r"\bip\b|address|host|server"),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", lambda t: F.rlike(t, F.lit(r"(?:[0-9][\x20-]?){12}[0-9]")), lambda m: _number_of_digits(m, 13, 19) & luhn(m), words="card|visa|credit|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")), lambda m: _number_of_digits(m, 9, 15), words="phone|call|tel|mobile"),
)
FURTHER = (
    Kind("iban", rf"(?<![A-Za-z0-9])(?:{_KNOWN_IBAN}|{_OTHER_IBAN})", lambda t: F.rlike(t, F.lit("[A-Z]{2}[0-9]{2}")), mod97, words="iban|account|konto|compte|cuenta"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda t: F.rlike(t, F.lit("[0-9]-[0-9]{2}-[0-9]")), lambda m: ~F.rlike(m, F.lit("^(?:000|666|9)|-00-|-0000$")), 0.3, r"\bssn\b|social|security|taxpayer"),
    Kind("secret", r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,128}+(?![A-Za-z0-9])", lambda t: F.rlike(t, F.lit("[0-9A-Fa-f]{32}")), lambda m: F.rlike(m, F.lit("[0-9]")), 0.3, "token|secret|api|key|passw|bearer"),
)
KINDS = BASE + FURTHER


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The fold by ``step``, from 0, of an array of integers up to each place. Stretches keep the arrays that grow short."""

    def appended(seen: Column, last: Column, more: Column) -> Column:
        return F.struct(last.alias("last"), F.concat(seen["out"], F.array(more)).alias("out"))

    def stretch(part: Column, before: Column) -> Column:
        begun = F.struct(before.alias("last"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, begun, lambda seen, x: let(step(seen["last"], x), lambda v: appended(seen, v, v)))

    def stretches(values: Column) -> Column:
        last = F.greatest(F.floor((F.size(values) - 1) / STRETCH), F.lit(0)).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * STRETCH + 1, STRETCH))
        begun = F.struct(F.lit(0).alias("last"), F.array().cast("array<array<int>>").alias("out"))
        folded = F.aggregate(parts, begun, lambda seen, part: let(stretch(part, seen["last"]), lambda s: appended(seen, s["last"], s["out"])))
        return F.flatten(folded["out"])

    return let(values, stretches)


def _piece(blocks: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` up to ``end``, from its blocks."""
    first = F.floor(start / BLOCK).cast("int")
    n = F.floor((end + BLOCK - 1) / BLOCK).cast("int") - first
    return F.substring(F.array_join(F.slice(blocks, first + 1, F.greatest(n, F.lit(0))), ""), start - first * BLOCK + 1, F.greatest(end - start, F.lit(0)))


def _matches(text: Column, kind: Kind) -> Column:
    """Spans of the kind's confirmed matches, in order."""
    none = F.array().cast(_SPAN)
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), 0)
    pieces = F.split(text, kind.pattern, -1)
    # the last piece follows the last match
    pairs = F.filter(F.arrays_zip(pieces.alias("before"), matches.alias("match")), lambda p: p["match"].isNotNull())
    zipped = F.transform(pairs, lambda p: F.struct((F.length(p["before"]) + F.length(p["match"])).alias("step"), p["match"].alias("match")))

    def spans(zipped: Column) -> Column:
        def placed(ends: Column) -> Column:
            span = lambda p, i: F.struct((F.get(ends, i) - F.length(p["match"])).alias("start"), F.get(ends, i).alias("end"), p["match"].alias("match"))
            return F.filter(F.transform(zipped, span), lambda s: kind.valid(s["match"]))

        return let(running(F.transform(zipped, lambda p: p["step"]), lambda total, n: total + n), placed)

    return F.when(kind.gate(text), let(zipped, spans)).otherwise(none)


def _scored(blocks: Column, kind: Kind, spans: Column) -> Column:
    """The kind's spans as (kind, start, end, score)."""

    def score(s: Column) -> Column:
        around = F.concat_ws(" ", _piece(blocks, F.greatest(s["start"] - NEAR, F.lit(0)), s["start"]), _piece(blocks, s["end"], s["end"] + NEAR))
        return F.when(F.rlike(F.lower(around), F.lit(kind.words)), kind.prior + CONTEXT).otherwise(kind.prior)

    return F.transform(
        spans, lambda s: F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score(s).alias("score"))
    )


def searched(text: Column) -> Column:
    """base and further, a text's spans by kind, then start, and blocks (none where no pattern matches), in one struct.

    All is bound inside one expression, so that no filter on a result computes a part of it anew for each span.
    """

    def of_matches(matches: Column) -> Column:
        some = sum((F.size(matches[k.name]) for k in KINDS), F.lit(0)) > 0
        blocks = F.when(some, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), 0)).otherwise(F.array().cast("array<string>"))
        return let(blocks, lambda b: of_blocks(matches, b))

    def of_blocks(matches: Column, blocks: Column) -> Column:
        scored = lambda kinds: F.concat(*(_scored(blocks, k, matches[k.name]) for k in kinds))
        sure = F.filter(scored(FURTHER), lambda s: s["score"] >= THRESHOLD)
        return F.struct(scored(BASE).alias("base"), sure.alias("further"), blocks.alias("blocks"))

    return let(F.struct(*(_matches(text, k).alias(k.name) for k in KINDS)), of_matches)


def found(docs: DataFrame, base: str = "base_spans", further: str = "further_spans") -> DataFrame:
    """``docs`` with two columns of spans, array<struct<kind, start, end, score>>, by kind, then start."""
    told = fresh(docs, "told")
    marked = docs.withColumn(told, searched(F.coalesce(docs["text"], F.lit(""))))
    return marked.withColumns({base: F.col(told)["base"], further: F.col(told)["further"]}).drop(told)


def _rebuilt(text: Column, told: Column) -> Column:
    """The text with its spans, as ``searched`` told them, replaced by their kinds in brackets."""

    def of_spans(spans: Column) -> Column:
        reach = running(F.transform(spans, lambda s: s["end"]), lambda far, end: F.greatest(far, end))
        return let(reach, lambda r: joined(spans, r))

    def joined(spans: Column, reach: Column) -> Column:  # reach: how far the spans up to each one go
        def tagged(s: Column, i: Column) -> Column:
            at = F.coalesce(F.get(reach, i - 1), F.lit(0))
            tag = F.concat(_piece(told["blocks"], at, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
            return F.when(s["start"] >= at, tag).otherwise("")  # a span that overlaps lies in its tag

        return F.concat(F.array_join(F.transform(spans, tagged), ""), _piece(told["blocks"], F.element_at(reach, -1), F.length(text)))

    spans = F.transform(F.concat(told["base"], told["further"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.when(F.size(told["base"]) + F.size(told["further"]) > 0, let(F.array_sort(spans), of_spans)).otherwise(text)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in brackets; n_chars, if there, follows where one was."""
    text = docs["text"]
    clean = let(searched(F.coalesce(text, F.lit(""))), lambda told: _rebuilt(text, told))
    if "n_chars" not in docs.columns:
        return docs.withColumn("text", clean)
    new = fresh(docs, "new_text")
    marked = docs.withColumn(new, clean)
    n_chars = F.when(F.col(new) != F.col("text"), F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return marked.withColumn("n_chars", n_chars).withColumn("text", F.col(new)).select(*docs.columns)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest, spans and their scores over all documents."""
    spans = found(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda name: F.size(F.filter("base_spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    return spans.select(
        "doc_id",
        *(count(k.name) for k in BASE),
        F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"),
        _joined(F.concat("base_spans", "further_spans")).alias("spans"),
        F.transform(F.concat("base_spans", "further_spans"), lambda s: s["score"]).alias("scores"),
    )
