"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Built-in functions only. The positions come from the texts between the matches: ``split`` and ``regexp_extract_all`` with
one pattern give gaps and matches, whose lengths are added up to the start of each match in as many passes as the number of
matches has binary digits, so nothing grows match by match. No group of rows is formed and nothing is shuffled. All patterns take possessive loops, and a run of characters is tried from its first one only (or
from the end of the match before, ``\\G``), so that long runs cost linear time and no recursion; the matches are those of
the plain patterns.

Fixed kinds (they stay whatever their score): email; ip, four parts of at most 255; card, 14 to 19 digits that pass
Luhn; phone, a plus sign and 10 to 15 digits. Further kinds, kept from a score of ``LEAST`` on: iban, confirmed by its
mod-97 check; ssn, three groups of 3, 2 and 4 digits; and secret, a key or token of 20 to 200 characters with letters and
digits, confirmed by the entropy of its characters. The last two need a hint in the words before them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.basics import let

# fixed values: kinds in the order of ties
KINDS = ["email", "ip", "card", "phone", "iban", "ssn", "secret"]
BASE = KINDS[:4]
# fixed values: the patterns of the kinds
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}+",
}
# fixed values: texts without a match of this cheaper pattern aren't searched for the kind
GUARDS = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9](?:[ -]?[0-9]){13}",
    "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}",
    "ssn": r"[0-9]-[0-9]{2}-[0-9]",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20}",
}
# fixed values: score of a confirmed match, and words that raise it when they stand within NEAR characters before it
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "secret": 0.4}
HINTS = {
    "email": r"mail|contact|write",
    "ip": r"\bip\b|address|server|host",
    "card": r"card|visa|credit|payment|karte|carte|tarjeta",
    "phone": r"phone|call|tel\b|mobile|fax|anruf",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "ssn": r"ssn|social|security|\btax",
    "secret": r"token|secret|passw|(?:api|access|private)[ _-]?key|bearer|credential",
}
NEAR, RAISE, LEAST = 40, 0.2, 0.5
#: A secret's longest length, and the least entropy of its characters in bits.
LONGEST, BITS = 200, 3.0
SPAN = "struct<start:int,rank:int,kind:string,end:int,score:double>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, its digits summed; the whole sum divides by ten."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: _luhn_digit(d.cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def _luhn_digit(d: Column, i: Column) -> Column:
    return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))


def _mod97(match: Column) -> Column:
    """The first four characters moved to the end, letters as 10 to 35: the number leaves 1 when divided by 97."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))), "")

    def step(rest: Column, c: Column) -> Column:
        value = F.ascii(c)
        return F.when(value >= 65, (rest * 100 + value - 55) % 97).otherwise((rest * 10 + value - 48) % 97)

    return F.aggregate(turned, F.lit(0), step) == 1


def _entropy(match: Column) -> Column:
    """Bits per character: the share of each different character times the logarithm of it."""

    def add(bits: Column, c: Column) -> Column:
        share = (F.length(match) - F.length(F.replace(match, c, F.lit("")))) / F.length(match)
        return bits - share * F.log2(share)

    return F.aggregate(F.filter(F.array_distinct(F.split(match, "")), lambda c: c != ""), F.lit(0.0), add)


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(256)) <= 255))
    if kind == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    if kind == "iban":
        return _mod97(match)
    if kind == "secret":
        mixed = match.rlike("[0-9]") & match.rlike("[A-Za-z]")
        return F.when((F.length(match) <= LONGEST) & mixed, _entropy(match) >= BITS).otherwise(False)
    return F.lit(True)


def _score(kind: str, gap: Column) -> Column:
    near = F.lower(F.substring(gap, -NEAR, NEAR))
    return F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(near.rlike(HINTS[kind]), RAISE).otherwise(0.0))


#: Passes of a running total: enough for any array of Spark.
PASSES = 31


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """The values joined with all earlier ones, by doubling: pass k joins what stands 2^k places apart."""

    def doubled(acc: Column, k: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1), k)
        moved = F.transform(acc, lambda x, i: F.coalesce(join(x, F.get(acc, i - step)), x))
        return F.when(F.size(acc) > step, moved).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), F.lit(PASSES - 1)), values, doubled)


def spans_of(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind, in order; positions in code points, the end exclusive."""
    pairs = F.arrays_zip(
        F.split(text, PATTERNS[kind], -1).alias("gap"), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("hit")
    )

    def judged(p: Column, ends: Column) -> Column:
        def made(pair: Column, i: Column) -> Column:
            score = _score(kind, pair["gap"])
            good = F.coalesce(_valid(kind, pair["hit"]), F.lit(False))
            if kind not in BASE:
                good = good & (score >= LEAST)
            end = F.get(ends, i)
            span = F.struct((end - F.length(pair["hit"])).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), score.alias("score"))
            return F.when(pair["hit"].isNotNull(), F.when(good, span))

        return F.array_compact(F.transform(p, made)).cast(f"array<{SPAN}>")

    lengths = lambda p: F.transform(p, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0)))
    found = let(pairs, lambda p: let(running(lengths(p), lambda x, y: x + y), lambda ends: judged(p, ends)))
    return F.when(text.rlike(GUARDS[kind]), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, name: str = "pii") -> DataFrame:
    """``docs`` with ``pii`` (or another name): an array of (start, rank, kind, end, score) of all spans, by start, then kind.

    Whole texts are searched; null text counts as empty and has no spans. Every row is judged by itself, so repeated rows
    and null ids need no rule; a column of that name is replaced, all others pass through. Kinds may overlap each other;
    matches of one kind don't.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.concat(*[spans_of(text, kind) for kind in KINDS])
    return docs.withColumn(name, F.array_sort(found))


def redact(docs: DataFrame, mask: str = "[removed]") -> DataFrame:
    """``docs`` without the found spans: each stretch of overlapping spans is replaced by ``mask``. Null text stays null."""
    spans, wide = F.col("_pii"), F.encode(F.col("text"), "UTF-32")  # four bytes a character: a place needs no walk through the text

    def clean(raw: Column, ends: Column) -> Column:
        part = lambda begin, end: F.decode(raw.substr((4 * begin + 1).cast("int"), (4 * (end - begin)).cast("int")), "UTF-32")
        before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        pieces = F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), F.concat(part(before(i), s["start"]), F.lit(mask))).otherwise(""))
        return F.concat(F.array_join(pieces, ""), part(F.element_at(ends, -1), F.length(F.col("text"))))

    ends = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    found = find_personal_data(docs, "_pii")
    text = let(wide, lambda raw: let(ends, lambda e: clean(raw, e)))
    return found.withColumn("text", F.when(F.col("text").isNull() | (F.size("_pii") == 0), F.col("text")).otherwise(text)).select(
        *docs.columns
    )
