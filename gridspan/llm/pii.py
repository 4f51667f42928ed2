"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust the score.

Each pattern runs once over a text. Where it matches, the text is split at the matches, and the running
lengths of the pieces give the spans in code points. Context and redaction cut from the text as UTF-32, where a
code point has a place of its own, so that cost grows with the spans and not with their square. No shuffle; no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A private-use character that parts matches from the rest; where a text has it, another one of the same length stands in.
MARK, STAND_IN = "\ue000", "\ue001"
#: Code points on either side of a span that are searched for context words.
NEAR = 48


@dataclass(frozen=True)
class Kind:
    """A pattern, and what must be there for it to be worth running.

    Loops are possessive, so no text is too long for them. A match that begins with a run of characters begins at the run's start, or
    where the match before ended inside it: from any other character of the run the search would come to the same end and fail the
    same way, so each run is read a fixed number of times and cost is linear in the text.
    """

    name: str
    pattern: str
    needs: str
    base_score: float
    context: str


#: Characters of an account number, by its country's registered format.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """Registered countries at their own length, so that no word behind is taken in; other codes, and other lengths, as long as groups go on."""

    def rest(n: int) -> str:
        return rf"(?:\x20?[A-Z0-9]{{4}}){{{n // 4}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")

    own = "|".join(rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}{rest(n - 4)}" for n, codes in IBAN_COUNTRIES.items())
    return rf"\b(?=[A-Z]{{2}}[0-9]{{2}})(?:(?:{own})\b|[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?\b)"


#: Base patterns first, in the order in which results list them.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, "mail|contact|write|kontakt|correo|courriel"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, "ip|address|server|host|login|adresse"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.4, "card|visa|credit|master|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, "phone|call|tel|mobile|fax|ruf|appel"),
    Kind("iban", _iban_pattern(), "", 0.4, "iban|bank|account|konto|compte|cuenta"),
)
BASE = ("email", "ip", "card", "phone")
CHECKED, CONTEXT = 0.3, 0.15
SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits is a multiple of ten."""
    ones = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.try_cast("int"))))
    return F.aggregate(ones, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an account number, country and check digits moved to its end and letters read as 10 to 35, leaves 1 when divided by 97."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97) == 1


def accepted(kind: str, found: Column) -> Column:
    if kind == "ip":
        # Of each part without leading zeros at most three digits are left, 255 at most.
        return F.forall(F.split(found, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))), 1, 4).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits_of(found)).between(13, 19) & luhn(digits_of(found))
    if kind == "phone":
        return F.length(digits_of(found)).between(9, 15)
    if kind == "iban":
        return mod97(found)
    return F.lit(True)


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once: a lambda's variable is bound, where a repeated column would be computed anew for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Elements that one fold appends to; a longer array is folded by blocks, since each append copies the array so far.
BLOCK = 256


def _fold(xs: Column, first: Column, merge) -> Column:
    """first, then first merged with each of the elements in turn."""
    return F.aggregate(xs, F.array(first), lambda done, x: F.concat(done, F.array(merge(F.element_at(done, -1), x))))


def running(xs: Column, zero: Column, merge) -> Column:
    """For each element of an array, ``zero`` merged with all elements before it. ``merge`` must be associative."""

    def over(xs):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda k: F.slice(xs, k * BLOCK + 1, F.lit(BLOCK)))
        return let(blocks, lambda blocks: let(_fold(F.transform(blocks, lambda b: F.aggregate(b, zero, merge)), zero, merge), lambda before: F.flatten(F.transform(blocks, lambda b, k: F.slice(_fold(b, F.get(before, k), merge), 1, F.size(b))))))

    return F.when(F.size(xs) == 0, F.slice(xs, 1, 0)).otherwise(let(xs, over))


def _cut(utf32: Column, start: Column, n: Column) -> Column:
    """n code points from place ``start``."""
    return F.decode(F.substring(utf32, (4 * start + 1).cast("int"), (4 * n).cast("int")), "UTF-32")


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def spans_of(clean: Column, kind: Kind) -> Column:
    """Accepted spans of one kind in a text that has no MARK."""
    parts = F.split(F.regexp_replace(clean, f"({kind.pattern})", f"{MARK}$1{MARK}"), MARK)
    sure = kind.base_score + (CHECKED if kind.name in ("card", "iban") else 0)

    def judge(parts):
        starts = running(F.transform(parts, lambda p: F.length(p).cast("bigint")), _zero(), lambda a, n: a + n)
        placed = F.zip_with(parts, starts, lambda p, at: F.struct(p.alias("text"), at.alias("start"), (at + F.length(p)).cast("bigint").alias("end")))
        return F.filter(F.filter(placed, lambda _, i: i % 2 == 1), lambda s: accepted(kind.name, s["text"]))

    def score(kept):
        def of(wide):
            near = lambda s: F.lower(F.concat(_cut(wide, F.greatest(s["start"] - NEAR, _zero()), F.least(s["start"], F.lit(NEAR))), F.lit(" "), _cut(wide, s["end"], F.lit(NEAR))))
            return F.transform(kept, lambda s: F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), (F.lit(sure) + F.when(near(s).rlike(kind.context), CONTEXT).otherwise(0.0)).alias("score")))

        return F.when(F.size(kept) == 0, F.array().cast(SPAN)).otherwise(let(F.encode(clean, "UTF-32"), of))

    return let(let(parts, judge), score)


def _without(text: Column, kind: Kind) -> Column:
    """True where the pattern can't match; costs a fraction of the pattern."""
    return ~F.contains(text, F.lit(kind.needs)) if kind.needs else ~text.rlike(kind.pattern)


def personal_spans(text: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """Spans of all kinds in a text; null has none."""
    text = F.coalesce(text, F.lit(""))
    clean = F.translate(text, MARK, STAND_IN)
    none = F.array().cast(SPAN)
    return F.concat(*[F.when(_without(text, k), none).otherwise(spans_of(clean, k)).cast(SPAN) for k in kinds])


def find_personal_data(docs: DataFrame, *, text_col: str = "text", spans_col: str = "pii_spans", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` plus an array of struct(kind, start, end, score): by kind as listed, then start; code points from 0, end exclusive.

    A column of the same name as ``spans_col`` is replaced; others stay, whatever their names. Null and empty texts have no
    spans. Repeated rows get the same spans each; an empty table stays empty. Spans of different kinds may overlap. A text may
    be of any length that Spark holds: cost is linear in it, and nearly so in its spans.
    """
    return docs.withColumn(spans_col, personal_spans(F.col(text_col), kinds))


def _rebuilt(text: Column, spans: Column) -> Column:
    """The text with spans as their kind in angle brackets; spans that overlap are one, of the kind that begins first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def of(ordered):
        done = running(F.transform(ordered, lambda s: s["end"]), _zero(), lambda a, x: F.greatest(a, x))
        # ``done``: where all spans before end. A span from there on begins a new piece, after the text in between.
        heads = F.filter(F.zip_with(ordered, done, lambda s, done: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), done.alias("done"))), lambda s: s["start"] >= s["done"])
        last = F.array_max(F.transform(ordered, lambda s: s["end"]))
        return let(
            F.encode(text, "UTF-32"),
            lambda wide: F.concat(F.array_join(F.transform(heads, lambda s: F.concat(_cut(wide, s["done"], s["start"] - s["done"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))), ""), _cut(wide, last, F.floor(F.octet_length(wide) / 4) - last)),
        )

    return let(ordered, of)


def redact(docs: DataFrame, *, text_col: str = "text", least: float = 0.5, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with each span of at least ``least`` replaced by its kind in angle brackets; all other characters and columns stay.

    Null texts stay null and empty ones empty. Repeated rows are redacted alike; an empty table stays empty. Spans that overlap
    become one, of the kind that begins first. Very long texts and texts of very many spans take time in proportion.
    """
    text = F.col(text_col)
    spans = F.filter(personal_spans(text, kinds), lambda s: s["score"] >= least)
    return docs.withColumn(text_col, let(spans, lambda spans: F.when(F.size(spans) == 0, text).otherwise(_rebuilt(text, spans))))


def span_list(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end, comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


