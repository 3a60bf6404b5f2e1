"""Personal data in text, with DataFrame functions only.

Regular expressions propose spans; checksums (Luhn, mod 97) and digit counts
confirm them; context words just before a span adjust its score.  The patterns
are written so that no run of characters is scanned twice (possessive
repeats, starts only where a run starts) and no repeat recurses; an IBAN is
looked for at each start, in the at most 67 characters from there on.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.session import prepare, table, texts
from strata.operators.skew import free_name

#: Spans of the added kinds count from this score on.
LEAST_SCORE = 0.5
#: Characters before a span in which context words count.
REACH = 40
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


class Kind(NamedTuple):
    name: str
    sign: str  # a character that every match has; "" for a digit
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    context: str
    gain: float
    whole: str = ""  # what a span is, where ``pattern`` only matches its first characters


#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """As many characters as the country has, single spaces between them aside; codes of no country: as many as there are."""
    codes = {n: c.replace(" ", "|") for n, c in IBAN_LENGTHS.items()}
    known = [rf"(?:{c})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in codes.items()]
    other = rf"(?!{'|'.join(codes.values())})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}+"
    return rf"(?:{'|'.join([*known, other])})(?![A-Za-z0-9])"


IBAN = _iban()


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def mod_97(x: Column) -> Column:
    """Whether an IBAN's check digits hold: letters count as 10 to 35, the first four characters come last."""
    plain = F.regexp_replace(x, " ", "")
    moved = F.split(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))), "")
    step = lambda r, c: F.when(c.between("0", "9"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(moved, lambda c: c != ""), F.lit(0), step) == 1


#: Base kinds in the order in which they sort, then the added ones.
KINDS = (
    Kind(
        "email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda x: F.lit(True), 0.9, "mail|contact|write|correo|courriel", 0.1,
    ),
    Kind("ip", ".", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", lambda x: x.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"), 0.6, "ip|host|server|address|addr", 0.3),
    Kind(
        "card", "", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
        lambda x: F.call_function("luhn_check", _digits(x)), 0.8, "card|visa|credit|pay|karte|carte|tarjeta", 0.2,
    ),
    Kind("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: F.length(_digits(x)).between(9, 15), 0.6, "tel|phone|call|mobile|fax", 0.3),
    Kind(
        "iban", "", rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?={IBAN})[A-Z]{{2}}[0-9]{{2}}",
        mod_97, 0.9, "iban|account|bank|konto|compte|cuenta", 0.1, f"^{IBAN}",
    ),
    Kind(
        "ssn", "-", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        lambda x: F.lit(True), 0.3, "ssn|social|security|insurance", 0.5,
    ),
)
BASE = 4


def _no_spans() -> Column:
    return F.array().cast("array<struct<start:int,kind:int,end:int,score:double>>")


def kind_spans(text: Column, kind: Kind, order: int) -> Column:
    """Array of (start, kind_order, end, score) of the valid spans; code points, end exclusive.

    Where a match is only the first characters of a span, spans may start inside others.
    The text between two matches comes from splitting by the same pattern, so
    positions are running sums of lengths.
    """
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pairs = F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), matches.alias("hit"))
    empty = _no_spans()

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.char_length(pair["gap"])
        to = start + F.char_length(pair["hit"])
        # twice an IBAN's most characters, for the spaces, and one behind
        hit = F.when(pair["hit"].isNotNull(), F.regexp_extract(F.substr(text, start + 1, F.lit(69)), kind.whole, 0)) if kind.whole else pair["hit"]
        end = start + F.char_length(hit)
        context = F.right(pair["gap"], F.lit(REACH)).rlike(f"(?i)(?:{kind.context})")
        score = F.lit(kind.score) + F.when(context, F.lit(kind.gain)).otherwise(F.lit(0.0))
        keep = pair["hit"].isNotNull() & kind.valid(hit) & (F.lit(order < BASE) | (score >= LEAST_SCORE))
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end"), score.alias("score")))
        return F.struct(F.coalesce(to, acc["at"]).alias("at"), F.when(keep, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    found = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(F.contains(text, F.lit(kind.sign)), found).otherwise(empty) if kind.sign else found


def with_spans(docs: DataFrame, text: str = "text", to: str = "pii") -> DataFrame:
    """docs with an array of spans (start, kind, end, score), sorted by start, then kind."""
    parts = [kind_spans(F.col(text), k, i) for i, k in enumerate(KINDS)]
    some = F.col(text).rlike("[0-9@]")  # every kind has one or the other
    return docs.withColumn(to, F.when(some, F.sort_array(F.concat(*parts))).otherwise(_no_spans()))


def _name(order: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k.name) for k in KINDS]), order + 1)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", _name(s["kind"]), s["start"], s["end"])), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans and all spans of every document.

    A null text is empty and has no spans; repeated rows are searched each.
    """
    prepare(docs.sparkSession)
    found = with_spans(texts(docs)).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["kind"] < BASE)
    count = lambda i: F.size(F.filter("pii", lambda s: s["kind"] == i)).cast("long")
    counts = [count(i).alias(f"n_{k.name}") for i, k in enumerate(KINDS)]
    return found.select(
        "doc_id", *counts[:BASE], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"),
        *counts[BASE:], F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )


def mask(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets, and n_chars (where there is one) counted anew.

    Spans that overlap are masked as one, under the first one's kind.  Null texts stay null, repeated rows stay
    repeated, no rows give no rows, and docs' other columns stay as they are, whatever they are called.
    """
    prepare(docs.sparkSession)
    spans, at = free_name(docs, "pii"), docs.columns
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["to"]
        shown = F.concat(F.substr(text, acc["to"] + 1, s["start"] - acc["to"]), F.lit("["), F.upper(_name(s["kind"])), F.lit("]"))
        return F.struct(F.when(new, F.concat(acc["out"], F.array(shown))).otherwise(acc["out"]).alias("out"), F.greatest(acc["to"], s["end"]).alias("to"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("to"))
    masked = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["to"] + 1)))
    out = with_spans(docs, to=spans).withColumn("text", F.when(F.size(spans) > 0, masked).otherwise(text))
    if "n_chars" in at:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*at)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
