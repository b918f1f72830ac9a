"""Personal data: expressions propose spans, checksums confirm them, words nearby adjust their scores.

All of it runs on Spark's own functions. The patterns are the plain ones with possessive quantifiers and
look-behinds where these cannot change what is matched, so no text, however long, makes them go back over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import read_table
from lexmill.llm.spans import joined, let, luhn, matches, mod97

#: \G: after a match, a further one may begin inside of a run of its characters.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

BASE = ("email", "ip", "card", "phone")
#: Kind: score without context, words that raise it.
SCORES = {
    "email": (0.9, r"(?i)\b(?:e-?mail|mail|contact|write)"),
    "ip": (0.6, r"(?i)\b(?:ip|address|host|server|client)\b"),
    "card": (0.8, r"(?i)\b(?:card|visa|mastercard|amex|credit|payment)"),
    "phone": (0.6, r"(?i)\b(?:tel|phone|call|mobile|fax|cell)"),
    "iban": (0.8, r"(?i)\b(?:iban|bank|account|konto|compte|cuenta)"),
    "ssn": (0.3, r"(?i)\b(?:ssn|social\s+security|tax\s+id)"),
}
CONTEXT, RAISE, LEAST = 48, 0.4, 0.5
_OCTET = r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})$"


def _scored(text: Column, kind: str, spans: Column) -> Column:
    base, words = SCORES[kind]

    def one(s: Column) -> Column:
        before = F.substr(text, F.greatest(s["start"] - CONTEXT, F.lit(0)).cast("int") + 1, F.least(s["start"], F.lit(CONTEXT)).cast("int"))
        after = F.substr(text, s["end"].cast("int") + 1, F.lit(CONTEXT))
        score = F.when(F.regexp_like(before, F.lit(words)) | F.regexp_like(after, F.lit(words)), F.lit(min(1.0, base + RAISE))).otherwise(F.lit(base))
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), score.alias("score"))

    return F.transform(spans, one)


def _digits(s: Column) -> Column:
    return F.translate(s, " -().+", "")


def found(text: Column) -> dict[str, Column]:
    """The confirmed spans of a text that is not null, by kind."""
    card = F.filter(matches(text, CARD), lambda s: F.length(_digits(s["value"])).between(13, 19))
    iban = F.filter(matches(text, IBAN), lambda s: mod97(F.translate(s["value"], " ", "")))
    out = {
        "email": matches(text, EMAIL),
        "ip": F.filter(matches(text, IP), lambda s: F.forall(F.split(s["value"], r"\.", -1), lambda p: F.regexp_like(p, F.lit(_OCTET)))),
        "card": F.filter(card, lambda s: luhn(_digits(s["value"]))),
        "phone": F.filter(matches(text, PHONE), lambda s: F.length(_digits(s["value"])).between(9, 15)),
        "iban": iban,
        "ssn": matches(text, SSN),
    }
    out = {k: _scored(text, k, v) for k, v in out.items()}
    return {k: v if k in BASE else F.filter(v, lambda s: s["score"] >= LEAST) for k, v in out.items()}


def personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a column for each kind: array of (kind, start, end, value, score), in code points.

    A null text counts as empty and has no spans. No row is dropped or merged, whatever is null or repeated;
    columns of docs named as a kind are replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumn("__text", text).withColumns(found(F.col("__text"))).drop("__text")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span of text_col replaced by its kind in angle brackets; of spans that overlap, the earliest and longest.

    A null text stays null; all other columns stay as they are.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.withColumn("__text", text).withColumns({f"__{k}": v for k, v in found(F.col("__text")).items()})
    spans = F.array_sort(F.concat(*(F.transform(F.col(f"__{k}"), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), s["kind"].alias("kind"))) for k in SCORES)))
    new = let(spans, lambda v: F.when(F.size(v) == 0, F.col(text_col)).otherwise(cut(F.col("__text"), v)))
    return out.withColumn(text_col, new).select(*docs.columns)


def cut(text: Column, spans: Column) -> Column:
    """text with spans, sorted (start, minus_end, kind), replaced by <kind>."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        put = F.struct((-s["minus_end"]).alias("at"), F.concat(acc["out"], F.array(piece, F.concat(F.lit("<"), s["kind"], F.lit(">")))).alias("out"))
        return F.when(s["start"] >= acc["at"], put).otherwise(acc)

    return F.aggregate(spans, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, (acc["at"] + 1).cast("int"))))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = personal_data(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.concat(*(F.col(k) for k in BASE))
    return docs.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.concat(base, F.col("iban"), F.col("ssn"))).alias("spans"),
    )
