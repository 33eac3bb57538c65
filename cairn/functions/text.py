"""Text, name and month helpers."""

from __future__ import annotations

import difflib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of personal data with the marks that stand for a value that has one, in the order in which they are tried; and the mark of any other value.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
CARD = r"\b(?:\d[ -]*){13,19}\b"
PHONE = r"(?:\+?\d[\d\s().-]{7,}\d)"
MARKS = ((EMAIL, "[REDACTED_EMAIL]"), (CARD, "[REDACTED_CARD_NUMBER]"), (PHONE, "[REDACTED_PHONE]"))
MARK = "[REDACTED]"
# Endings that a key's name may have, and the similarity of names that differ in them alone.
KEY_ENDINGS, ALIKE = ("id", "key", "code"), 0.85
# Formats of dates, and what a text value that looks like a date begins with.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss")
DATE_LIKE = r"^\d{4}-\d{2}-\d{2}(?:[Tt ].*)?$"
#: Characters of a label, and of a category beyond which it is named by a digest.
LABEL = 256


def trim(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def normal_question(c: Column) -> Column:
    """Lower case, everything but a-z and 0-9 as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def masked(c: Column) -> Column:
    """The mark of the first kind of personal data that the value holds, of any value, or the empty text."""
    out = F.when(c.isNull() | (c == ""), c).otherwise(MARK)
    for pattern, mark in reversed(MARKS):
        out = F.when(c.rlike(pattern), mark).otherwise(out)
    return out


def parsed_date(c: Column) -> Column:
    """The text as a timestamp by the first of DATE_FORMATS that it has, else null."""
    t = F.trim(c)
    shapes = (r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{4}/\d{1,2}/\d{1,2}$", r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$")
    short = ("yyyy-M-d", "yyyy/M/d", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s")
    return F.coalesce(*[F.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(form))) for shape, form in zip(shapes, short, strict=True)])


def short_label(c: Column) -> Column:
    """The first LABEL characters."""
    return F.substring(c, 1, LABEL)


def category_key(c: Column) -> Column:
    """The category, or the SHA-256 of one that is longer than LABEL."""
    return F.when(F.char_length(c) > LABEL, F.concat(F.lit("sha256:"), F.sha2(c, 256))).otherwise(c)


def whole_number(x: Column) -> Column:
    """The integer that a number is within 1e-12, else null."""
    return F.when(F.abs(x - F.round(x)) <= 1e-12, F.round(x)).cast("long")


def canonical_json(columns: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys; nulls are kept."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})


def tagged_json(kind: str, c: Column) -> Column:
    """A value of any type as JSON that carries its type; ``untagged`` gives the value back."""
    return F.to_json(F.struct(F.lit(kind).alias("type"), c.alias("value")), {"ignoreNullFields": "false"})


def untagged(kind: str, c: Column) -> Column:
    read = F.from_json(c, f"type string, value {kind}")
    return F.when(read["type"] == kind, read["value"])


def typed_fingerprint(columns: dict[str, tuple[str, Column]]) -> Column:
    """SHA-256 of a row whose values carry their types, so that 1, 1.0 and "1" differ; columns: name -> (type, column)."""
    return F.sha2(canonical_json({k: F.struct(F.lit(kind).alias("t"), c.cast("string").alias("v")) for k, (kind, c) in columns.items()}), 256)


def month_ordinal(c: Column) -> Column:
    return (F.year(c) * 12 + F.month(c) - 1).cast("long")


def month_label(ordinal: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(ordinal / 12).cast("long"), F.pmod(ordinal, F.lit(12)) + 1)


def normal_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.casefold())


def _readings(name: str) -> dict[str, float]:
    """What a name may be read as, with how much an agreement on it is worth."""
    whole = normal_name(name)
    shorter = {whole.removesuffix(e): ALIKE for e in KEY_ENDINGS if whole.endswith(e) and whole != e}
    return shorter | ({whole: 1.0} if whole else {})


def name_similarity(a: str, b: str) -> float:
    """The best agreement of two names' readings, else the matching ratio of their normal forms; 0 for names without letters and digits."""
    x, y = _readings(a), _readings(b)
    if not x or not y:
        return 0.0
    agreed = [min(x[r], y[r]) for r in x.keys() & y.keys()]
    return max(agreed) if agreed else difflib.SequenceMatcher(None, normal_name(a), normal_name(b), autojunk=False).ratio()


def output_text(kind: T.DataType, c: Column) -> Column:
    """A value as results show it: whole numbers without a fraction, decimals without trailing zeros, dates in ISO form, bytes as hex."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))
    if isinstance(kind, T.DecimalType):
        # zeros go only behind a point
        return F.when(c.cast("string").contains("."), F.regexp_replace(c.cast("string"), r"\.?0+$", "")).otherwise(c.cast("string"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.regexp_replace(c.cast("string"), " ", "T")
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(c))
    return c.cast("string")
