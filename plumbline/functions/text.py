"""Column functions on recognised text and product codes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..constants import CODE_CHARS, CODE_MAX, CODE_MIN, CODE_PREFIX, LOOKALIKE_FROM, LOOKALIKE_TO, UNSET

#: White space at either end, Unicode's and the separators of ASCII.
_ENDS = r"\A[\s\x1C-\x1F\x85\p{Z}]+|[\s\x1C-\x1F\x85\p{Z}]+\z"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, _ENDS, "")


def clean_code(c: Column) -> Column:
    """Trim, drop one unit prefix, trim."""
    return trimmed(F.regexp_replace(trimmed(c), CODE_PREFIX, ""))


def invalid_chars(c: Column) -> Column:
    """Distinct characters outside the allowed set, first seen first."""
    bad = F.regexp_replace(c, f"[{CODE_CHARS}]", "")
    return F.array_distinct(F.filter(F.split(bad, ""), lambda x: x != ""))


def validation_error(c: Column) -> Column:
    """Why a code is not valid (blank, short, long, charset), or null if it is."""
    t = trimmed(c)
    return (
        F.when(c.isNull() | (t == ""), "blank")
        .when(F.length(t) < CODE_MIN, "short")
        .when(F.length(t) > CODE_MAX, "long")
        .when(~t.rlike(rf"\A[{CODE_CHARS}]+\z"), "charset")
    )


def is_extractable(c: Column) -> Column:
    """Whether a cleaned line counts as a code: long enough and of allowed characters, however long."""
    return (F.length(c) >= CODE_MIN) & c.rlike(rf"\A[{CODE_CHARS}]+\z")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark has no expression for; nulls stay as they are."""
    some = s.notna()
    return s.where(~some, s[some].map(lambda x: unicodedata.normalize("NFKC", x))) if some.any() else s


def server_normalized(c: Column) -> Column:
    """NFKC, upper case, trim, then printable ASCII alone. What is ASCII already does not go through Python; a null takes its place there."""
    composed = F.coalesce(nfkc(F.when(~c.rlike(r"\A[\x00-\x7F]*\z"), c)), c)
    return F.regexp_replace(trimmed(F.upper(composed)), r"[^\x20-\x7E]", "")


def match_form(c: Column) -> Column:
    """The form labels and texts are compared in: upper case, without spaces and hyphens."""
    return F.translate(trimmed(F.upper(c)), " -\u3000", "")


def variants(c: Column) -> Column:
    """The text and every text with one look-alike character swapped."""
    swap = F.transform(
        F.sequence(F.lit(1), F.length(c)),
        lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.translate(F.substring(c, i, F.lit(1)), LOOKALIKE_FROM, LOOKALIKE_TO), F.substring(c, i + 1, F.length(c))),
    )
    return F.when(F.length(c) == 0, F.array(c)).otherwise(F.array_distinct(F.concat(F.array(c), swap)))


def useful_count(c: Column) -> Column:
    """Letters, digits, hyphens and slashes."""
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{Nd}\-/]", ""))


def ascii_folded(c: Column) -> Column:
    """A-Z to a-z, nothing else, as a case-insensitive LIKE of ASCII folds."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


def contains_like(column: Column, typed: str) -> Column:
    """``LIKE '%typed%'``: A-Z match a-z and nothing else is folded; wildcards in the typed text stay wildcards, a backslash is itself; an empty query matches all."""
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in typed.strip()).replace("\\", "\\\\")
    return F.lit(True) if not folded else ascii_folded(column).like(f"%{folded}%")


def worker_number(c: Column) -> Column:
    """An integer written without spaces, else 1."""
    return F.coalesce(F.when(c.rlike(r"\A[+-]?[0-9]+\z"), c.try_cast("int")), F.lit(1))


def before_mark(c: Column, mark: str) -> Column:
    """What stands before the first ``mark``, trimmed; all of it without one."""
    return trimmed(F.substring_index(c, mark, 1))


def two_decimals(c: Column) -> Column:
    return F.format_string("%.2f", c.cast("double"))


def result_note(confidence: Column, distance: Column, raw: Column) -> Column:
    """What is noted of a matched text: confidence, distance and the text as read."""
    return F.concat(F.lit("信頼度:"), two_decimals(confidence), F.lit("  距離:"), distance.cast("string"), F.lit("  OCR:"), raw)


def unmatched_note(raw: Column, confidence: Column) -> Column:
    return F.concat(raw, F.lit("  (信頼度:"), two_decimals(confidence), F.lit(")"))


def bullet(c: Column) -> Column:
    return F.concat(F.lit("・"), c)


def header_label(site: Column, process: Column) -> Column:
    return F.concat(F.lit("【"), site, F.lit("】"), process)


def or_unset(c: Column) -> Column:
    return F.coalesce(F.nullif(trimmed(c), F.lit("")), F.lit(UNSET))


def request_payload(**fields: Column) -> Column:
    """A JSON object with these names, in order."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))


REQUEST = "process_id int, division string, worker_id int, device_id string, registered_at string, product_numbers array<string>, construction_name string, process_name string"
RESPONSE = "success boolean, message string, id int"


def read_request(c: Column) -> Column:
    """A request as a struct; names that are missing, or not of their kind, are null, and so is what is no object."""
    return F.from_json(c, REQUEST)


def send_outcome(status: Column, body: Column) -> tuple[Column, Column]:
    """(ok, message) of an answer to a request: success needs a status of the 200s and a body that says so; a failure without a message gives the status."""
    r = F.from_json(body, RESPONSE)
    ok = status.between(200, 299) & F.coalesce(r["success"], F.lit(False))
    return ok, F.when(~ok, F.coalesce(r["message"], F.concat(F.lit("HTTP "), status.cast("string"))))


def zipped(codes: Column, **lists: tuple[Column, Column]) -> Column:
    """Parallel lists met by position, as structs (code, ...): where a list is shorter than ``codes`` its default stands (a column, or the code itself if None)."""
    return F.transform(codes, lambda c, i: F.struct(c.alias("code"), *(F.coalesce(F.get(v, i), c if d is None else d).alias(k) for k, (v, d) in lists.items())))


def location(warehouse: Column, column: Column, tier: Column) -> Column:
    return F.concat_ws(" / ", *(F.when(F.trim(c) != "", c) for c in (warehouse, column, tier)))
