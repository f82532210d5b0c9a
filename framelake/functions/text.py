"""Scalar helpers of the job and media layer as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock(ms: Column) -> Column:
    """mm:ss.d"""
    minutes, seconds, tenths = F.floor(ms / 60000), F.floor(ms / 1000) % 60, F.floor(ms / 100) % 10
    return F.concat(F.lpad(minutes.cast("string"), 2, "0"), F.lit(":"), F.lpad(seconds.cast("string"), 2, "0"), F.lit("."), tenths.cast("string"))


def byte_range(header: Column, total: Column) -> dict[str, Column]:
    """``first`` and ``last`` byte of a single-range header; ``state`` is full, range or unsatisfiable."""
    form = F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 0) != ""
    a = F.nullif(F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 1), F.lit("")).cast("bigint")
    b = F.nullif(F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 2), F.lit("")).cast("bigint")
    suffix = form & a.isNull() & b.isNotNull()
    known = form & a.isNotNull()
    return {
        "state": F.when(known & (a >= total), "unsatisfiable").when(known | suffix, "range").otherwise("full"),
        "first": F.when(suffix, F.greatest(total - b, F.lit(0))).when(known & (a < total), a),
        "last": F.when(suffix, F.greatest(total - 1, F.lit(0))).when(known & (a < total), F.least(b, total - 1)),
    }


def safe_extension(name: Column) -> Column:
    """Letters and digits after the last dot in small letters, five at most, else empty."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return F.substring(F.regexp_replace(ext, "[^a-z0-9]", ""), 1, 5)


def storage_of(key: Column) -> Column:
    return F.regexp_extract(key, "^(s3|local|inline)://", 1)


def job_id(ms: Column, n: Column) -> Column:
    """Hexadecimal time, a dash, a hexadecimal counter of four digits."""
    return F.concat(F.lower(F.hex(ms)), F.lit("-"), F.lpad(F.lower(F.hex(n)), 4, "0"))


def literal_regex(term: str) -> str:
    """The term if it is a regular expression, else the term taken literally."""
    import re

    try:
        re.compile(term)
        return term
    except re.error:
        return re.escape(term)


def highlight(text: Column, term: str) -> Column:
    import re

    return F.regexp_replace(text, f"(?i)({re.escape(term)})", "<mark>$1</mark>")


def percent_encoded(text: Column, keep: str = "") -> Column:
    """Every byte but letters, digits and ``-_.~`` (and the characters of ``keep``) as ``%XX``; a space is ``%20``."""
    out = F.url_encode(text)  # the form's rule: a space is +, * stays, ~ does not
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), *((f"%{ord(c):02X}", c) for c in keep)):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def base64_line(content: Column) -> Column:
    """Base64 as one line of any length; Spark's own may start a new line after every 76 characters."""
    return F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))
