"""Scalar functions over text columns, all built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of words that mark a line or sentence as important.
SALIENCE = {
    "fatal": 1.0,
    "panic": 1.0,
    "critical": 0.95,
    "crash": 0.95,
    "error": 0.9,
    "exception": 0.9,
    "traceback": 0.9,
    "failed": 0.85,
    "failure": 0.85,
    "fail": 0.8,
    "abort": 0.8,
    "aborted": 0.8,
    "timeout": 0.75,
    "denied": 0.75,
    "rejected": 0.75,
    "refused": 0.75,
    "warn": 0.6,
    "warning": 0.6,
    "deprecated": 0.5,
    "fixme": 0.45,
    "todo": 0.4,
    "important": 0.4,
    "note": 0.3,
}

# Patterns of pieces, terms, suffixes, sentence ends and volatile tokens. \s and \d are Unicode-aware.
WORD_PIECE = "[A-Za-z0-9_]{1,6}"
TERM = (
    r"(?U)([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    r"|[0-9a-fA-F]{12,}|\d+|[A-Za-z][A-Za-z0-9_]*)"
)
SUFFIX = r"^(.{3,}?)(?:ingly|edly|ing|ed|ies|es|s|e)$"
SENTENCE_END = r"""(?U)(?<=[.!?])\s+(?=[A-Z0-9"'(])|\n{2,}|\n(?=[-*#>\d])"""
TIMESTAMP = r"(?U)\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
VOLATILE = [
    (TIMESTAMP, "<TS>"),
    (r"(?U)\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>"),
    (r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?\b", "<IP>"),
    (r"(?U)\b[0-9a-fA-F]{12,}\b", "<HEX>"),
    (r"(?U)\d+(?:\.\d+)?", "<NUM>"),
]
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
LOG_LEVEL = r"\b(INFO|DEBUG|WARN|WARNING|ERROR|FATAL|TRACE)\b"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, also where it is referred to many times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("long")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def token_estimate(c: Column) -> Column:
    """Tokens a text costs: three quarters of its pieces, long ones counted by six characters, or a
    quarter of its characters if that is more; 1 at least, 0 for nothing."""
    # Each piece, or six characters of one, becomes a character, and white space none: a large text is not held as an array of its pieces.
    parts = F.length(F.regexp_replace(F.regexp_replace(c, WORD_PIECE, "w"), r"(?U)\s+", "")).cast("long")
    size = F.greatest(F.lit(1).cast("long"), div(parts * 3, 4), div(F.length(c), 4))
    return F.when(c.isNull() | (c == ""), F.lit(0).cast("long")).otherwise(size)


def content_ref(c: Column, salt: str = "") -> Column:
    """24 hex digits of the text's SHA-256; a salt keeps tenants' references apart."""
    return F.substring(F.sha2(F.concat(F.lit(salt + "\0"), c) if salt else c, 256), 1, 24)


def is_ref(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\A[0-9a-f]{24}\z"), F.lit(False))


def marker(ref: Column, tokens: Column, kind: Column, prefix: str = "ctx-ref") -> Column:
    """The line that stands before a lossy rendering and names its original."""
    return F.concat(
        F.lit(f"[{prefix} "), ref, F.lit(" original~"), tokens.cast("string"), F.lit("tok type="), kind,
        F.lit("; call retrieve('"), ref, F.lit("') for full content]"),
    )


def block_text(blocks: Column) -> Column:
    """Text of content blocks (array of structs with ``text``), joined by newlines; null counts as empty."""
    return F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), "\n")


def terms(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(TERM), F.lit(1)), F.lower)


def stem(c: Column) -> Column:
    return F.regexp_replace(c, SUFFIX, "$1")


def stems(c: Column) -> Column:
    return F.transform(terms(c), stem)


def salience(c: Column) -> Column:
    """The greatest weight among the words of a text, 0 if none has one."""
    table = F.create_map(*[F.lit(x) for pair in SALIENCE.items() for x in pair])
    weights = F.transform(terms(c), lambda t: F.coalesce(table[t], F.lit(0.0)))
    return F.coalesce(F.array_max(weights), F.lit(0.0))


def mask(c: Column) -> Column:
    """A line as a template: timestamps, ids, addresses, hashes and numbers by placeholders, in this order."""
    for pattern, token in VOLATILE:
        c = F.regexp_replace(c, pattern, token)
    return c


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SENTENCE_END, -1), strip), lambda s: s != "")


def lines(c: Column) -> Column:
    """Lines of a text without the empty one after a final line end."""
    return let(F.split(c, LINE_END, -1), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def savings_ratio(before: Column, after: Column) -> Column:
    return F.when(before == 0, F.lit(0.0)).otherwise(1.0 - after / before)


def savings_line(before: Column, after: Column) -> Column:
    """One line of totals: in, out, saved and the share saved."""
    pct = F.when(before == 0, F.lit(0.0)).otherwise((before - after) / before * 100)
    return F.concat(
        F.lit("tokens in: "), F.format_number(before, 0), F.lit(" | out: "), F.format_number(after, 0),
        F.lit(" | saved: "), F.format_number(before - after, 0), F.lit(" ("), F.bround(pct).cast("int").cast("string"), F.lit("%)"),
    )
