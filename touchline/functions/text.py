"""Scalar functions on labels, numbers and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance over the longer length; two empty strings are alike."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def to_int(v: Column) -> Column:
    return F.trim(v).try_cast("int")


def label(v: Column) -> Column:
    """Canonical digits of a shirt value, -1 if there is none."""
    return F.coalesce(to_int(v).cast("string"), F.lit("-1"))


def norm_jn(v: Column) -> Column:
    """Shirt value as a number: a trailing .0 goes, and all that is not digits is -1."""
    s = F.regexp_replace(F.trim(v), r"\.0$", "")
    return F.when(s.rlike("^[0-9]+$"), s.try_cast("int")).otherwise(-1)


def shirt(v: Column) -> Column:
    """Whether v is the canonical form of 1..99."""
    return F.coalesce(v.rlike("^[1-9][0-9]?$"), F.lit(False))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]+$", 0)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def grandparent(path: Column) -> Column:
    """Directory two levels above the file: the sequence's name; null where the path is too short."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 3, F.element_at(parts, -3))


def namespaced(*parts: Column) -> Column:
    return F.concat_ws("_", *parts)


def fingerprint(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts."""
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(16))


def metric_cell(v: Column) -> Column:
    """A whole number without decimals, any other with four; a dash for none. The double itself is rounded, as by printf, not the shortest decimal that names it (format_string)."""
    return F.when(v.isNull(), "-").when(v == F.floor(v), F.format_string("%d", v.cast("long"))).when(F.abs(v) < 0.0001, F.format_string("%.4f", v)).otherwise(F.call_function("format_number", v, F.lit("0.0000")))  # format_number rounds 0.00005 down


def ctc_collapse(tokens: Column, blank: int = 0) -> Column:
    """Tokens without neighbours' repeats and blanks."""
    return F.filter(F.transform(tokens, lambda x, i: F.when((i == 0) | (x != F.get(tokens, i - 1)), x)), lambda x: x.isNotNull() & (x != blank))


def until_end(tokens: Column, end: int) -> Column:
    """Tokens before the first end mark."""
    at = F.array_position(tokens, end)
    return F.when(at > 0, F.slice(tokens, F.lit(1), (at - 1).cast("int"))).otherwise(tokens)


def tokens(label: Column, charset: str) -> Column:
    """Place of each character of the label in the charset, from 1 on; a character outside it is an error, a null label null."""
    known = F.array(*[F.lit(c) for c in charset])
    at = F.transform(F.filter(F.split(label, ""), lambda c: c != ""), lambda c: F.array_position(known, c).cast("int"))
    foreign = F.exists(at, lambda i: i == 0)
    return F.when(foreign, F.raise_error(F.concat(F.lit("not in the charset: "), label)).cast("array<int>")).otherwise(at)


def encode(label: Column, charset: str, width: Column, end_marked: bool = True) -> Column:
    """Token ids of a label, padded to width.

    End-marked: begin mark, tokens, end mark 0, with the begin mark and the padding after the charset's ids. Otherwise (CTC): tokens, padded with the blank 0.
    """
    n = len(charset)
    ids = tokens(label, charset)
    full = F.concat(F.array(F.lit(n + 1)), ids, F.array(F.lit(0))) if end_marked else ids
    pad = F.lit(n + 2 if end_marked else 0)
    return F.concat(full, F.array_repeat(pad, F.greatest(F.lit(0), width - F.size(full)).cast("int")))
