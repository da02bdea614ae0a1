"""Scalar functions on names, paths and search text."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(s: Column) -> Column:
    return F.translate(s, UPPER, LOWER)


def camel_split(s: Column) -> Column:
    """Words of an identifier, in lower case, with single spaces between.

    Breaks at anything that is neither letter nor digit, before an ASCII capital
    that follows a lower-case letter or digit, and before the last of several
    capitals if a lower-case letter follows.
    """
    s = F.regexp_replace(s, "([a-z0-9])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, "([A-Z])([A-Z][a-z])", "$1 $2")
    return ascii_lower(F.trim(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " ")))


def camel_tokens(s: Column) -> Column:
    """Distinct words of ``camel_split``; none for an empty text."""
    return F.array_distinct(F.filter(F.split(camel_split(s), " "), lambda t: t != ""))


def word_tokens(s: Column) -> Column:
    """Distinct words of each whitespace-separated word of a query."""
    words = F.filter(F.split(s, r"\s+"), lambda t: t != "")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.filter(F.split(camel_split(w), " "), lambda t: t != ""))))


def like_escape(term: str) -> str:
    """The term with LIKE's own characters escaped by a backslash."""
    return term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_ci(c: Column, term: str) -> Column:
    """Case-insensitive substring, metacharacters taken literally."""
    return c.ilike(f"%{like_escape(term)}%")


def starts_ci(c: Column, term: str) -> Column:
    return c.ilike(f"{like_escape(term)}%")


def path_join(*parts: Column) -> Column:
    """Parts with one slash between; empty parts are left out."""
    trimmed = [F.regexp_replace(F.coalesce(p, F.lit("")), "/+$", "") for p in parts]
    return F.concat_ws("/", *(F.when(p != "", F.regexp_replace(p, "^/+", "") if i else p) for i, p in enumerate(trimmed)))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """Everything before the last slash; empty without one."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """After the last dot of the file's name; empty for none and for a name that only starts with a dot."""
    return F.regexp_extract(base_name(path), r"^.+\.([^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def canonical(s: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(s), "[^a-z0-9]+", "")


def path_segments(qname: Column) -> Column:
    """Words of a qualified name's segments but the last; none for a single segment."""
    raw = F.filter(F.split(qname, "[:/.]"), lambda x: x != "")
    lead = F.slice(raw, F.lit(1), F.greatest(F.size(raw) - 1, F.lit(0)))
    return F.array_distinct(F.flatten(F.transform(lead, lambda x: F.filter(F.split(camel_split(x), " "), lambda t: t != ""))))


def normalize_query(s: Column) -> Column:
    """White space collapsed, case kept."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def short_id(*parts: Column) -> Column:
    """Sixteen hex digits: the first eight bytes of a SHA-256."""
    return F.left(F.sha2(F.concat_ws("\x1f", *parts), 256), F.lit(16))


def valid_shell_argument(s: Column) -> Column:
    """No quotes, substitutions, separators or control characters."""
    return ~s.rlike(r"""['"`$;|&<>\\\x00-\x1f]""")


def valid_project(s: Column) -> Column:
    """Letters, digits, dots, dashes and underscores; no leading dot and no two dots in a row."""
    return s.rlike(r"^[A-Za-z0-9_-][A-Za-z0-9._-]*$") & ~s.contains("..")


def json_escape(s: Column) -> Column:
    """The inside of a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(s.alias("x"))), r'(?s)^\{"x":"(.*)"\}$', 1)


@F.pandas_udf(T.StringType())
def fold_accents(s: pd.Series) -> pd.Series:
    """Letters without their combining marks; there is no built-in for it."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def second_stamp(seconds: Column) -> Column:
    """A second since 1970 as the store writes it down; ``F.unix_timestamp()`` gives the present one."""
    return F.concat(F.lit("1970-01-01T00:00:00Z+"), seconds.cast("long").cast("string"), F.lit("s"))
