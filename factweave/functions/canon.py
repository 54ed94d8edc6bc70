"""Canonical form and hashes of facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = "h1"
SHOWN = 16  # hexadecimal digits of a displayed hash


def canonical(**fields: Column) -> Column:
    """JSON of the fields in alphabetical order, nulls kept, control characters with lower-case digits as JSON.stringify writes them."""
    text = F.to_json(F.struct(*[c.alias(k) for k, c in sorted(fields.items())]), {"ignoreNullFields": "false"})
    # Only control characters are escaped by number, as \u00XX with upper-case digits.
    for digit in "ABCDEF":
        for high in "01":
            text = F.regexp_replace(text, rf"(?<!\\)((?:\\\\)*)\\u00{high}{digit}", rf"$1\\u00{high}{digit.lower()}")
    return text


def full_hash(text: Column) -> Column:
    return F.concat(F.lit(f"{VERSION}:"), F.sha2(text, 256))


def display(hash_: Column) -> Column:
    """The version and the first digits of a full hash."""
    return F.substring(hash_, 1, len(VERSION) + 1 + SHOWN)


def match(recorded: Column, current: Column) -> Column:
    """"match", "differ" or "version": a recorded hash may be cut short; one of another version can't be compared."""
    version = lambda h: F.split_part(h, F.lit(":"), F.lit(1))
    return F.when(version(recorded) != version(current), "version").when(F.startswith(current, recorded), "match").otherwise("differ")


def normal_body(body: Column) -> Column:
    """Line ends as \\n, no blanks at line ends, no empty lines at either end."""
    body = F.regexp_replace(F.regexp_replace(body, "\r\n?", "\n"), "(?m)[ \t]+$", "")
    return F.regexp_replace(body, r"\A\n+|\n+\z", "")


def extract_key(parts: dict[str, Column], files: Column) -> Column:
    """40 digits that change with any of the parts (engine, provider, arguments ...) or of the files, an array of (path, digest) in any order."""
    named = F.array_join(F.transform(F.array_sort(files), lambda f: F.concat(f["path"], F.lit("\0"), f["digest"])), "\n")
    return F.substring(F.sha2(F.concat(canonical(**parts), F.lit("\n"), named), 256), 1, 40)


def aggregate_hash(pairs: Column) -> Column:
    """Of a collected array of (id, hash): the one hash, or that of all pairs in order of id."""
    ordered = F.array_sort(pairs)
    lists = F.transform(ordered, lambda p: F.concat(F.lit('["'), p["id"], F.lit('","'), p["hash"], F.lit('"]')))
    body = F.concat(F.lit('{"pairs":['), F.array_join(lists, ","), F.lit('],"schema_version":1,"type":"aggregate"}'))
    return F.when(F.size(ordered) == 1, ordered[0]["hash"]).otherwise(full_hash(body))
