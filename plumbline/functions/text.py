"""Columns over source text, invariants and names; all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATIC_MARKS = ("never panics", "no panic", "returns result", "returns error", "no unwrap", "never unwrap", "no unsafe", "never unsafe")


def quote(name: Column) -> Column:
    """name as a literal inside a regular expression."""
    return F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))


def count_calls(code: Column, name: Column) -> Column:
    """Occurrences of `name(` not after `fn `, in lines that, trimmed, do not begin with // or #."""
    lines = F.filter(F.split(code, "\r?\n"), lambda x: ~F.ltrim(x).startswith("//") & ~F.ltrim(x).startswith("#"))
    return F.coalesce(F.regexp_count(F.array_join(lines, "\n"), F.concat(F.lit("(?<!fn )"), quote(name), F.lit(r"\("))), F.lit(0)).cast("bigint")


def has_word(code: Column, word: str) -> Column:
    """Whether word stands in code between characters that are no ASCII letter, digit or underscore."""
    return code.rlike(f"(?<![A-Za-z0-9_])\\Q{word}\\E(?![A-Za-z0-9_])")


def no_panic(code: Column) -> Column:
    return ~(code.contains("panic!(") | code.contains(".unwrap()") | code.contains(".expect("))


def no_unwrap(code: Column) -> Column:
    return ~code.contains(".unwrap()")


def no_unsafe(code: Column) -> Column:
    return ~has_word(code, "unsafe")


def static_result(invariant: Column, code: Column) -> Column:
    """Outcome of the static check that an invariant's text asks for; null where there is none."""
    low = F.lower(invariant)
    has = lambda *x: F.greatest(*[low.contains(s) for s in x]) if len(x) > 1 else low.contains(x[0])
    return F.when(has("never panics", "no panic"), no_panic(code)).when(has("no unwrap", "never unwrap"), no_unwrap(code)).when(has("no unsafe", "never unsafe"), no_unsafe(code))


def classify_invariant(text: Column) -> Column:
    """static or behavioral."""
    low, static = F.lower(text), F.lit(False)
    for mark in STATIC_MARKS:
        static = static | low.contains(mark)
    return F.when(text.contains(": requires ") | text.contains(": ensures "), "behavioral").when(static, "static").otherwise("behavioral")


def cache_key(code: Column, invariant: Column) -> Column:
    """SHA-256 of code, a bar and the invariant, whole."""
    return F.sha2(F.concat(code, F.lit("|"), invariant), 256)


def estimate_tokens(prompt: Column) -> Column:
    """A quarter of the bytes, rounded down, and 100."""
    return (F.floor(F.octet_length(prompt) / 4) + 100).cast("bigint")


def sanitize_name(name: Column) -> Column:
    """Everything but letters, numbers and underscores becomes an underscore."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}_]", "_")


def squeeze(signature: Column) -> Column:
    """Without white space."""
    return F.regexp_replace(signature, r"\s", "")


def long_words(text: Column) -> Column:
    """Words of more than three bytes."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: F.octet_length(w) > 3)


def import_root(path: Column) -> Column:
    """Crate of a use path."""
    return F.trim(F.substring_index(path, "::", 1))


LOCAL_ROOTS = ("crate", "super", "self", "std", "core", "alloc")
