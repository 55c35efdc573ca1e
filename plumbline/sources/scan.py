"""Scanners over whole texts: native columns, but for test blocks, which need a count from line to line."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import batches as arrow

_BRACE = re.compile("[{}]")
SELF_CHECKS = ('.contains("', '.contains(&"', "lower.contains")


def comments_stripped(text: str) -> str:
    """text without // and /* */ comments; what is in double quotes, in which a backslash escapes, stays."""
    out, i, n = [], 0, len(text)
    while i < n:
        c = text[i]
        if c == '"':
            j = i + 1
            while j < n and text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            out.append(text[i : j + 1])
            i = j + 1
        elif text.startswith("//", i):
            j = text.find("\n", i)
            i = n if j < 0 else j
        elif text.startswith("/*", i):
            j = text.find("*/", i + 2)
            i = n if j < 0 else j + 2
        else:
            # up to whatever may open a string or a comment
            j = min((k for k in (text.find('"', i + 1), text.find("/", i + 1)) if k >= 0), default=n)
            out.append(text[i:j])
            i = j
    return "".join(out)


def tests_stripped(text: str) -> str:
    """text without the blocks under #[cfg(test)]: from that line to the first closing brace back at its depth, whose line stays."""
    if "#[cfg(test)]" not in text:
        return text
    out, depth, until = [], 0, None
    for line in text.split("\n"):
        if until is None and "#[cfg(test)]" in line:
            until = depth
            continue
        closed = False
        for c in _BRACE.findall(line):
            if c == "{":
                depth += 1
            else:
                depth -= 1
                closed = closed or (until is not None and depth <= until)
        if until is None:
            out.append(line)
        elif closed:
            until = None
            out.append(line)
    return "\n".join(out)


#: Java and RE2 read these alike, but for the possessive signs, which RE2 neither knows nor needs.
STRINGS = r'(\\++"?+)|(")(?:[^"\\\n]++|\\++"?+)*+("|$)'
COMMENTS = r'("(?:[^"\\]++|\\.)*+(?:"|\\?+\z))|//[^\n]*+|/\*.*?(?:\*/|\z)'


def strip_strings(c: Column) -> Column:
    """Text with nothing left between double quotes of one line; a quote after a backslash neither opens nor closes."""
    return F.regexp_replace(c, "(?md)" + STRINGS, "$1$2$3")


def strip_comments(c: Column) -> Column:
    """Text without // and /* */ comments; what is in double quotes, in which a backslash escapes, stays."""
    return F.regexp_replace(c, "(?s)" + COMMENTS, "$1")


def strip_tests(c: Column) -> Column:
    """Text without the blocks under #[cfg(test)]; texts that have none are passed through."""

    def run(texts: pa.Array) -> pa.Array:
        done = []
        for i, j in arrow.parts(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), arrow.PART):
            done.append(pa.array([None if t is None else tests_stripped(t) for t in texts.slice(i, j - i).to_pylist()], pa.string()))
        out = pa.concat_arrays(done) if done else pa.array([], pa.string())
        del done
        arrow.release()
        return out

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(c)


def strip_to_code(c: Column) -> Column:
    """Trimmed lines of text without test blocks, string contents, comment lines and lines that themselves search text."""
    own = F.filter(F.split(strip_tests(c), "\n", -1), lambda x: ~F.regexp_like(x, F.lit(r"^\s*//")) & ~reduce(Column.__or__, [x.contains(m) for m in SELF_CHECKS]))
    return strip_strings(F.array_join(F.transform(own, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), "\n"))
