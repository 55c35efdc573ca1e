"""Columns over module paths, references and file contents."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: extension -> language; an extension not listed is its own language
LANGUAGES = {"sol": "solidity", "rs": "rust", "flow": "flow9", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript"}
#: language, lower case -> extractor
EXTRACTORS = {"solidity": "solidity", "sol": "solidity", "rust": "rust", "rs": "rust", "flow9": "flow9", "flow": "flow9"}
#: language -> places, in order, where a module's source may be; {m} is the module's name, {l} the same in lower case
CANDIDATES = {
    "solidity": ("contracts/{m}.sol", "src/{m}.sol", "{m}.sol"),
    "rust": ("src/{l}.rs", "src/lib.rs", "src/main.rs"),
    "typescript": ("src/{m}.ts", "{m}.ts"),
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def module_name(path: Column) -> Column:
    """Last segment of a path without .rs; of `a/mod.rs`, `a`."""
    return F.element_at(F.split(F.regexp_replace(F.regexp_replace(path, r"(\.rs)+$", ""), "(/mod)+$", ""), "/"), -1)


def ref_project(ref: Column) -> Column:
    """Project of a `project::module` reference; null for a local one."""
    return F.when(F.instr(ref, "::") > 0, F.substring_index(ref, "::", 1))


def ref_module(ref: Column) -> Column:
    """What follows the first `::`, or all of a local reference."""
    return F.when(F.instr(ref, "::") > 0, F.substring(ref, F.instr(ref, "::") + 2, F.length(ref))).otherwise(ref)


def source_hash(content: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the UTF-8 bytes."""
    return F.left(F.sha2(content, 256), F.lit(16))


def detect_language(path: Column) -> Column:
    """Language by file extension; null without one."""
    ext = F.regexp_extract(F.regexp_extract(path, "[^/]*$", 0), r"[^.][.]([^.]+)$", 1)
    return F.when(ext != "", F.coalesce(_lookup(LANGUAGES, ext), ext))


def extractor(language: Column) -> Column:
    """The extractor for a language; null where there is none."""
    return _lookup(EXTRACTORS, F.lower(language))


def glob_regex(glob: str) -> str:
    """Regular expression of a glob: ** crosses folders, * and ? don't."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i]))
            i += 1
    return f"^{out}$"


def excluded(path: Column, globs: list[str]) -> Column:
    """Whether any glob matches the path."""
    return path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)) if globs else F.lit(False)
