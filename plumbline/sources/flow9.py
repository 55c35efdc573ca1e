"""Facts of Flow9 source: imports, forbids, exports, unions, structs, natives, declarations, functions and assignments.

What cannot be read is skipped to the next `;` or past a balanced block.
"""

from __future__ import annotations

import re

from plumbline.operators.types import split_args
from plumbline.sources.facts import Facts, TypeFacts
from plumbline.sources.rust import closing
from plumbline.sources.scan import comments_stripped

RESERVED = ("if", "switch", "export", "import", "native")
_NAME = r"[A-Za-z_]\w*"
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)


def render(t: str) -> str:
    """A type's text: [T] as Array<T>, ^T and ref T as ref<T>, void as ()."""
    t = t.strip()
    if t.startswith("[") and t.endswith("]"):
        return f"Array<{render(t[1:-1])}>"
    if t.startswith("^"):
        return f"ref<{render(t[1:])}>"
    if m := re.match(r"ref\s+", t):
        return f"ref<{render(t[m.end() :])}>"
    if t.startswith("("):
        end = closing(t, 0)
        rest = t[end + 1 :].strip()
        if rest.startswith("->"):
            return f"fn({', '.join(render(_typed(p)[1]) for p in split_args(t[1:end]))}) -> {render(rest[2:])}"
        return render(t[1:end])
    if t == "void":
        return "()"
    if m := re.fullmatch(rf"({_NAME})\s*<(.*)>", t, re.S):
        return f"{m[1]}<{', '.join(map(render, split_args(m[2])))}>"
    return t or "_"


def _typed(part: str) -> tuple[str, str]:
    """Name and type of `name : type`, or of a bare type or name."""
    m = re.match(rf"(?:mutable\s+)?({_NAME})\s*:(?!:)\s*", part)
    return (m[1], part[m.end() :]) if m else ("", part)


def _statements(s: str) -> list[str]:
    """Pieces up to a ; outside brackets and strings, or past a block in braces."""
    out, i, last = [], 0, 0
    while i < len(s):
        c = s[i]
        if c == '"':
            i += 1
            while i < len(s) and s[i] != '"':
                i += 2 if s[i] == "\\" else 1
        elif c in "([{":
            i = closing(s, i)
            if c == "{":
                out.append(s[last : i + 1])
                last = i + 1
        elif c == ";":
            out.append(s[last:i])
            last = i + 1
        i += 1
    return [x.strip() for x in [*out, s[last:]] if x.strip()]


class Reader:
    def __init__(self, facts: Facts, exported: set[str]):
        self.f, self.exported = facts, exported
        self.forbids: list[str] = []

    def read(self, s: str, exported: bool = False) -> None:
        for st in _statements(s):
            if m := re.match(r"export\s*\{", st):
                self.read(st[m.end() : -1], True)
            elif m := re.match(r"(import|require|forbid)\s+([\w/.]+)", st):
                if m[1] == "import":
                    self.f.add("imports", m[2])
                elif m[1] == "forbid":
                    self.forbids.append(m[2])
            else:
                self.declaration(st, exported)

    def _publish(self, name: str, exported: bool, private: bool = True) -> None:
        if exported or name in self.exported:
            self.f.add("public_functions", name)
        elif private and name not in self.f.public_functions:
            self.f.add("private_functions", name)

    def _function(self, name: str, params: str, result: str | None, override: bool) -> None:
        typed = [_typed(p) for p in split_args(params)]
        pairs = [(n, render(t)) if n else (("", render(t)) if override else (t.strip(), "_")) for n, t in typed]
        sig = "(" + ", ".join(f"{n} : {t}" if n and t != "_" else n or t for n, t in pairs) + ")" + (f" -> {render(result)}" if result else "")
        if override or name not in self.f.signatures:
            self.f.signatures[name] = sig
            self.f.functions[name] = (pairs, render(result) if result else None)

    def _struct(self, name: str, params: str, exported: bool) -> None:
        if name not in self.f.types:
            self.f.types[name] = TypeFacts(name, "struct", [(n or t.strip(), render(t) if n else "_") for n, t in map(_typed, split_args(params))])
        self._publish(name, exported, private=False)

    def declaration(self, st: str, exported: bool) -> None:
        if m := re.match(rf"native\s+({_NAME})\s*:\s*(?:io\s+)?", st):
            sig = st[m.end() :].split("=")[0] if "->" not in st[m.end() :].split("=")[0] + ">" else re.split(r"=(?!>)", st[m.end() :])[0]
            sig = sig.strip()
            if sig.startswith("("):
                end = closing(sig, 0)
                self._function(m[1], sig[1:end], sig[end + 1 :].strip().removeprefix("->"), True)
            else:
                self.f.signatures[m[1]] = render(sig)
            self._publish(m[1], exported, private=False)
        elif m := re.match(rf"({_NAME})\s*(<[^=]*>)?\s*::=\s*", st):
            names = [re.match(_NAME, v)[0] for v in split_args(st[m.end() :]) if re.match(_NAME, v)]
            self.f.types[m[1]] = TypeFacts(m[1], "enum", variants=names)
            self._publish(m[1], exported, private=False)
        elif m := re.match(rf"({_NAME})\s*:(?!:)\s*\(", st):
            end = closing(st, m.end() - 1)
            rest = st[end + 1 :].strip()
            if m[1][0].isupper():
                self._struct(m[1], st[m.end() : end], exported)
            elif rest.startswith("->"):
                self._function(m[1], st[m.end() : end], rest[2:], True)
                self._publish(m[1], exported)
        elif m := re.match(rf"({_NAME})\s*\(", st):
            end = closing(st, m.end() - 1)
            if m[1][0].isupper():
                self._struct(m[1], st[m.end() : end], exported)
            elif m[1] not in RESERVED:
                tail = st[end + 1 :]
                arrow = re.match(r"\s*->\s*", tail)
                result = re.split(r"[{]", tail[arrow.end() :])[0].strip() if arrow else None
                if result and "=" in result:
                    result = result.split("=")[0].strip()
                self._function(m[1], st[m.end() : end], result, False)
                self._publish(m[1], exported)
        elif m := re.match(rf"({_NAME})\s*(?::(?!:)([^=]*))?=(?!=)", st):
            known = m[1] in self.f.signatures or m[1] in self.f.types or any(m[1] in t.variants or m[1] in dict(t.fields) for t in self.f.types.values())
            if (exported or m[1] in self.exported) and (m[2] is not None or not known):
                self.f.add("state_variables", m[1])
        elif (m := re.match(rf"({_NAME})\s*:(?!:)\s*\S", st)) and (exported or m[1] in self.exported):
            self.f.add("state_variables", m[1])


def extract(text: str, name: str = "") -> Facts:
    facts = Facts(name=name, language="flow9")
    # what strings hold is no code
    clean = _STRING.sub('""', comments_stripped(text))
    exported = set()
    for m in re.finditer(r"\bexport\s*\{", clean):
        for st in _statements(clean[m.end() : closing(clean, m.end() - 1)]):
            if n := re.match(rf"(?:native\s+)?({_NAME})", st):
                exported.add(n[1])
    Reader(facts, exported).read(clean)
    return facts
