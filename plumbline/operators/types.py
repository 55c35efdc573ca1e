"""Type expressions: a recursive value, read from and written to text."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache


@dataclass(frozen=True)
class Type:
    """form: named (name, args), ref (mut, 1 arg), slice, array (name: length), tuple, fn (args, the last the result), unit, infer, generic forms of other languages as named."""

    form: str
    name: str = ""
    args: tuple[Type, ...] = ()

    def __str__(self) -> str:
        a = [str(x) for x in self.args]
        match self.form:
            case "named":
                return f"{self.name}<{', '.join(a)}>" if a else self.name
            case "ref":
                return f"&{'mut ' if self.name else ''}{a[0]}"
            case "slice":
                return f"[{a[0]}]"
            case "array":
                return f"[{a[0]}; {self.name}]"
            case "tuple":
                return f"({', '.join(a)})"
            case "fn":
                return f"fn({', '.join(a[:-1])}) -> {a[-1]}"
            case "unit":
                return "()"
        return "_"


UNIT, INFER = Type("unit"), Type("infer")
OPEN, CLOSE = "<([", ">)]"


def split_args(text: str, mark: str = ",") -> list[str]:
    """Parts between marks outside brackets of any kind; the > of an arrow closes nothing."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        if c in OPEN:
            depth += 1
        elif c in CLOSE and not (c == ">" and text[i - 1 : i] in "-=" and i):
            depth -= 1
        elif c == mark and depth == 0:
            out.append(text[last:i])
            last = i + 1
    out.append(text[last:])
    return [x.strip() for x in out if x.strip()]


def _closing(text: str, at: int) -> int:
    depth = 0
    for i in range(at, len(text)):
        if text[i] in OPEN:
            depth += 1
        elif text[i] in CLOSE and not (text[i] == ">" and i and text[i - 1] in "-="):
            depth -= 1
            if depth == 0:
                return i
    return len(text) - 1


@lru_cache(maxsize=4096)
def parse(text: str) -> Type:
    t = text.strip()
    if t in ("", "()"):
        return UNIT
    if t == "_":
        return INFER
    if t.startswith("&"):
        rest = re.sub(r"^'\w+\s+", "", t[1:].strip())
        if m := re.match(r"mut\s+", rest):
            return Type("ref", "mut", (parse(rest[m.end() :]),))
        return Type("ref", "", (parse(rest),))
    if t.startswith("[") and _closing(t, 0) == len(t) - 1:
        parts = split_args(t[1:-1], ";")
        return Type("array", parts[1], (parse(parts[0]),)) if len(parts) == 2 else Type("slice", "", (parse(t[1:-1]),))
    if m := re.match(r"fn\s*\(", t):
        end = _closing(t, m.end() - 1)
        arrow = t[end + 1 :].strip()
        return Type("fn", "", (*map(parse, split_args(t[m.end() : end])), parse(arrow[2:]) if arrow.startswith("->") else UNIT))
    if t.startswith("("):
        end = _closing(t, 0)
        if t[end + 1 :].strip().startswith("->"):
            return Type("fn", "", (*map(parse, split_args(t[1:end])), parse(t[end + 1 :].strip()[2:])))
        if end == len(t) - 1:
            return Type("tuple", "", tuple(map(parse, split_args(t[1:-1]))))
    at = t.find("<")
    if at > 0 and t.endswith(">"):
        return Type("named", t[:at].strip(), tuple(map(parse, split_args(t[at + 1 : -1]))))
    return Type("named", t)


def bare(t: Type) -> Type:
    """Without the outermost references."""
    while t.form == "ref":
        t = t.args[0]
    return t


def base_name(t: Type) -> str:
    t = bare(t)
    return t.name if t.form == "named" else str(t)
