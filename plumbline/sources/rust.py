"""Item-level facts of Rust source, by a tokenising scan.

Uses, functions, structs, enums, traits, aliases, modules, impls, constants and statics are
read; macros are not expanded and bodies are skipped by bracket. Kept as they are: only plain `pub` is
public, methods of trait impls count as private, an impl before its type is not recorded
with it, names of structs and enums are also state variables.
"""

from __future__ import annotations

import re

from plumbline.operators.types import split_args
from plumbline.sources.facts import Facts, TypeFacts, canonical

LOCAL = ("crate", "super", "self", "std", "core", "alloc")
_NOISE = re.compile(r"""//[^\n]*|/\*.*?\*/|b?r#*"(?:.*?)"#*|b?"(?:\\.|[^"\\])*"|b?'(?:\\.[^']*|[^'\\\n])'""", re.S)


def _blank(text: str) -> str:
    """Comments gone, literals emptied."""
    return _NOISE.sub(lambda m: " " if m[0].startswith("/") else '""', text)


def closing(s: str, at: int) -> int:
    """Position of the bracket that closes the one at `at`, counting (), [] and {}."""
    depth = 0
    for m in re.compile(r"[()\[\]{}]").finditer(s, at):
        depth += 1 if m[0] in "([{" else -1
        if depth == 0:
            return m.start()
    return len(s) - 1


def use_paths(tree: str, before: str = "") -> list[str]:
    """All paths of a use tree; a renamed import keeps its own name."""
    t = tree.strip()
    if t.startswith("{"):
        return [p for x in split_braced(t[1 : closing(t, 0)]) for p in use_paths(x, before)]
    m = re.match(r"(?:::)?([\w*]+)\s*(::)?\s*", t)
    if not m:
        return []
    here = f"{before}::{m[1]}" if before else m[1]
    return use_paths(t[m.end() :], here) if m[2] else [here]


def split_braced(s: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(s):
        depth += (c in "{([<") - (c in "})]" or c == ">" and s[i - 1 : i] not in ("-", "="))
        if c == "," and depth == 0:
            out.append(s[last:i])
            last = i + 1
    return [x.strip() for x in [*out, s[last:]] if x.strip()]


_ITEM = re.compile(r"(?P<vis>pub(?:\s*\([^)]*\))?\s+)?(?P<mods>(?:(?:async|unsafe|default|const(?=\s+(?:fn|unsafe|async|extern))|extern(?:\s*\"\")?)\s+)*)(?P<kw>use|fn|struct|enum|union|trait|type|mod|impl|const|static|extern|macro_rules!)\b\s*")
_ATTR = re.compile(r"#!?\[")


class Visitor:
    def __init__(self, facts: Facts):
        self.f = facts

    def items(self, s: str) -> None:
        i, attrs = 0, []
        while i < len(s):
            if m := _ATTR.match(s, i):
                end = closing(s, m.end() - 1)
                attrs.append(s[m.end() : end])
                i = end + 1
            elif m := _ITEM.match(s, i):
                i = self.item(s, m, attrs)
                attrs = []
            else:
                i = closing(s, i) + 1 if s[i] in "{([" else i + 1
                # to the next place where an item may begin
                while i < len(s) and (s[i].isalnum() or s[i] == "_") and (s[i - 1].isalnum() or s[i - 1] == "_"):
                    i += 1

    def item(self, s: str, m: re.Match, attrs: list[str]) -> int:
        kw, public, i = m["kw"], (m["vis"] or "").strip() == "pub", m.end()
        end_semi = lambda: (s.find(";", i) + 1) or len(s)
        if kw == "use":
            end = end_semi()
            for p in use_paths(s[i : end - 1]):
                if (root := p.split("::")[0]) not in LOCAL:
                    self.f.add("imports", root)
            return end
        if kw == "fn":
            return self.function(s, i, public, "")
        if kw in ("const", "static"):
            if n := re.match(r"(?:mut\s+)?(\w+)", s[i:]):
                if n[1] != "_":
                    self.f.add("state_variables", n[1])
            return self._past(s, i)
        if kw == "type":
            if n := re.match(r"(\w+)", s[i:]):
                self.f.types[n[1]] = TypeFacts(n[1], "alias")
            return end_semi()
        if kw == "mod":
            brace, semi = s.find("{", i), s.find(";", i)
            if brace < 0 or 0 <= semi < brace:
                return end_semi()
            end = closing(s, brace)
            if not any("cfg" in a and "test" in a for a in attrs):
                self.items(s[brace + 1 : end])
            return end + 1
        if kw in ("struct", "enum", "union", "trait"):
            return self.type_item(s, i, kw, attrs)
        if kw == "impl":
            return self.impl(s, i)
        return self._past(s, i)

    def _past(self, s: str, i: int) -> int:
        """Past the ; or the block that ends an item."""
        while i < len(s):
            if s[i] == ";":
                return i + 1
            if s[i] in "([":
                i = closing(s, i)
            elif s[i] == "{":
                i = closing(s, i)
                rest = s[i + 1 :].lstrip()
                if not rest.startswith(";"):
                    return i + 1
            i += 1
        return i

    def _generics(self, s: str, i: int) -> tuple[list[str], int]:
        if i < len(s) and s[i] == "<":
            depth = 0
            for j in range(i, len(s)):
                depth += (s[j] == "<") - (s[j] == ">" and s[j - 1] not in "-=")
                if depth == 0:
                    return [p.split(":")[0].strip() for p in split_args(s[i + 1 : j])], j + 1
        return [], i

    def type_item(self, s: str, i: int, kw: str, attrs: list[str]) -> int:
        n = re.match(r"(\w+)\s*", s[i:])
        if not n:
            return i
        name = n[1]
        generics, j = self._generics(s, i + n.end())
        derives = [d.split("::")[-1].strip() for a in attrs if a.strip().startswith("derive") for d in a[a.find("(") + 1 : a.rfind(")")].split(",") if d.strip()]
        t = TypeFacts(name, {"union": "struct"}.get(kw, kw), derives=derives, generics=generics)
        head = re.compile(r"[{(;]").search(s, j)
        if not head:
            return len(s)
        self.f.types[name] = t
        if kw == "trait":
            above = s[j : head.start()].split("where")[0]
            t.trait_impls = [x.strip() for x in above.partition(":")[2].split("+") if x.strip()]
            return closing(s, head.start()) + 1 if head[0] == "{" else self._past(s, j)
        self.f.add("state_variables", name)
        if head[0] == ";":
            return head.end()
        end = closing(s, head.start())
        parts = split_braced(s[head.end() : end])
        clean = [re.sub(r"^(?:#\[[^\]]*\]\s*)*(?:pub(?:\s*\([^)]*\))?\s+)?", "", p) for p in parts]
        if kw == "enum":
            t.variants = [v[0] for p in clean if (v := re.match(r"\w+", p))]
            return end + 1
        if head[0] == "(":
            t.fields = [(str(k), canonical(p)) for k, p in enumerate(clean)]
            return self._past(s, end + 1)
        t.fields = [(p.partition(":")[0].strip(), canonical(p.partition(":")[2])) for p in clean if ":" in p]
        return end + 1

    def function(self, s: str, i: int, public: bool, owner: str) -> int:
        n = re.match(r"(\w+)\s*", s[i:])
        if not n:
            return i
        _, j = self._generics(s, i + n.end())
        open_ = s.find("(", j)
        if open_ < 0:
            return len(s)
        end = closing(s, open_)
        params = []
        for p in split_args(s[open_ + 1 : end]):
            p = re.sub(r"^(?:#\[[^\]]*\]\s*)*", "", p).strip()
            if re.fullmatch(r"&?\s*(?:'\w+\s+)?(?:mut\s+)?self", p):
                params.append(("self", ("&mut Self" if "mut" in p else "&Self") if p.startswith("&") else "Self"))
            elif ":" in p:
                name, _, t = p.partition(":")
                params.append((re.sub(r"^mut\s+", "", name.strip()), canonical(t)))
        stop = re.compile(r"[{;]").search(s, end)
        tail = s[end + 1 : stop.start() if stop else len(s)]
        result = canonical(re.split(r"\bwhere\b", tail.partition("->")[2])[0]) if "->" in tail else None
        name = f"{owner}.{n[1]}" if owner else n[1]
        self.f.add("public_functions" if public else "private_functions", name)
        self.f.signatures[name] = "(" + ", ".join("self" if x == "self" else f"{x}: {t}" for x, t in params) + ")" + (f" -> {result}" if result else "")
        self.f.functions[name] = (params, result)
        if stop and stop[0] == "{":
            return closing(s, stop.start()) + 1
        return (stop.end() if stop else len(s))

    def impl(self, s: str, i: int) -> int:
        _, j = self._generics(s, i)
        brace = s.find("{", j)
        if brace < 0:
            return len(s)
        head = re.split(r"\bwhere\b", s[j:brace])[0]
        trait, _, target = head.rpartition(" for ")
        target = re.match(r"[&\s]*(?:mut\s+)?([\w:]+)", target.strip())
        owner = target[1].split("::")[-1] if target else ""
        end = closing(s, brace)
        if trait and owner in self.f.types:
            self.f.types[owner].trait_impls.append(canonical(trait.strip().lstrip("!")))
        body, k = s[brace + 1 : end], 0
        while k < len(body):
            if m := _ATTR.match(body, k):
                k = closing(body, m.end() - 1) + 1
            elif m := _ITEM.match(body, k):
                k = self.function(body, m.end(), (m["vis"] or "").strip() == "pub", owner) if m["kw"] == "fn" else self._past(body, m.end())
            else:
                k = closing(body, k) + 1 if body[k] in "{([" else k + 1
                while k < len(body) and (body[k].isalnum() or body[k] == "_") and (body[k - 1].isalnum() or body[k - 1] == "_"):
                    k += 1
        return end + 1


def extract(text: str, name: str = "") -> Facts:
    facts = Facts(name=name, language="rust")
    Visitor(facts).items(_blank(text))
    return facts
