"""What extractors find in one source file."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from plumbline.operators import types


@dataclass
class TypeFacts:
    name: str
    kind: str  # struct, enum, trait or alias
    fields: list[tuple[str, str]] = field(default_factory=list)
    variants: list[str] = field(default_factory=list)
    trait_impls: list[str] = field(default_factory=list)
    derives: list[str] = field(default_factory=list)
    generics: list[str] = field(default_factory=list)


@dataclass
class Facts:
    name: str = ""
    language: str = ""
    public_functions: list[str] = field(default_factory=list)
    private_functions: list[str] = field(default_factory=list)
    signatures: dict[str, str] = field(default_factory=dict)
    imports: list[str] = field(default_factory=list)
    events: list[str] = field(default_factory=list)
    state_variables: list[str] = field(default_factory=list)
    modifiers: list[str] = field(default_factory=list)
    types: dict[str, TypeFacts] = field(default_factory=dict)
    #: function -> parameters (name, type) and return type
    functions: dict[str, tuple[list[tuple[str, str]], str | None]] = field(default_factory=dict)

    def add(self, where: str, value: str) -> None:
        """Appends what the list does not hold."""
        if value not in getattr(self, where):
            getattr(self, where).append(value)

    def rows(self) -> list[tuple[str, int, str, str]]:
        """(field, pos, name, detail)."""
        out = [(f, i, v, self.signatures.get(v, "")) for f in ("public_functions", "private_functions", "imports", "events", "state_variables", "modifiers") for i, v in enumerate(getattr(self, f))]
        for i, t in enumerate(self.types.values()):
            parts = [*(f"{n}: {x}" for n, x in t.fields), *t.variants]
            out.append(("types", i, t.name, f"{t.kind} {{{', '.join(parts)}}}" + "".join(f" +{x}" for x in t.derives + t.trait_impls)))
        methods: dict[str, list[str]] = {}
        for f in self.public_functions + self.private_functions:
            owner, dot, method = f.partition(".")
            if dot:
                methods.setdefault(owner, []).append(method)
        for i, t in enumerate(self.types.values()):
            info = {"kind": t.kind, "fields": [{"name": n, "type": x} for n, x in t.fields], "variants": t.variants, "trait_impls": t.trait_impls, "derives": t.derives, "methods": methods.get(t.name, [])}
            out.append(("type_info", i, t.name, json.dumps(info)))
        for i, (name, (params, result)) in enumerate(self.functions.items()):
            out.append(("function_info", i, name, json.dumps({"params": [{"name": n, "type": x} for n, x in params], "return_type": result})))
        return out


def canonical(text: str) -> str:
    return str(types.parse(" ".join(text.split())))
