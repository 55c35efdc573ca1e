"""Facts from the JSON syntax trees that the Solidity compiler writes, of one file or of several under `sources`.

Functions at any depth are read, those outside contracts too; constructors, fallback and receive functions are passed over,
and a function without visibility counts as internal. A text without a tree is an error.
"""

from __future__ import annotations

import json
from typing import Any

from plumbline.sources.facts import Facts

#: The compiler's names: `x.sol` has its tree in `x.sol_json.ast`.
SUFFIX = "_json.ast"


def _types(parameters: dict | None, named: bool) -> list[str]:
    out = []
    for p in (parameters or {}).get("parameters") or []:
        t = (p.get("typeDescriptions") or {}).get("typeString") or "unknown"
        out.append(f"{t} {p['name']}" if named and p.get("name") else t)
    return out


def _signature(node: dict) -> str:
    results = _types(node.get("returnParameters"), False)
    tail = results[0] if len(results) == 1 else f"({', '.join(results)})"
    return f"({', '.join(_types(node.get('parameters'), True))})" + (f" -> {tail}" if results else "")


def _walk(top: dict, f: Facts) -> None:
    stack: list[Any] = [top]
    while stack:
        node = stack.pop()
        if not isinstance(node, dict):
            continue
        name, kind = node.get("name"), node.get("nodeType")
        if kind == "ContractDefinition" and name and not f.name:
            f.name = name
        elif kind == "FunctionDefinition":
            if name and node.get("kind") not in ("constructor", "fallback", "receive"):
                public = node.get("visibility") in ("public", "external")
                (f.public_functions if public else f.private_functions).append(name)
                f.signatures[name] = _signature(node)
            continue
        elif kind in ("EventDefinition", "ModifierDefinition", "VariableDeclaration"):
            if name:
                {"EventDefinition": f.events, "ModifierDefinition": f.modifiers, "VariableDeclaration": f.state_variables}[kind].append(name)
            continue
        elif kind == "ImportDirective":
            if node.get("absolutePath"):
                f.imports.append(node["absolutePath"])
            continue
        stack += reversed(node.get("nodes") or [])


def extract(text: str, name: str = "") -> Facts:
    at = text.find("{")
    if at < 0:
        raise ValueError("no syntax tree")
    tree, _ = json.JSONDecoder().raw_decode(text, at)
    facts = Facts(language="solidity")
    files = tree.get("sources")
    for top in [v.get("AST") or v.get("ast") or {} for v in files.values()] if files else [tree]:
        _walk(top, facts)
    facts.name = facts.name or name
    return facts
