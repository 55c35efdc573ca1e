"""Loading and writing specs, subsystems, defaults, rules and project configuration.

Spec files are read by Spark as whole texts and parsed where they lie; what comes
back is one row per file with the fields of the target schema. Small configuration (rules, project file) is
read on the driver. YAML needs the yaml package; without it JSON, which is YAML too, is still read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import layers, paths
from plumbline.operators.checks import append_missing
from plumbline.operators.rules import Rule
from plumbline.sources import solc

try:
    import yaml
except ImportError:
    yaml = None

LISTS = ("depends_on", "forbidden_deps", "external_deps", "forbidden_external", "invariants", "emits", "subscribes", "owns_state", "reads_state", "modifies", "callable_by", "roles")
SCALARS = ("description", "language", "source_path", "source_hash", "layer", "context", "stability")
EXPOSE_LISTS = ("requires", "ensures", "modifies", "emits", "callable_by", "type_constraints")
DEFAULT_SCALARS = ("language", "layer", "context", "stability")
DEFAULT_LISTS = ("forbidden_deps", "external_deps", "forbidden_external")

_EXPOSE = "name string, kind string, description string, signature string, visibility string, " + ", ".join(f"{x} array<string>" for x in EXPOSE_LISTS)
_PROTOCOL = "states array<string>, initial string, terminal array<string>, transitions array<struct<from_state: string, call: string, to_state: string>>, balanced_pairs array<struct<open_fn: string, close_fn: string>>"


def _struct(ddl: str) -> str:
    out, depth, word = "", 0, True
    for part in ddl.split(", "):
        name, _, kind = part.partition(" ")
        out += ("" if word else ", ") + (f"{name}: {kind}" if depth == 0 and kind else part)
        depth += part.count("<") - part.count(">")
        word = False
    return f"struct<{out}>"


SPEC_SCHEMA = "file string, error string, module string, " + ", ".join(f"{c} string" for c in SCALARS) + ", " + ", ".join(f"{c} array<string>" for c in LISTS) + f", exposes array<{_struct(_EXPOSE)}>, protocol {_struct(_PROTOCOL)}"
SUBSYSTEM_SCHEMA = "file string, error string, subsystem string, description string, layer string, context string, stability string, modules array<string>, invariants array<string>, depends_on array<string>, forbidden_deps array<string>, exposes array<struct<name: string, description: string, delegates_to: string, requires: array<string>, ensures: array<string>>>"


def parse_yaml(text: str) -> Any:
    return yaml.safe_load(text) if yaml is not None else json.loads(text)


def _strings(x: Any) -> list[str]:
    return [str(v) for v in x or []]


def _text(x: Any) -> str | None:
    return None if x is None else str(x)


def spec_record(text: str) -> dict[str, Any]:
    """The fields of one spec; unknown keys are passed over, `module` is required, the layer is in lower case."""
    d = parse_yaml(text)
    if not isinstance(d, dict) or "module" not in d:
        raise ValueError("no module")
    out: dict[str, Any] = {"module": str(d["module"]), **{c: _text(d.get(c)) for c in SCALARS}, **{c: _strings(d.get(c)) for c in LISTS}}
    out["layer"] = out["layer"] and out["layer"].lower()
    out["exposes"] = [{"name": str(k), **{c: _text((v or {}).get(c)) for c in ("kind", "description", "signature", "visibility")}, **{c: _strings((v or {}).get(c)) for c in EXPOSE_LISTS}} for k, v in (d.get("exposes") or {}).items()]
    p = d.get("protocol")
    out["protocol"] = p and {
        "states": _strings(p.get("states")), "initial": str(p["initial"]), "terminal": _strings(p.get("terminal")),
        "transitions": [{"from_state": str(t["from"]), "call": str(t["call"]), "to_state": str(t["to"])} for t in p.get("transitions") or []],
        "balanced_pairs": [{"open_fn": str(a), "close_fn": str(b)} for a, b in p.get("balanced_pairs") or []],
    }
    return out


def subsystem_record(text: str) -> dict[str, Any]:
    d = parse_yaml(text)
    if not isinstance(d, dict) or "subsystem" not in d:
        raise ValueError("no subsystem")
    out = {"subsystem": str(d["subsystem"]), **{c: _text(d.get(c)) for c in ("description", "layer", "context", "stability")}, **{c: _strings(d.get(c)) for c in ("modules", "invariants", "depends_on", "forbidden_deps")}}
    out["exposes"] = [{"name": str(k), "description": _text((v or {}).get("description")), "delegates_to": _text((v or {}).get("delegates_to")), "requires": _strings((v or {}).get("requires")), "ensures": _strings((v or {}).get("ensures"))} for k, v in (d.get("exposes") or {}).items()]
    return out


def _files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/").alias("file"), F.col("value").alias("text"))


def _parsed(files: DataFrame, parse, ddl: str) -> DataFrame:
    schema = files.sparkSession.createDataFrame([], ddl).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for file, text in zip(b["file"].to_pylist(), b["text"].to_pylist(), strict=True):
                try:
                    rows.append({"file": file, "error": None, **parse(text)})
                except Exception as e:  # noqa: BLE001 - a broken file is a row, whatever broke it
                    rows.append({"file": file, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.mapInArrow(run, schema)


def read_specs(spark: SparkSession, root: str) -> DataFrame:
    """A row for each *.spec.yaml and *.spec.yml under root; a file that cannot be read as a spec has its reason in `error`."""
    return _parsed(_files(spark, root, "*.spec.{yaml,yml}"), spec_record, SPEC_SCHEMA)


def load_specs(spark: SparkSession, root: str, project: str = "") -> DataFrame:
    """Specs under root with directory defaults applied and spec_ordinal, by which they are in order: their file. Any broken file is an error."""
    specs = read_specs(spark, root)
    if broken := specs.where("error is not null").select("file", "error").take(1):
        raise ValueError(f"{broken[0][0]}: {broken[0][1]}")
    return with_defaults(specs, read_defaults(spark, root), root).withColumn("project", F.lit(project)).withColumn("spec_ordinal", F.col("file"))


def load_subsystems(spark: SparkSession, root: str) -> DataFrame:
    """Subsystems under root; broken files are left out."""
    return _parsed(_files(spark, root, "*.subsystem.yaml"), subsystem_record, SUBSYSTEM_SCHEMA).where("error is null")


def read_defaults(spark: SparkSession, root: str) -> DataFrame:
    """dir and default fields of every readable _defaults.yaml under root. They are few and small, and Spark passes over files whose names begin with an underscore, so the driver reads them."""
    ddl = ", ".join(f"{c} string" for c in DEFAULT_SCALARS) + ", " + ", ".join(f"{c} array<string>" for c in DEFAULT_LISTS) + ", dir string"
    rows = []
    for folder, _, names in os.walk(os.path.abspath(root)):
        if "_defaults.yaml" in names:
            try:
                with open(os.path.join(folder, "_defaults.yaml"), encoding="utf-8") as f:
                    d = parse_yaml(f.read()) or {}
                rows.append((*(_text(d.get(c)) for c in DEFAULT_SCALARS), *(_strings(d.get(c)) for c in DEFAULT_LISTS), folder))
            except (OSError, ValueError, AttributeError, *((yaml.YAMLError,) if yaml is not None else ())):
                continue
    return spark.createDataFrame(rows, ddl)


def with_defaults(specs: DataFrame, defaults: DataFrame, root: str) -> DataFrame:
    """Specs with what the defaults of their folder and of those above it, up to root, set: the nearest folder's scalar where the spec has none; list items, root's first, after the spec's own."""
    top = os.path.abspath(root)
    s = specs.withColumn("__dir", F.regexp_replace("file", "/[^/]*$", ""))
    d = defaults.select(F.col("dir").alias("__d"), *[F.col(c).alias(f"__{c}") for c in DEFAULT_SCALARS + DEFAULT_LISTS]).where((F.col("__d") == top) | F.col("__d").startswith(top + "/"))
    deep = F.length("__d")
    # a folder meets the defaults of those above it by equal keys
    steps = F.split("__dir", "/")
    up = s.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))).alias("__up"))
    joined = up.join(d, F.col("__up") == F.col("__d"))
    fold = joined.groupBy("file").agg(*[F.max_by(f"__{c}", F.when(F.col(f"__{c}").isNotNull(), deep)).alias(f"__{c}") for c in DEFAULT_SCALARS], *[F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(deep.alias("k"), F.coalesce(f"__{c}", F.array().cast("array<string>")).alias("v")))), lambda x: x["v"]))).alias(f"__{c}") for c in DEFAULT_LISTS])
    out = s.join(fold, "file", "left")
    for c in DEFAULT_SCALARS:
        out = out.withColumn(c, F.coalesce(c, F.lower(f"__{c}") if c == "layer" else f"__{c}"))
    for c in DEFAULT_LISTS:
        out = out.withColumn(c, append_missing(c, f"__{c}"))
    return out.drop("__dir", *[f"__{c}" for c in DEFAULT_SCALARS + DEFAULT_LISTS])


def module_list(specs: DataFrame, field: str) -> DataFrame:
    """module, pos and value of a list field."""
    return specs.select("module", F.posexplode(field).alias("pos", "value"))


def exposes(specs: DataFrame) -> DataFrame:
    return specs.select("module", F.explode("exposes").alias("e")).select("module", "e.*")


def protocols(specs: DataFrame) -> DataFrame:
    return specs.where("protocol is not null").select("module", F.col("protocol.initial").alias("initial"))


def protocol_items(specs: DataFrame) -> DataFrame:
    part = lambda f: specs.select("module", F.lit(f).alias("field"), F.explode(f"protocol.{f}").alias("value"))
    return part("states").unionByName(part("terminal"))


def transitions(specs: DataFrame) -> DataFrame:
    return specs.select("module", F.posexplode("protocol.transitions").alias("pos", "t")).select("module", "pos", "t.*")


def balanced_pairs(specs: DataFrame) -> DataFrame:
    return specs.select("module", F.explode("protocol.balanced_pairs").alias("p")).select("module", "p.*")


def source_files(spark: SparkSession, root: str, excludes: list[str] = ()) -> DataFrame:
    """path (relative to root) of every file under root, none of which is opened, less those that a glob excludes."""
    top = os.path.abspath(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", "^file:/*", "/").alias("file"))
    return files.select(F.substring("file", F.lit(len(top) + 2), F.length("file")).alias("path")).where(~paths.excluded(F.col("path"), list(excludes)))


def syntax_trees(spark: SparkSession, root: str) -> DataFrame:
    """path of the source and text of the trees that the Solidity compiler left beside sources."""
    top = os.path.abspath(root)
    files = _files(spark, root, f"*{solc.SUFFIX}")
    return files.select(F.regexp_replace(F.substring("file", F.lit(len(top) + 2), F.length("file")), re.escape(solc.SUFFIX) + "$", "").alias("path"), "text")


def source_texts(spark: SparkSession, root: str, excludes: list[str] = ()) -> DataFrame:
    """path (relative to root), text and language of the source files that there are extractors for, less those that a glob excludes."""
    top = os.path.abspath(root)
    files = _files(spark, root, "*.{rs,sol,flow}").withColumn("path", F.substring("file", F.lit(len(top) + 2), F.length("file")))
    return files.where(~paths.excluded(F.col("path"), list(excludes))).select("path", "text", paths.detect_language(F.col("path")).alias("language"))


def load_rules(path: str) -> tuple[list[Rule], list[str], dict[str, tuple[str, ...]] | None]:
    """Custom rules, names of built-in rules to leave out, and the layer model, None for the built-in one: a list is linear, a map explicit."""
    with open(path, encoding="utf-8") as f:
        d = parse_yaml(f.read()) or {}
    own = [Rule(r["name"], r["require"], str(r.get("when", "true")).lower() if isinstance(r.get("when"), bool) else r.get("when", "true"), r.get("description"), str(r.get("severity", "error")).lower()) for r in d.get("rules") or []]
    model = d.get("layers")
    if isinstance(model, list):
        model = layers.linear(model)
    elif isinstance(model, dict):
        model = layers.explicit({k: (v or {}).get("can_depend_on") or [] for k, v in model.items()})
    return own, list(d.get("disable_builtin") or []), model


CONFIG_FILES = (".spec-config.yaml", ".spec-config.yml")


def load_config(root: str, names: tuple[str, ...] = CONFIG_FILES) -> dict[str, Any]:
    """The first readable project file: name, dependencies (name -> path), public_modules, exclude; a broken one is passed over; {} if there is none."""
    for n in names:
        try:
            with open(os.path.join(root, n), encoding="utf-8") as f:
                d = parse_yaml(f.read())
        except (OSError, ValueError, *((yaml.YAMLError,) if yaml is not None else ())):
            continue
        if isinstance(d, dict):
            d["dependencies"] = {k: v["path"] if isinstance(v, dict) else v for k, v in (d.get("dependencies") or {}).items()}
            return d
    return {}


def save_config(root: str, name: str, excludes: list[str], file: str = CONFIG_FILES[0]) -> bool:
    """Adds name and excludes to the project file, keeping all else; True if it changed."""
    path = os.path.join(root, file)
    before = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            before = parse_yaml(f.read()) or {}
    after = {**before, "name": before.get("name", name), "exclude": list(dict.fromkeys([*(before.get("exclude") or []), *excludes]))}
    if after == before:
        return False
    with open(path, "w", encoding="utf-8") as f:
        f.write(yaml.safe_dump(after, sort_keys=False) if yaml is not None else json.dumps(after, indent=2))
    return True


def write_specs(specs: list[dict[str, Any]], out: str) -> list[str]:
    """Spec files for records with module and source_path, mirrored under out; empty fields are left out."""
    done = []
    for s in specs:
        path = os.path.join(out, os.path.splitext(s.get("source_path") or s["module"])[0] + ".spec.yaml")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        kept = {k: v for k, v in s.items() if v not in (None, [], {})}
        with open(path, "w", encoding="utf-8") as f:
            f.write(yaml.safe_dump(kept, sort_keys=False) if yaml is not None else json.dumps(kept, indent=2))
        done.append(path)
    return done


def resolve_settings(defaults: dict[str, Any], file: dict[str, Any], options: dict[str, Any], environment: dict[str, str]) -> dict[str, Any]:
    """Settings of the verifier: defaults, then the file's provider (the one it names as `default`, else the first by name; without `providers` the file's own top level), then its `check_mode`, then what the caller gives, then a key from the environment where none is set, by the provider's `key_env`."""
    out = dict(defaults)
    providers = file.get("providers") or {}
    if providers:
        name = file.get("default") or min(providers)
        if name not in providers:
            raise ValueError(f"no provider {name!r}")
        out |= {"provider": name, **(providers[name] or {})}
    else:
        out |= {k: v for k, v in file.items() if k not in ("default", "providers", "check_mode")}
    if file.get("check_mode") is not None:
        out["check_mode"] = file["check_mode"]
    out |= {k: v for k, v in options.items() if v is not None}
    if not out.get("key") and environment.get(out.get("key_env") or ""):
        out["key"] = environment[out["key_env"]]
    return out


def rewrite_spec(file: str, change: dict[str, Any]) -> None:
    """Sets fields of a spec file, keeping all others; exposes are merged by name."""
    with open(file, encoding="utf-8") as f:
        d = parse_yaml(f.read())
    exposes = {**(d.get("exposes") or {})}
    for name, fields in (change.pop("exposes", None) or {}).items():
        exposes[name] = {**(exposes.get(name) or {}), **fields}
    d |= change
    if exposes:
        d["exposes"] = exposes
    with open(file, "w", encoding="utf-8") as f:
        f.write(yaml.safe_dump(d, sort_keys=False) if yaml is not None else json.dumps(d, indent=2))


def refined(file: str, spec: dict[str, Any], given: list[dict[str, Any]], source_hash: str) -> str:
    """Adds to a spec file what was given of its module and entities, in order, without repetitions, and sets its source_hash. Of entities only those the spec has are changed."""
    own = {e["name"]: e for e in spec.get("exposes") or []}
    change: dict[str, Any] = {"source_hash": source_hash, "exposes": {}}
    more = lambda have, extra: [*have, *(x for x in dict.fromkeys(extra or []) if x not in have)]
    for g in given:
        if g["name"] is None:
            change["invariants"] = more(change.get("invariants", spec.get("invariants") or []), g["invariants"])
            if g["description"]:
                change["description"] = g["description"]
        elif g["name"] in own:
            at = change["exposes"].setdefault(g["name"], {})
            for f in ("requires", "ensures", "modifies"):
                if items := more(at.get(f, own[g["name"]].get(f) or []), g[f]):
                    at[f] = items
            if g["description"]:
                at["description"] = g["description"]
    rewrite_spec(file, change)
    return file


def project_graph(root: str, names: tuple[str, ...] | None = None) -> tuple[list[dict[str, Any]], list[tuple[str, str]]]:
    """Projects (name, root, public_modules) reached through `dependencies`, each once, and edges (project, dependency). A dependency whose own name differs from the one used for it is an error."""
    found: dict[str, dict[str, Any]] = {}
    edges: list[tuple[str, str]] = []

    def visit(path: str, called: str | None) -> str:
        real = os.path.realpath(path)
        if real in found:
            return found[real]["name"]
        c = load_config(real, names or CONFIG_FILES)
        name = c.get("name") or called or os.path.basename(real)
        if called is not None and c.get("name") not in (None, called):
            raise ValueError(f"{real} is named {name!r}, not {called!r}")
        found[real] = {"name": name, "root": real, "public_modules": c.get("public_modules")}
        for dep, where in (c.get("dependencies") or {}).items():
            edges.append((name, visit(os.path.join(real, where), dep)))
        return name

    visit(root, None)
    return list(found.values()), edges
