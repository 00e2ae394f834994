"""Symbols, imports, exports and descriptions of source files: a registry of parsers, one function a language, applied where the files are.

Python is read from its syntax tree; all others line by line, so declarations that are nested or split over lines are missed.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Symbol(NamedTuple):
    name: str
    kind: str
    line: int
    exported: bool = True
    doc: str | None = None
    detail: str | None = None
    parent: str | None = None
    parameters: list[str] = []


class Import(NamedTuple):
    source: str
    names: list[str]
    type_only: bool = False


class Export(NamedTuple):
    name: str
    reexport: bool = False
    source: str | None = None


@dataclass
class Parsed:
    symbols: list[Symbol] = field(default_factory=list)
    imports: list[Import] = field(default_factory=list)
    exports: list[Export] = field(default_factory=list)
    doc: str | None = None


Parser = Callable[[str, str], Parsed]
PARSERS: dict[str, Parser] = {}


def parser(*languages: str) -> Callable[[Parser], Parser]:
    """Registers a parser for languages; a later one takes the place of an earlier one."""

    def add(f: Parser) -> Parser:
        PARSERS.update(dict.fromkeys(languages, f))
        return f

    return add


def parse(language: str, text: str, path: str) -> Parsed:
    """What the language's parser finds; languages without one have a description at most."""
    return PARSERS.get(language, plain)(text, path)


def _exports(symbols: list[Symbol]) -> list[Export]:
    return [Export(s.name) for s in symbols if s.exported and not s.parent]


def _base(path: str) -> str:
    return path.rsplit("/", 1)[-1]


@parser("python")
def python(text: str, path: str) -> Parsed:
    """Top-level functions, classes and upper-case names; __all__ decides what is exported, else a leading underscore. Decorated definitions are left out."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return Parsed()
    summary = lambda n: (ast.get_docstring(n) or "").strip().split("\n")[0] or None
    listed: set[str] | None = None
    found: list[Symbol] = []
    out = Parsed(doc=summary(tree))
    for n in tree.body:
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) and not n.decorator_list:
            is_class = isinstance(n, ast.ClassDef)
            names = [] if is_class else [a.arg for a in (*n.args.posonlyargs, *n.args.args, *([n.args.vararg] if n.args.vararg else []), *n.args.kwonlyargs, *([n.args.kwarg] if n.args.kwarg else []))]
            bases = ", ".join(map(ast.unparse, n.bases)) if is_class else (ast.unparse(n.returns) if n.returns else "")
            found.append(Symbol(n.name, "class" if is_class else "function", n.lineno, True, summary(n), bases or None, None, [x for x in names if x not in ("self", "cls")]))
        elif isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name):
            name = n.targets[0].id
            if name == "__all__" and isinstance(n.value, ast.List | ast.Tuple):
                listed = {e.value for e in n.value.elts if isinstance(e, ast.Constant)}
            elif name.isupper():
                found.append(Symbol(name, "constant", n.lineno))
        elif isinstance(n, ast.Import):
            out.imports += [Import(a.name, [a.asname or a.name]) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            out.imports.append(Import("." * n.level + (n.module or ""), [a.name for a in n.names]))
    out.symbols = [s._replace(exported=s.name in listed if listed is not None else not s.name.startswith("_")) for s in found]
    out.exports = _exports(out.symbols)
    return out


def by_line(text: str, kinds: list[tuple[str, str]], exported: Callable[[re.Match], bool] = lambda m: True, comment: str | None = None, nested: tuple[str, ...] = ()) -> list[Symbol]:
    """A symbol for each line that a pattern fits, the first that does. comment: lines whose group doc describes the next symbol, if no other line comes between.

    Kinds in nested belong to the last symbol that is not of them.
    """
    out: list[Symbol] = []
    told, parent = None, None
    for i, line in enumerate(text.split("\n"), 1):
        note = comment and re.match(comment, line)
        if note:
            told = note["doc"].strip() or told
            continue
        for kind, pattern in kinds:
            m = re.match(pattern, line)
            if m:
                groups = m.groupdict()
                params = [re.split(r"[:=]", p)[0].strip().lstrip(".*&$") for p in (groups.get("params") or "").split(",") if p.strip()]
                out.append(Symbol(m["name"], kind, i, exported(m), told, groups.get("detail"), parent if kind in nested else None, params))
                parent = parent if kind in nested else m["name"]
                break
        if line.strip():
            told = None
    return out


HASH, SLASHES, DASHES = r"\s*#(?!!)\s*(?P<doc>.*)", r"\s*(?:///?|/\*\*?|\*(?!/))\s*(?P<doc>(?:(?!\*/).)*)", r"\s*--\s*(?P<doc>.*)"


@parser("yaml")
def yaml(text: str, path: str) -> Parsed:
    """Top-level keys, and what the file is for by words in it and its name."""
    symbols, low, base = by_line(text, [("property", r"(?P<name>[a-zA-Z_][\w-]*)\s*:")]), text.lower(), _base(path).lower()
    kind = re.search(r"kind:\s*(\S+)", text, re.I)
    #: Purposes in order, and what tells of them.
    purposes = (
        ("Ansible playbook", "hosts:" in low and "tasks:" in low),
        ("Ansible role configuration", "- role:" in low or "ansible.builtin" in low),
        ("Docker Compose file", "services:" in low and ("image:" in low or "build:" in low)),
        (f"Kubernetes {kind[1] if kind else 'resource'}", "apiversion:" in low and "kind:" in low),
        ("GitHub Actions workflow", ("on:" in low or "'on':" in low) and "jobs:" in low),
        ("Helm chart definition", base in ("chart.yaml", "chart.yml")),
        ("Helm values configuration", base in ("values.yaml", "values.yml")),
        ("GitLab CI/CD configuration", base == ".gitlab-ci.yml"),
        ("Travis CI configuration", base == ".travis.yml"),
        ("YAML configuration file", base.endswith((".yml", ".yaml"))),
    )
    return Parsed(symbols, [], [], next((p for p, hit in purposes if hit), None))


@parser("shell")
def shell(text: str, path: str) -> Parsed:
    kinds = [("function", r"\s*(?P<name>[a-zA-Z_]\w*)\s*\(\)\s*\{?"), ("function", r"\s*function\s+(?P<name>[a-zA-Z_]\w*)"), ("variable", r"\s*export\s+(?P<name>[A-Z_][A-Z0-9_]*)="), ("constant", r"\s*(?:readonly|declare\s+-r)\s+(?P<name>[A-Z_][A-Z0-9_]*)=")]
    lines = text.split("\n")
    bang = lines[0] if lines[0].startswith("#!") else ""
    sort = next((s for s in ("bash", "zsh", "sh") if s in bang), "shell")
    head = next((x for x in (line.strip() for line in lines[bool(bang) : 20]) if x), "")
    doc = re.match(r"#(?!!)\s*(.*)", head)
    return Parsed(by_line(text, kinds, comment=HASH), [], [], doc[1] if doc else f"{sort.capitalize()} script")


@parser("hcl")
def hcl(text: str, path: str) -> Parsed:
    """Blocks of the known kinds; a block's name is its word and labels, joined by dots."""
    #: Kinds by a block's first word.
    kinds = {"resource": "class", "data": "property", "variable": "variable", "output": "property", "module": "module", "provider": "namespace", "terraform": "namespace", "locals": "namespace"}
    found = by_line(text, [("block", rf'\s*(?P<name>(?P<detail>{"|".join(kinds)})\s+(?:"[^"]+"\s+)?(?:"[^"]+"\s*)?)\{{')], comment=r"\s*(?:#|//)[#/]*\s*(?P<doc>.*)")
    symbols = [s._replace(name=".".join([s.detail, *re.findall(r'"([^"]+)"', s.name)]), kind=kinds[s.detail]) for s in found]
    #: Descriptions by file name.
    named = {"main.tf": "Main Terraform configuration", "variables.tf": "Terraform variable definitions", "outputs.tf": "Terraform output definitions", "providers.tf": "Terraform provider configuration", "versions.tf": "Terraform version constraints", "backend.tf": "Terraform backend configuration"}
    return Parsed(symbols, [], [], named.get(_base(path), "HCL configuration" if path.endswith(".hcl") else "Terraform configuration"))


@parser("sql")
def sql(text: str, path: str) -> Parsed:
    """What CREATE statements make; unique indexes and altered tables are left out."""
    #: Kinds by what is created.
    kinds = {"table": "class", "view": "interface", "materialized view": "interface", "function": "function", "procedure": "function", "trigger": "function", "index": "property", "type": "type", "schema": "namespace", "sequence": "variable", "enum": "enum"}
    words = "|".join(k.replace(" ", r"\s+") for k in sorted(kinds, key=len, reverse=True))
    line = rf"(?i)\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?P<detail>{words})\s+(?:if\s+not\s+exists\s+)?[`\"']?(?P<name>[a-z_][a-z0-9_.]*)[`\"']?\s*(?=\(|as|;|\s)"
    found = by_line("\n".join(x.strip() + " " for x in text.split("\n")), [("made", line)], comment=DASHES)
    symbols = [s._replace(kind=kinds[" ".join(s.detail.lower().split())], detail=" ".join(s.detail.upper().split())) for s in found]
    tables, functions = sum(s.detail == "TABLE" for s in symbols), sum(s.kind == "function" for s in symbols)
    counted = ", ".join([f"{tables} tables"] * bool(tables) + [f"{functions} functions"] * bool(functions))
    doc = f"SQL {'schema' if tables else 'functions'} ({counted})" if counted else f"SQL definitions ({len(symbols)} objects)" if symbols else "SQL file"
    base = _base(path).lower()
    return Parsed(symbols, [], [], f"Database migration — {doc}" if "migration" in base or "migrate" in base else "Database seed data" if "seed" in base else doc)


@parser("markdown")
def markdown(text: str, path: str) -> Parsed:
    """Headings, and the first line of prose as description: no markup, badge, fence or rule, and either 20 characters or a full stop."""

    def bare(t: str) -> str:
        for pattern in (r"\[([^\]]*)\]\([^)]*\)", r"`([^`]*)`", r"\*\*([^*]*)\*\*", r"\*([^*]*)\*"):
            t = re.sub(pattern, r"\1", t)
        return t.strip()

    heads = by_line(text, [("property", r"(?P<detail>#{1,6})\s+(?P<name>.+)$")])
    symbols = [s._replace(name=bare(s.name.strip()), detail=f"h{len(s.detail)}") for s in heads]
    doc = None
    for line in (x.strip() for x in text.split("\n")):
        if not line or re.match(r"(?i)</?[a-z][^>]*>$|<!--|\[!\[|<img\s|<a\s|.*•.*<a\s|---|```|#{1,6}\s+.", line):
            continue
        told = re.sub(r"<[^>]+>", "", line).strip()
        if told and (len(told) >= 20 or "." in told):
            cut = told.rfind(" ", 0, 301)
            doc = told if len(told) <= 300 else told[: cut if cut > 200 else 300] + "..."
            break
    #: Descriptions by file name, where nothing else tells.
    named = {"readme.md": "Project README", "contributing.md": "Contributing guide", "changelog.md": "Project changelog", "license.md": "License information"}
    return Parsed(symbols, [], [], doc or (heads[0].name.strip() if heads else None) or named.get(_base(path).lower()))


def plain(text: str, path: str) -> Parsed:
    """No symbols; the first line that isn't blank, of the first ten, as description if it is a comment."""
    line = next((x for x in text.split("\n")[:10] if x.strip()), "")
    m = re.match(r"\s*(?:#|//|/\*\*?|--|<!--)\s*(.+)$", line)
    return Parsed(doc=m[1].strip() if m else None)


def _specifiers(clause: str) -> list[str]:
    """Names of an import clause: default, * as name, and what stands in braces, each by the name it has at its source."""
    braces = re.search(r"\{([^}]*)\}", clause, re.S)
    named = [re.split(r"\s+as\s+", x.strip().removeprefix("type "))[0] for x in (braces[1] if braces else "").split(",") if x.strip()]
    rest = [x.strip() for x in re.sub(r"\{[^}]*\}", "", clause, flags=re.S).split(",") if x.strip()]
    return [re.sub(r"\*\s+as\s+", "", x) for x in rest] + named


@parser("typescript", "javascript")
def typescript(text: str, path: str) -> Parsed:
    head, name = r"(?P<export>export\s+)?(?:default\s+)?(?:declare\s+)?", r"(?P<name>[A-Za-z_$][\w$]*)"
    arrow = rf"{head}(?:const|let)\s+{name}[^=]*=\s*(?:async\s*)?(?:\((?P<params>[^)]*)\)|\w+)\s*(?::[^=]+)?=>"
    kinds = [
        ("function", rf"{head}(?:async\s+)?function\*?\s+{name}\s*(?:<[^>]*>)?\s*(?:\((?P<params>[^)]*)\))?"), ("class", rf"{head}(?:abstract\s+)?class\s+{name}(?:<[^>]*>)?(?:\s+extends\s+(?P<detail>[\w.$]+))?"),
        ("interface", rf"{head}interface\s+{name}"), ("type", rf"{head}type\s+{name}\b[^=]*="), ("enum", rf"{head}(?:const\s+)?enum\s+{name}"), ("function", arrow), ("constant", rf"{head}const\s+{name}"),
    ]
    out = Parsed(by_line(text, kinds, lambda m: m["export"] is not None, SLASHES))
    out.exports = _exports(out.symbols)
    for m in re.finditer(r"(?m)^\s*import\s+(?:(type)\s+)?(?:([\w*{}\s,$]+?)\s+from\s+)?['\"]([^'\"]+)['\"]", text):
        out.imports.append(Import(m[3], _specifiers(m[2] or ""), m[1] is not None))
    for m in re.finditer(r"(?m)^\s*export\s+(?:type\s+)?(?:(\*)(?:\s+as\s+(\w+))?|\{([^}]*)\})(?:\s*from\s+['\"]([^'\"]+)['\"])?", text):
        names = [m[2] or "*"] if m[1] else [re.split(r"\s+as\s+", x.strip())[-1] for x in m[3].split(",") if x.strip()]
        out.exports += [Export(n, m[4] is not None, m[4]) for n in names]
    doc = re.match(r"\s*/\*\*\s*\n?\s*\*?\s*([^\n*].*?)\s*(?:\*/|\n)", text)
    out.doc = doc[1] if doc else None
    return out


@parser("go")
def go(text: str, path: str) -> Parsed:
    kinds = [
        ("function", r"func\s+(?P<name>\w+)\s*\((?P<params>[^)]*)\)"), ("method", r"func\s+\([^)]*?\*?(?P<detail>\w+)\)\s*(?P<name>\w+)\s*\((?P<params>[^)]*)\)"), ("class", r"type\s+(?P<name>\w+)\s+struct"),
        ("interface", r"type\s+(?P<name>\w+)\s+interface"), ("type", r"type\s+(?P<name>\w+)"), ("constant", r"const\s+(?P<name>\w+)"), ("variable", r"var\s+(?P<name>\w+)"),
    ]
    found = by_line(text, kinds, lambda m: m["name"][0].isupper(), SLASHES)
    symbols = [s._replace(parent=s.detail, parameters=[p.split(" ")[0] for p in s.parameters]) if s.kind == "method" else s._replace(parameters=[p.split(" ")[0] for p in s.parameters]) for s in found]
    blocks = [m[1] for m in re.finditer(r"(?m)^import\s*\(([^)]*)\)", text)] + [m[1] for m in re.finditer(r"(?m)^import\s+((?:[\w.]+\s+)?\"[^\"]+\")", text)]
    imports = [Import(m[2], [m[1] or m[2].rsplit("/", 1)[-1]]) for b in blocks for m in re.finditer(r"(?:([\w.]+)\s+)?\"([^\"]+)\"", b)]
    doc = re.search(r"(?m)^//\s*(Package .*)$", text)
    return Parsed(symbols, imports, _exports(symbols), doc[1] if doc else None)


@parser("rust")
def rust(text: str, path: str) -> Parsed:
    pub = r"\s*(?P<pub>pub(?:\([^)]*\))?\s+)?"
    words = (("class", "struct"), ("enum", "enum"), ("interface", "trait"), ("type", "type"), ("constant", "const"), ("constant", "static"))
    kinds = [("function", rf"{pub}(?:async\s+|unsafe\s+|const\s+)*fn\s+(?P<name>\w+)\s*(?:<[^>]*>)?\s*(?:\((?P<params>[^)]*)\))?"), *((k, rf"{pub}{w}\s+(?P<name>\w+)") for k, w in words)]
    symbols = by_line(text, kinds, lambda m: m["pub"] is not None, SLASHES)
    out = Parsed(symbols, [], _exports(symbols))
    for m in re.finditer(r"(?m)^\s*(pub\s+)?use\s+([\w:]+?)(?:::\{([^}]*)\}|::(\*))?(?:\s+as\s+(\w+))?\s*;", text):
        names = [x.strip() for x in m[3].split(",") if x.strip()] if m[3] else ["*"] if m[4] else [m[2].rsplit("::", 1)[-1]]
        out.imports.append(Import(m[2], names))
        out.exports += [Export(n, True, m[2]) for n in names] if m[1] else []
    doc = re.match(r"\s*//!\s*(.+)", text)
    out.doc = doc[1].strip() if doc else None
    return out


_MODIFIERS = r"\s*(?P<mods>(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|async|override|virtual|readonly)\s+)*)"
_METHOD = ("method", _MODIFIERS + r"(?!return\b|new\b|else\b|throw\b)[\w<>\[\], ?.]+\s+(?P<name>\w+)\s*\((?P<params>[^;)]*)\)?[^;]*\{?\s*$")


def _last_words(symbols: list[Symbol]) -> list[Symbol]:
    """Parameters that are written type first, by their names."""
    return [s._replace(parameters=[p.split()[-1] for p in s.parameters if p.split()]) for s in symbols]


@parser("java")
def java(text: str, path: str) -> Parsed:
    """Imports that are not static only bring types."""
    kinds = [("class", _MODIFIERS + r"(?:class|record)\s+(?P<name>\w+)"), ("interface", _MODIFIERS + r"@?interface\s+(?P<name>\w+)"), ("enum", _MODIFIERS + r"enum\s+(?P<name>\w+)"), _METHOD]
    symbols = _last_words(by_line(text, kinds, lambda m: "public" in m["mods"], SLASHES, ("method",)))
    imports = [Import(m[2], [m[2].rsplit(".", 1)[-1]], m[1] is None) for m in re.finditer(r"(?m)^\s*import\s+(static\s+)?([\w.*]+)\s*;", text)]
    return Parsed(symbols, imports, _exports(symbols))


@parser("csharp")
def csharp(text: str, path: str) -> Parsed:
    kinds = [
        ("namespace", r"\s*namespace\s+(?P<name>[\w.]+)"), ("class", _MODIFIERS + r"(?:class|record|struct)\s+(?P<name>\w+)"), ("interface", _MODIFIERS + r"interface\s+(?P<name>\w+)"),
        ("enum", _MODIFIERS + r"enum\s+(?P<name>\w+)"), ("property", _MODIFIERS + r"[\w<>\[\], ?.]+\s+(?P<name>\w+)\s*\{\s*get"), _METHOD,
    ]
    symbols = _last_words(by_line(text, kinds, lambda m: "mods" not in m.groupdict() or "public" in m["mods"], SLASHES, ("method", "property")))
    symbols = [s._replace(doc=re.sub(r"<[^>]+>", "", s.doc).strip() or None) if s.doc else s for s in symbols]
    imports = [Import(m[1], [m[1].rsplit(".", 1)[-1]]) for m in re.finditer(r"(?m)^\s*using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;", text)]
    return Parsed(symbols, imports, _exports(symbols))


@parser("ruby")
def ruby(text: str, path: str) -> Parsed:
    hidden = {x for m in re.finditer(r"(?m)^\s*private\s+(:.+)$", text) for x in re.findall(r":(\w+)", m[1])}
    kinds = [("class", r"\s*class\s+(?P<name>\w+)(?:\s*<\s*(?P<detail>[\w:]+))?"), ("namespace", r"\s*module\s+(?P<name>\w+)"), ("method", r"\s*def\s+(?:self\.)?(?P<name>\w+[?!]?)\s*(?:\((?P<params>[^)]*)\))?"), ("constant", r"\s*(?P<name>[A-Z][A-Z0-9_]+)\s*=")]
    symbols = by_line(text, kinds, lambda m: m["name"] not in hidden, HASH, ("method", "constant"))
    imports = [Import(("./" if m[1] and not m[2].startswith(".") else "") + m[2], []) for m in re.finditer(r"(?m)^\s*require(_relative)?\s*\(?\s*['\"]([^'\"]+)['\"]", text)]
    return Parsed(symbols, imports, _exports(symbols))


@parser("php")
def php(text: str, path: str) -> Parsed:
    kinds = [("class", r"\s*(?:abstract\s+|final\s+)*(?:class|trait)\s+(?P<name>\w+)(?:\s+extends\s+(?P<detail>[\w\\]+))?"), ("interface", r"\s*interface\s+(?P<name>\w+)"), ("enum", r"\s*enum\s+(?P<name>\w+)"), ("function", r"\s*(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+(?P<name>\w+)\s*\((?P<params>[^)]*)\)?")]
    symbols = by_line(text, kinds, lambda m: "private" not in m[0], SLASHES)
    symbols = [s._replace(parameters=[p.split()[-1].lstrip("$&.") for p in s.parameters if p.split()]) for s in symbols]
    out = Parsed(symbols, [], _exports(symbols))
    for m in re.finditer(r"(?m)^use\s+(?:function\s+|const\s+)?([\w\\]+?)(?:\\\{([^}]*)\})?(?:\s+as\s+(\w+))?\s*;", text):
        out.imports.append(Import(m[1], [x.strip().split(" as ")[0] for x in m[2].split(",") if x.strip()] if m[2] else [m[1].rsplit("\\", 1)[-1]]))
    return out


_SYMBOL = pa.struct([("name", pa.string()), ("kind", pa.string()), ("line", pa.int64()), ("exported", pa.bool_()), ("doc", pa.string()), ("detail", pa.string()), ("parent", pa.string()), ("parameters", pa.list_(pa.string()))])
_IMPORT = pa.struct([("source", pa.string()), ("names", pa.list_(pa.string())), ("type_only", pa.bool_())])
_EXPORT = pa.struct([("name", pa.string()), ("reexport", pa.bool_()), ("source", pa.string())])
PARSED = pa.schema([("path", pa.string()), ("language", pa.string()), ("symbols", pa.list_(_SYMBOL)), ("imports", pa.list_(_IMPORT)), ("exports", pa.list_(_EXPORT)), ("doc", pa.string())])
_DDL = (
    "path string, language string, symbols array<struct<name:string,kind:string,line:bigint,exported:boolean,doc:string,detail:string,parent:string,parameters:array<string>>>, "
    "imports array<struct<source:string,names:array<string>,type_only:boolean>>, exports array<struct<name:string,reexport:boolean,source:string>>, doc string"
)


def parsed(files: DataFrame) -> DataFrame:
    """(path, language, symbols, imports, exports, doc) of files (path, language, text); a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                p = parse(lang or "", text or "", path or "")
                told = lambda xs: [x._asdict() for x in xs]
                rows.append({"path": path, "language": lang, "symbols": told(p.symbols), "imports": told(p.imports), "exports": told(p.exports), "doc": p.doc})
            yield pa.RecordBatch.from_pylist(rows, PARSED)

    return files.select("path", "language", "text").mapInArrow(run, _DDL)


def symbols(files: DataFrame) -> DataFrame:
    """(path, language, sym_ordinal, name, kind, line, exported, doc, detail, parent, parameters)."""
    return symbols_of(parsed(files))


def symbols_of(found: DataFrame) -> DataFrame:
    return found.select("path", "language", F.posexplode("symbols").alias("sym_ordinal", "s")).select("path", "language", F.col("sym_ordinal").cast("bigint").alias("sym_ordinal"), "s.*")


def imports_of(found: DataFrame) -> DataFrame:
    """(src, import_ordinal, source, names, type_only) of parsed() files."""
    return found.select(F.col("path").alias("src"), F.posexplode("imports").alias("import_ordinal", "i")).select("src", "import_ordinal", "i.*")


def exports_of(found: DataFrame) -> DataFrame:
    return found.select("path", F.posexplode("exports").alias("export_ordinal", "e")).select("path", "export_ordinal", "e.*")
