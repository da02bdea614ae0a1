"""Symbols and references out of source files, by a registry of extractors."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: label, name, qualified name, first and last line, doc; source, target, type, properties
Found = tuple[list[tuple], list[tuple]]
EXTRACTORS: dict[str, Callable[[str, str], Found]] = {}
NODE = "file_path string, label string, name string, qualified_name string, start_line long, end_line long, properties string, confidence double"
RAW = "file_path string, source_qname string, target_qname string, edge_type string, properties string"
LONGEST_SPAN = 400


def extractor(*languages: str):
    """Register a function (path, text) -> nodes and references for some languages."""

    def add(run):
        EXTRACTORS.update(dict.fromkeys(languages, run))
        return run

    return add


def brace_end(lines: list[str], start: int) -> int:
    """The line (from 1) on which the braces opened on or after ``start`` close; ``start`` itself if none do in LONGEST_SPAN lines."""
    depth, opened = 0, False
    for n, line in enumerate(lines[start - 1 : start - 1 + LONGEST_SPAN], start):
        for c in re.sub(r'"(\\.|[^"\\])*"|\'(\\.|[^\'\\])*\'|//.*', "", line):
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
                if opened and depth == 0:
                    return n
    return start


class _Python(ast.NodeVisitor):
    def __init__(self, path: str):
        self.path, self.owner, self.nodes, self.refs, self.within = path, [], [], [], [f"{path}::__file__"]

    def _define(self, node, label: str) -> None:
        name = f"{self.path}::{self.owner[-1] if self.owner else label}::{node.name}"
        self.nodes.append((label, node.name, name, node.lineno, node.end_lineno, ast.get_docstring(node) or ""))
        self.within.append(name)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._define(node, "Class")
        for base in node.bases:
            if isinstance(base, ast.Name):
                self.refs.append((self.within[-1], "", "TYPE_REF", {"type_name": base.id}))
        self.owner.append(node.name)
        self.generic_visit(node)
        self.owner.pop()
        self.within.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        self._define(node, "Method" if self.owner else "Function")
        kept, self.owner = self.owner, []
        self.generic_visit(node)
        self.owner = kept
        self.within.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Call(self, node: ast.Call) -> None:
        name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
        if name:
            self.refs.append((self.within[-1], "", "CALLS", {"callee_name": name}))
        self.generic_visit(node)

    def _import(self, module: str, names: list[ast.alias]) -> None:
        for x in names:
            path = "::".join([*module.split("."), x.name] if module else x.name.split("."))
            self.refs.append((self.within[0], "", "IMPORTS", {"imported_name": x.name.split(".")[-1], "path": path, "alias": x.asname or ""}))

    def visit_Import(self, node: ast.Import) -> None:
        self._import("", node.names)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        self._import(node.module or "", node.names)


@extractor("Python")
def python_symbols(path: str, text: str) -> Found:
    """Definitions, calls, bases and imports of a Python file, by its syntax tree."""
    visitor = _Python(path)
    visitor.visit(ast.parse(text))
    return visitor.nodes, visitor.refs


_BRACED = {
    "Rust": (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(fn|struct|enum|trait)\s+(\w+)", {"fn": "Function", "struct": "Class", "enum": "Enum", "trait": "Interface"}, r"^\s*use\s+([\w:]+)"),
    "Go": (r"^(func|type)\s+(?:\([^)]*\)\s*)?(\w+)", {"func": "Function", "type": "Class"}, r'^\s*(?:import\s+)?"([\w./-]+)"'),
    "Java": (r"^\s*(?:public|private|protected|static|final|abstract|\s)*(class|interface|enum)\s+(\w+)", {"class": "Class", "interface": "Interface", "enum": "Enum"}, r"^\s*import\s+(?:static\s+)?([\w.]+)"),
    "JavaScript": (r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(function|class)\s+(\w+)", {"function": "Function", "class": "Class"}, r"""^\s*import\s.*from\s+['"]([\w./@-]+)"""),
}
_BRACED["TypeScript"] = _BRACED["Tsx"] = _BRACED["JavaScript"]


def _braced(language: str) -> Callable[[str, str], Found]:
    pattern, labels, importing = _BRACED[language]
    head, imports = re.compile(pattern), re.compile(importing)

    def run(path: str, text: str) -> Found:
        lines, nodes, refs = text.split("\n"), [], []
        for n, line in enumerate(lines, 1):
            if m := head.match(line):
                label = labels[m[1]]
                nodes.append((label, m[2], f"{path}::{label}::{m[2]}", n, brace_end(lines, n), ""))
            elif m := imports.match(line):
                parts = [p for p in re.split(r"::|[./]", m[1]) if p]
                if parts:
                    refs.append((f"{path}::__file__", "", "IMPORTS", {"imported_name": parts[-1], "path": "::".join(parts)}))
        return nodes, refs

    return run


for _language in _BRACED:
    EXTRACTORS[_language] = _braced(_language)


def _rows(files: pd.DataFrame) -> Iterator[tuple[str, Found | None, float]]:
    for path, language, text in zip(files["rel_path"], files["language"], files["text"], strict=True):
        run = EXTRACTORS.get(language)
        if run is not None and text is not None:
            try:
                yield path, run(path, text), 1.0 if language == "Python" else 0.6
            except (SyntaxError, ValueError, RecursionError):
                yield path, None, 0.0


def nodes(files: DataFrame) -> DataFrame:
    """Definitions in files (rel_path, language, text), and a module node for each file that could be read."""

    def run(batches):
        for batch in batches:
            out = []
            for path, found, confidence in _rows(batch):
                if found is not None:
                    name = path.rsplit("/", 1)[-1].split(".")[0]
                    out.append((path, "Module", name, f"{path}::__file__", 1, 1, "{}", 1.0))
                    out += [(path, label, name, qname, a, b, json.dumps({"doc": doc}), confidence) for label, name, qname, a, b, doc in found[0]]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in NODE.split(", ")])

    return files.select("rel_path", "language", "text").mapInPandas(run, NODE)


def references(files: DataFrame) -> DataFrame:
    """Raw references in files, to be resolved by name."""

    def run(batches):
        for batch in batches:
            out = [(path, s, t, kind, json.dumps(props)) for path, found, _ in _rows(batch) if found is not None for s, t, kind, props in found[1]]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RAW.split(", ")])

    return files.select("rel_path", "language", "text").mapInPandas(run, RAW)


def failures(files: DataFrame) -> DataFrame:
    """Files whose extractor gave up: ``rel_path, reason``."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([(path, "failed") for path, found, _ in _rows(batch) if found is None], columns=["rel_path", "reason"])

    return files.select("rel_path", "language", "text").mapInPandas(run, "rel_path string, reason string")
