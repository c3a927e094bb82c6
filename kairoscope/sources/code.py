"""Source files to tables of classes, functions, imports and calls."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairoscope.sources.script import parse_script

ITEM = "array<struct<kind string, name string, qualified_name string, parent string, line int, column int, calls array<string>>>"


def _calls(node: ast.AST) -> list[str]:
    """Names called in a function's own body, first seen first; nested definitions keep theirs."""
    found: list[str] = []
    stack = list(reversed(list(ast.iter_child_nodes(node))))
    while stack:
        n = stack.pop()
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            continue
        if isinstance(n, ast.Call):
            name = n.func.id if isinstance(n.func, ast.Name) else n.func.attr if isinstance(n.func, ast.Attribute) else None
            if name and name not in found:
                found.append(name)
        stack.extend(reversed(list(ast.iter_child_nodes(n))))
    return found


def parse_python(content: str) -> list[tuple]:
    """kind, name, qualified name, parent, line, column, calls of a module; one row of kind error where it does not parse."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError) as e:
        return [("error", str(e)[:200], "", "", getattr(e, "lineno", 0) or 0, 0, [])]
    rows: list[tuple] = []

    def visit(node: ast.AST, owners: list[str]) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.Import):
                rows.extend(("import", a.name, a.name, "", n.lineno, n.col_offset, []) for a in n.names)
            elif isinstance(n, ast.ImportFrom):
                module = "." * n.level + (n.module or "")
                rows.append(("import", module, module, "", n.lineno, n.col_offset, []))
            elif isinstance(n, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                is_class = isinstance(n, ast.ClassDef)
                word = "class " if is_class else "async def " if isinstance(n, ast.AsyncFunctionDef) else "def "
                own = [*owners, n.name]
                rows.append(("class" if is_class else "function", n.name, ".".join(own), ".".join(owners), n.lineno, n.col_offset + len(word), [] if is_class else _calls(n)))
                visit(n, own)
                continue
            visit(n, owners)

    visit(tree, [])
    return rows


def parse_files(files: DataFrame) -> DataFrame:
    """repo_id, path and an item a row for (repo_id, path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            items = [parse_python(c or "") if p.endswith(".py") else parse_script(c or "") for p, c in zip(b["path"], b["content"], strict=True)]
            names = ("kind", "name", "qualified_name", "parent", "line", "column", "calls")
            yield pd.DataFrame({"repo_id": b["repo_id"], "path": b["path"], "items": [[dict(zip(names, r, strict=True)) for r in rows] for rows in items]})

    parsed = files.select("repo_id", "path", "content").mapInPandas(run, f"repo_id string, path string, items {ITEM}")
    return parsed.select("repo_id", "path", F.explode("items").alias("item")).select("repo_id", "path", "item.*")


def same_file_calls(items: DataFrame) -> DataFrame:
    """repo_id, path, caller, callee: calls of a name that exactly one other function of the file has."""
    f = items.where("kind = 'function'")
    unique = f.groupBy("repo_id", "path", F.col("name").alias("call")).agg(F.count("*").alias("n"), F.min("qualified_name").alias("callee")).where("n = 1").drop("n")
    calls = f.select("repo_id", "path", F.col("qualified_name").alias("caller"), F.explode("calls").alias("call"))
    return calls.join(unique, ["repo_id", "path", "call"]).where("caller <> callee").select("repo_id", "path", "caller", "callee").distinct()
