"""Source trees as tables: scan, ignore rules, changes and import candidates."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that a scan skips. Fixed values.
IGNORED = [".git", "node_modules", "__pycache__", ".venv*", "venv*", "dist", "build"]
SCRIPT_SUFFIXES = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]


def ignored(path: Column, folders: list[str] | None = None, paths: list[str] | None = None) -> Column:
    """Whether a folder on the way, the path or its last part fits a pattern."""
    folders = IGNORED if folders is None else folders
    inside = F.lit(False)
    for pattern in folders:
        inside = inside | path.rlike("(^|/)" + _body(pattern) + "/")
    for pattern in paths or []:
        inside = inside | path.rlike("^" + _body(pattern) + "$") | path.rlike("(^|/)" + _body(pattern) + "$")
    return inside


def _body(pattern: str) -> str:
    """A glob as a regular expression that stays within one part of a path."""
    return re.sub(r"\\Z$|\\z$", "", fnmatch.translate(pattern).removeprefix("(?s:")).rstrip(")").replace(".*", "[^/]*")


def scan(spark: SparkSession, root: str, repo_id: str, suffixes: list[str]) -> DataFrame:
    """repo_id, path, content, hash of the files below ``root`` that are not ignored."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").split("://")[-1]) + "/", "")
    rows = files.select(F.lit(repo_id).alias("repo_id"), base.alias("path"), F.col("content").cast("string").alias("content"), F.md5("content").alias("hash"))
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | F.col("path").endswith(s)
    return rows.where(wanted & ~ignored(F.col("path")))


def changed(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files that are new or whose hash differs from the stored one."""
    old = stored.select("repo_id", "path", F.col("hash").alias("old"))
    return files.join(old, ["repo_id", "path"], "left").where("old IS NULL OR old <> hash").drop("old")


def vanished(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored files that are gone."""
    return stored.join(files, ["repo_id", "path"], "left_anti")


def python_candidates(path: str, module: str) -> list[str]:
    """Where a Python import may lead; leading dots climb from the file's own folder, none lead out of the root."""
    dots = len(module) - len(module.lstrip("."))
    parts = module.lstrip(".").split(".") if module.strip(".") else []
    if dots:
        folder = path.split("/")[:-1]
        if dots - 1 > len(folder):
            return []
        parts = folder[: len(folder) - (dots - 1)] + parts
    stem = "/".join(parts)
    return [stem, f"{stem}.py", f"{stem}/__init__.py"] if stem else ["__init__.py"]


def script_candidates(path: str, specifier: str) -> list[str]:
    """Where a script import may lead; ``@/``, ``~/`` and ``/`` start at the root, as do names without a leading dot."""
    s = re.split(r"[?#]", specifier.strip("'\" "))[0]
    if s.startswith(("@/", "~/")):
        parts = s[2:].split("/")
    elif s.startswith("/"):
        parts = s[1:].split("/")
    elif s.startswith("."):
        parts = path.split("/")[:-1] + s.split("/")
    else:
        parts = s.split("/")
    out: list[str] = []
    for p in parts:
        if p == "..":
            if not out:
                return []
            out.pop()
        elif p not in ("", "."):
            out.append(p)
    base = "/".join(out)
    if any(base.endswith(x) for x in SCRIPT_SUFFIXES):
        return [base]
    return [base, *(base + x for x in SCRIPT_SUFFIXES), *(f"{base}/index{x}" for x in SCRIPT_SUFFIXES)]


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """repo_id, path, target: each import (repo_id, path, module) with the files that it can mean."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [python_candidates(p, m) if p.endswith(".py") else script_candidates(p, m) for p, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["repo_id", "path", "targets"])

    distinct = imports.select("repo_id", "path", "module").dropna().distinct()
    wanted = distinct.mapInArrow(candidates, "repo_id string, path string, targets array<string>").select("repo_id", "path", F.explode("targets").alias("target"))
    return wanted.join(files.select("repo_id", F.col("path").alias("target")), ["repo_id", "target"]).select("repo_id", "path", "target").distinct()
