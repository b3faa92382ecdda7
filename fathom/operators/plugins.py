"""Plug-ins: extractors, passes, tools and reports in files that run only if a lock names their hash."""

from __future__ import annotations

import hashlib
import importlib.util
import json
import os

from pyspark.sql import DataFrame

from fathom.operators.extract import run


def digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def approve(folder: str) -> dict[str, str]:
    """Writes the lock: the hash of every plug-in file."""
    lock = {n: digest(os.path.join(folder, n)) for n in sorted(os.listdir(folder)) if n.endswith(".py")}
    with open(os.path.join(folder, "lock.json"), "w", encoding="utf-8") as f:
        json.dump(lock, f, indent=1)
    return lock


def trusted(folder: str) -> list[str]:
    """Files whose hash is the lock's; changed and unknown ones are left out."""
    lock_path = os.path.join(folder, "lock.json")
    if not os.path.exists(lock_path):
        return []
    with open(lock_path, encoding="utf-8") as f:
        lock = json.load(f)
    return [p for n, h in sorted(lock.items()) if os.path.exists(p := os.path.join(folder, n)) and digest(p) == h]


def loaded(path: str):
    spec = importlib.util.spec_from_file_location(f"plugin_{digest(path)[:8]}", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def extractor(rows, table: str, gate: str | None = None, suffixes: tuple[str, ...] = run.JVM):
    """Turns a function of one file (path, text) into rows of a native table into an engine's extractor."""

    def extract(corpus: DataFrame) -> dict[str, DataFrame]:
        found = run.table_function(corpus, lambda s: [{"source": "plugin"} | r for r in rows(s.path, s.text)], run.SCHEMAS[table], gate, suffixes)
        return {table: found}

    return extract
