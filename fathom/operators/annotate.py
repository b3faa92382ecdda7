"""Write-back: assertions, dismissals, insights and decisions, in files that people review."""

from __future__ import annotations

import json
import os
import re
from datetime import UTC, datetime

KINDS = {"kafka": ("topic", "direction"), "db": ("table", "mode"), "http_endpoint": ("method", "path"), "http_call": ("method", "path")}
ALLOWED = {"direction": ("produce", "consume"), "mode": ("read", "write", "rw")}
LEAST_INSIGHT, MOST_INSIGHT, LEAST_EVIDENCE = 40, 4000, 20


def _load(path: str) -> list[dict]:
    """The array in a file; a file that holds anything else is never overwritten."""
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as f:
        try:
            rows = json.load(f)
        except ValueError as e:
            raise ValueError(f"{path} is malformed; it is left as it is") from e
    if not isinstance(rows, list):
        raise ValueError(f"{path} holds no array; it is left as it is")
    return rows


def _save(path: str, rows: list[dict]) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump(rows, f, indent=2, ensure_ascii=False)
    os.replace(f"{path}.new", path)


def _key(row: dict) -> tuple:
    names = ("gap", "key") if row.get("kind") == "dismissal" else ("kind", "file", "line", *KINDS.get(row.get("kind", ""), ()))
    return ("dismissal" if row.get("kind") == "dismissal" else "edge", *[row.get(n) for n in names])


def assert_edge(path: str, row: dict, hashes: dict[str, str]) -> list[dict]:
    """Adds an assertion with evidence; one with the same key is replaced. hashes: of the files known."""
    kind = row.get("kind")
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {sorted(KINDS)}")
    missing = [n for n in ("file", "line", "evidence", *KINDS[kind]) if not row.get(n)]
    if missing:
        raise ValueError(f"missing: {', '.join(missing)}")
    if len(str(row["evidence"]).strip()) < LEAST_EVIDENCE:
        raise ValueError(f"evidence needs at least {LEAST_EVIDENCE} characters")
    for name, values in ALLOWED.items():
        if name in KINDS[kind] and row[name] not in values:
            raise ValueError(f"{name} must be one of {values}")
    if row["file"] not in hashes:
        raise ValueError(f"unknown file {row['file']}")
    row = {"confidence": "medium", "author": "unknown"} | row | {"source_hash": hashes[row["file"]], "asserted_at": datetime.now(UTC).isoformat()}
    rows = [r for r in _load(path) if _key(r) != _key(row)] + [row]
    _save(path, rows)
    return rows


def dismiss(path: str, gap: str, key: str, reason: str, author: str) -> list[dict]:
    row = {"kind": "dismissal", "gap": gap, "key": key, "reason": reason, "author": author, "dismissed_at": datetime.now(UTC).isoformat()}
    rows = [r for r in _load(path) if _key(r) != _key(row)] + [row]
    _save(path, rows)
    return rows


def retract(path: str, row: dict) -> list[dict]:
    rows = [r for r in _load(path) if _key(r) != _key(row)]
    _save(path, rows)
    return rows


def reaffirm(path: str, row: dict, hashes: dict[str, str]) -> list[dict]:
    """Moves an assertion's hash to the file's present text."""
    rows = [r | {"source_hash": hashes.get(r["file"])} if _key(r) == _key(row) else r for r in _load(path)]
    _save(path, rows)
    return rows


def insight(target: str, kind: str, summary: str, hash_: str, model: str = "") -> dict:
    """A row for the table of insights."""
    if kind not in ("module", "file", "topic", "table"):
        raise ValueError("kind must be module, file, topic or table")
    if len(summary.strip()) < LEAST_INSIGHT:
        raise ValueError(f"a summary needs at least {LEAST_INSIGHT} characters")
    return {"target": target, "kind": kind, "hash": hash_, "summary": summary.strip()[:MOST_INSIGHT], "model": model, "generated_at": datetime.now(UTC)}


def save_decision(folder: str, title: str, decision: str, context: str = "", supersedes: str = "", day: str | None = None) -> str:
    """Writes the next numbered record, and gives its path."""
    os.makedirs(folder, exist_ok=True)
    numbers = [int(m.group(1)) for n in os.listdir(folder) if (m := re.match(r"(?i)adr-(\d+)", n))]
    number = max(numbers, default=0) + 1
    slug = re.sub(r"[^a-z0-9]+", "-", title.lower()).strip("-")[:60]
    path = os.path.join(folder, f"ADR-{number:03d}-{slug}.md")
    lines = [f"# ADR-{number:03d}: {title}", "", "Status: accepted", f"Date: {day or datetime.now(UTC).date().isoformat()}"]
    lines += [f"Supersedes: {supersedes}"] * bool(supersedes) + ["", "## Context", context, "", "## Decision", decision, ""]
    with open(path, "x", encoding="utf-8") as f:
        f.write("\n".join(lines))
    return path
