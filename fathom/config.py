"""Settings of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field

#: fixed values: folders that hold no source of their own
SKIP_DIRS = (".git", "node_modules", "vendor", "dist", "build", "target", "__pycache__", ".venv", "venv", ".next", "coverage", ".idea", ".vscode")


@dataclass(frozen=True)
class Config:
    skip_dirs: tuple[str, ...] = SKIP_DIRS
    alias_prefixes: tuple[str, ...] = ("@/", "~/")
    extra_extensions: dict[str, str] = field(default_factory=dict)
    max_file_bytes: int = 1_500_000
    chunk_lines: int = 40
    test_patterns: tuple[str, ...] = ()
    production_patterns: tuple[str, ...] = ()
    table_name_overrides: dict[str, str] = field(default_factory=dict)
    max_rows: int = 50
    max_bytes: int = 24_000
    summary_threshold: int = 40
    max_diagram_nodes: int = 30
    max_doc_items: int = 60
