"""A managed block in Markdown files of a repository that tells readers and tools of its catalog.

The block stands between two marker comments and is replaced in place; what stands around it is left alone.
It is written only where a build asks for it.
"""

from __future__ import annotations

import os
from pathlib import Path

# The markers, and the files that hold the block.
BEGIN, END = "<!-- BEGIN CAIRN KNOWLEDGE -->", "<!-- END CAIRN KNOWLEDGE -->"
FILES = ("AGENTS.md", "CLAUDE.md")


def block(catalog: str) -> str:
    return "\n".join([
        BEGIN,
        "## Repository knowledge",
        "",
        f"A compiled catalog of this repository lies at `{catalog}` (built per machine, not checked in).",
        "",
        f"- Build it: `python -m cairn.cli build . -o {catalog}`",
        f"- Find entities: `python -m cairn.cli query -k {catalog} \"words\"`",
        f"- Context for a question: `python -m cairn.cli context -k {catalog} --show \"question\"`",
        f"- Context with code: `python -m cairn.cli ask -k {catalog} --show \"question\"`",
        f"- Tables of databases: `python -m cairn.cli db -k {catalog}`",
        END,
    ])


def upsert(path: str | Path, text: str) -> str:
    """Puts the block into a file: `created` if there was none, else `updated`."""
    path = Path(path)
    if not path.exists():
        path.write_text(f"{text}\n", encoding="utf-8")
        return "created"
    old = path.read_text(encoding="utf-8")
    before, begin, rest = old.partition(BEGIN)
    _, end, after = rest.partition(END)
    if begin and end:
        new = before + text + after
    else:
        new = old.rstrip("\n") + "\n" * (2 if old.strip() else 0) + text + "\n"
    path.write_text(new, encoding="utf-8")
    return "updated"


def write(repo: str, catalog: str) -> dict[str, str]:
    """The files of repo with the block, and whether each was created or updated."""
    text = block(os.path.relpath(catalog, repo))
    return {name: upsert(Path(repo) / name, text) for name in FILES}
