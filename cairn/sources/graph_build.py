"""Where the graph of a build comes from: a workspace that has one, a folder of graph files, or an external command.

These are steps of the driver over a checked-out repository and a few small files; no data passes through them.
"""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Sequence
from pathlib import Path

from .graph_json import ANALYSIS_FILE, LABELS_FILE, LoadError

GRAPH = "graph.json"
#: What belongs to a graph beside its file, by the endings of names.
BESIDE = (ANALYSIS_FILE, LABELS_FILE, "REPORT.md")


def run_command(command: Sequence[str], repo: str, folder: str) -> None:
    """Runs an external program that writes folder/graph.json; {repo} in its arguments stands for the repository."""
    argv = [part.replace("{repo}", repo) for part in command]
    if shutil.which(argv[0]) is None:
        raise LoadError(f"{argv[0]} isn't on the path: install it, or name a folder with {GRAPH}")
    try:
        done = subprocess.run(argv, cwd=repo, capture_output=True, text=True, check=False)
    except OSError as e:
        raise LoadError(f"{argv[0]} can't be started: {e}") from e
    if done.returncode:
        raise LoadError(f"{argv[0]} ended with {done.returncode}: {(done.stderr or done.stdout).strip()[-500:]}")
    if not (Path(folder) / GRAPH).is_file():
        raise LoadError(f"{argv[0]} wrote no {GRAPH} into {folder}")


def import_files(source: str, workspace: str) -> list[str]:
    """Copies the graph and what belongs to it into the workspace; their names."""
    Path(workspace).mkdir(parents=True, exist_ok=True)
    found = sorted(p.name for p in Path(source).iterdir() if p.is_file() and (p.name == GRAPH or p.name.endswith(BESIDE)))
    for name in found:
        shutil.copy2(Path(source) / name, Path(workspace) / name)
    return found


def ensure_graph(repo: str, workspace: str, source: str, command: Sequence[str] | None = None, rebuild: bool = False, keep_source: bool = False) -> dict:
    """Sees to it that the workspace holds a graph: its own, else that of source, else what the command writes there.

    A graph in the workspace is used again unless rebuild. A source folder that only this run made is deleted
    after its files are copied, unless keep_source. Returns what was done.
    """
    if (Path(workspace) / GRAPH).is_file() and not rebuild:
        return {"workspace": workspace, "cached": True, "ran_command": False, "imported": []}
    ran = False
    if rebuild or not (Path(source) / GRAPH).is_file():
        if not command:
            raise LoadError(f"there is no {GRAPH} in {source}, and no command that builds one")
        made = not Path(source).exists()
        run_command(command, repo, source)
        ran = True
    imported = import_files(source, workspace)
    if ran and made and not keep_source:
        shutil.rmtree(source, ignore_errors=True)
    return {"workspace": workspace, "cached": False, "ran_command": ran, "imported": imported}
