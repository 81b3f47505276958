"""Configuration and errors of a build."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from cairn.sources.files import MAX_BYTES, MAX_FILES

if TYPE_CHECKING:
    from pyspark.sql import DataFrame


class BuildError(Exception):
    """A pass of the build failed; the message names it."""


class ValidationError(BuildError):
    """A strict build found errors."""


@dataclass(frozen=True)
class Config:
    repo: str
    graph: str | None = None  # folder of graph.json; None: the graph follows from the sources
    workspace: str | None = None  # folder that keeps the graph for later builds
    graph_command: tuple[str, ...] | None = None  # program that writes the graph's folder, {repo} being the repository
    rebuild: bool = False  # run the command even if there is a graph
    agents_doc: bool = False  # write the managed block into the repository's Markdown files
    output: str | None = None
    strict: bool = False
    builder_version: str = "1"
    min_cohesion: float = 0.15
    max_module_size: int = 60
    max_files: int | None = MAX_FILES  # None: no limit
    max_bytes: int | None = MAX_BYTES


@dataclass
class Diagnostics:
    """What a build reports: (level, pass, message), seconds and figures by pass, and all issues.

    issues (level, code, message) is whole, as is its count by level and code; rows has the first ones of each
    code and a line with the number of the rest. With an output, the issues are stored in its folder `issues`.
    """

    rows: list[tuple[str, str, str]] = field(default_factory=list)
    seconds: dict[str, float] = field(default_factory=dict)
    counts: dict[tuple[str, str], int] = field(default_factory=dict)
    stats: dict[str, dict] = field(default_factory=dict)
    issues: DataFrame | None = None

    def add(self, level: str, name: str, message: str) -> None:
        self.rows.append((level, name, message))
