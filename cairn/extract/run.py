"""Runs a parser over a files DataFrame in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cairn.session import reach_workers

ROWS = 2000


def extract(files: DataFrame, parser: Callable[[str, str], Iterable[dict]], schema: str | StructType) -> DataFrame:
    """A row per dict that parser(path, text) yields; parsers raise for sources they can't read, which then give none."""
    reach_workers(files.sparkSession)
    kinds = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(kinds)

    def run(batches):
        rows: list[dict] = []
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                if text is None:
                    continue
                try:
                    rows += [{f.name: r.get(f.name) for f in arrow} for r in parser(path, text)]
                except (SyntaxError, ValueError, RecursionError, KeyError, TypeError, AttributeError):
                    continue
                if len(rows) >= ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("path", "text").mapInArrow(run, kinds)
