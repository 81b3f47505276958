"""Token counts with a public tokenizer file, or a stated approximation where none is given."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

APPROXIMATION = "words-and-marks"
TOKENIZER_VARIABLE = "CAIRN_TOKENIZER"


def tokenizer_name(path: str | None = None) -> str:
    path = path or os.environ.get(TOKENIZER_VARIABLE)
    return os.path.basename(path) if path else APPROXIMATION


def approximate_tokens(text: Column) -> Column:
    """Runs of up to four letters or digits, and single marks: about what a byte-pair encoding gives for code."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]{1,4}|[^\s\p{L}\p{N}_]")), F.lit(0)).cast("long")


def count_tokens(text: Column, path: str | None = None) -> Column:
    path = path or os.environ.get(TOKENIZER_VARIABLE)
    if not path:
        return approximate_tokens(text)

    def count(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return pd.Series([len(x.ids) for x in t.encode_batch_fast(texts.fillna("").tolist(), add_special_tokens=False)], dtype="int64")

    return F.pandas_udf(count, LongType())(text)
