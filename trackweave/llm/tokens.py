"""Sizes in tokens of the byte-level tokenizer of ByT5 without special tokens: one token per UTF-8 byte."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def size(text: str | Column) -> Column:
    """Tokens of a text; null for a null text."""
    return F.octet_length(F.col(text) if isinstance(text, str) else text).cast("long")
