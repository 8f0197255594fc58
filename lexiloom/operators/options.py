"""Options of an identification."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class IdentifyOptions:
    """lexicon: a table (lang, rank, word), by default the seed.

    ml_scores: the name of a column array<struct<tag:string,conf:float>> with a classifier's scores of the row, and
    unsupported: the name of a column struct<label:string,conf:float> with its signal of an unsupported language.
    tokenize: whether segments carry tokens; segments: whether they are made at all.
    """

    lexicon: DataFrame | None = None
    ml_scores: str | None = None
    unsupported: str | None = None
    tokenize: bool = False
    segments: bool = True
