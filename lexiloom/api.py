"""What users import: identification of tables, lines and streams, tag helpers, and a function for SQL."""

from __future__ import annotations

from .functions.charsets import SINITIC, VARIANTS
from .functions.columns import normalized
from .operators.identify import identify, identify_lines, result_json
from .operators.labels import classifier_signals
from .operators.options import IdentifyOptions
from .sources.lexicon import corpus_lexicon, derived_lexicon, read_lexicon, read_word_lists, seed_lexicon
from .streaming.stream import identify_stream, language_mix

__all__ = [
    "IdentifyOptions", "classifier_signals", "corpus_lexicon", "derived_lexicon", "create_identified_view", "identify", "identify_json", "identify_lines", "identify_stream", "language_mix", "macro_of", "normalized", "read_lexicon", "read_word_lists", "register_functions", "result_json", "seed_lexicon", "variants_of",
]


def create_identified_view(spark, source: str, name: str, text_col: str = "text", options: IdentifyOptions = IdentifyOptions()) -> None:
    """A temporary view of a table or view with its rows' results and their JSON, for SQL and other languages' clients."""
    identify_json(spark.table(source), text_col, options).createOrReplaceTempView(f"{name}_json")
    identify(spark.table(source), text_col, options).createOrReplaceTempView(name)


def register_functions(spark) -> None:
    """SQL functions macro_of(tag) and variants_of(macro)."""
    listed = ", ".join(f"'{t}'" for t in SINITIC)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION macro_of(tag STRING) RETURNS STRING RETURN CASE WHEN tag IN ({listed}) THEN 'zh' ELSE tag END")
    cases = " ".join(f"WHEN '{m}' THEN array({', '.join(map(repr, v))})" for m, v in VARIANTS.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION variants_of(macro STRING) RETURNS ARRAY<STRING> RETURN CASE macro {cases} ELSE cast(array() AS ARRAY<STRING>) END")


def macro_of(tag: str) -> str:
    return "zh" if tag in SINITIC else tag


def variants_of(macro: str) -> list[str]:
    return list(VARIANTS.get(macro, []))


def identify_json(df, text_col: str = "text", options: IdentifyOptions = IdentifyOptions(), pretty: bool = False):
    """df with a column json, the whole result as one object."""
    held = df.columns
    return identify(df, text_col, options).select(*held, result_json(pretty).alias("json"))
