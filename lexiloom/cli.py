"""Command line: identify a text given as arguments, or the lines of standard input as one text; the result is JSON.

Standard input counts up to the first line that is no UTF-8.
Exit status: 0 done, 1 the result can't be made or written, 2 wrong usage or a model that can't be loaded.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators.identify import identify, result_json
from .operators.options import IdentifyOptions


def lines(stream) -> list[str]:
    """The lines of a binary stream up to the first that can't be read as UTF-8."""
    out = []
    try:
        for line in stream:
            out.append(line.decode("utf-8").removesuffix("\n").removesuffix("\r"))
    except (UnicodeDecodeError, OSError):
        pass
    return out


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lexiloom", description=__doc__)
    parser.add_argument("--pretty", action="store_true", help="indent the JSON")
    parser.add_argument("--tokens", action="store_true", help="add tokens to the segments")
    parser.add_argument("--model", help="folder of a saved classifier")
    parser.add_argument("text", nargs="+", help="the text, or - for standard input")
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    text = "\n".join(lines(sys.stdin.buffer)) if args.text == ["-"] else " ".join(args.text)
    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
    df = spark.createDataFrame([(text,)], "text string")
    options = IdentifyOptions(tokenize=args.tokens)
    if args.model:
        from pyspark.ml import PipelineModel

        from .operators.ml import scores

        try:
            df = scores(PipelineModel.load(args.model), df)
        except Exception as e:
            print(f"the model can't be loaded: {e}", file=sys.stderr)
            return 2
        options = IdentifyOptions(tokenize=args.tokens, ml_scores="scores")
    try:
        print(identify(df, options=options).select(result_json(args.pretty)).first()[0])
    except Exception as e:
        print(f"no result: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
