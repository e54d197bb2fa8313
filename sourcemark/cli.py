"""python -m sourcemark.cli read --answer ... --context ...: one answer against its sources, on a local session."""

from __future__ import annotations

import argparse
import sys

from .functions.encoders import ModelEncoder, TrigramEncoder


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="sourcemark", description="Shows where to look in a generated answer. Gives no verdict.")
    read = out.add_subparsers(dest="command", required=True).add_parser("read", help="proofread one answer")
    read.add_argument("--answer", required=True, help="a file or the text")
    read.add_argument("--context", action="append", required=True, help="id=file, a file or a text; may be repeated")
    read.add_argument("--k", type=int, default=1, help="anchors that the floor averages; 0: by the answer's length")
    read.add_argument("--locale", default="und")
    read.add_argument("--model", help="a sentence-transformers model; without it words are compared by trigrams")
    read.add_argument("--json", action="store_true")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from .plans.proofread import proofread
    from .sources import sinks
    from .sources.evidence import case_rows, named_source, text_or_file

    spark = SparkSession.builder.getOrCreate()
    sources = [named_source(c, i) for i, c in enumerate(args.context)]
    cases = case_rows(spark, [("answer", text_or_file(args.answer), sources)], args.k, args.locale)
    found = proofread(cases, ModelEncoder(args.model) if args.model else TrigramEncoder(384), args.k, strict=True)
    if args.json:
        print(sinks.as_json(found).first().json)
    else:
        row = found.select("warnings").first()
        for w in row.warnings:
            print(f"warning: {w}", file=sys.stderr)
        print(sinks.summary(found).first().text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
