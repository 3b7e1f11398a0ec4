"""Command line: python -m tokenwright PATH..."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tokens import counted_by
from ..operators.checks import RANK
from ..operators.rewrite import rewrite_requests
from ..operators.summary import PRICE_IN, PRICE_OUT
from ..sources import files
from . import report
from .audit import Audit, Result

VERSION = "0.1.0"
FORMATS = "terminal markdown json".split()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(report.NAME, description="Audits what language-model prompts and request logs cost.", epilog="exit codes: 0 fine, 1 a gate was exceeded, 2 usage or no input")
    p.add_argument("paths", nargs="*", help="files, directories, or - for standard input")
    p.add_argument("-f", "--format", default=FORMATS[0], choices=FORMATS)
    p.add_argument("-o", "--output")
    p.add_argument("--price-in", type=float, default=PRICE_IN, help="US dollars per million input tokens")
    p.add_argument("--price-out", type=float, default=PRICE_OUT)
    p.add_argument("--calls", type=int, help="calls a month, for the projection")
    p.add_argument("--weight", type=int, default=1, help="calls that each record stands for")
    p.add_argument("--min-confidence", choices=tuple(RANK), default="judgement")
    p.add_argument("--vocabulary", default=os.environ.get("TOKENWRIGHT_RANKS"), help="byte-pair vocabulary file, for exact counts")
    p.add_argument("--approx", action="store_true", help="approximate counts, even where a vocabulary is given")
    p.add_argument("--fail-over-pct", type=float)
    p.add_argument("--fail-over-tokens", type=int)
    p.add_argument("--fix", metavar="DIR", help="write rewritten prompts")
    p.add_argument("--version", action="version", version=f"{report.NAME} {VERSION}")
    return p


def fixed_files(requests: DataFrame) -> DataFrame:
    """(file, text) of each request's rewrite; a name that recurs is numbered in input order."""
    m = rewrite_requests(requests).select("ingest_seq", "source", F.col("messages").alias("m"))
    base = F.substring_index(F.substring_index("source", ":", 1), "/", -1)
    m = m.withColumn("base", F.when(base == "", "stdin").otherwise(base))
    m = m.withColumn("nr", F.row_number().over(Window.partitionBy("base").orderBy("ingest_seq")))
    ext = F.regexp_extract("base", r"[^.](\.[^.]*)$", 1)
    stem = F.expr("substr(base, 1, length(base) - length(ext))")
    new = F.when(F.lower("ext").isin("", ".jsonl", ".ndjson", ".json"), ".txt").otherwise(F.col("ext"))
    name = F.concat(stem, F.when(F.col("nr") > 1, F.concat(F.lit("."), F.col("nr"))).otherwise(""), new)
    one = F.size("m") == 1
    body = F.array_join(F.transform("m", lambda x: F.when(one, x["content"]).otherwise(F.concat(F.lit("<<<"), x["role"], F.lit(">>>\n"), x["content"]))), "\n\n")
    return m.withColumn("ext", ext).select("ingest_seq", name.alias("file"), F.concat(body, F.lit("\n")).alias("text"))


def write_fixes(requests: DataFrame, where: str, vocabulary: str | None = None) -> int:
    """Writes the rewrites into a folder of this machine, a partition at a time."""
    os.makedirs(where, exist_ok=True)
    written = 0
    with counted_by(vocabulary):
        fixed = fixed_files(requests)
    for row in fixed.toLocalIterator():
        try:
            with open(os.path.join(where, row["file"]), "w", encoding="utf-8") as f:
                f.write(row["text"])
            written += 1
        except OSError:
            continue
    return written


def gate(r: Result, tokens: int | None, pct: float | None) -> str | None:
    """Why the run fails, if it does."""
    if tokens is not None and r.safe > tokens:
        return f"{r.safe:,} recoverable tokens are more than {tokens:,}"
    if pct is not None and r.summary["input_tokens"] and r.pct > pct:
        return f"{r.pct:.1f}% recoverable is more than {pct:.1f}%"
    return None


def main_exit() -> None:
    """Console script."""
    sys.exit(main())


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    for stream in (sys.stdout, sys.stderr):
        if hasattr(stream, "reconfigure"):
            stream.reconfigure(encoding="utf-8", errors="replace")
    a = parser().parse_args(argv)
    say = lambda x: print(f"{report.NAME}: {x}", file=sys.stderr)
    for option in ("weight", "calls"):
        if getattr(a, option) is not None and getattr(a, option) < 1:
            say(f"--{option} must be at least 1")
            return 2
    spark = spark or SparkSession.builder.appName(report.NAME).getOrCreate()
    vocabulary = None if a.approx else a.vocabulary
    if vocabulary and not os.path.isfile(vocabulary):
        say(f"can't read the vocabulary {vocabulary}")
        return 2
    left_out = files.too_large(a.paths)
    if left_out:
        say(f"{len(left_out)} file(s) of more than {files.MOST_BYTES:,} bytes left out: {', '.join(left_out[:5])}")
    audit = Audit.from_paths(spark, a.paths, weight=a.weight, vocabulary=vocabulary)
    result = audit.run()
    if result is None:
        say("no prompts or request records found; give files, a directory or standard input")
        return 2
    if a.fix:
        say(f"{write_fixes(audit.requests, a.fix, vocabulary)} rewritten file(s) in {a.fix}")
    shown = result.visible(a.min_confidence)
    money = {"price_in": a.price_in, "price_out": a.price_out, "calls": a.calls}
    if a.format == "terminal":
        text = report.terminal(shown, colour=not a.output and report.coloured(sys.stdout), **money)
    else:
        text = (report.markdown if a.format == "markdown" else report.as_json)(shown, **money)
    if a.output:
        try:
            with open(a.output, "w", encoding="utf-8") as f:
                f.write(text.rstrip("\n") + "\n")
        except OSError as why:
            say(f"can't write {a.output}: {why}")
            return 2
        say(f"wrote {a.output}")
    else:
        print(text)
    why = gate(shown, a.fail_over_tokens, a.fail_over_pct)
    if why:
        say(why)
    return 1 if why else 0
