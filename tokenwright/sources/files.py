"""Prompt and log files.  The driver walks the paths, since Spark's own file sources skip names
that start with `_` or `.`; executors read and parse the files, spread by path."""

from __future__ import annotations

import os
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import records
from .tables import REQUESTS

TEXT = set(".j2 .jinja .jinja2 .markdown .md .prompt .prompts .template .tmpl .toml .txt .xml .yaml .yml".split())
LINES = {".jsonl", ".ndjson"}
KNOWN = TEXT | LINES | {".json"}
PRUNED = {"__pycache__", "build", "dist", "node_modules", "site-packages", "venv"}  # and all dot-directories
MOST_BYTES = 8 * 1024 * 1024
FILE_SEQ = 1 << 32  # a file's records are numbered within its own stretch


def _suffix(path: str) -> str:
    return os.path.splitext(path)[1].lower()


def walk(path: str) -> list[str]:
    """Files of a path: itself, or those of a directory with a known suffix, in path order."""
    if os.path.isfile(path):
        return [path]
    out = []
    for here, folders, names in os.walk(path):
        folders[:] = sorted(x for x in folders if not (x[0] == "." or x in PRUNED))
        out += [f"{here.rstrip('/')}/{name}" for name in sorted(names) if _suffix(name) in KNOWN]
    return out


def too_large(paths: list[str], most_bytes: int = MOST_BYTES) -> list[str]:
    """The files that `load_inputs` leaves out for their size."""
    return [f for path in paths if path != "-" and "://" not in path for f in walk(path) if os.path.getsize(f) > most_bytes]


def read_text(path: str, most_bytes: int = MOST_BYTES) -> str | None:
    """Text of a file of at most `most_bytes`, line ends as newlines; None where it can't be read.

    A file that was listed and isn't there is an error: this machine lacks the folder that the driver has."""
    try:
        if os.path.getsize(path) > most_bytes:
            return None
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read()
    except FileNotFoundError:
        raise
    except OSError:
        return None


def _line_requests(text: str, source: str):
    for number, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if line and not line.startswith("//"):
            got = records.request_of(records.parsed(line))
            if got:
                yield {"source": f"{source}:{number}", **got}


def _json_requests(text: str, source: str):
    value = records.parsed(text)
    items = [(f"{source}[{i}]", x) for i, x in enumerate(value)] if isinstance(value, list) else [(source, value)]
    for name, item in items:
        got = records.request_of(item)
        if got:
            yield {"source": name, **got}


def _template(text: str, source: str):
    if text.strip():
        yield {"source": source, "model": None, "completion": None, "messages": [{"pos": 0, "role": "system", "content": text}], "tools": [], "tools_called": []}


def requests_in(text: str, source: str, suffix: str):
    if suffix in LINES:
        return _line_requests(text, source)
    return _json_requests(text, source) if suffix == ".json" else _template(text, source)


def sniffed(text: str, source: str = "<stdin>"):
    """Requests of a text of unknown kind: log lines, JSON or a template."""
    if re.match(r"\s*[\[{]", text):
        return list(_line_requests(text, source)) or list(_json_requests(text, source))
    return list(_template(text, source))


def _numbered(rows, order: int) -> list[dict]:
    return [{"request_id": order * FILE_SEQ + i, "ingest_seq": order * FILE_SEQ + i, "weight": 1, **r} for i, r in enumerate(rows)]


def _read(most_bytes: int):
    def run(batches):
        for b in batches:
            for order, path in zip(b.column("ord").to_pylist(), b.column("path").to_pylist()):
                text = read_text(path, most_bytes)
                if text is not None:
                    yield records.batch(_numbered(requests_in(text, path, _suffix(path)), order))

    return run


def _decoded(batches):
    for b in batches:
        for order, path, raw in zip(*(b.column(c).to_pylist() for c in ("ord", "path", "content"))):
            text = raw.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
            yield records.batch(_numbered(requests_in(text, path, _suffix(path)), order))


def from_uri(spark: SparkSession, uri: str, order: int, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Requests of a file or folder of any file system that the session knows (s3a, hdfs, file).

    Spark lists it, so names that start with `_` or `.` are left out, and files are in no fixed order."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(uri).where(F.col("length") <= most_bytes)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    pruned = F.col("path").rlike(f"/(?:{'|'.join(sorted(PRUNED))})/")
    scheme = r"^[A-Za-z0-9+.-]+:/+"
    itself = F.regexp_replace("path", scheme, "") == F.lit(re.sub(scheme, "", uri))
    kept = found.where((suffix.isin(*sorted(KNOWN)) & ~pruned) | itself)
    numbered = kept.select((F.lit(order) + F.pmod(F.xxhash64("path"), F.lit(1 << 30))).cast("long").alias("ord"), "path", "content")
    return numbered.mapInArrow(_decoded, REQUESTS)


def load_inputs(spark: SparkSession, paths: list[str], stdin=None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Requests of files, directories, URIs and `-` for standard input, in the order of the arguments.

    Files of more than `most_bytes` are left out; `too_large` names them."""
    listed: list[tuple[int, str]] = []
    piped: list[dict] = []
    frames = []
    order = 0
    for path in paths or ["-"]:
        if path == "-":
            piped += _numbered(sniffed((stdin or sys.stdin).read()), order)
            order += 1
        elif "://" in path:
            frames.append(from_uri(spark, path, order, most_bytes))
            order += 1 << 30
        else:
            for found in walk(path):
                listed.append((order, found))
                order += 1
    if listed:
        table = spark.createDataFrame(listed, "ord long, path string")
        frames.append(table.repartition(min(len(listed), 4 * spark.sparkContext.defaultParallelism), "path").mapInArrow(_read(most_bytes), REQUESTS))
    if piped or not frames:
        frames.append(spark.createDataFrame(records.batch(piped).to_pylist(), REQUESTS))
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out
