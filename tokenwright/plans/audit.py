"""An audit: totals, findings and the measured rewrite of one set of requests."""

from __future__ import annotations

import os
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import counted_by
from ..operators import checks as C
from ..operators.rewrite import measure
from ..operators.summary import summary
from ..sources import files, records, tables


@dataclass
class Result:
    """What the reports and gates need; at most a few dozen rows."""

    summary: Row
    measured: Row
    findings: list[dict] = field(default_factory=list)
    backend: str = "approximate"
    exact: bool = False

    def visible(self, min_confidence: str = "judgement") -> Result:
        keep = [f for f in self.findings if f["conf_rank"] <= C.RANK[min_confidence]]
        return Result(self.summary, self.measured, keep, self.backend, self.exact)

    def total(self, confidence: str) -> int:
        return sum(f["tokens_saved"] for f in self.findings if f["confidence"] == confidence)

    @property
    def safe(self) -> int:
        return self.measured["saved"] + self.total("high")

    @property
    def pct(self) -> float:
        n = self.summary["input_tokens"]
        return self.safe / n * 100 if n else 0.0


class Audit:
    """Lazy frames over `requests`, and `run()` for the collected result.  `vocabulary` is a byte-pair
    vocabulary file for exact counts; without it counts are approximate."""

    def __init__(self, requests: DataFrame, weight: int = 1, settings: dict[str, dict] | None = None, vocabulary: str | None = None):
        self.vocabulary = vocabulary
        self.requests = requests.withColumn("weight", F.lit(weight).cast("long")) if weight > 1 else requests
        self.settings = settings or {}

    @classmethod
    def from_paths(cls, spark: SparkSession, paths: list[str], **more) -> Audit:
        return cls(files.load_inputs(spark, paths), **more)

    @classmethod
    def from_records(cls, spark: SparkSession, texts: list[str], source: str = "record", **more) -> Audit:
        rows = [(i, f"{source}:{i + 1}", t) for i, t in enumerate(texts)]
        return cls(records.from_records(spark.createDataFrame(rows, "ingest_seq long, source string, record string")), **more)

    @classmethod
    def from_table(cls, df: DataFrame, **more) -> Audit:
        return cls(tables.as_requests(df), **more)

    def findings(self) -> DataFrame:
        with counted_by(self.vocabulary):
            return C.findings(self.requests, self.settings)

    def summary(self) -> DataFrame:
        with counted_by(self.vocabulary):
            return summary(self.requests)

    def measured(self) -> DataFrame:
        with counted_by(self.vocabulary):
            return measure(self.requests)

    def run(self) -> Result | None:
        """The collected result; None without requests.  A check that fails becomes a finding."""
        held = self.requests.persist(StorageLevel.MEMORY_AND_DISK)
        with counted_by(self.vocabulary), _released(held):
            if held.isEmpty():
                return None
            p = C.prepare(held)
            found: list[dict] = []
            for k, (name, check) in enumerate(C.CHECKS.items()):
                try:
                    found += [{**r.asDict(), "check_ord": k} for r in check(p, **self.settings.get(name, {})).collect()]
                except Exception as why:  # noqa: BLE001
                    found.append(_failed(name, k, why))
            found.sort(key=lambda f: (f["conf_rank"], -f["tokens_saved"], f["check_ord"], f["emit_ord"]))
            return Result(summary(held).first(), measure(held).first(), found, backend_of(self.vocabulary), bool(self.vocabulary))


@contextmanager
def _released(held: DataFrame):
    try:
        yield
    finally:
        held.unpersist()


def backend_of(vocabulary: str | None) -> str:
    return f"byte-pair/{os.path.splitext(os.path.basename(vocabulary))[0]}" if vocabulary else "approximate"


def _failed(name: str, k: int, why: Exception) -> dict:
    return {
        "check": name, "title": "Check failed to run", "confidence": "judgement", "conf_rank": C.RANK["judgement"], "tokens_saved": 0, "calls_affected": 0,
        "detail": f"{type(why).__name__}: {str(why).splitlines()[0] if str(why) else ''}", "fix": "Report it with the input that causes it.", "evidence": [], "check_ord": k, "emit_ord": 0,
    }
