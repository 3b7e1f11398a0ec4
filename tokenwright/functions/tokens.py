"""The approximate token count as a column.

Text falls into chunks by one leftmost-first pattern (short forms, letters, digits and marks with a blank
in front, white space), and each chunk has a cost by its kind.  Counts are made of whole Arrow batches, see
`counting`.  The character classes are spelled out so that Java, Python and RE2 read them alike.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import counting

SPACE = r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{SPACE}]"
LETTERS = r"[\p{L}\p{Nl}\p{No}]+"
DIGITS = r"\p{Nd}+"
SHORT_FORMS = "'(?:s|d|m|t|ll|ve|re)"
PER_REQUEST, PER_MESSAGE = 3, 4


_vocabulary: ContextVar[str | None] = ContextVar("vocabulary", default=None)


@contextmanager
def counted_by(vocabulary: str | None):
    """Plans made inside count exactly, with a byte-pair vocabulary file; None keeps the model."""
    token = _vocabulary.set(vocabulary)
    try:
        yield
    finally:
        _vocabulary.reset(token)


def _approximate(text: Column) -> Column:
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(counting.counts(texts), pa.int64())

    return F.arrow_udf(count, "long")(text)


def _approximates(texts: Column) -> Column:
    def count(lists: pa.Array) -> pa.Array:
        return counting.counts_of_lists(lists)

    return F.arrow_udf(count, "array<long>")(texts)


def counter() -> Callable[[pa.Array], np.ndarray]:
    """For functions over batches: tokens of each text, by the vocabulary that plans are made with."""
    return partial(_tokens_of, _vocabulary.get())


def _tokens_of(ranks: str | None, texts: pa.Array) -> np.ndarray:
    if not ranks:
        return counting.counts(texts)
    enc = _encoding(ranks)
    found = [_exact(enc, t) for t in texts.to_pylist()]
    return np.array([int(counting.counts(texts[i : i + 1])[0]) if n is None else n for i, n in enumerate(found)], np.int64)


def token_count(text: Column | str) -> Column:
    """Tokens of a string column; null counts 0.  A text that the exact count can't take is approximated."""
    text = F.col(text) if isinstance(text, str) else text
    ranks = _vocabulary.get()
    return F.coalesce(exact_count(text, ranks), _approximate(text)) if ranks else _approximate(text)


def token_counts(texts: Column) -> Column:
    """Tokens of each string of an array."""
    ranks = _vocabulary.get()
    if not ranks:
        return _approximates(texts)
    return F.zip_with(_exact_counts(texts, ranks), _approximates(texts), lambda n, m: F.coalesce(n, m))


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda acc, n: acc + n)


@lru_cache(maxsize=4)
def _encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    pattern = rf"{SHORT_FORMS}" r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _exact(enc, text: str | None) -> int | None:
    try:
        return len(enc.encode_ordinary(text)) if text else 0
    except Exception:  # noqa: BLE001 - counted by the model then
        return None


def exact_count(text: Column | str, ranks: str) -> Column:
    """Exact byte-pair tokens with the vocabulary file `ranks`; special tokens are ordinary text, and
    null is a text that can't be encoded."""
    def count(batch: pd.Series) -> pd.Series:
        enc = _encoding(ranks)
        return pd.Series([_exact(enc, t) for t in batch], dtype="Int64")

    return F.pandas_udf(count, "long")(text)


def _exact_counts(texts: Column, ranks: str) -> Column:
    def count(batch: pd.Series) -> pd.Series:
        enc = _encoding(ranks)
        return batch.map(lambda many: None if many is None else [_exact(enc, t) for t in many])

    return F.pandas_udf(count, "array<long>")(texts)


def framed(messages: Column) -> Column:
    """Tokens of a chat request: its messages' and the framing."""
    each = token_counts(F.transform(messages, lambda m: m["content"]))
    return F.lit(PER_REQUEST).cast("long") + F.size(messages) * PER_MESSAGE + total(each)


def framed_json(messages: Column) -> Column:
    """Tokens of a raw chat request, a JSON array of messages: content as a string or as parts with
    `text`, and the name of who speaks.  What is no object isn't counted."""
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit(""))
    at = lambda v, key, as_: F.try_variant_get(v, f"$.{key}", as_)
    text = lambda v, key: F.when(kind(at(v, key, "variant")) == "STRING", at(v, key, "string"))
    many = lambda v: F.coalesce(v, F.array().cast("array<variant>"))
    objects = F.filter(many(F.try_variant_get(F.try_parse_json(messages), "$", "array<variant>")), lambda m: kind(m).startswith("OBJECT"))
    parts = lambda m: F.transform(F.when(kind(at(m, "content", "variant")).startswith("ARRAY"), many(at(m, "content", "array<variant>"))).otherwise(F.array().cast("array<variant>")), lambda x: F.when(kind(x).startswith("OBJECT"), text(x, "text")))
    texts = F.flatten(F.transform(objects, lambda m: F.concat(F.array(text(m, "content"), text(m, "name")), parts(m))))
    return F.lit(PER_REQUEST).cast("long") + F.size(objects) * PER_MESSAGE + total(token_counts(F.filter(texts, lambda t: t.isNotNull())))
