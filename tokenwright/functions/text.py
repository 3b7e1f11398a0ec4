"""Text helpers on string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import SPACE, WS

SENTENCE = rf"(?<=[.!?]){WS}+|\n{{2,}}"
BLOCK = rf"\n{WS}*\n"
UNIT = rf"(?<=[.!?])(?={WS})|(?<=\n)"


def flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def norm(text: Column) -> Column:
    """Runs of white space as one space, ends stripped, lower case (of each letter by itself)."""
    return F.lower(F.replace(F.replace(flat(text), F.lit("Σ"), F.lit("σ")), F.lit("İ"), F.lit("i")))


def norm_text(text: str) -> str:
    """`norm` of one text."""
    return " ".join(text.split()).replace("Σ", "σ").replace("İ", "i").lower()


def truncate(text: Column, n: int = 88) -> Column:
    short = flat(text)
    return F.when(F.length(short) > n, F.concat(F.substring(short, 1, n - 1), F.lit("…"))).otherwise(short)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+\\z", "")


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE, -1)


def blocks(text: Column) -> Column:
    return F.split(text, BLOCK, -1)


def units(text: Column) -> Column:
    """Sentence-like pieces that keep their separators."""
    return F.split(text, UNIT, -1)


def joined(messages: Column, keep=None) -> Column:
    """Contents of the messages that `keep` accepts, one a line."""
    chosen = F.filter(messages, keep) if keep else messages
    return F.array_join(F.transform(chosen, lambda m: m["content"]), "\n")


def full_text(messages: Column) -> Column:
    return joined(messages)


def system_text(messages: Column) -> Column:
    return joined(messages, lambda m: m["role"] == "system")


def other_text(messages: Column) -> Column:
    return joined(messages, lambda m: m["role"] != "system")


def common_prefix(a: Column, b: Column) -> Column:
    """Longest common prefix of two strings, by halving steps.

    Of a set of strings it is that of the smallest and the largest."""
    steps = F.array(*[F.lit(1 << k) for k in range(29, -1, -1)])
    most = F.least(F.length(a), F.length(b))
    size = F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= most) & (F.substr(a, F.lit(1), n + s) == F.substr(b, F.lit(1), n + s)), n + s).otherwise(n))
    return F.substr(a, F.lit(1), size)


__all__ = ["SPACE", "blocks", "common_prefix", "flat", "full_text", "joined", "norm", "norm_text", "other_text", "sentences", "strip", "system_text", "truncate", "units"]
