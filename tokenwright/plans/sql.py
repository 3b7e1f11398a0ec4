"""The same definitions as SQL text for an independent engine with RE2 regular expressions.

RE2 has no look-ahead.  Where white space precedes other text, chr(1) is put before the last blank,
which no pattern matches, so that the chunks come out the same."""

from __future__ import annotations

from ..functions.tokens import DIGITS, LETTERS, SHORT_FORMS, SPACE, WS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_MARKS = rf"[^{SPACE}\p{{L}}\p{{N}}_\x01]+"
_CHUNKS = quoted("|".join([SHORT_FORMS, f" ?{LETTERS}", f" ?{DIGITS}", f" ?{_MARKS}", f"{WS}+"]))


def tokens(x: str) -> str:
    """Tokens of a SQL string expression."""
    split = rf"regexp_replace({x}, '({WS})({WS}[^{SPACE}])', '\1' || chr(1) || '\2', 'g')"
    cost = rf"""CASE
        WHEN regexp_matches(c, '^(?: ?[\p{{L}}\p{{Nl}}\p{{No}}]|''[a-z])') THEN
            CASE WHEN length(ltrim(c, ' ')) <= 4 THEN 1 ELSE round_even(length(ltrim(c, ' ')) / 4.0, 0)::BIGINT + len(regexp_extract_all(c, '[a-z0-9][A-Z]')) END
        WHEN regexp_matches(c, '^{WS}+$') THEN greatest(1, length(c) - length(replace(c, chr(10), '')) + (length(replace(c, chr(10), '')) + 2) // 3)
        WHEN regexp_matches(c, '^ ?\p{{Nd}}') THEN (length(ltrim(c, ' ')) + 2) // 3
        ELSE (length(ltrim(c, ' ')) + 1) // 2 END"""
    return f"coalesce(list_sum(list_transform(regexp_extract_all({split}, {_CHUNKS}), lambda c: {cost})), 0)::BIGINT"


def flat(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'), ' ')"


def norm(x: str) -> str:
    return f"lower({flat(x)})"


def truncate(x: str, n: int = 88) -> str:
    return f"CASE WHEN length({flat(x)}) > {n} THEN left({flat(x)}, {n - 1}) || '…' ELSE {flat(x)} END"


def blocks(x: str) -> str:
    return rf"string_split(regexp_replace({x}, '\n{WS}*\n', chr(1), 'g'), chr(1))"


def sentences(x: str) -> str:
    return rf"string_split(regexp_replace(regexp_replace({x}, '([.!?]){WS}+', '\1' || chr(1), 'g'), '\n{{2,}}', chr(1), 'g'), chr(1))"


def units(x: str) -> str:
    ends = rf"regexp_replace({x}, '([.!?])({WS})', '\1' || chr(1) || '\2', 'g')"
    return f"string_split(replace({ends}, chr(10), chr(10) || chr(1)), chr(1))"


RESENT = """
    calls AS (
        SELECT a.conv_id, a.turn, a.conv_id * 100000 + a.turn AS seq, a.text AS completion,
               list(lower(b.role) ORDER BY b.turn) AS roles, list(b.text ORDER BY b.turn) AS texts
        FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn < a.turn
        WHERE lower(a.role) = 'assistant' AND b.text <> '' GROUP BY ALL)"""
