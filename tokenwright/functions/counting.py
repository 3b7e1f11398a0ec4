"""The approximate token count of many texts at once, over arrays of code points.

Stretches of one kind of character are found first; the chunks of the pattern in `tokens` follow from
neighbouring stretches, so that no chunk is taken out of its text."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_OTHER, _BLANK, _LETTER, _DIGIT, _MARK = range(5)  # other: the underscore, which is in no chunk
_KIND, _UPPER, _LOWER = 7, 8, 16
_BLANKS = (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_AT_ONCE = 1 << 16  # bytes of text, if one text isn't longer: arrays that stay in the cache are counted twice as fast as those of 1 MB


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Kind of each code point, with flags of the ASCII letters."""
    kinds = np.full(0x110000, _MARK, np.uint8)
    for c in range(0x110000):
        category = unicodedata.category(chr(c))
        if category == "Nd":
            kinds[c] = _DIGIT
        elif category[0] in "LN":
            kinds[c] = _LETTER
    kinds[list(_BLANKS)], kinds[ord("_")] = _BLANK, _OTHER
    kinds[ord("A") : ord("Z") + 1] |= _UPPER
    kinds[ord("a") : ord("z") + 1] |= _LOWER
    return kinds


def _blank(n: np.ndarray, lines: np.ndarray) -> np.ndarray:
    return np.maximum(1, lines + (n - lines + 2) // 3)


def _counted(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Tokens of the texts codes[bounds[i] : bounds[i + 1]]."""
    if not len(codes):
        return np.zeros(len(bounds) - 1, np.int64)
    flags = _kinds()[codes]
    kinds = flags & _KIND
    new = np.empty(len(codes), bool)
    new[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=new[1:])
    new[bounds[:-1][bounds[:-1] < len(codes)]] = True
    start = np.flatnonzero(new)
    n = np.diff(start, append=len(codes))
    kind = kinds[start]
    of_text = np.searchsorted(start, bounds)  # the first stretch of each text
    last = np.zeros(len(start) + 1, bool)
    last[of_text[1:] - 1] = True  # an empty text marks the end of the one before
    last = last[:-1]
    after = np.append(kind[1:], _OTHER)
    cost = np.zeros(len(start), np.int64)

    # white space before other text: the last blank goes with what follows or stands alone
    blank = np.flatnonzero(kind == _BLANK)
    inner = ~last[blank]
    taken = inner & (codes[start[blank] + n[blank] - 1] == 32) & (after[blank] != _OTHER)
    main = n[blank] - inner
    lines = np.flatnonzero(codes == 10)
    held = np.searchsorted(lines, start[blank] + main) - np.searchsorted(lines, start[blank])
    cost[blank] = np.where(main > 0, _blank(main, held), 0) + (inner & ~taken)
    led = np.zeros(len(start) + 1, bool)  # stretches that have a blank in front in their chunk
    led[blank[taken] + 1] = True

    # short forms: an apostrophe that begins its chunk takes one or two letters with it
    begin = start.copy()
    mark = np.flatnonzero(kind == _MARK)
    cost[mark] = (n[mark] + 1) // 2
    short = mark[(n[mark] == 1) & (codes[start[mark]] == 39) & ~led[mark] & ~last[mark] & (after[mark] == _LETTER)] + 1
    if len(short):
        a = codes[start[short]]
        b = np.where(n[short] > 1, codes[np.minimum(start[short] + 1, len(codes) - 1)], 0)
        two = ((a == ord("l")) & (b == ord("l"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("r")) & (b == ord("e")))
        begin[short] += np.where(np.isin(a, [ord(c) for c in "sdmt"]), 1, np.where(two, 2, 0))

    letter = kind == _LETTER
    size = n - (begin - start)
    word = np.where(size > 4, np.rint(size / 4).astype(np.int64), (size > 0).astype(np.int64))
    cost[letter] = word[letter]
    hump = np.flatnonzero((flags[1:] & _UPPER != 0) & (flags[:-1] & _LOWER != 0))  # a capital behind a small letter
    if len(hump):
        where = np.searchsorted(start, hump, "right") - 1
        within = (hump >= begin[where]) & (hump + 1 < start[where] + n[where]) & (size[where] > 4)
        np.add.at(cost, where[within], 1)
    digit = kind == _DIGIT
    cost[digit] = (n[digit] + 2) // 3
    sums = np.concatenate([[0], np.cumsum(cost)])
    return np.diff(sums[of_text])


def _slice(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Tokens of the UTF-8 texts of `data`, which end at `ends` (the first one is where data begins)."""
    at = ends - ends[0]
    if not len(data) or data.max() < 128:
        return _counted(data, at)
    whole = data.tobytes()
    try:
        codes = np.frombuffer(whole.decode("utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:  # malformed bytes: text by text, as they are read
        texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        return _counted(codes, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    places = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
    return _counted(codes, places[at])


def counts(texts: pa.Array) -> np.ndarray:
    """Tokens of each text; null counts 0."""
    texts = texts.cast(pa.large_string()) if texts.null_count == 0 else texts.cast(pa.large_string()).fill_null("")
    out = np.zeros(len(texts), np.int64)
    if not len(texts):
        return out
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + _AT_ONCE, "right")) - 1)
        out[i:j] = _slice(held[ends[i] : ends[j]], ends[i : j + 1])
        i = j
    return out


def counts_of_lists(lists: pa.Array) -> pa.Array:
    """Tokens of each text of each list; a null list stays null."""
    lists = lists.cast(pa.large_list(pa.large_string()))
    sizes = lists.value_lengths().fill_null(0)
    ends = np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False))]).astype(np.int32)
    kinds = lists.flatten().dictionary_encode()  # a message that is sent again, or a schema of many calls, is counted once
    tokens = pc.fill_null(pa.array(counts(kinds.dictionary)).take(kinds.indices), 0)
    return pa.ListArray.from_arrays(pa.array(ends), tokens, mask=lists.is_null() if lists.null_count else None)
