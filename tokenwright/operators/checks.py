"""The checks: each reads prepared requests and returns a frame of findings.

A check is one lazy plan: grouped sums, windows and top-k lists, ending in few rows.  Thresholds
are parameters.  Amounts are tokens, weighted by how many calls a request stands for."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.tokens import WS, counter, framed, token_count, token_counts, total
from .rewrite import blobs

RANK = {"certain": 0, "high": 1, "judgement": 2}
FINDINGS = "check string, title string, confidence string, conf_rank int, tokens_saved bigint, calls_affected bigint, detail string, fix string, evidence array<string>, check_ord int, emit_ord bigint"
DISCOUNT = 0.5
CACHE_FLOOR = 1024
# as in functions.text, for functions over batches
_BLOCK, _SENTENCE = re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?])\s+|\n{2,}")
_LINE_ENDS, _BLANK_LINES, _RUN = re.compile(r"(?m)[ \t]+$"), re.compile("\n{3,}"), re.compile("[ \t]{2,}")


def prepare(requests: DataFrame) -> DataFrame:
    """Adds the texts that the checks read."""
    m = F.col("messages")
    return requests.withColumns({"full_text": X.full_text(m), "system_text": X.system_text(m), "other_text": X.other_text(m)})


def _n(c: Column | str) -> Column:
    return F.format_number(F.col(c) if isinstance(c, str) else c, 0)


def _found(df: DataFrame, check: str, confidence: str, saved, affected, title: Column, detail: Column, fix: str, evidence, order=None) -> DataFrame:
    return df.select(
        F.lit(check).alias("check"), title.alias("title"), F.lit(confidence).alias("confidence"), F.lit(RANK[confidence]).alias("conf_rank"),
        F.col(saved).cast("long").alias("tokens_saved") if isinstance(saved, str) else saved.cast("long").alias("tokens_saved"),
        (F.col(affected) if isinstance(affected, str) else affected).cast("long").alias("calls_affected"),
        detail.alias("detail"), F.lit(fix).alias("fix"), evidence.cast("array<string>").alias("evidence"),
        F.lit(0).alias("check_ord"), (order if order is not None else F.lit(0)).cast("long").alias("emit_ord"),
    )


def _top(k: int, order: list[Column], line: Column) -> Column:
    """The first k lines by `order`, as an aggregate over rows that a limit has made few before."""
    ranked = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], line.alias("line"))
    return F.transform(F.slice(F.sort_array(F.collect_list(ranked)), 1, k), lambda x: x["line"])


def _first_lines(df: DataFrame, k: int, order: list[Column], line: Column) -> DataFrame:
    """One row: the first k lines of df by order (a top-k, then an aggregate of those k rows)."""
    at = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    few = df.select(at.alias("at"), line.alias("line")).orderBy("at").limit(k)
    return few.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]).alias("evidence"))


def shared_prefix(p: DataFrame, min_chars: int = 64, cache_floor: int = CACHE_FLOOR, min_tokens: int = 128, min_calls: int = 3) -> DataFrame:
    """Opening text that all requests of a model share: cacheable, or too short for that."""
    t = F.when(F.col("full_text") != "", F.col("full_text"))
    g = p.groupBy("model").agg(F.count(F.lit(1)).alias("records"), F.sum("weight").alias("w"), F.count(t).alias("texts"), F.min(t).alias("lo"), F.max(t).alias("hi"), F.min("ingest_seq").alias("first"))
    g = g.where("records >= 2 and w >= 2 and texts >= 2").withColumn("prefix", X.common_prefix(F.col("lo"), F.col("hi")))
    g = g.where(F.length("prefix") >= min_chars).withColumn("t", token_count("prefix")).drop("lo", "hi")
    cached = g.where(F.col("t") >= cache_floor)
    saved = F.floor(F.col("t") * F.col("w") - (F.col("t") + F.col("t") * (F.col("w") - 1) * (1 - DISCOUNT)))
    of_model = F.when(F.coalesce(F.col("model"), F.lit("")) != "", F.concat(F.lit(" of model "), F.col("model"))).otherwise("")
    a = _found(
        cached, "cacheable-prefix", "high", saved, "w",
        F.concat(F.lit("The first "), _n("t"), F.lit(" tokens"), of_model, F.lit(" are the same in every call and not cached")),
        F.concat(_n("w"), F.lit(" calls open with the same text of "), _n("t"), F.lit(" tokens, long enough for prompt caching, and pay the full price each time.")),
        "Turn on prompt caching for this opening and keep everything that varies behind it. Half price for cached reads is assumed.",
        F.array(X.truncate(F.col("prefix"), 160)), F.col("first"),
    )
    short = g.where((F.col("t") < cache_floor) & (F.col("t") >= min_tokens) & (F.col("w") >= min_calls))
    b = _found(
        short, "stable-prefix-below-cache-floor", "judgement", F.col("t") * (F.col("w") - 1), "w",
        F.lit("A shared opening is too short to be cached"),
        F.concat(_n("w"), F.lit(" calls share an opening of "), _n("t"), F.lit(f" tokens, below the {cache_floor} that caching usually asks for.")),
        "Move more of the fixed text to the front until caching applies, or make the opening shorter.",
        F.array(X.truncate(F.col("prefix"))), F.col("first"),
    )
    return a.unionByName(b)


def repeated_system(p: DataFrame, min_tokens: int = 50, min_redundant: int = 200) -> DataFrame:
    """The system prompt that most calls send again."""
    s = p.withColumn("s", X.strip(F.col("system_text"))).where("s <> ''").withColumn("key", X.norm(F.col("s")))
    g = s.groupBy("key").agg(F.sum("weight").alias("w"), F.min_by("s", "ingest_seq").alias("s"), F.min("ingest_seq").alias("first")).withColumn("t", token_count("s"))
    g = g.where((F.col("w") >= 2) & (F.col("t") >= min_tokens) & (F.col("t") * (F.col("w") - 1) >= min_redundant)).orderBy(F.desc("w"), "first").limit(1)
    return _found(
        g, "repeated-system-prompt", "high", F.floor(F.col("t") * (F.col("w") - 1) * DISCOUNT), "w",
        F.concat(F.lit("One system prompt of "), _n("t"), F.lit(" tokens goes out with "), _n("w"), F.lit(" calls")),
        F.concat(F.lit("It costs "), _n(F.col("t") * F.col("w")), F.lit(" tokens in all, of which "), _n(F.col("t") * (F.col("w") - 1)), F.lit(" are repeats.")),
        "Cache the prompt, then shorten it: rules that no longer earn their place can go. Only caching at half price is counted here.",
        F.array(X.truncate(F.col("key"), 160)),
    )


def _keys_of(text: str | None, min_chars: int) -> list[tuple[int, str, str]]:
    """(place, digest, normal form) of the paragraphs that are long enough."""
    keys = [(i, X.norm_text(b)) for i, b in enumerate(_BLOCK.split(text)) if len(b) >= min_chars] if text and len(text) >= min_chars else []
    return [(i, hashlib.md5(k.encode(), usedforsecurity=False).hexdigest(), k) for i, k in keys if len(k) >= min_chars]


def _blocks(min_chars: int):
    """One row for each paragraph of a request, with its first place and how often it stands there."""

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for rid, seq, w, text in zip(*(b.column(c).to_pylist() for c in ("request_id", "ingest_seq", "weight", "other_text"))):
                held: dict[str, list[int]] = {}
                for i, digest, _ in _keys_of(text, min_chars):
                    held.setdefault(digest, [i, 0])[1] += 1
                for digest, (i, n) in held.items():
                    for column, x in zip(out, (digest, rid, seq, i, n, w)):
                        column.append(x)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["hash", "request_id", "ingest_seq", "i", "n", "weight"])

    return run


def _block_texts(min_chars: int):
    def run(batches):
        for b in batches:
            found = {digest: key for text in b.column("other_text").to_pylist() for _, digest, key in _keys_of(text, min_chars)}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.string())], names=["hash", "key"])

    return run


def duplicate_blocks(p: DataFrame, min_chars: int = 80, top: int = 40, min_tokens: int = 24, min_wasted: int = 40, min_total: int = 100) -> DataFrame:
    """Paragraphs outside the system prompt that several requests hold."""
    rows = p.select("request_id", "ingest_seq", "weight", "other_text")
    # digests are grouped, not texts; of the top ones, the text is fetched by a second look at the requests that hold them first
    one = rows.mapInArrow(_blocks(min_chars), "hash string, request_id long, ingest_seq long, i int, n long, weight long")
    one = one.groupBy("hash", "request_id").agg(F.sum("n").alias("n"), F.first("weight").alias("w"), F.min(F.struct("ingest_seq", "i")).alias("at"))
    g = one.groupBy("hash").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.min("at").alias("at")).orderBy(F.desc("n"), "at").limit(top)
    holders = g.select(F.col("at.ingest_seq").alias("holder")).distinct()
    first = rows.join(F.broadcast(holders), F.col("ingest_seq").eqNullSafe(F.col("holder")), "left_semi")
    texts = first.mapInArrow(_block_texts(min_chars), "hash string, key string").join(F.broadcast(g.select("hash")), "hash", "left_semi").groupBy("hash").agg(F.min("key").alias("key"))  # at most `top` rows
    g = g.where("n >= 2").join(texts, "hash").withColumn("t", token_count("key")).withColumn("wasted", F.col("t") * (F.col("w") - 1)).where((F.col("t") >= min_tokens) & (F.col("wasted") >= min_wasted))
    line = F.concat(F.lit("x"), F.col("w"), F.lit(" ("), F.col("t"), F.lit(" tok): "), X.truncate(F.col("key")))
    out = g.agg(F.sum("wasted").alias("saved"), F.max("w").alias("w"), _top(4, [-F.col("n"), F.col("at")], line).alias("evidence")).where(F.col("saved") >= min_total)
    return _found(
        out, "duplicate-blocks", "certain", "saved", "w", F.lit("The same paragraphs are sent in several requests"),
        F.concat(_n("saved"), F.lit(" tokens repeat paragraphs that other requests hold too, outside the shared opening.")),
        "Keep such a paragraph in one constant, put it into the cached opening, and delete second copies within a request.",
        F.col("evidence"),
    )


def _partial(k: int):
    """Sums and first k lines of a partition, one row."""

    def run(batches):
        saved = w = 0
        few: list[tuple[int, str]] = []
        for b in batches:
            if not b.num_rows:
                continue
            seq, weight = b.column("ingest_seq").to_numpy(), b.column("weight").to_numpy()
            saved += int((b.column("delta").to_numpy() * weight).sum())
            w += int(weight.sum())
            near = np.flatnonzero(seq <= np.partition(seq, min(k, len(seq)) - 1)[min(k, len(seq)) - 1])
            lines = b.column("line").take(pa.array(near)).to_pylist()
            few = sorted([*few, *zip(seq[near].tolist(), lines)], key=lambda x: (x[0], x[1] or ""))[:k]
        if w:
            kind = pa.list_(pa.struct([("at", pa.int64()), ("line", pa.string())]))
            yield pa.RecordBatch.from_arrays([pa.array([saved], pa.int64()), pa.array([w], pa.int64()), pa.array([[{"at": a, "line": x} for a, x in few]], kind)], names=["saved", "w", "few"])

    return run


def _per_request(rows: DataFrame, min_total: int, line: Column, k: int = 3) -> DataFrame:
    """One row (saved, w, evidence) of rows with `delta` and `weight`, above the floor.

    Rows are counted once: a partition gives its sums and its first k lines in one row."""
    small = rows.select("ingest_seq", F.col("delta").cast("long").alias("delta"), F.col("weight").cast("long").alias("weight"), line.alias("line"))
    parts = small.mapInArrow(_partial(k), "saved long, w long, few array<struct<at:long,line:string>>")
    lines = F.slice(F.sort_array(F.flatten(F.collect_list("few"))), 1, k)  # k of each partition
    out = parts.agg(F.sum("saved").alias("saved"), F.sum("w").alias("w"), F.transform(lines, lambda x: x["line"]).alias("evidence"))
    return out.where(F.col("saved") >= min_total)


def slack_free(text: str) -> str:
    """No blanks at line ends, at most one blank line, single blanks."""
    if " \n" in text or "\t\n" in text or text.endswith((" ", "\t")):
        text = _LINE_ENDS.sub("", text)
    if "\n\n\n" in text:
        text = _BLANK_LINES.sub("\n\n", text)
    return _RUN.sub(" ", text) if "  " in text or "\t" in text else text


def _deltas(find, more_than: int = 0):
    """For mapInArrow: rows whose `delta` is above `more_than`, of find(texts) -> {row: (delta, mark)}; each text is read once."""

    def run(batches):
        for b in batches:
            found = {i: x for i, x in find(b.column("full_text").to_pylist()).items() if x[0] > more_than}
            at = pa.array(list(found), pa.int64())
            held = [b.column(c).take(at) for c in ("ingest_seq", "source", "weight")]
            yield pa.RecordBatch.from_arrays([*held, pa.array([x[0] for x in found.values()], pa.int64()), pa.array([x[1] for x in found.values()], pa.string())], names=["ingest_seq", "source", "weight", "delta", "mark"])

    return run


def _gains(p: DataFrame, find, more_than: int = 0) -> DataFrame:
    return p.select("ingest_seq", "source", "weight", "full_text").mapInArrow(_deltas(find, more_than), "ingest_seq long, source string, weight long, delta long, mark string")


def _slack(count):
    def find(texts):
        slim = [(i, t, c) for i, t in enumerate(texts) if t and (c := slack_free(t)) != t]
        gain = count(pa.array([t for _, t, _ in slim], pa.string())) - count(pa.array([c for _, _, c in slim], pa.string()))
        return {i: (int(n), None) for (i, _, _), n in zip(slim, gain)}

    return find


def whitespace_bloat(p: DataFrame, min_total: int = 25) -> DataFrame:
    """White space that tells the model nothing."""
    r = _gains(p, _slack(counter()))
    out = _per_request(r, min_total, F.concat(F.col("source"), F.lit(": "), F.col("delta"), F.lit(" tok/call")))
    return _found(
        out, "whitespace-bloat", "certain", "saved", "w", F.lit("Blanks at line ends, empty lines and padding"),
        F.concat(_n("saved"), F.lit(" tokens are white space only: line-end blanks, runs of empty lines, aligned columns.")),
        "Normalise white space where prompts are built; the model's answers don't depend on it.", F.col("evidence"),
    )


def _indented(count, min_gain: int):
    def find(texts):
        held = [(i, t[a:b], small) for i, t in enumerate(texts) if t for a, b, small in blobs(t)]
        gain = count(pa.array([x for _, x, _ in held], pa.string())) - count(pa.array([x for _, _, x in held], pa.string()))
        out: dict[int, tuple[int, None]] = {}
        for (i, _, _), n in zip(held, gain.tolist()):
            if n > min_gain:
                out[i] = (out[i][0] + n if i in out else n, None)
        return out

    return find


def pretty_json(p: DataFrame, min_gain: int = 8, min_total: int = 25) -> DataFrame:
    """Indented JSON that could be compact."""
    r = _gains(p, _indented(counter(), min_gain))
    out = _per_request(r, min_total, F.concat(F.col("source"), F.lit(": "), F.col("delta"), F.lit(" tok/call")))
    return _found(
        out, "pretty-printed-json", "certain", "saved", "w", F.lit("JSON is sent with indentation"),
        F.concat(_n("saved"), F.lit(" tokens are the indentation and line ends of JSON values.")),
        "Serialise without blanks; models read compact JSON as well.", F.col("evidence"),
    )


_EDGE = r"\b"


def _opt(text: str) -> str:
    return f"(?:{text})?"


_NICE = "(?:" + "|".join(sorted(("useful", "helpful", "friendly"))) + ")"
# (pattern between word edges, what may follow it, why); the order is the order of the hits
_PHRASES = [
    (f"you are a {_opt('very ')}{_NICE}(?:,? {_NICE})* {_opt('ai ')}assistant", r"\.?", "generic framing"),
    ("please note that", "", "empty hedge"),
    (f"it (?:'s|is) important {_opt('to note ')}that", "", "empty hedge"),
    ("keep in mind that", "", "empty hedge"),
    ("as an? (?:language model|ai)", "", "self-reference"),
    ("do your best", "", "changes nothing"),
    ("take a deep breath", "", "changes nothing"),
    (f"think {_opt('about it ')}carefully{_opt(' before answering')}", "", "vague"),
    ("i (?:'ll|will) tip you", r"[^.\n]*", "changes nothing"),
    ("this is very important (?:for|to) my career", "", "changes nothing"),
    ("feel free to", "", "filler"),
    *((words, "", "wordy") for words in ("in order to", "at this point in time", "due to the fact that")),
]
FILLERS = [(f"{_EDGE}{rx}{_EDGE}{tail}", why) for rx, tail, why in _PHRASES]


# how a match of each pattern can begin
_STARTS = [
    ("you are a ",), ("please note that",), ("it 's important ", "it is important "), ("keep in mind that",), ("as a ", "as an "), ("do your best",), ("take a deep breath",),
    ("think carefully", "think about it carefully"), ("i 'll tip you", "i will tip you"), ("this is very important ",), ("feel free to",), ("in order to",), ("at this point in time",), ("due to the fact that",),
]


_JOINED = ("\u200c\u200d", ("Ⓐ", "ⓩ"), ("\U0001f130", "\U0001f149"), ("\U0001f150", "\U0001f169"), ("\U0001f170", "\U0001f189"))


def _is_word(c: str) -> bool:
    """Whether an edge of a phrase can't be beside it: letters, marks, digits, connectors and joiners of any script."""
    return unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Nd", "Mn", "Mc", "Me", "Pc") or c in _JOINED[0] or any(a <= c <= b for a, b in _JOINED[1:])


def _plain(text: str) -> bool:
    """Whether word edges are those of Python's expressions."""
    return text.isascii() or all(c.isascii() or _is_word(c) == (c.isalnum() or c == "_") for c in text)


_FILLER_RX = [re.compile(rx, re.IGNORECASE) for rx, _ in FILLERS]


@lru_cache(maxsize=1)
def _filler_patterns() -> list[re.Pattern]:
    """The patterns with edges that hold for any text; they take some time to compile."""
    starts = [c for c in range(0x110000) if _is_word(chr(c)) and not (c and _is_word(chr(c - 1)))]
    ends = [c for c in range(0x110000) if _is_word(chr(c)) and not (c < 0x10FFFF and _is_word(chr(c + 1)))]
    any_of = "(?-i:[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends)) + "])"
    return [re.compile(f"(?<!{any_of}){rx}(?!{any_of}){tail}", re.IGNORECASE) for rx, tail, _ in _PHRASES]


def _hits_of(text: str) -> list[tuple[int, int, str]]:
    """(pattern, place among its matches, phrase), in that order."""
    out: list[tuple[int, int, str]] = []
    if not text.isascii() and any(c in text for c in "ſKıİ"):  # letters that match others in any case: no short cut
        rxs = _FILLER_RX if _plain(text) else _filler_patterns()
        return [(k, i, m.group()) for k, rx in enumerate(rxs) for i, m in enumerate(rx.finditer(text))]
    low = text.lower()
    for k, starts in enumerate(_STARTS):
        at = sorted(p for s in starts for p in _places(low, s))
        end = i = 0
        for p in at:
            if p >= end:
                rx = _FILLER_RX[k] if _plain(text[max(0, p - 1) : p + 200]) else _filler_patterns()[k]
                if m := rx.match(text, p):
                    out.append((k, i, m.group()))
                    i, end = i + 1, m.end()
    return out


def _places(text: str, part: str):
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


def _filler_batch(count):
    def run(batches):
        for b in batches:
            rows, hits = [], []
            for row, text in enumerate(b.column("full_text").to_pylist()):
                for hit in _hits_of(text) if text else ():
                    rows.append(row)
                    hits.append(hit)
            tok = count(pa.array([h[2] for h in hits], pa.string()))
            keep = np.flatnonzero(tok > 0)
            rows = np.array(rows, np.int64)[keep]
            hits = [hits[x] for x in keep]
            lead = np.concatenate([[True], rows[1:] != rows[:-1]])[: len(rows)]  # the first hit of a request
            held = [b.column(c).take(pa.array(rows)) for c in ("ingest_seq", "source", "weight")]
            more = [pa.array([h[0] for h in hits], pa.int32()), pa.array([h[1] for h in hits], pa.int32()), pa.array([h[2] for h in hits], pa.string()), pa.array([FILLERS[h[0]][1] for h in hits], pa.string()), pa.array(tok[keep]), pa.array(lead, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*held, *more], names=["ingest_seq", "source", "weight", "nr", "i", "phrase", "why", "tok", "lead"])

    return run


def filler_hits(p: DataFrame) -> DataFrame:
    """(ingest_seq, source, weight, nr, i, phrase, why, tok, lead), one row a match; the first of a request leads."""
    return p.select("ingest_seq", "source", "weight", "full_text").mapInArrow(_filler_batch(counter()), "ingest_seq long, source string, weight long, nr int, i int, phrase string, why string, tok long, lead boolean")


def _phrase_sums(k: int):
    """Sums and the first k phrases of a partition, one row."""

    def run(batches):
        saved = w = rows = 0
        few: list[tuple] = []
        for b in batches:
            rows += b.num_rows
            saved, w = saved + sum(b.column("saved").to_pylist()), w + sum(b.column("w").to_pylist())
            few = nsmallest(k, [*few, *zip(*(b.column(c).to_pylist() for c in ("less", "seq", "nr", "i", "phrase", "why")))])
        if rows:
            names = ("less", "seq", "nr", "i", "phrase", "why")
            kind = pa.list_(pa.struct([("less", pa.int64()), ("seq", pa.int64()), ("nr", pa.int32()), ("i", pa.int32()), ("phrase", pa.string()), ("why", pa.string())]))
            yield pa.RecordBatch.from_arrays([pa.array([saved], pa.int64()), pa.array([w], pa.int64()), pa.array([[dict(zip(names, x)) for x in few]], kind)], names=["saved", "w", "few"])

    return run


def filler_phrases(p: DataFrame, min_total: int = 15) -> DataFrame:
    """Stock phrases that don't steer the model."""
    at = F.struct("ingest_seq", "nr", "i")
    own = F.when(F.col("lead"), F.col("weight")).otherwise(0)
    g = filler_hits(p).groupBy(F.substring(X.norm(F.col("phrase")), 1, 60).alias("phrase")).agg(F.sum("weight").alias("n"), F.min(at).alias("at"), F.max_by("why", at).alias("why"), F.sum(F.col("tok") * F.col("weight")).alias("saved"), F.sum(own).alias("w"))
    # phrases are counted once: a partition gives its sums and its first phrases in one row
    parts = g.select((-F.col("n")).alias("less"), F.col("at.ingest_seq").alias("seq"), "at.nr", "at.i", "phrase", "why", "saved", "w").mapInArrow(_phrase_sums(5), "saved long, w long, few array<struct<less:long,seq:long,nr:int,i:int,phrase:string,why:string>>")
    line = lambda x: F.concat(F.lit("x"), -x["less"], F.lit('  "'), x["phrase"], F.lit('"  -- '), x["why"])
    out = parts.agg(F.sum("saved").alias("saved"), F.sum("w").alias("w"), F.transform(F.slice(F.sort_array(F.flatten(F.collect_list("few"))), 1, 5), line).alias("evidence")).where(F.col("saved") >= min_total)
    return _found(
        out, "filler-phrases", "judgement", "saved", "w", F.lit("Stock phrases that say nothing to the model"),
        F.concat(_n("saved"), F.lit(" tokens are generic framing, hedges and incantations.")),
        "Delete them a group at a time and run your evaluations after each; a few do matter to some models.", F.col("evidence"),
    )


def _repeats(count, min_chars: int):
    """Copies of sentences, and the sentence with copies that comes first."""

    def find(texts):
        rows, copies, first = [], [], {}
        for i, t in enumerate(texts):
            if not t or len(t) < 2 * min_chars:
                continue
            seen: dict[str, int] = {}
            for s in _SENTENCE.split(t):
                if len(s) >= min_chars and len(key := X.norm_text(s)) >= min_chars:
                    seen[key] = seen.get(key, 0) + 1
            for key, n in seen.items():
                if n > 1:
                    first.setdefault(i, key)
                    rows.append((i, n - 1))
                    copies.append(key)
        out: dict[int, tuple[int, str]] = {}
        for (i, n), tok in zip(rows, count(pa.array(copies, pa.string())).tolist()):
            out[i] = (n * tok + (out[i][0] if i in out else 0), first[i])
        return out

    return find


def restated(p: DataFrame, min_chars: int = 40, more_than: int = 10, min_total: int = 25) -> DataFrame:
    """Sentences that one request holds more than once."""
    r = _gains(p, _repeats(counter(), min_chars), more_than).withColumnRenamed("mark", "key")
    out = _per_request(r, min_total, F.concat(F.col("source"), F.lit(": "), X.truncate(F.col("key"))))
    return _found(
        out, "restated-instructions", "certain", "saved", "w", F.lit("A prompt says the same sentence more than once"),
        F.concat(_n("saved"), F.lit(" tokens repeat sentences within one request, word for word.")),
        "Keep one copy, where it belongs. A rule that isn't followed needs a clearer form, not a second copy.", F.col("evidence"),
    )


MARKER = rf"^{WS}*(?:###{WS}*)?(?:a|assistant|example|input|output|q|user){WS}*\p{{Nd}}*{WS}*[:\-]"


_MARKER = re.compile(r"^\s*(?:###\s*)?(?ai:a|assistant|example|input|output|q|user)\s*\d*\s*[:\-]", re.MULTILINE)


def _examples(count, min_markers: int, min_tokens: int):
    """Half of the tokens from the first marker on; the mark is how many there are, and the tokens."""

    def find(texts):
        held = []
        for i, t in enumerate(texts):
            if t and t.count(":") + t.count("-") >= min_markers:
                marks = [m.start() for m in _MARKER.finditer(t)]
                if marks and len(marks) >= min_markers:
                    held.append((i, len(marks), t[marks[0] :]))
        return {i: (n // 2, f"{k} {n}") for (i, k, _), n in zip(held, count(pa.array([x for _, _, x in held], pa.string())).tolist()) if n >= min_tokens}

    return find


def fewshot(p: DataFrame, min_markers: int = 6, min_tokens: int = 200, min_total: int = 100) -> DataFrame:
    """Long blocks of worked examples."""
    r = _gains(p, _examples(counter(), min_markers, min_tokens), -1).withColumn("marks", F.substring_index("mark", " ", 1)).withColumn("t", F.substring_index("mark", " ", -1).cast("long"))
    out = _per_request(r, min_total, F.concat(F.col("source"), F.lit(": ~"), F.col("marks"), F.lit(" demonstration markers, "), _n("t"), F.lit(" tok")))
    return _found(
        out, "fewshot-weight", "judgement", "saved", "w", F.lit("Worked examples take much room; half may do"),
        F.concat(F.lit("Half of the demonstrations would free some "), _n("saved"), F.lit(" tokens.")),
        "Evaluate with all, half and a quarter of the examples and keep the fewest that hold quality; cache the ones that stay.", F.col("evidence"),
    )


def io_ratios(p: DataFrame) -> DataFrame:
    """(source, inp, out, ratio) of the calls with a counted completion."""
    r = p.where("completion <> ''").select("source", framed(F.col("messages")).alias("inp"), token_count("completion").alias("out"))
    return r.where("out > 0").withColumn("ratio", F.col("inp") / F.col("out"))


def io_imbalance(p: DataFrame, ratio: float = 50, min_calls: int = 3) -> DataFrame:
    """Large inputs for small outputs; the median is the upper one of an even number."""
    r = io_ratios(p)
    # place n // 2 from the top is the smallest ratio that half of the calls don't exceed
    median = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY ratio)")
    some = r.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ratio") >= ratio).alias("bad"), median.alias("median"))
    said = p.where("completion <> ''").agg(F.count(F.lit(1)).alias("pairs"))
    few = _first_lines(r.where(F.col("ratio") >= ratio), 3, [-F.col("ratio"), -F.col("inp"), -F.col("out"), F.col("source")], F.concat(F.col("source"), F.lit(": "), _n("inp"), F.lit(" in -> "), _n("out"), F.lit(" out ("), F.bround("ratio", 0).cast("int"), F.lit("x)")))
    out = some.crossJoin(said).crossJoin(few).where((F.col("pairs") >= min_calls) & (F.col("n") > 0) & (F.col("bad") >= F.greatest(F.lit(2), F.floor(F.col("n") / 10))))  # single rows
    return _found(
        out, "io-imbalance", "judgement", F.lit(0), "bad", F.lit("Much is sent for very short answers"),
        F.concat(_n("bad"), F.lit(" of "), _n("n"), F.lit(f" logged calls send at least {ratio:g} times what they get back (median "), F.bround("median", 0).cast("int"), F.lit("x), which points to retrieving too much.")),
        "See which retrieved parts the answers use, and retrieve fewer of them. No saving is claimed: only a test tells how many are needed.", F.col("evidence"),
    )


def _tools(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per tool: name, cost first seen, declared, first; one row: weight, total)."""
    with_tools = p.where(F.size("tools") > 0)
    t = with_tools.select("ingest_seq", "weight", F.explode("tools").alias("t")).select("ingest_seq", "weight", "t.pos", "t.name", "t.schema_json")
    # each distinct schema is counted once, not in every call
    schemas = t.groupBy("name", "schema_json").agg(F.sum("weight").alias("declared"), F.min(F.struct("ingest_seq", "pos")).alias("at")).withColumn("cost", token_count("schema_json")).drop("schema_json")
    per = schemas.groupBy("name").agg(F.min_by("cost", "at").alias("cost"), F.sum("declared").alias("declared"), F.min("at").alias("at"))
    w = with_tools.agg(F.sum("weight").alias("w"))
    totals = w.crossJoin(schemas.agg(F.sum(F.col("cost") * F.col("declared")).alias("total")))  # single rows
    return per, totals


def tool_schema_cost(p: DataFrame, min_average: int = 100) -> DataFrame:
    """Tool schemas are input tokens of every call."""
    per, totals = _tools(p)
    few = _first_lines(per, 5, [-F.col("cost"), F.col("at")], F.concat(F.col("name"), F.lit(": "), F.col("cost"), F.lit(" tok")))
    n = per.agg(F.count(F.lit(1)).alias("n"))
    out = totals.where("w > 0").withColumn("avg", F.floor(F.col("total") / F.col("w"))).where(F.col("avg") >= min_average).crossJoin(n).crossJoin(few)  # single rows
    return _found(
        out, "tool-schema-cost", "high", F.floor((F.col("total") - F.col("avg")) * DISCOUNT), "w",
        F.concat(F.lit("Each call carries "), _n("avg"), F.lit(" tokens of tool schemas")),
        F.concat(_n("n"), F.lit(" tool schemas go out with "), _n("w"), F.lit(" calls, "), _n("total"), F.lit(" tokens in all; every step of an agent pays for them again.")),
        "Cache the schemas with the prompt's opening, then shorten their descriptions and nesting.", F.col("evidence"),
    )


def unused_tools(p: DataFrame, min_wasted: int = 200, min_share: float = 0.5) -> DataFrame:
    """Tools that are declared in `min_share` of the calls or more, in two at least, and never called."""
    per, totals = _tools(p)
    called = p.where(F.size("tools") > 0).select(F.explode("tools_called").alias("name")).distinct()
    some = called.agg(F.count(F.lit(1)).alias("called"))
    never = per.join(called, "name", "left_anti").crossJoin(totals.crossJoin(some)).where((F.col("called") > 0) & (F.col("declared") >= F.greatest(F.lit(2), F.floor(F.col("w") * min_share))))
    sums = never.agg(F.sum(F.col("cost") * F.col("declared")).alias("saved"), F.max("w").alias("w"), F.count(F.lit(1)).alias("n"))
    few = _first_lines(never, 5, [-F.col("cost"), F.col("at")], F.concat(F.col("name"), F.lit(": "), F.col("cost"), F.lit(" tok, never called")))
    out = sums.where(F.col("saved") >= min_wasted).crossJoin(few)  # single rows
    return _found(
        out, "unused-tool-schemas", "judgement", "saved", "w", F.concat(_n("n"), F.lit(" declared tools are never called")),
        F.concat(F.lit("Their schemas cost "), _n("saved"), F.lit(" tokens in these calls, and none was called in the log.")),
        "Offer tools by the task at hand, and check over a longer log that they are really unused before removing them.", F.col("evidence"),
    )


def long_history(p: DataFrame, min_turns: int = 10, min_tokens: int = 500, window: int = 6, min_total: int = 200) -> DataFrame:
    """Conversations that are sent again as a whole."""
    turns = F.filter("messages", lambda m: m["role"].isin("user", "assistant"))
    r = p.select("ingest_seq", "source", "weight", token_counts(F.transform(turns, lambda m: m["content"])).alias("t")).withColumn("turns", F.size("t")).where(F.col("turns") >= min_turns)
    r = r.withColumn("past", total(F.slice("t", F.lit(1), F.greatest(F.col("turns") - 1, F.lit(0))))).where(F.col("past") >= min_tokens)
    r = r.withColumn("delta", total(F.slice("t", F.lit(1), F.greatest(F.col("turns") - window, F.lit(0))))).drop("t")
    few = _first_lines(r, 3, [-F.col("past"), F.col("ingest_seq")], F.concat(F.col("source"), F.lit(": "), F.col("turns"), F.lit(" turns, "), _n("past"), F.lit(" tok of history")))
    out = r.agg(F.sum(F.col("delta") * F.col("weight")).alias("saved"), F.sum("weight").alias("w"), F.max("past").alias("most")).where(F.col("saved") >= min_total).crossJoin(few)  # single rows
    return _found(
        out, "unbounded-history", "judgement", "saved", "w", F.concat(F.lit("Whole conversations go out again in "), _n("w"), F.lit(" calls")),
        F.concat(F.lit("Each turn sends all before it, up to "), _n("most"), F.lit(" tokens, so cost grows with the square of the length.")),
        f"Send the last {window} turns or so and a summary of the rest; test where quality starts to fall.", F.col("evidence"),
    )


CHECKS: dict[str, Callable[..., DataFrame]] = {
    "shared_prefix": shared_prefix,
    "repeated_system": repeated_system,
    "duplicate_blocks": duplicate_blocks,
    "whitespace_bloat": whitespace_bloat,
    "pretty_json": pretty_json,
    "filler_phrases": filler_phrases,
    "restated": restated,
    "fewshot": fewshot,
    "io_imbalance": io_imbalance,
    "tool_schema_cost": tool_schema_cost,
    "unused_tools": unused_tools,
    "long_history": long_history,
}


def findings(requests: DataFrame, settings: dict[str, dict] | None = None) -> DataFrame:
    """All checks' findings as one lazy frame, in report order."""
    p = prepare(requests)
    out = None
    for k, (name, check) in enumerate(CHECKS.items()):
        one = check(p, **(settings or {}).get(name, {})).withColumn("check_ord", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out.orderBy("conf_rank", F.desc("tokens_saved"), "check_ord", "emit_ord")
