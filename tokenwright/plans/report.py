"""Terminal, Markdown and JSON reports of a collected result (a few dozen rows, on the driver)."""

from __future__ import annotations

import json
import os
import textwrap

from ..operators.summary import PRICE_IN, PRICE_OUT, money
from .audit import Result

NAME = "tokenwright"
LABEL = {"certain": "CERTAIN", "high": "HIGH", "judgement": "JUDGEMENT"}
_COLOUR = {"certain": "32", "high": "36", "judgement": "33"}


class Style:
    def __init__(self, on: bool):
        self.on = on

    def __call__(self, text: str, code: str) -> str:
        return f"\x1b[{code}m{text}\x1b[0m" if self.on else text


def coloured(stream) -> bool:
    """NO_COLOR wins, then FORCE_COLOR, then whether the stream is a terminal."""
    if os.environ.get("NO_COLOR"):
        return False
    return bool(os.environ.get("FORCE_COLOR")) or bool(getattr(stream, "isatty", bool)())


def scale_of(r: Result, calls: int | None) -> float:
    return calls / r.summary["calls"] if calls and r.summary["calls"] else 1.0


def projected(r: Result, calls: int, price_in: float) -> dict[str, float]:
    k = scale_of(r, calls)
    usd = lambda t: money(int(t), price_in)
    return {"spend": usd(r.summary["input_tokens"] * k), "monthly": usd(r.safe * k), "annual": usd(r.safe * k * 12)}


def note(r: Result) -> str:
    return f"exact ({r.backend})" if r.exact else "approximate, mostly within 10%"


CAVEAT = "The measured figure is counted after rewriting and is not a sum of findings; findings may overlap, so they don't add up."


def terminal(r: Result, price_in: float = PRICE_IN, price_out: float = PRICE_OUT, calls: int | None = None, colour: bool = False) -> str:
    s, t = Style(colour), r.summary
    out = [s(NAME, "1") + ": what this context costs", "", s("Corpus", "1"), f"  records   {t['records']:,} of {t['n_sources']} source(s)", f"  calls     {t['calls']:,}", f"  input     {t['input_tokens']:,} tokens, {t['avg_input']:,} a call"]
    if t["tool_tokens"]:
        out += [f"            messages {t['message_tokens']:,}, tool schemas {t['tool_tokens']:,}"]
    if t["output_tokens"]:
        out += [f"  output    {t['output_tokens']:,} tokens"]
    out += [f"  counting  {note(r)}", ""]
    if not r.findings and not r.measured["saved"]:
        return "\n".join([*out, s("Nothing found above the thresholds.", "32"), "The prompts are tight already, or too few calls are given; try --calls or a request log.", ""])
    out += [s("Recoverable", "1"), s(f"  measured  {r.measured['saved']:>12,}", "32") + "  safe rewrites, applied and counted again", s(f"  high      {r.total('high'):>12,}", "36") + "  caching of what repeats", s(f"  judgement {r.total('judgement'):>12,}", "33") + "  needs an evaluation", f"  {r.pct:.1f}% of input tokens without a change of behaviour (measured + high)", *textwrap.wrap(CAVEAT, 70, initial_indent="  ", subsequent_indent="  "), ""]
    out += [s("Cost", "1"), f"  rates ${price_in:.2f} in, ${price_out:.2f} out per million tokens"]
    if price_in == PRICE_IN:
        out += [s("  placeholder rate: give your own with --price-in", "33")]
    out += [f"  spend  ${money(t['input_tokens'], price_in):,.2f}", f"  saving ${money(r.safe, price_in):,.2f}"]
    if calls:
        p = projected(r, calls, price_in)
        out += [f"  at {calls:,} calls a month ({scale_of(r, calls):.1f} times this sample):", f"    spend ${p['spend']:,.2f}, saving ${p['monthly']:,.2f} a month, ${p['annual']:,.2f} a year"]
    out += ["", s(f"Findings ({len(r.findings)})", "1")]
    wrap = lambda x: textwrap.fill(x, 66, initial_indent="   ", subsequent_indent="   ")
    for i, f in enumerate(r.findings, 1):
        affected = f", {f['calls_affected']:,} call(s)" if f["calls_affected"] else ""
        out += ["", f"{i}. {s(f['title'], '1')}", s(f"   [{LABEL[f['confidence']]}]", _COLOUR[f["confidence"]]) + f" {f['tokens_saved']:,} tokens{affected}, {f['check']}", wrap(f["detail"]), wrap("Fix: " + f["fix"])]
        out += [f"     - {e}" for e in f["evidence"] or []]
    return "\n".join([*out, ""])


def markdown(r: Result, price_in: float = PRICE_IN, price_out: float = PRICE_OUT, calls: int | None = None) -> str:
    t = r.summary
    out = [f"# {NAME} report", "", "## Corpus", "", "| | |", "|---|---:|", f"| records | {t['records']:,} |", f"| calls | {t['calls']:,} |", f"| input tokens | {t['input_tokens']:,} |", f"| a call | {t['avg_input']:,} |", f"| messages | {t['message_tokens']:,} |", f"| tool schemas | {t['tool_tokens']:,} |", f"| output tokens | {t['output_tokens']:,} |", f"| counting | {note(r)} |", ""]
    out += ["## Recoverable", "", "| class | tokens |", "|---|---:|", f"| measured | {r.measured['saved']:,} |", f"| high | {r.total('high'):,} |", f"| judgement | {r.total('judgement'):,} |", "", f"**{r.pct:.1f}% of input tokens** (measured + high).", "", f"> {CAVEAT}", ""]
    out += ["## Cost", "", f"Rates: ${price_in:.2f} in, ${price_out:.2f} out per million tokens." + (" **Placeholder rate.**" if price_in == PRICE_IN else ""), "", f"- spend ${money(t['input_tokens'], price_in):,.2f}", f"- saving ${money(r.safe, price_in):,.2f}"]
    if calls:
        p = projected(r, calls, price_in)
        out += [f"- at {calls:,} calls a month ({scale_of(r, calls):.1f} times): spend ${p['spend']:,.2f}, saving ${p['monthly']:,.2f}, a year ${p['annual']:,.2f}"]
    out += ["", f"## Findings ({len(r.findings)})", ""]
    for i, f in enumerate(r.findings, 1):
        out += [f"### {i}. {f['title']}", "", f"`{LABEL[f['confidence']]}`, {f['tokens_saved']:,} tokens, {f['calls_affected']:,} call(s), `{f['check']}`", "", f["detail"], "", f"Fix: {f['fix']}", ""]
        if f["evidence"]:
            out += ["<details><summary>Evidence</summary>", "", *(f"- `{e}`" for e in f["evidence"]), "", "</details>", ""]
    return "\n".join(out)


FINDING_KEYS = ("check", "title", "confidence", "tokens_saved", "detail", "fix", "calls_affected", "evidence")


def as_json(r: Result, price_in: float = PRICE_IN, price_out: float = PRICE_OUT, calls: int | None = None) -> str:
    t = r.summary
    out = {
        "tool": NAME,
        "counting": {"backend": r.backend, "exact": r.exact},
        "corpus": {"records": t["records"], "calls": t["calls"], "input_tokens": t["input_tokens"], "message_tokens": t["message_tokens"], "tool_schema_tokens": t["tool_tokens"], "output_tokens": t["output_tokens"], "avg_input_tokens_per_call": t["avg_input"]},
        "pricing": {"is_placeholder_rate": price_in == PRICE_IN, **{f"{way}_per_million_usd": rate for way, rate in (("input", price_in), ("output", price_out))}},
        "recoverable_tokens": {"measured_safe_rewrite": r.measured["saved"], "high_prompt_caching": r.total("high"), "judgement": r.total("judgement"), "_note": "the measured part is counted after rewriting; findings may overlap"},
        "recoverable_tokens_confident": r.safe,
        "recoverable_pct_confident": round(r.pct, 2),
        "estimated_saving_usd_confident": round(money(r.safe, price_in), 4),
        "findings": [{k: f[k] for k in FINDING_KEYS} for f in r.findings],
    }
    if calls and t["calls"]:
        p = projected(r, calls, price_in)
        out["projection"] = {"calls_per_month": calls, "scale_factor": round(scale_of(r, calls), 4), "monthly_saving_usd": round(p["monthly"], 2), "annual_saving_usd": round(p["annual"], 2)}
    return json.dumps(out, indent=2)
