"""Reports: results as JSON or text. Only a run's few results reach the driver."""

from __future__ import annotations

import json
import os
import re
import shutil
import sys

from pyspark.sql import DataFrame

from ..operators.analyze import Results, top_sources

#: Sources shown for each model.
SHOWN = 5
WIDTHS = (44, 120)


def human_bytes(n: int) -> str:
    size, unit = float(n), "B"
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
        if size < 1024 or unit == "TiB":
            break
        size /= 1024
    return f"{n} B" if unit == "B" else f"{size:.1f} {unit}"


def commas(n: int) -> str:
    return f"{n:,}"


def usd(micros: int) -> str:
    sign, micros = ("-", -micros) if micros < 0 else ("", micros)
    return f"{sign}{micros // 1_000_000}.{micros % 1_000_000:06d}"


def short_usd(micros: int) -> str:
    """Dollars for a dashboard: two places from a dollar on, four below."""
    return f"${micros / 1e6:,.2f}" if abs(micros) >= 1_000_000 else f"${micros / 1e6:.4f}"


def plural(n: int, one: str, many: str | None = None) -> str:
    return f"{commas(n)} {one if n == 1 else many or one + 's'}"


def visible_width(text: str) -> int:
    return len(re.sub(r"\x1b\[[0-9;]*m", "", text))


def unique_warnings(*lists) -> list[str]:
    """Warnings without repeats, as first seen."""
    return list(dict.fromkeys(w for ws in lists for w in ws or ()))


def expected_scenario(scenarios: list) -> object | None:
    """The scenario named expected, else the middle one."""
    named = [s for s in scenarios if s["scenario"] == "expected"]
    return named[0] if named else scenarios[len(scenarios) // 2] if scenarios else None


def to_json(df: DataFrame, keys: list[str]) -> str:
    """Rows of a result as indented JSON, ordered by ``keys``."""
    rows = [json.loads(x) for x in df.orderBy(*keys).toJSON().collect()]
    return json.dumps(rows, indent=2, ensure_ascii=False) + "\n"


def _gathered(results: Results, request_id: str) -> list[dict]:
    own = lambda df: df.where(df["request_id"] == request_id)
    models = [r.asDict() for r in own(results.models).orderBy("model").collect()]
    for m in models:
        m["scenarios"], m["sources"] = [], []
    by = {m["model"]: m for m in models}
    for s in own(results.scenarios).orderBy("model", "scenario_no").collect():
        by[s["model"]]["scenarios"].append(s.asDict())
    for s in own(top_sources(results.sources, SHOWN)).orderBy("model", "place").collect():
        by[s["model"]]["sources"].append(s.asDict())
    return models


def text_report(results: Results, request_id: str) -> str:
    """Per model: range, overhead, costs, and the sources with most tokens."""
    lines = []
    for m in _gathered(results, request_id):
        lines.append(f"{m['model']} ({m['provider']}): {commas(m['input_tokens'])} tokens, {commas(m['input_low'])} to {commas(m['input_high'])}, {m['utilization']:.2%} of {commas(m['context_window'])}")
        if m["confidence"] == 0:
            lines.append("  bounds are uncalibrated")
        lines.append(f"  overhead: system {m['system_tokens']}, tools {m['tool_tokens']}, wrapper {m['wrapper_tokens']}, runtime {m['runtime_tokens']}; status {m['status']}")
        lines += [f"  {s['scenario']}: {commas(s['output_tokens'])} out, ${usd(s['cost_micros'])}" for s in m["scenarios"]]
        lines += [f"  {s['label']}: {commas(s['tokens'])}" for s in m["sources"]]
        lines += [f"  warning: {w}" for w in unique_warnings(m["warnings"])]
    return "\n".join(lines) + "\n"


def terminal_width(asked: int | None = None) -> int:
    """The asked or the terminal's width, within what a dashboard can use."""
    return min(max(asked if asked is not None else shutil.get_terminal_size((80, 24)).columns, WIDTHS[0]), WIDTHS[1])


def _apart(left: str, right: str, width: int) -> str:
    """A line with its two ends at the edges."""
    return left + " " * max(1, width - visible_width(left) - visible_width(right)) + right


def dashboard(results: Results, request_id: str, requested: list[str], width: int | None = None, color: bool | None = None, saved_as: str | None = None) -> str:
    """Each requested model's tokens, bounds, context use and cost, in the order asked for.

    ``saved_as``, the id of a saved run, says where the warnings are kept.
    """
    if color is None:
        color = "NO_COLOR" not in os.environ and sys.stdout.isatty()
    width = terminal_width(width)
    paint = (lambda code, s: f"\x1b[{code}m{s}\x1b[0m") if color else (lambda code, s: s)
    place = {m: k for k, m in enumerate(requested)}
    found = sorted(_gathered(results, request_id), key=lambda m: place.get(m["model"], len(place)))
    lines = []
    if found:
        whole = "" if all(m["status"] == "supported" for m in found) else " (incomplete)"
        lines.append(_apart(plural(found[0]["n_sources"], "source") + whole, human_bytes(found[0]["total_bytes"]), width))
    for m in found:
        full = max(12, width - 2)
        # a request that has tokens shows at least one mark
        used = min(full, max(int(m["utilization"] * full), int(m["input_tokens"] > 0)))
        bar = paint("31" if m["overflow"] else "32", "#" * used) + "." * (full - used)
        s = expected_scenario(m["scenarios"])
        cost = f"{short_usd(s['cost_micros'])} {s['scenario']}" if s else "cost unknown"
        lines += ["-" * width, _apart(paint("1", m["model"]), plural(m["input_tokens"], "token"), width), f"[{bar}]", _apart(f"{m['utilization']:.2%} of the context", cost, width)]
        lines.append(f"between {commas(m['input_low'])} and {commas(m['input_high'])}" + (", uncalibrated" if m["confidence"] == 0 else ""))
        lines += [paint("33", f"! {m['status']}")] if m["status"] != "supported" else []
    lines.append("-" * width)
    if warnings := unique_warnings(*[m["warnings"] for m in found]):
        lines += [f"! {w}" for w in warnings]
        lines.append(f"{plural(len(warnings), 'warning')}, " + (f"kept with run {saved_as}" if saved_as else "kept if the run is saved"))
    counted = "counted by an external verifier" if any(m["verified"] for m in found) else "estimated locally"
    lines.append(f"{counted}; no content is stored" + ("; the run's figures are" if saved_as else ""))
    return "\n".join(lines) + "\n"


def diff_text(models: DataFrame, sources: DataFrame) -> str:
    lines = [f"{r['model']}: {r['token_delta']:+,} tokens, ${usd(r['cost_delta'])}" for r in models.orderBy("model").collect()]
    return "\n".join(lines + [f"{r['change']}: {r['source']}" for r in sources.orderBy("change", "source").collect()]) + "\n"


def history_text(runs: DataFrame) -> str:
    rows = runs.collect()
    return "\n".join(f"{r['id']}  {r['created_at']:%Y-%m-%d %H:%M:%S}  {', '.join(r['models'])}  {human_bytes(r['total_bytes'])}{'  incomplete' if r['incomplete'] else ''}" for r in rows) + "\n"
