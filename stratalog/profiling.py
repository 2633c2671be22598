"""Reports over an engine's log: relations, rounds and a log file that can be read again."""

from __future__ import annotations

import json


def by_relation(log: list[dict]) -> list[dict]:
    out: dict[str, dict] = {}
    for e in log:
        if e["kind"] == "runtime":
            continue
        r = out.setdefault(e["relation"], {"relation": e["relation"], "seconds": 0.0, "nonrecursive_seconds": 0.0, "recursive_seconds": 0.0, "rows": 0, "rounds": 0})
        r["seconds"] += e["seconds"]
        r[f"{e['kind']}_seconds"] += e["seconds"]
        r["rows"] += e["rows"]
        r["rounds"] = max(r["rounds"], e.get("round", 0))
    return sorted(out.values(), key=lambda r: -r["seconds"])


def report(log: list[dict], command: str = "rel", name: str | None = None) -> str:
    """``top``: totals; ``rel``: by relation; ``graph``: the rounds of one relation."""
    runtime = next((e["seconds"] for e in reversed(log) if e["kind"] == "runtime"), 0.0)
    rows = sum(e["rows"] for e in log if e["kind"] != "runtime")
    if command == "top":
        return f"Total runtime: {runtime:.3f}\nTotal number of new tuples: {rows}"
    if command == "graph":
        most = max((e["rows"] for e in log if e["relation"] == name), default=0)
        lines = [f"{'round':>6} {'seconds':>9} {'tuples':>10}"]
        for e in log:
            if e["relation"] == name:
                lines.append(f"{e.get('round', 0):>6} {e['seconds']:>9.3f} {e['rows']:>10} {'#' * (40 * e['rows'] // most if most else 0)}")
        return "\n".join(lines)
    lines = [f"{'seconds':>9} {'nonrec':>9} {'rec':>9} {'tuples':>10} {'rounds':>6} relation"]
    for r in by_relation(log):
        if name in (None, r["relation"]):
            lines.append(f"{r['seconds']:>9.3f} {r['nonrecursive_seconds']:>9.3f} {r['recursive_seconds']:>9.3f} {r['rows']:>10} {r['rounds']:>6} {r['relation']}")
    return "\n".join(lines)


def save(log: list[dict], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(json.dumps(e) + "\n" for e in log)


def load(path: str) -> list[dict]:
    with open(path, encoding="utf-8") as f:
        return [json.loads(x) for x in f if x.strip()]
