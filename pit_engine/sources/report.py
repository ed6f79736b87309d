"""A snapshot of the latest results as Markdown between two markers of a page."""

from __future__ import annotations

import math
from datetime import date, datetime

BEGIN, END = "<!-- snapshot:begin -->", "<!-- snapshot:end -->"
FIELDS = {"as_of": str, "signal_week": str, "weights": dict, "probabilities": dict, "metrics": list}


def validate(snapshot: dict, now: datetime, most_days: int = 14) -> None:
    """Raise ValueError unless all fields are there, sums are one and nothing is from the future or stale."""
    if set(snapshot) != set(FIELDS):
        raise ValueError(f"fields differ: {sorted(set(snapshot) ^ set(FIELDS))}")
    for k, kind in FIELDS.items():
        if not isinstance(snapshot[k], kind):
            raise ValueError(f"{k} is no {kind.__name__}")
    age = (now.date() - date.fromisoformat(snapshot["as_of"])).days
    if not 0 <= age <= most_days:
        raise ValueError(f"as_of is {age} days old")
    for k in ("weights", "probabilities"):
        values = list(snapshot[k].values())
        if any(not math.isfinite(v) or v < -1e-9 for v in values) or abs(sum(values) - 1) > 1e-6:
            raise ValueError(f"{k} are no distribution")


def render(snapshot: dict, now: datetime) -> str:
    validate(snapshot, now)
    table = lambda head, rows: ["| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *("| " + " | ".join(r) + " |" for r in rows)]
    lines = [f"As of {snapshot['as_of']}, for the week of {snapshot['signal_week']}.", ""]
    lines += table(["Asset", "Weight"], [[k, f"{v:.1%}"] for k, v in sorted(snapshot["weights"].items())])
    lines += ["", *table(["Regime", "Probability"], [[k, f"{v:.1%}"] for k, v in snapshot["probabilities"].items()])]
    if snapshot["metrics"]:
        head = list(snapshot["metrics"][0])
        lines += ["", *table(head, [[f"{m[h]:.4f}" if isinstance(m[h], float) else str(m[h]) for h in head] for m in snapshot["metrics"]])]
    return "\n".join(lines)


def update_page(page: str, body: str) -> str:
    """The page with the part between the markers replaced; both markers once, in order."""
    if page.count(BEGIN) != 1 or page.count(END) != 1 or page.index(BEGIN) > page.index(END):
        raise ValueError("the page needs both markers once, in order")
    return page[: page.index(BEGIN) + len(BEGIN)] + "\n" + body + "\n" + page[page.index(END) :]
