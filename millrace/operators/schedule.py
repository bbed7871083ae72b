"""Schedules of ingestion, as cron and rate expressions."""

from __future__ import annotations

CRON = {f: f"cron({e} *)" for f, e in dict(
    hourly="0 * * * ?", daily="0 0 * * ?", weekly="0 0 ? * MON", weekdays="0 0 ? * MON-FRI", twice_daily="0 0,12 * * ?", every_6_hours="0 */6 * * ?", every_12_hours="0 */12 * * ?",
).items()}
RATE = {f: f"rate({e})" for f, e in dict(hourly="1 hour", daily="1 day", weekly="7 days", every_6_hours="6 hours", every_12_hours="12 hours").items()}


def _expression(frequency: str, known: dict[str, str]) -> str:
    if frequency.startswith(("cron(", "rate(")):
        return frequency
    if frequency not in known:
        raise ValueError(f"unknown frequency {frequency!r}; known are {', '.join(sorted(known))} and cron(...) or rate(...)")
    return known[frequency]


def cron(frequency: str) -> str:
    return _expression(frequency, CRON)


def rate(frequency: str) -> str:
    return _expression(frequency, RATE)


def plan(sources: list[dict]) -> list[dict]:
    """One entry per source; a frequency that isn't known runs daily but keeps its name."""
    out = []
    for s in sources:
        frequency = s.get("update_frequency") or "daily"
        try:
            expression = cron(frequency)
        except ValueError:
            expression = CRON["daily"]
        out.append({"source_name": s["name"], "source_type": s["type"], "frequency": frequency, "cron_expression": expression, "enabled": True})
    return out
