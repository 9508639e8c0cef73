"""Settings and filters as users type them: each gives the values, or what is wrong by field."""

from __future__ import annotations

import re
import unicodedata
from datetime import UTC, date, datetime, time, timedelta, tzinfo

from pagetide.functions.urls import bare_host, normalized
from pagetide.operators.graph import SIGNALS
from pagetide.schemas import EVENT_TYPES, OUTCOMES

#: Bounds of a crawl's settings.
WHOLE = {"max_pages": (1, 200), "max_depth": (0, 10)}
NUMBERS = {"delay": (0.5, 60.0), "timeout": (1.0, 120.0)}
MAX_AGENT = 200


def canonical_int(text: str, least: int) -> int | None:
    """An integer written as it prints: no sign, no leading zeros."""
    return int(text) if re.fullmatch(r"0|[1-9][0-9]*", text) and int(text) >= least else None


def crawl_settings(form: dict[str, str]) -> tuple[dict | None, dict[str, str]]:
    values, errors = {}, {}
    for name, (low, high) in WHOLE.items():
        text = form[name].strip()
        if re.fullmatch(r"[+-]*\d+", text) and re.fullmatch(r"[+-]?\d+", text) and low <= int(text) <= high:
            values[name] = int(text)
        else:
            errors[name] = f"a whole number from {low} to {high}"
    for name, (low, high) in NUMBERS.items():
        text = form[name].strip().replace(",", ".")
        if re.fullmatch(r"[+-]?(\d+(\.\d*)?|\.\d+)", text) and low <= float(text) <= high:
            values[name] = float(text)
        else:
            errors[name] = f"a number from {low:g} to {high:g}"
    agent = form["user_agent"].strip()
    if not 1 <= len(agent) <= MAX_AGENT or any(unicodedata.category(c) == "Cc" for c in agent):
        errors["user_agent"] = "1 to 200 characters without control characters"
    values["user_agent"] = agent
    return (None, errors) if errors else (values, {})


def structure_filters(url: str = "", depth: str = "", outcome: str = "", broken: str = "", unchecked: str = "", signal: str = "", page: str = "1") -> tuple[dict | None, dict[str, str]]:
    """Arguments of graph.filtered() and a page number."""
    errors = {}
    flags = {"": None, "yes": True, "no": False}
    if len(url) > 2048 or any(ord(c) < 32 for c in url):
        errors["url"] = "too long, or has control characters"
    if depth and canonical_int(depth, 0) is None:
        errors["depth"] = "a whole number"
    if outcome and outcome not in OUTCOMES:
        errors["outcome"] = "unknown"
    for name, value in (("broken", broken), ("unchecked", unchecked)):
        if value not in flags:
            errors[name] = "yes or no"
    if signal and signal not in SIGNALS:
        errors["signal"] = "unknown"
    if canonical_int(page, 1) is None:
        errors["page"] = "a positive whole number"
    if errors:
        return None, errors
    return {"url": url or None, "depth": canonical_int(depth, 0) if depth else None, "outcome": outcome or None, "broken": flags[broken], "unchecked": flags[unchecked], "signal": signal or None, "page": int(page)}, {}


def iso_day(text: str) -> date | None:
    try:
        day = date.fromisoformat(text)
    except ValueError:
        return None
    return day if day.isoformat() == text else None


def feed_filters(event_type: str = "", date_from: str = "", date_to: str = "", page: str = "1", view_status: str = "", site_id: str = "", zone: tzinfo = UTC) -> tuple[dict | None, dict[str, str]]:
    """Arguments of feed.filtered() and a page number. Local days, both included, become a half-open range of moments."""
    errors = {}
    if site_id and canonical_int(site_id, 1) is None:
        errors["site_id"] = "unknown"
    if event_type and event_type not in EVENT_TYPES:
        errors["event_type"] = "unknown"
    if view_status not in ("", "viewed", "not_viewed"):
        errors["view_status"] = "unknown"
    first, last = (iso_day(d) if d else None for d in (date_from, date_to))
    for name, text, day in (("date_from", date_from, first), ("date_to", date_to, last)):
        if text and day is None:
            errors[name] = "no date"
    if first and last and first > last:
        errors["date_range"] = "from after to"
    if canonical_int(page, 1) is None:
        errors["page"] = "a positive whole number"
    if errors:
        return None, errors
    moment = lambda d: datetime.combine(d, time.min, zone).astimezone(UTC)
    try:
        begin = moment(first) if first else None
    except (OverflowError, ValueError):
        return None, {"date_from": "out of range"}
    try:
        end = moment(last + timedelta(days=1)) if last else None
    except (OverflowError, ValueError):
        return None, {"date_to": "out of range"}
    return {"site_id": int(site_id) if site_id else None, "event_types": [event_type] if event_type else None, "from_time": begin, "before_time": end, "viewed": {"": None}.get(view_status, view_status == "viewed"), "page": int(page)}, {}


def count_phrase(n: int, one: str = "запись", few: str = "записи", many: str = "записей") -> str:
    """A count with its noun in the form that the number asks for."""
    if n % 10 == 1 and n % 100 != 11:
        return f"{n} {one}"
    return f"{n} {few}" if 2 <= n % 10 <= 4 and not 12 <= n % 100 <= 14 else f"{n} {many}"


def matching_properties(site_url: str, properties: list[dict]) -> list[dict]:
    """Properties (id, label, permission) of a service that are verified and cover the site's host, each once."""
    own, found = bare_host(site_url), {}
    for p in properties:
        usable = str(p.get("permission", "")).lower() not in ("siteunverifieduser", "none")
        if usable and own and any(bare_host(v if "://" in v or v.startswith("sc-domain:") else f"https://{v}") == own for v in (p["id"], p.get("label") or p["id"])):
            found.setdefault(p["id"], p)
    return list(found.values())


def only_property(site_url: str, properties: list[dict]) -> dict | None:
    """The property to take without asking: the only one of the whole domain."""
    domains = [p for p in properties if p["id"].lower().startswith("sc-domain:")]
    return domains[0] if len(domains) == 1 and normalized(site_url) else None
