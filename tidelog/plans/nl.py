"""English requests to pipeline queries by fixed rules."""

from __future__ import annotations

import re

# The words that requests are read by.
PLACE_WORDS = ("from", "in", "service", "app", "job", "container")
LEVEL_WORDS = (("error", "error"), ("errors", "error"), ("warning", "warn"), ("warnings", "warn"), ("warn", "warn"), ("info", "info"), ("debug", "debug"), ("fatal", "fatal"), ("critical", "fatal"), ("panic", "fatal"))
STATUS_WORDS = ("500", "5xx", "404", "4xx", "503", "502", "200")
SLOW_WORDS = ("slow", "latency", "timeout")
JSON_WORDS = ("json", "structured", "parse")
SEARCH_WORDS = ("containing", "with", "matching", "like", "about", "for")
STOP_WORDS = ("from", "in", "last", "since", "between")
FILLER = ("show", "me", "the", "all", "find", "get", "logs", "log", "please", "can", "you", "i", "want", "to", "see", "display", "list")


def _first(words, text):
    return next((w for w in words if w in text), None)


def _place(text: str, low: str) -> str | None:
    for w in PLACE_WORDS:
        at = low.find(w)
        if at >= 0 and (rest := text[at + len(w) :].split()):
            name = re.sub(r"^[^\w-]+|[^\w-]+$", "", rest[0])
            if len(name) > 1:
                return name
    return None


def _wanted_text(text: str, low: str) -> str | None:
    for w in SEARCH_WORDS:
        at = low.find(w)
        if at < 0:
            continue
        rest = text[at + len(w) :].lstrip()
        if rest.startswith('"'):
            term = rest.strip('"').split('"')[0]
        else:
            words = rest.split()
            stop = next((i for i, x in enumerate(words) if x.lower() in STOP_WORDS), len(words))
            term = " ".join(words[:stop])
        if len(term) > 1:
            return term
    return None


def translate(text: str, labels: tuple[str, ...] = ()) -> str:
    """The query an English request stands for. Rules go by first hit, in a
    fixed order; words are found as substrings, so 'warnings' names a place."""
    low = text.lower()
    filters, label_filters, stages = [], [], []
    place = _place(text, low)
    key = next((k for k in ("job", "app", "service") if k in labels), "job")
    level = next((to for w, to in LEVEL_WORDS if w in low), None)
    if level:
        (label_filters if "level" in labels else filters).append(f'level="{level}"' if "level" in labels else f'|= "{level}"')
    status = _first(STATUS_WORDS, low)
    if status:
        filters.append(f'|~ "{status[0]}[0-9]{{2}}"' if status.endswith("xx") else f'|= "{status}"')
    if _first(SLOW_WORDS, low):
        stages.append("json")
        number = re.search(r"\d[\d.]*", low)
        try:
            limit = float(number[0]) if number else 1000.0
        except ValueError:
            limit = 1000.0
        label_filters.append(f"duration>{int(limit * 1000 if 'second' in low else limit)}")
    if _first(JSON_WORDS, low) and "json" not in stages:
        stages.append("json")
    term = _wanted_text(text, low)
    if term:
        filters.append(f'|= "{term}"')
    if not (filters or label_filters or stages):
        rest = " ".join(w for w in low.split() if w not in FILLER)
        if rest:
            filters.append(f'|= "{rest}"')
    query = f'{{{key}="{place}"}}' if place else "{}"
    query += "".join(f" | {s}" for s in stages) + "".join(f" {f}" for f in filters) + "".join(f" | {f}" for f in label_filters)
    return "{} " if query == "{}" else query
