"""Repairs of model output and of markup: sequential rules in Python, applied over Arrow batches by :func:`mapped`."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = re.compile(r"^\s*```[a-zA-Z]*\s*\n?|\n?\s*```\s*$")
MARKER = re.compile(r"<<REF_[0-9]+>>|\[\[?CITE_[0-9]+\]?\]|\[\^[0-9]+\]")


def mapped(column: Column, rule: Callable[[str], str | None]) -> Column:
    """The rule applied to each text; null stays null."""

    @F.pandas_udf("string")
    def run(texts):
        return texts.map(lambda t: None if t is None else rule(t))

    return run(column)


def repair_json(text: str) -> str | None:
    """JSON out of a model's answer: without fences and trailing commas, closed where it was cut off; None if that fails."""
    text = FENCE.sub("", text.strip())
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    text = text[start:]
    for candidate in (text, *_closed(text)):
        candidate = re.sub(r",(\s*[}\]])", r"\1", candidate)
        try:
            return json.dumps(json.loads(candidate), ensure_ascii=False)
        except ValueError:
            continue
    return None


def _closed(text: str):
    """The text cut after its last whole value, with the brackets closed that were open there; later cuts first."""
    stack, inside, escaped, cuts = [], False, False, []
    for i, c in enumerate(text):
        if inside:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = False
            continue
        if c == '"':
            inside = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            if stack:
                stack.pop()
            cuts.append((i + 1, "".join(reversed(stack))))
            if not stack:
                break
        elif c == ",":
            cuts.append((i, "".join(reversed(stack))))
    if inside or stack:
        yield text + ('"' if inside else "") + "".join(reversed(stack))
    for at, closing in reversed(cuts):
        yield text[:at] + closing


def unique_markers(text: str) -> str:
    """Only the first occurrence of each citation marker stays."""
    seen = set()

    def keep(m: re.Match) -> str:
        if m[0] in seen:
            return ""
        seen.add(m[0])
        return m[0]

    return re.sub(r" +([.,;])", r"\1", MARKER.sub(keep, text))


def unescape_markdown(text: str) -> str:
    """Backslash escapes undone, except in code spans."""
    parts = re.split(r"(`[^`]*`)", text)
    return "".join(p if p.startswith("`") else re.sub(r"\\([\\`*_{}\[\]()#+.!>-])", r"\1", p) for p in parts)


def unescape_comments(text: str) -> str:
    """Written-out line breaks become real ones inside comments only."""
    return re.sub(r"\{>>.*?<<\}|<!--.*?-->", lambda m: m[0].replace("\\n", "\n"), text, flags=re.S)


def normalize_markdown(text: str) -> str:
    return unescape_comments(unescape_markdown(text)).replace("\r\n", "\n").replace("\r", "\n")


def markdown_issues(text: str) -> list[str]:
    """What is wrong with a text's comment marks: not closed, empty, or without spaces around."""
    out = []
    opens, closes = text.count("{>>"), text.count("<<}")
    if opens != closes:
        out.append(f"{opens} comments begin and {closes} end")
    out += ["empty comment"] * len(re.findall(r"\{>>\s*<<\}", text))
    out += ["no space before a comment"] * len(re.findall(r"[^\s{]\{>>", text))
    return out


def whole_sentences(text: str, most: int = 350) -> str:
    """As many whole sentences from the start as fit."""
    kept = ""
    for s in re.split(r"(?<=[.!?])\s+", text.strip()):
        joined = f"{kept} {s}".strip()
        if len(joined) > most:
            break
        kept = joined
    return kept


def fallback_quote(text: str, most: int = 300, least: int = 20) -> str:
    """The first paragraph of some length, cut to whole sentences."""
    for p in re.split(r"\n\s*\n", text):
        if len(p.strip()) > least:
            return whole_sentences(p, most) or p.strip()[:most]
    return ""


#: Ordinals of repeated labels.
ORDINALS = ["En", "En anden", "En tredje", "En fjerde", "En femte", "En sjette"]


def ordered_labels(text: str, label: str = "borger") -> str:
    """In each section, the n-th sentence in a row that begins with the same label gets the n-th ordinal."""
    out = []
    for section in re.split(r"(?m)(?=^#)", text):
        run = 0
        parts = re.split(r"(?<=[.!?])(\s+)", section)
        for i in range(0, len(parts), 2):
            m = re.match(rf"En {label}\b", parts[i])
            run = run + 1 if m else 0
            if run > 1:
                parts[i] = ORDINALS[min(run, len(ORDINALS)) - 1] + parts[i][2:]
        out.append("".join(parts))
    return "".join(out)


def contents(text: str, deepest: int = 3) -> str:
    """A table of contents: Markdown headers as an indented list."""
    found = re.findall(r"(?m)^(#{1,6})[ \t]+(.+?)\s*$", text)
    return "\n".join(f"{'  ' * (len(h) - 1)}- {t}" for h, t in found if len(h) <= deepest)
