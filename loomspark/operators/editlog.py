"""An edit log over groups of members: kinds of operations, each with its inverse, folded in order.

The state of a draft is a mapping from (theme, title) to members. The fold is sequential within a draft, so drafts are
the groups; the same function serves batch (``applyInPandas``) and stream (``streaming.drafts``).
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame

REQUIRED = {
    "MOVE_CITATION": {"response", "source", "target"},
    "CREATE_POSITION": {"theme", "title", "responses"},
    "MERGE_POSITIONS": {"keys", "theme", "title"},
    "UNMERGE_POSITIONS": {"restore", "key"},
    "SPLIT_POSITION": {"key", "splits"},
    "DELETE_POSITION": {"key"},
    "UPDATE_POSITION": {"key", "theme", "title"},
    "MARK_NO_OPINION": {"responses"},
    "CREATE_THEME": {"theme"},
    "DELETE_THEME": {"theme"},
    "RESTORE_STATE": {"state"},
}
NO_OPINION = ("other", "no opinion")
#: What stands for a theme that has no position yet.
EMPTY = ""
State = dict[tuple[str, str], list[int]]


def problem(kind: str, data: dict) -> str | None:
    """Why an operation is not valid, or None."""
    if kind not in REQUIRED:
        return f"unknown operation {kind}"
    missing = REQUIRED[kind] - data.keys()
    return f"missing {', '.join(sorted(missing))}" if missing else None


def applied(state: State, kind: str, data: dict) -> tuple[State, tuple[str, dict]]:
    """The state after an operation, and the operation that takes it back. The state given stays as it is."""
    if why := problem(kind, data):
        raise ValueError(why)
    before = {k: list(v) for k, v in state.items()}
    new: State = {k: list(v) for k, v in state.items()}
    key = lambda x: tuple(x)
    if kind == "MOVE_CITATION":
        source, target, who = key(data["source"]), key(data["target"]), data["response"]
        if who not in new.get(source, []):
            raise ValueError("the response is not in the position")
        if target not in new:
            raise ValueError("there is no such position to move to")
        new[source].remove(who)
        new[target] = sorted({*new.get(target, []), who})
    elif kind == "CREATE_POSITION":
        if (data["theme"], data["title"]) in new:
            raise ValueError("the position exists")
        for members in new.values():
            members[:] = [m for m in members if m not in data["responses"]]
        new.pop((data["theme"], EMPTY), None)
        new[(data["theme"], data["title"])] = sorted(set(data["responses"]))
    elif kind == "MERGE_POSITIONS":
        if len(data["keys"]) < 2:
            raise ValueError("a merge needs two positions")
        if (data["theme"], data["title"]) in new and [data["theme"], data["title"]] not in [list(k) for k in data["keys"]]:
            raise ValueError("another position has that title")
        members = sorted({m for k in data["keys"] for m in new.pop(key(k))})
        new[(data["theme"], data["title"])] = members
    elif kind == "UNMERGE_POSITIONS":
        new.pop(key(data["key"]), None)
        for theme, title, members in data["restore"]:
            new[(theme, title)] = list(members)
    elif kind == "SPLIT_POSITION":
        theme, _ = key(data["key"])
        new.pop(key(data["key"]))
        for title, members in data["splits"]:
            new[(theme, title)] = sorted(members)
    elif kind == "DELETE_POSITION":
        new.pop(key(data["key"]))
    elif kind == "UPDATE_POSITION":
        if key(data["key"]) != (data["theme"], data["title"]) and (data["theme"], data["title"]) in new:
            raise ValueError("another position has that title")
        new[(data["theme"], data["title"])] = new.pop(key(data["key"]))
    elif kind == "MARK_NO_OPINION":
        for members in new.values():
            members[:] = [m for m in members if m not in data["responses"]]
        new[NO_OPINION] = sorted({*new.get(NO_OPINION, []), *data["responses"]})
    elif kind == "CREATE_THEME":
        if any(theme == data["theme"] for theme, _ in new):
            raise ValueError("the theme exists")
        new[(data["theme"], EMPTY)] = []
    elif kind == "DELETE_THEME":
        own = [k for k in new if k[0] == data["theme"]]
        if not own or any(new[k] or k[1] != EMPTY for k in own):
            raise ValueError("there is no such theme without positions")
        for k in own:
            new.pop(k)
    else:
        new = {(t, n): list(m) for t, n, m in data["state"]}
    return new, ("RESTORE_STATE", {"state": [[t, n, m] for (t, n), m in before.items()]})


def all_applied(state: State, operations: list[tuple[str, dict]]) -> tuple[State, list[tuple[str, dict]]]:
    """All operations or none: an operation that fails takes back those before it."""
    inverses: list[tuple[str, dict]] = []
    now = state
    for kind, data in operations:
        try:
            now, inverse = applied(now, kind, data)
        except (ValueError, KeyError) as e:
            for k, d in reversed(inverses):
                now, _ = applied(now, k, d)
            raise ValueError(f"taken back: {e}") from e
        inverses.append(inverse)
    return now, inverses


def folded(start: DataFrame, log: DataFrame) -> DataFrame:
    """draft, theme, title, members after a log: ``start`` has draft, theme, title, members (array of long); ``log`` draft,
    sequence, kind, data (JSON) and undone (boolean). Operations that are undone, or do not apply, change nothing."""

    def fold(key, rows: pd.DataFrame, operations: pd.DataFrame) -> pd.DataFrame:
        state: State = {(r.theme, r.title): sorted(int(m) for m in r.members) for r in rows.itertuples()}
        for o in operations[~operations["undone"].astype(bool)].sort_values("sequence").itertuples():
            try:
                state, _ = applied(state, o.kind, json.loads(o.data))
            except (ValueError, KeyError):
                continue
        return pd.DataFrame([(key[0], t, n, m) for (t, n), m in state.items()], columns=["draft", "theme", "title", "members"])

    return start.groupBy("draft").cogroup(log.groupBy("draft")).applyInPandas(fold, "draft long, theme string, title string, members array<long>")
