"""A plain reading of statements, to test the copy operator against."""

from __future__ import annotations

import re

_BLANKS = " \t\r\n\f\v\xa0"


def canonical(sql: str) -> tuple:
    literals: list[str] = []

    def keep(m):
        literals.append(m.group())
        return f"\0{len(literals) - 1}\0"

    text = re.sub(r"'[^']*'", keep, sql).lower()
    text = re.sub(r"[\"();]", " ", text)
    text = re.sub(f"[{_BLANKS}]+", " ", text).strip()
    text = re.sub(r" ?([<>=.,:*]+) ?", r"\1", text)
    restore = lambda s: re.sub("\0(\\d+)\0", lambda m: literals[int(m.group(1))], s)
    m = re.fullmatch(r"select ?(.*?) ?from (.*?)(?: where (.*))?", text)
    if not m:
        return (restore(text),)
    relations = frozenset(re.sub(" as ", " ", r.strip()) for r in m.group(2).split(","))
    conditions = set()
    for c in (m.group(3) or "").split(" and "):
        c = c.strip()
        sides = re.fullmatch(r"([a-z_]\w*\.\w+)=([a-z_]\w*\.\w+)", c)
        conditions.add("=".join(sorted(sides.groups())) if sides else restore(c))
    return (m.group(1), relations, frozenset(conditions))


def copies(rows: list[tuple]) -> set[tuple]:
    """(first key, copy key) from (key, run, statement) rows."""
    by: dict = {}
    for key, run, sql in rows:
        if sql is not None:
            by.setdefault((run, canonical(sql)), set()).add(key)
    return {(min(keys), k) for keys in by.values() for k in keys if k != min(keys)}
