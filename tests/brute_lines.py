"""A plain, character by character reading of workload lines, to test the column expressions against."""

from __future__ import annotations

import datetime
import re

TABLES = {"users", "badges", "comments", "posts", "posthistory", "postlinks", "votes", "tags"}
LAYOUT = {"complete": ["count", "sql"], "single_table": ["sql", "id", "count"], "subquery": ["sql", "id"]}
BLANKS = " \t\r\n\v\f\xa0﻿"


def fields_of(line: str) -> list[str] | None:
    out, now, quote, i = [], "", "", 0
    while i < len(line):
        c = line[i]
        if quote:
            if c == quote:
                quote = ""
        elif c in "'\"":
            quote = c
        elif line.startswith("||", i):
            out.append(now)
            now, i = "", i + 2
            continue
        now += c
        i += 1
    out.append(now)
    if quote:
        return None
    fields = []
    for f in out:
        f = f.strip(BLANKS)
        if len(f) > 1 and f[0] == f[-1] == '"':
            f = f[1:-1].replace('""', '"').strip(BLANKS)
            if f.count("'") % 2:
                return None
        fields.append(f)
    return fields


def tokens_of(sql: str) -> list[tuple[str, str]] | None:
    out, i = [], 0
    rule = re.compile(r"(?P<blank>[\s\xa0]+)|(?P<text>'(?:[^']|'')*')|(?P<cast>::\s*[A-Za-z]+)|(?P<number>-?\d+(?:\.\d+)?(?![A-Za-z0-9_]))|(?P<name>[A-Za-z_]\w*)|(?P<op><=|>=|=|<|>)|(?P<mark>[(),.;*])", re.A)
    while i < len(sql):
        m = rule.match(sql, i)
        if not m:
            return None
        if m.lastgroup != "blank":
            out.append((m.lastgroup, m.group().lower() if m.lastgroup != "text" else m.group()))
        i = m.end()
    return out


def statement_ok(sql: str) -> bool:
    t = tokens_of(sql)
    if t is None:
        return False
    while t and t[-1][1] == ";":
        t.pop()
    head = ["select", "count", "(", "*", ")", "from"]
    if [v for _, v in t[:6]] != head:
        return False
    i, aliases = 6, set()
    while True:
        part = t[i : i + 3]
        if not part or part[0][1] not in TABLES:
            return False
        i += 1
        if i < len(t) and t[i] == ("name", "as"):
            i += 1
        if i >= len(t) or t[i][0] != "name":
            return False
        aliases.add(t[i][1])
        i += 1
        if i < len(t) and t[i][1] == ",":
            i += 1
            continue
        break
    if i == len(t):
        return True
    if t[i] != ("name", "where"):
        return False
    rest = t[i + 1 :]

    def column(j):
        if [k for k, _ in rest[j : j + 3]] == ["name", "mark", "name"] and rest[j + 1][1] == "." and rest[j][1] in aliases:
            return j + 3
        return None

    def condition(j):
        if j < len(rest) and rest[j][1] == "(":
            j = conjunction(j + 1)
            return j + 1 if j is not None and j < len(rest) and rest[j][1] == ")" else None
        j = column(j)
        if j is None or j >= len(rest) or rest[j][0] != "op":
            return None
        j += 1
        if j >= len(rest):
            return None
        if rest[j][0] == "number":
            return j + 1
        if rest[j][0] == "text":
            if j + 1 < len(rest) and rest[j + 1][0] == "cast":
                if "timestamp" in rest[j + 1][1]:
                    try:
                        datetime.datetime.strptime(rest[j][1][1:-1], "%Y-%m-%d %H:%M:%S")
                    except ValueError:
                        return None
                return j + 2
            return j + 1
        return column(j)

    def conjunction(j):
        j = condition(j)
        while j is not None and j < len(rest) and rest[j] == ("name", "and"):
            j = condition(j + 1)
        return j

    return conjunction(0) == len(rest)


def reason_of(file_format: str | None, line_number: str | None, line: str | None) -> str | None:
    """'blank', None for a line that loads, or the first reason."""
    if line is None or not line.strip(BLANKS):
        return "blank"
    fields = fields_of(line)
    if fields is None:
        return "quoting"
    if len(fields) != len(LAYOUT.get(file_format, ())):
        return "columns"
    got = dict(zip(LAYOUT[file_format], fields))
    if "count" in got and not (re.fullmatch(r"(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", got["count"], re.A) and float(got["count"]) < float("inf")):
        return "value"
    if "id" in got and not re.fullmatch(r"\d+", got["id"], re.A):
        return "value"
    if line_number is None or not re.fullmatch(r"0*[1-9]\d*", line_number.strip(BLANKS), re.A):
        return "value"
    return None if statement_ok(got["sql"]) else "value"
