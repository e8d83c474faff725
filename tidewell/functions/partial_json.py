"""JSON that was cut off: the longest object it can still be, and the state of one field."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CLOSING = {"{": "}", "[": "]"}
_NUMBER = re.compile(r"-?\d+(\.\d+)?([eE][-+]?\d+)?")


def complete(raw: str | None) -> tuple[str | None, str]:
    """The first object of a text, closed if it was cut, and ``missing``, ``partial`` or ``complete``.

    One pass with a stack of open brackets.  An open string value is closed where it
    was cut, without half an escape; a key without its value, and a number or word
    that nothing ends, go; a comma before a closing bracket goes.  What doesn't follow
    the grammar ends the object there.
    """
    start = (raw or "").find("{")
    if start < 0:
        return None, "missing"
    out: list[str] = []
    stack: list[str] = []
    safe, safe_stack = 0, ""  # how much of the output can be closed as it stands, and by which brackets
    want = "value"
    i, n = start, len(raw)

    def close(end: int, brackets: str) -> str:
        return "".join(out[:end]) + "".join(CLOSING[b] for b in reversed(brackets))

    while i < n:
        ch = raw[i]
        if ch in " \t\r\n":
            i += 1
            continue
        if ch == '"' and want in ("value", "key", "first key", "first value"):
            j, good = i + 1, i + 1
            while j < n and raw[j] != '"':
                half = raw[j] == "\\" and raw[j + 1 : j + 2] == "u" and raw[j + 2 : j + 4].lower() in ("d8", "d9", "da", "db")
                j += 1 if raw[j] != "\\" else 6 if raw[j + 1 : j + 2] == "u" else 2
                good = j if j <= n and not half else good
            if j >= n:
                if "key" in want:
                    break
                body = raw[i:good].replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
                return "".join(out) + body + '"' + "".join(CLOSING[b] for b in reversed(stack)), "partial"
            out.append(raw[i : j + 1].replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t"))
            i, want = j + 1, "colon" if "key" in want else "comma"
        elif ch in "{[" and want in ("value", "first value"):
            out.append(ch)
            stack.append(ch)
            i, want = i + 1, "first key" if ch == "{" else "first value"
        elif stack and ch == CLOSING[stack[-1]] and want in ("comma", "first key", "first value", "key", "value") and not (want == "value" and out[-1] == ":"):
            if out[-1] == ",":
                out.pop()
            out.append(ch)
            stack.pop()
            i, want = i + 1, "comma"
            if not stack:
                return "".join(out), "complete"
        elif ch == "," and want == "comma":
            out.append(ch)
            i, want = i + 1, "key" if stack[-1] == "{" else "value"
            continue
        elif ch == ":" and want == "colon":
            out.append(ch)
            i, want = i + 1, "value"
            continue
        elif want in ("value", "first value") and (m := re.compile(r"true|false|null|-?[\d.eE+-]+").match(raw, i)) and m.end() < n and raw[m.end()] in ",]} \t\r\n" and (m[0][0] in "tfn" or _NUMBER.fullmatch(m[0])):
            out.append(m[0])
            i, want = m.end(), "comma"
        else:
            break
        if want in ("comma", "first key", "first value"):
            safe, safe_stack = len(out), "".join(stack)
    return close(safe, safe_stack), "partial"


def _completed(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([complete(x) for x in raw], columns=["body", "status"])


def completed(raw: Column | str) -> Column:
    """``body, status``: ``complete`` of each text."""
    return F.pandas_udf(_completed, "body string, status string")(raw)


def partial_field(raw: Column | str, field: str) -> Column:
    """``value, status`` of a string field as far as it has come: ``missing``, ``partial`` or ``complete``; keys in any case.

    Half an escape at the end waits for its rest.
    """
    text = F.coalesce(F.col(raw) if isinstance(raw, str) else raw, F.lit(""))
    found = r'(?is)"' + re.escape(field) + r'"\s*:\s*"((?:[^"\\]|\\u[0-9a-f]{4}|\\[^u])*+)("?)'
    body = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, found, 1), "\n", r"\\\\n"), "\t", r"\\\\t")
    value = F.coalesce(F.get(F.from_json(F.concat(F.lit('["'), body, F.lit('"]')), "array<string>"), F.lit(0)), body)
    status = F.when(~text.rlike(found), "missing").when(F.regexp_extract(text, found, 2) == '"', "complete").otherwise("partial")
    return F.struct(F.when(status == "missing", "").otherwise(value).alias("value"), status.alias("status"))
