"""JSON as models write it: fenced, cut short, or with braces missing.  Arrow batches; each text is parsed once."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_LISTS = ("items", "results", "entities")


def unfenced(text: str) -> str:
    return re.sub(r"```\s*$", "", re.sub(r"^```(?:json)?\s*", "", text.strip(), flags=re.M).strip(), flags=re.M).strip()


def closed(text: str) -> str:
    """The text with what it leaves open closed: a string, then brackets from the inside out; a comma or colon at the end goes."""
    open_, quoted, escaped = [], False, False
    for c in text:
        if quoted:
            escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]" and open_ and open_[-1] == c:
            open_.pop()
    text = text + '"' if quoted else re.sub(r"[,:\s]+$", "", text)
    return text + "".join(reversed(open_))


def whole_objects(text: str) -> list:
    """The outermost objects of a text that are complete and valid."""
    out, depth, start = [], 0, -1
    for i, c in enumerate(text):
        if c == "{":
            start = i if depth == 0 else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                try:
                    out.append(json.loads(text[start : i + 1]))
                except ValueError:
                    pass
    return out


def parse(text: str | None) -> object:
    for attempt in (lambda t: t, closed, lambda t: t.replace("{{", "{").replace("}}", "}")):
        try:
            return json.loads(attempt(unfenced(text or "")))
        except ValueError:
            continue
    return None


def items(text: str | None) -> list:
    """The list that a text is or holds; of a list cut short, its whole objects."""
    plain = unfenced(text or "")
    try:
        found = json.loads(plain)
    except ValueError:
        return whole_objects(plain) or (x if isinstance(x := parse(text), list) else [])
    if isinstance(found, list):
        return found
    return next((found[k] for k in _LISTS if isinstance(found.get(k), list)), []) if isinstance(found, dict) else []


@F.pandas_udf(StringType())
def lenient_object(texts: pd.Series) -> pd.Series:
    """A text's object as plain JSON; null if it has none."""
    return texts.map(lambda t: json.dumps(x, sort_keys=True) if isinstance(x := parse(t), dict) else None)


@F.pandas_udf(ArrayType(StringType()))
def lenient_list(texts: pd.Series) -> pd.Series:
    """A text's list, each item as plain JSON."""
    return texts.map(lambda t: [json.dumps(x, sort_keys=True) for x in items(t)])
