"""Objects out of replies that hold JSON: fences and prose around it, or an end that is missing."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What a reply is made of, for brackets: strings (the last one may lack its end) and the brackets outside them.
PARTS = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[{}\[\]]', re.DOTALL)
FENCE = re.compile(r"\A```(?:json)?\s*|\s*```\s*\Z", re.IGNORECASE)
PAIR = {"{": "}", "[": "]"}


def brackets(text: str) -> Iterator[tuple[int, str]]:
    """(end, closing brackets still owed) after each closing bracket outside strings."""
    owed = ""
    for part in PARTS.finditer(text):
        mark = part[0]
        if mark in PAIR:
            owed = PAIR[mark] + owed
        elif mark in ("}", "]"):
            owed = owed[1:]
            yield part.end(), owed


def decoded(text: str, **how) -> tuple[object, int]:
    """The value that text begins with, or None, and how far it could be read."""
    try:
        value, end = json.JSONDecoder(**how).raw_decode(text)
        return value, end
    except json.JSONDecodeError as e:
        return None, e.pos


def ways(text: str) -> Iterator[object]:
    """The text as a value: as it is, whole up to the last container that closed before the fault, with small mistakes put right."""
    value, read = decoded(text)
    yield value if read == len(text) else None
    last = None
    for end, owed in brackets(text):
        if end > read:
            break
        last = end, owed
    if last and (last[0] < len(text) or last[1]):
        yield decoded(text[: last[0]] + last[1])[0]
    yield decoded(re.sub(r",(?=\s*[}\]])", "", text), strict=False)[0]


def extract_object(raw: str | None) -> dict | None:
    """The first object of a reply: the balanced one, else all from the first brace to the last."""
    text = FENCE.sub("", raw or "")
    text = text[text.find("{") :] if "{" in text else ""
    whole = next((end for end, owed in brackets(text) if not owed), 0)
    for candidate in (text[:whole], text[: text.rfind("}") + 1]):
        found = next((v for v in ways(candidate) if v is not None), None) if candidate else None
        if found is not None:
            return found if isinstance(found, dict) else None
    return None


@F.pandas_udf(StringType())
def repaired_json(raw: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The first object of each reply as JSON, null where there is none."""
    for part in raw:
        yield part.map(lambda t: None if (v := extract_object(t)) is None else json.dumps(v, ensure_ascii=False), na_action="ignore")
