"""Objects inside JSON scripts of pages. SQL has no walk to any depth, so a small Arrow helper flattens the scripts of a batch."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: JSON nested deeper than this is refused like malformed JSON.
DEEPEST = 400


def _text(value) -> str | None:
    """A scalar as text; an object as its name, value or id."""
    if isinstance(value, dict):
        value = next((value[k] for k in ("name", "value", "@id") if value.get(k) is not None), None)
    if isinstance(value, bool) or value is None or isinstance(value, dict | list):
        return None
    return value if isinstance(value, str) else json.dumps(value)


def _picture(value) -> str | None:
    if isinstance(value, list):
        return next(filter(None, map(_picture, value)), None)
    if isinstance(value, dict):
        value = value.get("url") or value.get("contentUrl")
    return value if isinstance(value, str) else None


def _walk(value, top: bool, depth: int, out: list[dict]) -> None:
    if depth > DEEPEST:
        raise ValueError("nested too deep")
    if isinstance(value, list):
        for child in value:
            _walk(child, top, depth + 1, out)
    elif isinstance(value, dict):
        kind = value.get("@type")
        row = {k: t for k, v in value.items() if (t := _text(v)) is not None}
        row |= {f"#{k}": p for k in ("image", "logo") if (p := _picture(value.get(k)))}
        row |= {"#type": " ".join(map(str, kind)) if isinstance(kind, list) else str(kind or "")}
        out.append(row | ({"#top": "1"} if top else {}))
        for k, child in value.items():
            _walk(child, top and k == "@graph", depth + 1, out)


def walked(block: str) -> list[dict]:
    """Every object of a JSON text, outermost first; nothing if it is malformed."""
    out: list[dict] = []
    try:
        _walk(json.loads(block), True, 0, out)
    except (ValueError, RecursionError):
        return []
    return out


_ROWS = T.ArrayType(T.MapType(T.StringType(), T.StringType()))


def _objects(blocks: pd.Series) -> pd.Series:
    return blocks.map(lambda some: [row for b in (some if some is not None else ()) for row in walked(b)])


def objects(blocks: Column) -> Column:
    """All objects of an array of JSON texts, one map each: scalar entries as text, and under "#type", "#image", "#logo" what these
    mean; "#top" marks those reached through arrays and @graph alone."""
    return F.pandas_udf(_objects, _ROWS)(blocks)
