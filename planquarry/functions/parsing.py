"""JSON out of model answers: strict objects, lists, fenced blocks, truncated lists. Arrow UDFs, as no built-in
parser is strict about what follows a value or repairs a cut one."""

from __future__ import annotations

import difflib
import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How answers mark code and thoughts.
_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S | re.I)
_THINK = re.compile(r"<think>.*?(?:</think>|$)", re.S | re.I)
# End of fixed values.


def _clean(text: str | None) -> str:
    return _THINK.sub("", text or "").strip()


def _load(text: str):
    def refuse(name):
        raise ValueError(name)

    try:
        return json.loads(text, parse_constant=refuse)
    except (ValueError, RecursionError):
        return None


def candidates(text: str | None) -> list[str]:
    """Texts to try in order: fenced blocks, the whole, values that stand alone, the first open bracket closed, inner values."""
    body = _clean(text)
    out = [x.strip() for x in _FENCE.findall(body)] + [body]
    decoder, outer, inner, upto = json.JSONDecoder(), [], [], 0
    for m in re.finditer(r"[{\[]", body):
        try:
            _, end = decoder.raw_decode(body, m.start())
        except (ValueError, RecursionError):
            upto = len(body)  # what follows may be part of a cut value
            continue
        (outer if m.start() >= upto else inner).append(body[m.start() : end])
        upto = max(upto, end)
    out += outer
    if (fixed := closed(body)) is not None:
        out.append(fixed)
    out += inner
    return list(dict.fromkeys(x for x in out if x))


def closed(text: str) -> str | None:
    """A cut value, from its first bracket to its last whole element, with its open brackets closed."""
    start = re.search(r"[{\[]", text)
    if not start:
        return None
    stack, quoted, escaped, safe = [], False, False, None
    for k in range(start.start(), len(text)):
        c = text[k]
        if quoted:
            escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
            continue
        if c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            if not stack or stack.pop() != c:
                return None
            safe = (k + 1, list(stack))
            if not stack:
                return text[start.start() : k + 1]
    if safe is None:
        return None
    end, rest = safe
    return text[start.start() : end] + "".join(reversed(rest))


def object_of(text: str | None) -> dict | None:
    """The one object that a text is, after thinking and a fence are taken off; nothing may stand around it."""
    body = _clean(text)
    fence = _FENCE.search(body)
    value = _load((fence.group(1) if fence else body).strip())
    return value if isinstance(value, dict) else None


def list_of(text: str | None) -> list | None:
    """The first list that can be read out of a text, cut ones included; null if there is none."""
    for x in candidates(text):
        value = _load(x)
        if isinstance(value, list):
            return value
    return None


def lists_of(text: str | None) -> list[list]:
    """All lists of a text in order: the whole, else fenced blocks, else naked ones."""
    body = _clean(text)
    whole = _load(body)
    if isinstance(whole, list):
        return [whole]
    fenced = [v for x in _FENCE.findall(body) if isinstance(v := _load(x.strip()), list)]
    if fenced:
        return fenced
    out, at, decoder = [], 0, json.JSONDecoder()
    while (m := re.search(r"\[", body[at:])) is not None:
        try:
            value, end = decoder.raw_decode(body, at + m.start())
        except (ValueError, RecursionError):
            at += m.start() + 1
            continue
        if isinstance(value, list):
            out.append(value)
        at = end
    return out


def items_of(values) -> list[dict]:
    """Annotations in a list: (category, size, bbox), other spellings accepted, bad ones left out."""
    out = []
    for x in values or []:
        if not isinstance(x, dict):
            continue
        name, box = x.get("category", x.get("label")), x.get("bbox", x.get("bbox_2d"))
        if not isinstance(name, str) or not name.strip() or not isinstance(box, list) or len(box) != 4:
            continue
        if not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in box):
            continue
        out.append({"category": name.strip(), "size": str(x.get("size") or "").strip(), "bbox": [float(v) for v in box]})
    return out


# Types as objects: workers import this module and have no session to parse type texts with.
ITEMS = T.ArrayType(
    T.StructType([T.StructField("category", T.StringType()), T.StructField("size", T.StringType()), T.StructField("bbox", T.ArrayType(T.DoubleType()))])
)


@F.pandas_udf(T.StringType())
def parse_object(texts: pd.Series) -> pd.Series:
    """Compact JSON of the strict object, or null."""
    found = (object_of(t) for t in texts)
    return pd.Series([None if v is None else json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in found], dtype=object)


@F.pandas_udf(ITEMS)
def parse_items(texts: pd.Series) -> pd.Series:
    """Annotations of the first readable list, or null."""
    found = (list_of(t) for t in texts)
    return pd.Series([None if v is None else items_of(v) for v in found], dtype=object)


@F.pandas_udf(T.ArrayType(ITEMS))
def parse_blocks(texts: pd.Series) -> pd.Series:
    """Annotations of every list of a text, in order."""
    return pd.Series([[items_of(v) for v in lists_of(t)] for t in texts], dtype=object)


def snap(names: list[str], cutoff: float = 0.6):
    """UDF: the closest of `names` by matching blocks, at least `cutoff` alike, else the text itself."""

    @F.pandas_udf(T.StringType())
    def closest(texts: pd.Series) -> pd.Series:
        table = {t: next(iter(difflib.get_close_matches(t, names, 1, cutoff)), t) for t in texts.dropna().unique()}
        return pd.Series([table.get(t) for t in texts], dtype=object)

    return closest
