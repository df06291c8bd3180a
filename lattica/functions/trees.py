"""JSON trees as ordered leaves, and tagged claims as structs."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAVES = "array<struct<pos:int,path:array<string>,value:string>>"
CLAIMS = "array<struct<claim_id:int,claim_string:string,subclaims:array<string>,citations:array<int>,rationale:string,supported:boolean>>"


def leaves_of(text: str | None) -> list[dict] | None:
    """Leaves of a JSON text in document order, the last of repeated keys; None if it isn't JSON.

    A text inside a list goes without its index in the path; other items of a list have it.
    """
    try:
        tree = json.loads(text)
    except (TypeError, ValueError):
        return None
    out, stack = [], [((), tree)]
    while stack:
        path, node = stack.pop()
        if isinstance(node, dict):
            stack.extend(((*path, k), v) for k, v in reversed(node.items()))
        elif isinstance(node, list):
            stack.extend((path if isinstance(v, str) else (*path, str(i)), v) for i, v in reversed(list(enumerate(node))))
        else:
            out.append({"pos": len(out), "path": list(path), "value": str(node)})
    return out


def leaves(c: Column) -> Column:
    @F.pandas_udf(LEAVES)
    def run(text: pd.Series) -> pd.Series:
        return text.map(leaves_of)

    return run(c)


def is_json(c: Column) -> Column:
    """Whether a text is a JSON document as a strict parser reads it."""
    return F.try_parse_json(c).isNotNull()


def _numbers(text: str) -> list[int]:
    """Citations 's1', ranges 's2-s4' or 's2 to s4'; what isn't a number is left out."""
    out: list[int] = []
    for part in text.replace("|", "").split(","):
        m = re.fullmatch(r"\s*s?(\d+)\s*(?:-|to)\s*s?(\d+)\s*", part)
        if m:
            out.extend(range(int(m[1]), int(m[2]) + 1))
        elif m := re.fullmatch(r"\s*s?(\d+)\s*", part):
            out.append(int(m[1]))
    return out


def claims_of(response: str | None) -> list[dict] | None:
    """Claims of a tagged response; without a verdict a claim is supported, parts that lack are empty."""
    if response is None:
        return None
    out = []
    for block in response.split("<end||r>"):
        fields = block.strip().split("><")
        head = re.match(r"<?\|r?(\d+)\|", fields[0])
        if not head or len(fields) < 2:
            continue
        rest = fields[3:]
        stop = next((k for k, f in enumerate(rest) if f.startswith("end||subclaims")), None)
        subclaims, tail = (rest, []) if stop is None else (rest[:stop], rest[stop + 1 :])
        if stop is None:
            tail = rest
        after = lambda tag, where=tail: next((where[k + 1] for k in range(len(where) - 2, -1, -1) if where[k].startswith(tag)), "")
        verdict = [f for f in tail if re.match(r"\|(un)?supported\|", f)]
        out.append({"claim_id": int(head[1]), "claim_string": fields[1], "subclaims": subclaims, "citations": _numbers(after("|cite|")), "rationale": after("|explain|"), "supported": not verdict or verdict[-1].startswith("|supported|")})
    return out


def claims(c: Column) -> Column:
    @F.pandas_udf(CLAIMS)
    def run(text: pd.Series) -> pd.Series:
        return text.map(claims_of)

    return run(c)
