"""Canonical JSON (sorted keys, shortest numbers), digests and event hashes."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEPTH = 256


def _number(x: float) -> str:
    """A double as ECMAScript writes it."""
    if x == 0:
        return "0"
    sign, x = ("-", -x) if x < 0 else ("", x)
    text = repr(x)
    mantissa, _, exponent = text.partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(exponent or 0)
    digits = (whole + part).lstrip("0")
    point -= len(whole + part) - len((whole + part).lstrip("0"))
    digits = digits.rstrip("0") or "0"
    n = len(digits)
    if n <= point <= 21:
        return sign + digits + "0" * (point - n)
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    e = point - 1
    return f"{sign}{digits[0]}{'.' + digits[1:] if n > 1 else ''}e{'+' if e > 0 else '-'}{abs(e)}"


def canonical(value: object, depth: int = 0) -> str:
    """Canonical text of a parsed JSON value; ValueError for what has none."""
    if depth > DEPTH:
        raise ValueError("too deep")
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, int):
        return str(value) if abs(value) <= 2**53 else _number(float(value))
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("not finite")
        return _number(value)
    if isinstance(value, str):
        value.encode("utf-8")  # lone surrogates are rejected
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        return "[" + ",".join(canonical(v, depth + 1) for v in value) + "]"
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical(k, depth + 1)}:{canonical(value[k], depth + 1)}" for k in keys) + "}"
    raise ValueError(type(value).__name__)


def _unique(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("duplicate key")
    return out


def canonical_text(raw: str | None) -> str | None:
    """Canonical form of a JSON text; None if it is not strict JSON or has duplicate keys."""
    if raw is None:
        return None
    try:
        return canonical(json.loads(raw, object_pairs_hook=_unique, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c))))
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def canonical_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Exact path, an Arrow batch at a time."""
    for raw in batches:
        yield raw.map(canonical_text)


def canonical_json_fast(raw: Column) -> Column:
    """JVM path by VARIANT: sorted keys, shortest numbers; for values without exponents."""
    return F.to_json(F.try_parse_json(raw))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def event_hash(canonical_without_hash: Column) -> Column:
    return F.sha2(F.concat(canonical_without_hash, F.lit("\n")), 256)


def bundle_text(records: list[tuple[str, Column]]) -> Column:
    """``{"kind":[...],...}`` from arrays of canonical records, kinds in the order given."""
    parts = [F.concat(F.lit(f'"{kind}":['), F.array_join(rows, ","), F.lit("]")) for kind, rows in records]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
