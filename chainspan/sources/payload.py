"""Nested payloads (JSON text) to flat field maps."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainspan.functions.text import bound

_OBJECT = "map<string,variant>"


def _text(v: Column, kind: Column) -> Column:
    """A leaf as text: strings as they are, null as '', lists and the rest as JSON."""
    return (
        F.when(v.isNull() | (kind == "VOID"), F.lit(""))
        .when(kind == "STRING", F.try_variant_get(v, "$", "string"))
        .otherwise(F.to_json(v))
    )


#: Levels of objects that are unrolled as built-in expressions; payloads nested deeper go to a Python function.
UNROLLED = 4


def flat_json(text: str | None) -> str | None:
    """A JSON object with its nested objects opened up: dotted keys, objects read in key order, later leaves replacing
    earlier ones. Leaves stay as they are, numbers letter for letter."""
    if text is None:
        return None
    # Numbers are carried as marked strings, so that nothing is rounded or written in another form.
    mark = next(m for m in map(chr, range(0xE000, 0xF8FF)) if m not in text)
    whole = json.loads(text, parse_int=lambda n: mark + n, parse_float=lambda n: mark + n)
    todo = [("", whole if isinstance(whole, dict) else {})]
    out: dict[str, object] = {}
    while todo:
        key, value = todo.pop()
        if isinstance(value, dict):
            todo += [(f"{key}.{k}" if key else k, v) for k, v in sorted(value.items(), key=lambda kv: kv[0].encode("utf-8", "surrogatepass"), reverse=True)]
        else:
            out[key] = value
    return re.sub(f'"{mark}([^"]*)"', r"\1", json.dumps(out, ensure_ascii=False))


def _flat(text: pd.Series) -> pd.Series:
    return text.map(flat_json)


def flatten_payload(c: Column) -> Column:
    """JSON object -> map of dotted key to text, however deep objects lie in it. Objects are read in key order; of repeated
    dotted keys the last one read stays.

    Up to ``UNROLLED`` levels are built-in expressions, each handling all keys of an object at once. Only payloads with
    objects below that are opened up in Python; their leaves are then rendered by the same expressions as all others, so
    the result does not depend on the depth. Empty objects have no leaves.
    """
    empty = F.array().cast("array<struct<k:string,v:string>>")

    def entries(obj: Column, prefix: Column, left: int) -> Column:
        pairs = F.map_entries(F.try_variant_get(obj, "$", _OBJECT))

        def one(e: Column) -> Column:
            key = F.concat(prefix, e["key"])

            def opened(kind: Column) -> Column:
                leaf = F.array(F.struct(key.alias("k"), _text(e["value"], kind).alias("v")))
                if left == 0:
                    return leaf
                nested = kind.startswith("OBJECT")
                return F.when(nested, entries(e["value"], F.concat(key, F.lit(".")), left - 1)).otherwise(leaf)

            return bound(F.schema_of_variant(e["value"]), opened)

        return F.coalesce(F.flatten(F.transform(pairs, one)), empty)

    def last(found: Column) -> Column:
        # Most payloads hold each key once; only the others compare their keys.
        once = F.size(F.array_distinct(F.transform(found, lambda e: e["k"]))) == F.size(found)
        later = lambda e, i: F.exists(F.slice(found, i + 2, F.size(found)), lambda x: x["k"] == e["k"])
        return F.when(once, found).otherwise(F.filter(found, lambda e, i: ~later(e, i)))

    # Deeper nesting needs more opening braces than there are levels unrolled.
    deep = lambda x: (F.octet_length(x) - F.octet_length(F.replace(x, F.lit("{"), F.lit("")))) > UNROLLED
    flat = F.pandas_udf(_flat, T.StringType())(bound(c, lambda x: F.when(deep(x) & F.try_parse_json(x).isNotNull(), x)))
    # What was opened up is one level deep and has each key once.
    found = bound(F.try_parse_json(F.coalesce(flat, c)), lambda whole: entries(whole, F.lit(""), UNROLLED - 1))
    return F.map_from_entries(bound(found, last))
