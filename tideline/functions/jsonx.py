"""JSON containment, presence and merge with PostgreSQL's jsonb rules, over JSON text columns.

A scalar is compared by type and value within the JVM. Objects and arrays as right sides go through an Arrow
function, since their containment recurses."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.functions.scalars import col


def _path(keys: Sequence[str]) -> str:
    return "$" + "".join("['" + k.replace("'", "\\'") + "']" for k in keys)


def contains(left: object, right: object) -> bool:
    """Whether a parsed JSON value contains another: objects by keys, arrays as sets, scalars by type and value."""
    if isinstance(right, dict):
        return isinstance(left, dict) and all(k in left and contains(left[k], v) for k, v in right.items())
    if isinstance(right, list):
        return isinstance(left, list) and all(any(_element(x, y) for x in left) for y in right)
    if isinstance(left, (dict, list)):
        return False
    if isinstance(left, bool) or isinstance(right, bool) or left is None or right is None:
        return left is right
    if isinstance(left, str) or isinstance(right, str):
        return isinstance(left, str) and isinstance(right, str) and left == right
    return left == right


def _element(left: object, right: object) -> bool:
    return contains(left, right) if isinstance(right, (dict, list)) else not isinstance(left, (dict, list)) and contains(left, right)


def json_contains(document: str | Column, keys: Sequence[str], value: object) -> Column:
    """Whether the document has the value at the path of object keys; false for null documents."""
    if isinstance(value, (dict, list)):
        wanted = json.dumps(value)

        @F.pandas_udf("boolean")
        def walk(documents: pd.Series) -> pd.Series:
            right = json.loads(wanted)
            for k in reversed(keys):
                right = {k: right}
            return documents.map(lambda d: d is not None and contains(json.loads(d), right))

        return F.coalesce(walk(col(document)), F.lit(False))
    at = F.try_variant_get(F.try_parse_json(col(document)), _path(keys), "variant")
    kind = F.schema_of_variant(at)
    if value is None:
        found = F.is_variant_null(at)
    elif isinstance(value, bool):
        found = (kind == "BOOLEAN") & (F.try_variant_get(at, "$", "boolean") == F.lit(value))
    elif isinstance(value, str):
        found = (kind == "STRING") & (F.try_variant_get(at, "$", "string") == F.lit(value))
    else:
        number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        found = number & (F.try_variant_get(at, "$", "double") == F.lit(float(value)))
        if isinstance(value, int) and abs(value) < 10**27:
            #: A double alone takes large integers for their neighbours, a decimal alone rounds small differences off.
            found = found & (F.try_variant_get(at, "$", "decimal(38,10)") == F.lit(str(value)).cast("decimal(38,10)"))
    return F.coalesce(found, F.lit(False))


def json_present(document: str | Column, keys: Sequence[str]) -> Column:
    """Whether the path leads to a value; a JSON null is one. Keys of digits also index arrays."""
    parsed = F.try_parse_json(col(document))
    found = F.try_variant_get(parsed, _path(keys), "variant").isNotNull()
    if any(k.isdigit() for k in keys):
        steps = "$" + "".join(f"[{k}]" if k.isdigit() else f"['{k}']" for k in keys)
        found = found | F.try_variant_get(parsed, steps, "variant").isNotNull()
    return F.coalesce(found, F.lit(False))


def json_merge(left: str | Column, right: str | Column) -> Column:
    """The keys of both objects, at the top level only; the right one's values win. Null counts as {}."""
    kind = "map<string,variant>"
    one, two = (F.coalesce(F.try_variant_get(F.try_parse_json(col(x)), "$", kind), F.expr(f"cast(map() as {kind})")) for x in (left, right))
    kept = F.map_filter(one, lambda k, _: ~F.map_contains_key(two, k))
    return F.to_json(F.map_concat(kept, two))
