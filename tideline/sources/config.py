"""Experiment configuration: YAML files composed by a defaults list, overrides, references, and a flat form."""

from __future__ import annotations

import datetime as dt
import re
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

REFERENCE = re.compile(r"\$\{([^${}]+)\}")


def merged(a: dict, b: dict) -> dict:
    out = dict(a)
    for k, v in b.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(path: str, overrides: tuple[str, ...] = ()) -> dict[str, Any]:
    """The resolved configuration of a YAML file.

    ``defaults`` names files beside it (``- group: name``; ``_self_`` is the file itself, last if not named).
    Overrides are ``a.b=value`` with YAML values; one that names a group of the defaults picks another file.
    """
    file = Path(path)
    own = yaml.safe_load(file.read_text()) or {}
    steps = own.pop("defaults", [])
    sets = dict(o.split("=", 1) for o in overrides)
    out: dict[str, Any] = {}
    for step in [*steps, *([] if "_self_" in steps else ["_self_"])]:
        if step == "_self_":
            out = merged(out, own)
            continue
        for group, name in step.items():
            chosen = sets.pop(group, name)
            out = merged(out, {group: yaml.safe_load((file.parent / group / f"{chosen}.yaml").read_text()) or {}})
    for key, value in sets.items():
        nested: Any = yaml.safe_load(value)
        for part in reversed(key.split(".")):
            nested = {part: nested}
        out = merged(out, nested)
    return resolve(out, out, ())


def resolve(node: Any, root: dict, above: tuple[str, ...]) -> Any:
    """``${a.b}`` stands for another key, ``${now:format}`` for the time; other names with a colon stay."""
    if isinstance(node, dict):
        return {k: resolve(v, root, above) for k, v in node.items()}
    if isinstance(node, list):
        return [resolve(v, root, above) for v in node]
    if not isinstance(node, str):
        return node

    def value(name: str) -> Any:
        if name.startswith("now:"):
            return dt.datetime.now().strftime(name[4:])
        if ":" in name:
            return f"${{{name}}}"
        if name in above:
            raise ValueError(f"{name} refers to itself")
        at: Any = root
        for part in name.split("."):
            at = at[part]
        return resolve(at, root, (*above, name))

    if whole := REFERENCE.fullmatch(node):
        return value(whole[1])
    return REFERENCE.sub(lambda m: str(value(m[1])), node)


def flatten(tree: dict[str, Any], prefix: str = "") -> dict[str, Any]:
    """Dotted keys; lists become comma-joined text (an empty one ""), empty maps nothing, nulls stay."""
    out: dict[str, Any] = {}
    for k, v in tree.items():
        name = f"{prefix}{k}"
        if isinstance(v, dict):
            out |= flatten(v, f"{name}.")
        else:
            out[name] = ",".join(map(str, v)) if isinstance(v, list) else v
    return out


def as_table(spark: SparkSession, tree: dict[str, Any]) -> DataFrame:
    """key, value of the flat form, values as text."""
    rows = [(k, None if v is None else str(v)) for k, v in flatten(tree).items()]
    return spark.createDataFrame(rows, "key string, value string")


def flatten_rows(rows: DataFrame, ids: tuple[str, ...]) -> DataFrame:
    """The ids, key and value of each row's nested columns, as flatten() has them: dotted names of structs' fields, arrays as
    comma-joined text (nulls in them left out), nulls as null; a null struct gives its fields as null. A row of n fields gives n rows."""

    def leaves(kind: StructType, column, prefix: str) -> list:
        out = []
        for f in kind.fields:
            own, name = column(f.name), f"{prefix}{f.name}"
            if isinstance(f.dataType, StructType):
                out += leaves(f.dataType, lambda n, own=own: own.getField(n), f"{name}.")
            else:
                value = F.when(own.isNotNull(), F.array_join(own.cast("array<string>"), ",")) if isinstance(f.dataType, ArrayType) else own.cast("string")
                out.append(F.struct(F.lit(name).alias("key"), value.alias("value")))
        return out

    kept = StructType([f for f in rows.schema.fields if f.name not in ids])
    found = leaves(kept, F.col, "")
    return rows.select(*ids, F.inline(F.array(*found))) if found else rows.select(*ids, F.lit("").alias("key"), F.lit("").alias("value")).limit(0)


def save(tree: dict[str, Any], path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(yaml.safe_dump(tree, sort_keys=False))
