"""Typed references between collections, as text and as Columns.

A pointer is ``@collection:key`` (an old ``lnk_`` before the key is dropped) or,
structurally, ``db/schema/collection/key`` with no ``@``, ``:`` or backslash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_AT = re.compile(r"@([^:]+):(?:lnk_)?([^:]+)", re.S)
#: A structural pointer as a Java pattern: at least two segments before the key.
PATH_PATTERN = r"^([^@:\\/]+(?:/[^@:\\/]+)+)/(?:lnk_)?([^@:\\/]+)$"
_PATH = re.compile(r"([^@:\\/]+(?:/[^@:\\/]+)+)/(?:lnk_)?([^@:\\/]+)", re.S)


def parse_pointer(text: str) -> tuple[str, str] | None:
    """(collection, key), or None if ``text`` is no pointer."""
    if text.startswith("@"):
        found = _AT.fullmatch(text)
        return (found[1], found[2]) if found else None
    found = _PATH.fullmatch(text)
    if not found or any(s in (".", "..") for s in (*found[1].split("/"), found[2])):
        return None
    return found[1], found[2]


def clean_key(text: str) -> str:
    """A record key without the pointer around it."""
    if text.startswith("@"):
        found = _AT.fullmatch(text)
        if found:
            return found[2]
    return text.lstrip("@").removeprefix("lnk_")


def format_pointer(collection: str, key: str) -> str:
    return f"@{collection.lstrip('@')}:{clean_key(key)}"


def scoped(collection: str, namespace: str | None) -> str:
    """A collection's name within a namespace: prefixed once."""
    if namespace is None or collection.startswith(f"{namespace}_"):
        return collection
    return f"{namespace}_{collection}"


def normalize(collection: str, reference: str, namespace: str | None = None) -> str:
    """The full pointer that ``reference`` stands for; a bare key points into ``collection``."""
    found = parse_pointer(reference)
    target, key = found or (collection, reference)
    return format_pointer(scoped(target, namespace), key)


def inferred_collection(field: str) -> str:
    """The collection a field's name suggests: its singular.

    ``ies`` becomes ``y`` and a last ``s`` goes, but for ``ss`` and ``us`` and
    one-letter names.
    """
    if field.endswith("ies") and len(field) > 3:
        return field[:-3] + "y"
    if len(field) > 1 and field.endswith("s") and not field.endswith(("ss", "us")):
        return field[:-1]
    return field


def _at(col: Column) -> tuple[Column, Column, Column]:
    """Whether a text is a pointer with ``@``, its collection and key, by places: patterns are slow on many rows."""
    colon = F.instr(col, ":")
    rest = F.substring(col, colon + 1, F.length(col))
    good = F.startswith(col, F.lit("@")) & (colon > 2) & (rest != "") & (F.instr(rest, ":") == 0)
    key = F.when(F.startswith(rest, F.lit("lnk_")) & (rest != "lnk_"), F.substring(rest, F.lit(5), F.length(rest))).otherwise(rest)
    return good, F.substring(col, F.lit(2), colon - 2), key


def pointer_key(col: Column) -> Column:
    """The key of a pointer column; other texts as they are."""
    good, _, key = _at(col)
    path = F.regexp_extract(col, PATH_PATTERN, 2)
    return F.when(good, key).when(F.startswith(col, F.lit("@")), col).when(path != "", path).otherwise(col)


def pointer_collection(col: Column) -> Column:
    """The collection of a pointer column; null for other texts."""
    good, collection, _ = _at(col)
    path = F.regexp_extract(col, PATH_PATTERN, 1)
    return F.when(good, collection).when(~F.startswith(col, F.lit("@")) & (path != ""), path)


def normalized(col: Column, collection: str, namespace: str | None = None) -> Column:
    """:func:`normalize` of a column."""
    target = F.coalesce(pointer_collection(col), F.lit(collection))
    if namespace is not None:
        prefix = f"{namespace}_"
        target = F.when(F.startswith(target, F.lit(prefix)), target).otherwise(F.concat(F.lit(prefix), target))
    key = F.when(pointer_collection(col).isNull(), F.regexp_replace(col, r"^@*(?:lnk_)?", "")).otherwise(pointer_key(col))
    return F.concat(F.lit("@"), target, F.lit(":"), key)


def without_legacy_prefix(col: Column) -> Column:
    """Ids and pointers of old stores, freed of ``lnk_``."""
    return F.regexp_replace(col, r"^(@[^:]+:)?lnk_", "$1")


def pointer_to(collection: str, key: Column) -> Column:
    return F.concat(F.lit(f"@{collection.lstrip('@')}:"), key)
