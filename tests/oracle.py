"""An interpreter of query objects over plain Python values, written apart from the compiler."""

from __future__ import annotations

import re

from larkspur.functions.pointers import normalize, parse_pointer

MISSING = object()


def kind(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, (int, float)):
        return "number"
    return {str: "string", list: "array", dict: "object"}[type(v)]


def at(record, path):
    for part in path.split("."):
        if not isinstance(record, dict) or part not in record:
            return MISSING
        record = record[part]
    return record


def matches(record, query):
    return all((v := at(record, p)) is not MISSING and field(p, v, q) for p, q in query.items())


def like(text, pattern):
    return re.fullmatch(".*".join(map(re.escape, pattern.split("%"))), text, re.S) is not None


def equal(a, b):
    if kind(a) != kind(b):
        return False
    if kind(a) == "number":
        return isinstance(a, int) == isinstance(b, int) and a == b
    if kind(a) == "array":
        return len(a) == len(b) and all(map(equal, a, b))
    if kind(a) == "object":
        return a.keys() == b.keys() and all(equal(a[k], b[k]) for k in a)
    return a == b


def order(a, b):
    if kind(a) != kind(b) or kind(a) in ("array", "object"):
        return None
    if kind(a) == "null":
        return 0
    if kind(a) == "number":
        a, b = float(a), float(b)
    if kind(a) == "string":
        a, b = a.encode(), b.encode()
    return (a > b) - (a < b)


def field(path, actual, expected):
    if kind(expected) == "string":
        return kind(actual) == "string" and like(actual, expected)
    if kind(expected) == "array":
        return kind(actual) == "array" and len(actual) == len(expected) and all(field(path, x, y) for x, y in zip(actual, expected, strict=True))
    if kind(expected) != "object":
        return equal(actual, expected)
    if any(k.startswith("$") for k in expected):
        return all(operator(path, actual, k, v) for k, v in expected.items())
    if set(expected) == {"_id"} and isinstance(expected["_id"], str):
        return actual == normalize(singular(path), expected["_id"])
    return kind(actual) == "object" and all(k in actual and field(f"{path}.{k}", actual[k], v) for k, v in expected.items())


def singular(path):
    name = path.rpartition(".")[2]
    if name.endswith("ies"):
        return name[:-3] + "y"
    return name[:-1] if len(name) > 1 and name.endswith("s") and not name.endswith(("ss", "us")) else name


def operator(path, actual, name, operand):
    if name == "$in":
        return any(candidate(path, actual, c) for c in operand)
    o = order(actual, operand)
    if name == "$ne":
        return o != 0
    return o is not None and {"$eq": o == 0, "$gt": o > 0, "$gte": o >= 0, "$lt": o < 0, "$lte": o <= 0}.get(name, False)


def candidate(path, actual, c):
    if equal(actual, c):
        return True
    if kind(c) == "object" and set(c) == {"_id"} and isinstance(c["_id"], str):
        return actual == normalize(singular(path), c["_id"])
    if kind(actual) == kind(c) == "string":
        key = lambda x: (parse_pointer(x) or ("", x))[1]
        return like(actual, c) or key(actual) == key(c) or normalize(singular(path), actual) == normalize(singular(path), c)
    return order(actual, c) == 0
