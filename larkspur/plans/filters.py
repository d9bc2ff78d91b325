"""What a request selects: filters, their coercion and validation."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from larkspur.errors import InvalidInput
from larkspur.functions.pointers import clean_key, parse_pointer

OPERATORS = frozenset({"$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in"})


@dataclass(frozen=True)
class Filter:
    """One of: none, drawer, pointer, query, many."""

    kind: str = "none"
    value: Any = None

    @classmethod
    def drawer(cls, name: str) -> Filter:
        return cls("drawer", name.lstrip("@"))

    @classmethod
    def pointer(cls, text: str) -> Filter:
        if text.startswith("@") and ":" not in text:
            return cls.drawer(text)
        return cls("pointer", text)

    @classmethod
    def query(cls, query: dict) -> Filter:
        return cls("query", query)

    @classmethod
    def of(cls, value: Any) -> Filter:
        """The filter that a plain value stands for.

        A string is a pointer if it starts with ``@``, else a collection; an
        object is a pointer by its text ``_id``, a collection by its text
        ``drawer``, else a query; ``{}`` and None select nothing in particular;
        a pair is (collection, key); a list merges its members.
        """
        if isinstance(value, Filter):
            return value
        if value is None or value == {}:
            return cls()
        if isinstance(value, str):
            return cls.pointer(value) if value.startswith("@") else cls.drawer(value)
        if isinstance(value, tuple):
            return cls.pointer(f"@{value[0].lstrip('@')}:{value[1].removeprefix('lnk_')}")
        if isinstance(value, list):
            members = [cls.of(v) for v in value]
            return cls("many", members) if members else cls()
        if isinstance(value, dict):
            if isinstance(value.get("_id"), str):
                return cls.pointer(value["_id"])
            if isinstance(value.get("drawer"), str):
                return cls.drawer(value["drawer"])
        return cls("query", value)

    @classmethod
    def of_dict(cls, value: dict) -> Filter:
        """Like :meth:`of`, but an object without drawer, pointer or query is always a query."""
        if not {"drawer", "pointer", "query"} & value.keys():
            return cls.query(value) if value else cls()
        parts = [cls.drawer(value["drawer"])] if "drawer" in value else []
        parts += [cls.pointer(value["pointer"])] if "pointer" in value else []
        parts += [cls.query(value["query"])] if "query" in value else []
        return parts[0] if len(parts) == 1 else cls("many", parts)


@dataclass
class Selection:
    """A filter's parts, merged: at most one collection and one query, and pointers in order."""

    drawer: str | None = None
    query: dict | None = None
    pointers: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, value: Any) -> Selection:
        out = cls()
        out._add(Filter.of(value))
        if out.query is not None:
            validate(out.query)
        return out

    def _add(self, part: Filter) -> None:
        if part.kind == "many":
            for member in part.value:
                self._add(member)
        elif part.kind == "drawer":
            self._at(part.value)
        elif part.kind == "pointer":
            found = parse_pointer(part.value)
            if found is None:
                raise InvalidInput(f"malformed pointer: {part.value}")
            self.pointers.append(f"@{found[0]}:{clean_key(found[1])}")
        elif part.kind == "query":
            if self.query is not None:
                raise InvalidInput("a filter can hold only one query")
            self.query = part.value

    def _at(self, drawer: str) -> None:
        if self.drawer not in (None, drawer):
            raise InvalidInput(f"conflicting collections: {self.drawer} and {drawer}")
        self.drawer = drawer

    def target(self) -> str:
        """The one collection that is meant."""
        names = {self.drawer} if self.drawer else set()
        names |= {parse_pointer(p)[0] for p in self.pointers}
        if len(names) != 1:
            raise InvalidInput("the filter names no collection" if not names else f"conflicting collections: {sorted(names)}")
        return names.pop()


def validate(query: Any) -> dict:
    """A query's shape: an object whose operators are known and whose ``$in`` holds a list."""
    if not isinstance(query, dict):
        raise InvalidInput("a query must be a JSON object")
    for value in query.values():
        if not isinstance(value, dict):
            continue
        if any(k.startswith("$") for k in value):
            for name, operand in value.items():
                if name.startswith("$") and name not in OPERATORS:
                    raise InvalidInput(f"unknown operator {name}")
                if name == "$in" and not isinstance(operand, list):
                    raise InvalidInput("$in needs a list")
        else:
            validate(value)
    return query
