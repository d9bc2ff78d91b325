"""Options of a request, parsed strictly, and the shape of its result."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Any

from larkspur.errors import InvalidInput
from larkspur.plans.filters import Selection

SHAPES = ("default", "records", "record", "pointers", "exists", "diagnostics")
_ALIASES = {"excludeHydration": "exclude_hydration", "select": "projection", "fields": "projection"}
_FLAGS = ("multi", "atomic", "create_if_missing", "hydrate", "include_diagnostics")
_COUNTS = ("limit", "offset", "page", "page_size", "depth")
_LISTS = ("exclude_hydration", "projection")
DEFAULT_PAGE_SIZE = 100


@dataclass
class Options:
    """``include_diagnostics`` and the shape ``diagnostics`` are accepted and change nothing; ``depth`` bounds how many references deep a read resolves."""

    multi: bool | None = None
    atomic: bool | None = None
    create_if_missing: bool | None = None
    return_shape: str | None = None
    hydrate: bool | None = None
    exclude_hydration: list[str] | None = None
    depth: int | None = None
    projection: list[str] | None = None
    limit: int | None = None
    offset: int | None = None
    order_by: str | None = None
    order_direction: str | None = None
    cursor: str | None = None
    page: int | None = None
    page_size: int | None = None
    include_diagnostics: bool | None = None

    @classmethod
    def of(cls, value: Any = None, **more: Any) -> Options:
        """Options from an object and keywords; unknown names and wrong types are errors."""
        if isinstance(value, Options) and not more:
            return value
        if value is not None and not isinstance(value, dict):
            raise InvalidInput("operation options must be a JSON object")
        out = cls()
        known = {f.name for f in fields(cls)}
        for given, v in {**(value or {}), **more}.items():
            name = _ALIASES.get(given, given)
            if name not in known:
                raise InvalidInput(f"unknown operation option '{given}'")
            if name in _FLAGS:
                good = isinstance(v, bool)
            elif name in _COUNTS:
                good = isinstance(v, int) and not isinstance(v, bool) and v >= 0
            elif name in _LISTS:
                good = isinstance(v, (list, tuple)) and all(isinstance(x, str) for x in v)
            else:
                good = isinstance(v, str)
            if name == "return_shape" and v not in SHAPES or name == "order_direction" and v not in ("asc", "desc"):
                raise InvalidInput(f"unsupported {name} option '{v}'")
            if not good:
                raise InvalidInput(f"option '{given}' has the wrong type")
            setattr(out, name, list(v) if name in _LISTS else v)
        return out

    @property
    def pages(self) -> bool:
        return self.cursor is not None or self.page is not None or self.page_size is not None

    def check_pages(self) -> int:
        """The page size, once pagination's rules hold."""
        if self.order_by is None:
            raise InvalidInput("pagination needs order_by")
        if self.limit is not None or self.offset is not None:
            raise InvalidInput("pagination can't be combined with limit or offset")
        if self.cursor is not None and self.page is not None:
            raise InvalidInput("cursor can't be combined with page")
        if self.page == 0 or self.page_size == 0:
            raise InvalidInput("page and page_size start at 1")
        return DEFAULT_PAGE_SIZE if self.page_size is None else self.page_size

    def shape(self, selection: Selection) -> str:
        """By default one pointer gives its record, everything else records."""
        if self.return_shape in (None, "default", "diagnostics"):
            return "record" if len(selection.pointers) == 1 and selection.query is None else "records"
        return self.return_shape
