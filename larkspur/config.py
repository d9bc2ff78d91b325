"""Settings of an engine, checked when they are read, and where its events are logged."""

from __future__ import annotations

import json
import logging
import sys
from dataclasses import dataclass, field, fields
from typing import Any

from larkspur.errors import InvalidInput

LEVELS = {"off": logging.CRITICAL + 10, "error": logging.ERROR, "warn": logging.WARNING, "info": logging.INFO, "debug": logging.DEBUG, "trace": 5}
FORMATS = ("pretty", "json")
DESTINATIONS = ("stderr", "stdout", "file")


def _known(kind: type, given: dict[str, Any], label: str) -> dict[str, Any]:
    if not isinstance(given, dict):
        raise InvalidInput(f"{label} must be a JSON object")
    unknown = given.keys() - {f.name for f in fields(kind)}
    if unknown:
        raise InvalidInput(f"unknown {label} setting '{min(unknown)}'")
    return given


@dataclass(frozen=True)
class Logging:
    """Level, format (pretty or json), destination (stderr, stdout or file) and the file's path on the driver."""

    level: str = "off"
    format: str = "pretty"
    destination: str = "stderr"
    file: str | None = None

    def __post_init__(self):
        for value, allowed, label in ((self.level, LEVELS, "level"), (self.format, FORMATS, "format"), (self.destination, DESTINATIONS, "destination")):
            if value not in allowed:
                raise InvalidInput(f"unknown logging {label} '{value}'")
        if self.destination == "file" and not self.file:
            raise InvalidInput("logging to a file needs its path")

    def logger(self) -> logging.Logger:
        """A logger of these settings; equal settings share one."""
        out = logging.getLogger(f"larkspur.{abs(hash(self))}")
        if not out.handlers:
            handler = logging.FileHandler(self.file, encoding="utf-8") if self.destination == "file" else logging.StreamHandler(getattr(sys, self.destination))
            handler.setFormatter(_Lines(self.format == "json"))
            out.addHandler(handler)
            out.propagate = False
            out.setLevel(LEVELS[self.level])
        return out


class _Lines(logging.Formatter):
    """One line for an event: its time, level, message and fields."""

    def __init__(self, as_json: bool):
        super().__init__()
        self.as_json = as_json

    def format(self, record: logging.LogRecord) -> str:
        said = {"time": self.formatTime(record), "level": record.levelname.lower(), "message": record.getMessage(), **getattr(record, "fields", {})}
        if self.as_json:
            return json.dumps(said, default=str)
        return " ".join([said.pop("time"), said.pop("level").upper(), said.pop("message"), *[f"{k}={v}" for k, v in said.items()]])


@dataclass(frozen=True)
class Config:
    """``root`` holds the store; changes are merged with a base beyond ``merge_share`` of its size, and with one another beyond ``most_changes``."""

    root: str | None = None
    merge_share: float = 0.25
    most_changes: int = 8
    logging: Logging = field(default_factory=Logging)

    def __post_init__(self):
        if not isinstance(self.merge_share, (int, float)) or isinstance(self.merge_share, bool) or self.merge_share < 0:
            raise InvalidInput("merge_share must be a number of at least 0")
        if not isinstance(self.most_changes, int) or isinstance(self.most_changes, bool) or self.most_changes < 1:
            raise InvalidInput("most_changes must be a whole number of at least 1")

    @classmethod
    def of(cls, value: Any = None, **more: Any) -> Config:
        """Settings from an object, the path of a JSON file, or keywords; unknown names are errors."""
        if isinstance(value, Config) and not more:
            return value
        if isinstance(value, str):
            with open(value, encoding="utf-8") as file:
                value = json.load(file)
        given = {**_known(cls, value or {}, "engine"), **_known(cls, more, "engine")}
        if isinstance(given.get("logging"), dict):
            given["logging"] = Logging(**_known(Logging, given["logging"], "logging"))
        return cls(**given)
