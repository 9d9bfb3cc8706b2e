"""Typed settings from the environment or a JSON file, and the health report."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from . import storage


class MissingSetting(ValueError):
    """A setting without a default that is not there, or blank."""


def setting(key: str, default=dataclasses.MISSING):
    """A field that is read from ``key``; without a default it must be given."""
    return field(metadata={"key": key}) if default is dataclasses.MISSING else field(default=default, metadata={"key": key})


def load(kind: type, values: Mapping | str):
    """A settings class from a mapping or JSON text.

    Blank values have their default; texts become what the field is: numbers, or true
    for 1, true, yes and on in any case."""
    values = json.loads(values) if isinstance(values, str) else values
    made = {}
    for f in dataclasses.fields(kind):
        key = f.metadata.get("key", f.name)
        given = values.get(key)
        given = given.strip() if isinstance(given, str) else given
        if given is None or given == "":
            if f.default is dataclasses.MISSING:
                raise MissingSetting(key)
            continue
        if f.type == "bool" and isinstance(given, str):
            given = given.lower() in ("1", "true", "yes", "on")
        made[f.name] = int(given) if f.type == "int" else tuple(given) if isinstance(given, list) else given
    return kind(**made)


@dataclass(frozen=True)
class Engine:
    environment: str = setting("APP_ENV")
    root: str = setting("STORAGE_ROOT")
    mail_config: str = setting("MAIL_CONFIG_PATH", "")


@dataclass(frozen=True)
class LayoutService:
    token: str = setting("LAYOUT_API_TOKEN")
    model: str = setting("LAYOUT_MODEL_VERSION", "vlm")
    language: str = setting("LAYOUT_LANGUAGE", "ch")
    ocr: bool = setting("LAYOUT_ENABLE_OCR", False)
    tables: bool = setting("LAYOUT_ENABLE_TABLE", True)
    formulas: bool = setting("LAYOUT_ENABLE_FORMULA", True)
    page_ranges: str = setting("LAYOUT_PAGE_RANGES", "")
    poll_seconds: int = setting("LAYOUT_POLL_INTERVAL_SECONDS", 2)
    poll_timeout: int = setting("LAYOUT_POLL_TIMEOUT_SECONDS", 300)
    per_minute: int = setting("LAYOUT_SUBMIT_RATE_PER_MIN", 45)
    pause_seconds: int = setting("LAYOUT_RATE_LIMIT_PAUSE_SECONDS", 120)
    max_pauses: int = setting("LAYOUT_RATE_LIMIT_MAX_PAUSES", 2)


@dataclass(frozen=True)
class ChatService:
    key: str = setting("CHAT_API_KEY")
    address: str = setting("CHAT_BASE_URL")
    model: str = setting("CHAT_MODEL")
    timeout: int = setting("CHAT_TIMEOUT_SECONDS", 120)

    def __post_init__(self):
        object.__setattr__(self, "address", self.address.rstrip("/"))


def health(spark: SparkSession, values: Mapping, service: str) -> dict:
    """What a running service says of itself: all its tables are there, or what lacks."""
    engine = load(Engine, values)
    storage.migrate(spark, engine.root)
    found = storage.inspect(spark, engine.root)
    return {"status": found["status"], "service": service, "environment": engine.environment, "root": engine.root, "tables": found}
