"""Settings: given values before the environment, the environment before a TOML file, the file before the defaults."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import get_type_hints

from .errors import ValidationError
from .grid import DEFAULT_GRID

#: Names of the environment's variables are PREFIX + SECTION + "__" + FIELD.
PREFIX, FILE = "LAMINA_", "lamina.toml"


@dataclass(frozen=True)
class Store:
    kind: str = "parquet"
    root: str = "lamina-store"
    search_timeout_s: float | None = None  # seconds a size; None waits


@dataclass(frozen=True)
class Embedding:
    provider: str = "fake"
    model: str | None = None
    base_url: str | None = None
    api_key: str | None = None
    batch_size: int = 32
    max_concurrency: int = 4


@dataclass(frozen=True)
class Defaults:
    """Of a corpus (applied once, when it is created) and of a query."""

    grid_sizes: tuple[int, ...] = DEFAULT_GRID.sizes
    tokenizer: str = "chars"
    top_k_per_size: int = 10
    strategy: str = "greedy_upward"


@dataclass(frozen=True)
class Limits:
    max_document_codepoints: int = 500_000
    max_batch_documents: int = 100
    max_token_budget: int = 32_000


@dataclass(frozen=True)
class Tools:
    enable_document_tools: bool = False
    default_token_budget: int = 4_000


@dataclass(frozen=True)
class Settings:
    store: Store = field(default_factory=Store)
    embedder: Embedding = field(default_factory=Embedding)
    defaults: Defaults = field(default_factory=Defaults)
    limits: Limits = field(default_factory=Limits)
    tools: Tools = field(default_factory=Tools)


def typed(name: str, kind: object, value: object) -> object:
    """A value of a file or of the environment (text) as the field's type."""
    wanted = str(kind)
    try:
        if value is None or (isinstance(value, str) and "str" in wanted):
            return value
        if "tuple" in wanted:
            return tuple(int(x) for x in (json.loads(value) if isinstance(value, str) else value))
        if "bool" in wanted:
            if str(value).lower() not in ("true", "false", "1", "0"):
                raise ValueError(value)
            return str(value).lower() in ("true", "1")
        return float(value) if "float" in wanted else int(value) if "int" in wanted else str(value)
    except (TypeError, ValueError) as e:
        raise ValidationError(f"{name} cannot be {value!r}") from e


def load(file: str | Path | None = FILE, environment: Mapping[str, str] | None = None, **given: Mapping[str, object]) -> Settings:
    """Settings from all sources; given: section=dict(field=value). A file that is not there, and names that are not known, are passed over."""
    environment = os.environ if environment is None else environment
    path = Path(file) if file else None
    table = tomllib.loads(path.read_text(encoding="utf-8")) if path and path.is_file() else {}
    sections = {}
    for section in fields(Settings):
        own = section.default_factory()
        kinds = get_type_hints(type(own))
        found = {}
        for name, kind in kinds.items():
            variable = f"{PREFIX}{section.name}__{name}".upper()
            for source, key in ((given.get(section.name, {}), name), (environment, variable), (table.get(section.name, {}), name)):
                if key in source:
                    found[name] = typed(f"{section.name}.{name}", kind, source[key])
                    break
        sections[section.name] = replace(own, **found)
    return Settings(**sections)
