"""Token counters: functions from a text column to a count column, by name."""

from __future__ import annotations

import threading
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..errors import UnknownTokenizer

Counter = Callable[[Column], Column]
_lock = threading.Lock()
_factories: dict[str, Callable[[], Counter]] = {}
_made: dict[str, Counter] = {}


def chars(text: Column) -> Column:
    """One token a code point."""
    return F.length(text)


def whitespace(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def tiktoken_counter(encoding: str) -> Counter:
    """Counts of a tiktoken encoding; the vocabulary is loaded once a worker, and checked here first.

    Text that holds a special token's string is counted as ordinary text: one such document does not fail its batch.
    """
    import tiktoken

    tiktoken.get_encoding(encoding)

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        own = tiktoken.get_encoding(encoding)
        return texts.map(lambda t: None if t is None else len(own.encode_ordinary(t)))

    return count


def bpe_counter(ranks_path: str, pattern: str) -> Counter:
    """Counts of a byte-level vocabulary file of `base64 rank` lines that every executor has; it is opened here first."""
    _bpe(ranks_path, pattern)

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        own = _bpe(ranks_path, pattern)
        return texts.map(lambda t: None if t is None else len(own.encode_ordinary(t)))

    return count


_loaded: dict[tuple[str, str], object] = {}


def _bpe(path: str, pattern: str):
    if (path, pattern) not in _loaded:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path, pattern] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path, pattern]


def register(name: str, factory: Callable[[], Counter]) -> None:
    """Make a counter known; a name given again is made anew at its next use."""
    with _lock:
        _factories[name] = factory
        _made.pop(name, None)


def registered() -> list[str]:
    return sorted(_factories)


def get(name: str) -> Counter:
    """Registered names first, then `tiktoken:<encoding>`; what fails to load is tried again next time."""
    with _lock:
        if name in _made:
            return _made[name]
        try:
            if name in _factories:
                made = _factories[name]()
            elif name.startswith("tiktoken:"):
                made = tiktoken_counter(name.split(":", 1)[1])
            else:
                raise UnknownTokenizer(f"no counter {name!r}; known: {', '.join(sorted(_factories))} and tiktoken:<encoding>")
        except UnknownTokenizer:
            raise
        except Exception as e:
            raise UnknownTokenizer(f"counter {name!r} cannot be loaded: {e}") from e
        _made[name] = made
        return made


def proven(spark: SparkSession, name: str) -> Counter:
    """The counter, once it has counted a text on an executor."""
    counter = get(name)
    try:
        spark.range(1).select(counter(F.lit(""))).collect()
    except Exception as e:
        raise UnknownTokenizer(f"counter {name!r} does not count: {str(e).splitlines()[0]}") from e
    return counter


register("chars", lambda: chars)
register("whitespace", lambda: whitespace)
