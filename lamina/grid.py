"""The grid: slice sizes that divide each other, all aligned at offset zero."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import InvalidGrid


@dataclass(frozen=True)
class Grid:
    sizes: tuple[int, ...]

    def __post_init__(self) -> None:
        object.__setattr__(self, "sizes", tuple(self.sizes))
        s = self.sizes
        if not s:
            raise InvalidGrid("a grid needs at least one size")
        if any(type(x) is not int or x <= 0 for x in s):
            raise InvalidGrid(f"sizes must be positive integers: {s}")
        for low, high in zip(s, s[1:], strict=False):
            if low >= high or high % low:
                raise InvalidGrid(f"{low} must be below {high} and divide it")

    @property
    def smallest(self) -> int:
        return self.sizes[0]

    @property
    def largest(self) -> int:
        return self.sizes[-1]

    def __contains__(self, size: object) -> bool:
        return size in self.sizes

    def _known(self, size: int) -> int:
        if size not in self.sizes:
            raise InvalidGrid(f"{size} is not a size of {self.sizes}")
        return size

    def above(self, size: int) -> tuple[int, ...]:
        return self.sizes[self.sizes.index(self._known(size)) + 1 :]

    def below(self, size: int) -> tuple[int, ...]:
        return self.sizes[: self.sizes.index(self._known(size))]

    @staticmethod
    def parent_offset(offset: int, size: int) -> int:
        return offset - offset % size

    def parent(self, size: int, offset: int) -> tuple[int, int] | None:
        """(size, offset) of the enclosing slice one size up; None at the top."""
        return next(iter(self.ancestors(size, offset)), None)

    def ancestors(self, size: int, offset: int) -> list[tuple[int, int]]:
        return [(s, self.parent_offset(offset, s)) for s in self.above(size)]

    def fingerprint(self) -> str:
        return hashlib.sha256(b"sizes=" + ",".join(map(str, self.sizes)).encode("ascii")).hexdigest()

    # Column forms, for plans.

    def array(self) -> Column:
        return F.array(*(F.lit(s) for s in self.sizes))

    def above_column(self, size: Column) -> Column:
        """Array of all larger sizes, ascending."""
        return F.filter(self.array(), lambda s: s > size)

    def below_column(self, size: Column) -> Column:
        return F.filter(self.array(), lambda s: s < size)

    def ancestors_column(self, size: Column, offset: Column) -> Column:
        """Array of (size, codepoint_offset) of all enclosing slices, size ascending."""
        return F.transform(
            self.above_column(size),
            lambda s: F.struct(s.alias("size"), (offset - offset % s).alias("codepoint_offset")),
        )


DEFAULT_GRID = Grid((64, 128, 256, 512, 1024))
