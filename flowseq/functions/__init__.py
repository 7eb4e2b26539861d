"""Functions on single values: optionals (P11 to P17) and the bounded heap."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from typing import Any


class EmptyValue(RuntimeError):
    """An empty value was unwrapped."""


def unwrap(value: Any) -> Any:
    """The value, or an error if there is none."""
    if value is None:
        raise EmptyValue("unwrap of an empty value")
    return value


def unwrap_or(value: Any, default: Any) -> Any:
    """P12"""
    return default if value is None else value


class Optional:
    """A value that may be missing."""

    def __init__(self, value: Any = None):
        self.value = value

    def map(self, fn: Callable[[Any], Any]) -> Optional:
        """An optional result is not nested."""
        out = None if self.value is None else fn(self.value)
        return out if isinstance(out, Optional) else Optional(out)

    def flatmap(self, fn: Callable[[Any], Iterable[Any]]) -> list[Any]:
        """The items for a value that is there, else none."""
        return [] if self.value is None else list(fn(self.value))

    def filter(self, p: Callable[[Any], bool]) -> Optional:
        """P15"""
        return self if self.value is not None and p(self.value) else Optional()

    def foreach(self, f: Callable[[Any], None]) -> None:
        """P16"""
        if self.value is not None:
            f(self.value)

    def inspect(self, f: Callable[[Any], None]) -> Optional:
        """P17"""
        self.foreach(f)
        return self

    def unwrap(self) -> Any:
        return unwrap(self.value)

    def unwrap_or(self, default: Any) -> Any:
        return unwrap_or(self.value, default)


class TopK:
    """O7 to O11 on the driver: keeps the k largest elements, or those with the largest keys.

    ``smallest`` keeps the smallest instead.  Of equal keys the earlier stays.
    ``top`` is the least wanted of those kept, so draining goes from there to the best.
    """

    def __init__(self, k: int, by: Callable[[Any], Any] | None = None, smallest: bool = False):
        self.k, self._by, self._smallest = k, by or (lambda x: x), smallest
        self._heap: list[tuple[Any, int, Any]] = []
        self._pushed = 0

    def push(self, value: Any) -> None:
        key = self._by(value)
        heapq.heappush(self._heap, (_Reversed(key) if self._smallest else key, -self._pushed, value))
        self._pushed += 1
        if len(self._heap) > self.k:
            heapq.heappop(self._heap)

    append = push

    def top(self) -> Any:
        return self._heap[0][2]

    def pop(self) -> Any:
        return heapq.heappop(self._heap)[2]

    def empty(self) -> bool:
        return not self._heap

    def __len__(self) -> int:
        return len(self._heap)

    def drain(self) -> Iterator[Any]:
        while self._heap:
            yield self.pop()


class _Reversed:
    def __init__(self, key: Any):
        self.key = key

    def __lt__(self, other: _Reversed) -> bool:
        return other.key < self.key

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Reversed) and self.key == other.key
