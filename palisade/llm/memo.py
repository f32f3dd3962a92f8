"""A bounded memory of what short strings were turned into, one per Python worker."""

from __future__ import annotations

from collections.abc import Callable


class Memo(dict):
    """``memo[key]`` is ``make(key)``, remembered for keys up to ``longest``. Two generations of ``room`` entries are
    kept: when the younger is full it becomes the older, so what is used often stays. Memory is bounded; results are not affected."""

    def __init__(self, make: Callable, room: int = 500_000, longest: int = 48):
        super().__init__()
        self.make, self.room, self.longest, self.older = make, room, longest, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.room:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value
