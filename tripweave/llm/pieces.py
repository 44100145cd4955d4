"""Texts as pieces whose tokens do not depend on each other, resolved once per task."""

from __future__ import annotations

import re
from collections.abc import Callable

PIECE_LIMIT = 100_000


class Memo:
    """Values by key in the dictionary `now`; those not used for long are let go.

    Once `now` is full it becomes the old one and a new one begins; what is still used comes
    over from the old one.
    """

    def __init__(self, limit: int):
        self.limit, self.now, self.old = limit, {}, {}

    def turn(self) -> dict:
        """The dictionary to use for the next texts."""
        if len(self.now) > self.limit:
            self.now, self.old = {}, self.now
        return self.now

    def absent(self, keys: set) -> list:
        """The keys without a value."""
        new = []
        for key in keys.difference(self.now):
            if key in self.old:
                self.now[key] = self.old[key]
            else:
                new.append(key)
        return new


class SpacedPieces:
    """Texts cut before single spaces, for tokenizers that split as byte-level BPE does.

    That splitting attaches one space to the word behind it, and never joins what stands
    before and after white space. A cut before a space is therefore safe where the space
    begins or ends its run of white space; texts with a space inside a run stay whole.
    Values of pieces are kept for the task, at most about twice `limit` at a time.
    """

    def __init__(self, resolve: Callable[[list[str]], list], limit: int = PIECE_LIMIT):
        self.resolve, self.known = resolve, Memo(limit)
        self.inside = re.compile(r"\s \s")

    def _cut(self, text: str) -> tuple[str, list[str]]:
        if self.inside.search(text):
            return text, []
        head, *rest = text.split(" ")
        return head, rest

    def values(self, texts: list) -> list[list]:
        """The values of the pieces of each text, in order; null counts as empty."""
        known = self.known.turn()
        cut = [self._cut(text or "") for text in texts]
        missing: set[str] = set()
        for _, rest in cut:
            missing.update(set(rest).difference(known))
        order = self.known.absent(missing)
        known.update(zip(order, self.resolve([" " + piece for piece in order])))
        heads = self.resolve([head for head, _ in cut])
        return [[first, *map(known.__getitem__, rest)] for first, (_, rest) in zip(heads, cut)]
