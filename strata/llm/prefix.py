"""The prefix table that BPE encoding and token counting share.

For each prefix of a piece the table names the one token that ends the prefix's encoding: the
token under which no merge crosses the border to the token before it. Only one token can do so.
"""

from __future__ import annotations

NEVER = 1 << 60
PAIR_BYTES = 20 << 20  # about what a generation of remembered pairs of tokens may take
PAIR_COST = 100


class Recent:
    """What a worker remembers, in two generations of at most limit bytes each: a full one becomes the old one, whose entries come back as they are used.

    new is always the same dictionary, so a loop may hold on to its get.
    """

    def __init__(self, limit: int) -> None:
        self.new: dict = {}
        self.old: dict = {}
        self.limit, self.cost = limit, 0

    def older(self, key, cost: int):
        """The value of a key that new lacks, or None."""
        found = self.old.get(key)
        if found is not None:
            self.put(key, found, cost)
        return found

    def put(self, key, value, cost: int) -> None:
        if self.cost + cost > self.limit:
            self.old = self.new.copy()
            self.new.clear()
            self.cost = 0
        self.new[key] = value
        self.cost += cost

    def clear(self) -> None:
        self.new.clear()
        self.old, self.cost = {}, 0


class Merges:
    """Tokens as integers that rise with their merge; left and right are the parts a token was merged from."""

    def __init__(self, names: dict[int, str | bytes], left: list[int], right: list[int]):
        self.names, self.left, self.right = names, left, right
        self.known = Recent(PAIR_BYTES)

    def merged(self, a: int, b: int) -> int:
        """The token that a and b merge into, or NEVER."""
        raise NotImplementedError

    def compatible(self, a: int, b: int) -> bool:
        """Whether a followed by b stays as it is: undo their merges, latest first, and look for an earlier one across the border."""
        key = a << 20 | b
        found = self.known.new.get(key)
        if found is None:
            found = self.known.older(key, PAIR_COST)
        if found is None:
            found = self._compatible(a, b)
            self.known.put(key, found, PAIR_COST)
        return found

    def _compatible(self, a: int, b: int) -> bool:
        limit, left, right = NEVER, self.left, self.right
        while self.merged(a, b) >= limit:
            turn = a > b
            for _ in range(2):  # the later of both comes apart; if it is a single unit, the other
                x = a if turn else b
                part = right[x] if turn else left[x]
                if part != x:
                    break
                turn = not turn
            else:
                return True
            if turn:
                limit, a = a, part
            else:
                limit, b = b + 1, part
        return False
