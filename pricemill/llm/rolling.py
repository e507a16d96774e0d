"""Hashes of all runs of consecutive items, for the two operators that look for repeated runs."""

from __future__ import annotations

#: Odd multipliers of the two polynomial hashes, and the seeds of the item hashes they run over.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SEEDS = (1, 2)
#: Items whose hash a worker remembers; beyond that it starts anew.
REMEMBERED = 500_000


def item_hasher(seed: int):
    """A function from a list of byte strings to the array of their 64-bit hashes."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh64_intdigest

    class Memory(dict):
        def __missing__(self, item: bytes) -> int:
            if len(self) >= REMEMBERED:
                self.clear()
            value = self[item] = digest(item, seed)
            return value

    look = Memory().__getitem__
    return lambda items: np.fromiter(map(look, items), np.uint64, len(items))


class RunHasher:
    """Polynomial hashes modulo 2**64 of runs of `width` items, at chosen starts."""

    def __init__(self, base: int):
        import numpy as np

        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int):
        import numpy as np

        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, self.base, np.uint64)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, self.inverse, np.uint64)], dtype=np.uint64)

    def __call__(self, items, width: int, starts):
        import numpy as np

        n = len(items)
        self._powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(items * self.up[:n], out=sums[1:])
        value = (sums[starts + width] - sums[starts]) * self.down[starts]
        # the low bits of a sum of products are weak; mix them
        value ^= value >> np.uint64(32)
        value *= np.uint64(0xD6E8FEB86659FD93)
        return value ^ (value >> np.uint64(32))


def window_starts(positions, before: int, width: int, n: int):
    """Starts of the windows of `width` items that begin at most `before` items ahead of a position."""
    import numpy as np

    last = n - width + 1
    if last <= 0:
        return np.empty(0, np.int64)
    edge = np.zeros(last + 1, np.int64)
    low = np.clip(np.asarray(positions, np.int64) - before, 0, last)
    high = np.clip(np.asarray(positions, np.int64) + 1, 0, last)
    np.add.at(edge, low, 1)
    np.add.at(edge, high, -1)
    return np.flatnonzero(np.cumsum(edge[:last]) > 0)


def covered(starts, width: int, n: int):
    """Mask of the n items that lie in a window of `width` items at one of the starts."""
    import numpy as np

    edge = np.zeros(n + 1, np.int64)
    starts = np.asarray(starts, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:n]) > 0


def mask_spans(mask) -> list[dict]:
    """Runs of set items as [start, end)."""
    import numpy as np

    turns = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return [{"start": int(a), "end": int(b)} for a, b in zip(turns[::2], turns[1::2])]
