"""Sums of word features over whole texts, with a bounded cache of words.

Linear models over averaged word features need each distinct word's features once; a text is
then a sum of table rows. The cache stops growing at a fixed size; words beyond it are worked
out again for each group of texts, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

CACHE_WORDS = 500_000
CHUNK_CHARS = 1_000_000


class WordSums:
    """``features`` gives a row of ``width`` numbers for each of many distinct words."""

    def __init__(self, features: Callable, width: int, cache: int = CACHE_WORDS):
        import numpy as np

        self.features, self.cache = features, cache
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, width))

    def _group(self, held: list[list[str]]) -> Iterator:
        import numpy as np

        look, n = self.known.get, len(self.known)
        fresh: dict[str, int] = {}
        found = []
        for words in held:
            rows = list(map(look, words))
            if None in rows:
                for i, r in enumerate(rows):
                    if r is None:
                        rows[i] = fresh.setdefault(words[i], n + len(fresh))
            found.append(rows)
        if fresh:
            while len(self.table) < n + len(fresh):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[n : n + len(fresh)] = np.asarray(self.features(list(fresh))).reshape(len(fresh), -1)
        for rows in found:
            yield self.table[rows].sum(axis=0)
        if n + len(fresh) <= self.cache:
            self.known.update(fresh)

    def sums(self, texts: Iterable[list[str]]) -> Iterator:
        """The sum of the rows of each text's words; zeros for none."""
        held: list[list[str]] = []
        size = 0
        for words in texts:
            held.append(words)
            size += sum(map(len, words))
            if size >= CHUNK_CHARS:
                yield from self._group(held)
                held, size = [], 0
        yield from self._group(held)


def segment_sums(values, sizes):
    """Sums of consecutive rows of ``values``, ``sizes[i]`` of them for row i."""
    import numpy as np

    sizes = np.asarray(sizes, np.int64)
    out = np.zeros((len(sizes), *values.shape[1:]))
    some = sizes > 0
    if some.any():
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        out[some] = np.add.reduceat(values, starts[some], axis=0)
    return out
