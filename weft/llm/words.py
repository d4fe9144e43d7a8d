"""Numbers for the words of texts: a table that a worker fills with the features of each distinct word once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash

#: Words in a worker's table; when it is full it begins anew, between texts.
ENTRIES = 250_000


class Words(dict):
    """Word -> row of `rows`, which holds what `describe` makes of the words, one row each."""

    def __init__(self, describe: Callable[[list[str]], np.ndarray], entries: int = ENTRIES):
        super().__init__()
        self.describe, self.entries = describe, entries
        self.fresh: list[str] = []
        self.rows = describe([])
        self.used = 0

    def __missing__(self, word: str) -> int:
        self[word] = at = self.used + len(self.fresh)
        self.fresh.append(word)
        return at

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(row of each word of all texts, words of each text); the rows are good until the next call."""
        if self.used > self.entries:
            self.clear()
            self.used = 0
        get = self.__getitem__
        out, sizes = [], []
        for text in texts:
            words = text.split()
            sizes.append(len(words))
            out.append(np.fromiter(map(get, words), np.int32, len(words)))
        if self.fresh:
            new = self.describe(self.fresh)
            if self.used + len(new) > len(self.rows):
                grown = np.zeros((max(2 * len(self.rows), self.used + len(new), 1024), *new.shape[1:]), new.dtype)
                grown[: self.used] = self.rows[: self.used]
                self.rows = grown
            self.rows[self.used : self.used + len(new)] = new
            self.used += len(new)
            self.fresh = []
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), np.array(sizes, np.int64)


def hash64(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
