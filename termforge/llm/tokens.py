"""A chunk of texts as arrays: word numbers, document bounds and the chunk's vocabulary."""

from __future__ import annotations

from collections import defaultdict
from itertools import chain

import numpy as np


class Tokens:
    """Words are runs of anything but ASCII white space, A-Z lower-cased if asked. A text
    without words, an empty one among them, has none; no texts give empty arrays."""

    def __init__(self, texts: list[bytes], lower: bool = True):
        split = [(t.lower() if lower else t).split() for t in texts]
        self.lengths = np.array([len(s) for s in split], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        self.ids = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int32, int(self.offsets[-1]))
        self.vocabulary = list(number)
        self.doc = np.repeat(np.arange(len(texts)), self.lengths)

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """The sum over each document of a value for each word."""
        total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]
