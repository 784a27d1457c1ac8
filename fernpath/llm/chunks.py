"""Token ids of whole texts by way of white-space chunks: equal chunks are encoded once a task, ids are gathered as arrays."""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: A worker forgets its chunks beyond this number and starts anew; results do not depend on it.
MOST_CHUNKS = 250_000
#: Separators to Python's str type that the tokenizers' patterns take for symbols; texts with one are encoded whole.
_ODD = re.compile("[\x1c-\x1f]")


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def lasting(kind: str, key, make: Callable):
    """What make() gives, made once for each Python worker and kept from task to task until another key or a task of another kind comes."""
    kept = sys.__dict__.setdefault("_fernpath_lasting", {})  # functions travel by value, so that a variable here would not last
    if kind not in kept or kept[kind][0] != key:
        kept[kind] = key, make()
    return kept[kind][1]


class _Numbers(dict):
    """Chunks in order of their first appearance; `new` lists those seen since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.new.append(chunk)
        return n


class Encoder:
    """Ids of texts as numpy arrays. `split` parts a text so that ids of the parts, put together, are those of the whole.

    `encode` gives the ids of parts, all in one array, and how many each part has.
    """

    def __init__(self, tokenizer, split: Callable[[str], list[str]], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.tokenizer, self.split, self.encode = tokenizer, split, encode
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers()
        self.size, self.ids = array("q"), array("I")

    def whole(self, text: str) -> bool:
        return bool(_ODD.search(text)) or any(s in text for s in self.special)

    def _places(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of the parts of each text."""
        number = self.number
        if self.split is not str.split or not texts:
            return [np.fromiter(map(number.__getitem__, parts), np.int64, len(parts)) for parts in map(self.split, texts)]
        # words of all texts are parted and made distinct in compiled code; what stands before the first word or behind the last is empty
        words = pa.compute.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        kinds = words.values.dictionary_encode()
        own = kinds.dictionary.to_pylist()
        at = np.fromiter(map(number.__getitem__, own), np.int64, len(own))[kinds.indices.to_numpy()]
        ends = words.offsets.to_numpy()
        return [at[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def block(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > MOST_CHUNKS:
            self.clear()
        number, plain = self.number, [not self.whole(t) for t in texts]
        places = self._places([t for t, p in zip(texts, plain, strict=True) if p])
        if number.new:
            ids, size = self.encode(number.new)
            self.ids.frombytes(ids.astype(np.uint32).tobytes())
            self.size.frombytes(size.astype(np.int64).tobytes())
            number.new.clear()
        size, ids = np.array(self.size, np.int64), np.array(self.ids, np.uint32)
        first = np.concatenate(([0], np.cumsum(size)))
        found, places = [], iter(places)
        for text, is_plain in zip(texts, plain, strict=True):
            if not is_plain:
                found.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
                continue
            at = next(places)
            n = size[at]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            found.append(ids[np.repeat(first[at] - ends + n, n) + np.arange(total)])
        return found
