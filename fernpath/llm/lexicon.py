"""A minimal acyclic automaton over byte strings whose paths add up to a word's number, kept as flat arrays in one file."""

from __future__ import annotations

import mmap
import os
import struct
import tempfile

import numpy as np


class _State:
    __slots__ = ("arcs", "final", "words", "number")

    def __init__(self):
        self.arcs: dict[int, _State] = {}
        self.final, self.words, self.number = False, 0, -1

    def key(self):
        return self.final, tuple((b, id(s)) for b, s in self.arcs.items())


def compiled(entries: dict[bytes, list[int]]) -> bytes:
    """The automaton of the words, with shared prefixes and suffixes, and the words' id lists in order of their numbers.

    Built from sorted words: once a later word departs from a path, the states below it can change no more and are
    replaced by equal ones. An arc carries how many words come before those that pass through it.
    """
    words = sorted(entries)
    root, known, path = _State(), {}, []  # path: (parent, byte, child) of the latest word

    def settle(depth: int) -> None:
        while len(path) > depth:
            parent, byte, child = path.pop()
            child.words = child.final + sum(s.words for s in child.arcs.values())
            parent.arcs[byte] = known.setdefault(child.key(), child)

    last = b""
    for word in words:
        shared = len(os.path.commonprefix([last, word]))
        settle(shared)
        state = path[-1][2] if path else root
        for byte in word[shared:]:
            state.arcs[byte] = new = _State()
            path.append((state, byte, new))
            state = new
        state.final, last = True, word
    settle(0)

    order, stack = [], [root]
    root.number = 0
    while stack:
        state = stack.pop()
        order.append(state)
        for child in state.arcs.values():
            if child.number < 0:
                child.number = 0
                stack.append(child)
    for k, state in enumerate(order):
        state.number = k
    # each state's arcs start at its own base so that byte b of the state lies at base + b, in slots no other arc uses
    base = np.zeros(len(order), np.int32)
    low, hint = 256, 256  # below low no slot is free; states with several arcs are tried from hint on
    owner, target, skip = [-1] * 256, [0] * 256, [0] * 256
    for state in sorted(order, key=lambda s: -len(s.arcs)):
        labels = list(state.arcs)
        if not labels:
            continue
        while low < len(owner) and owner[low] >= 0:
            low += 1
        at, tries = (low - labels[0], 0) if len(labels) == 1 else (max(hint, low - labels[0]), 0)
        while True:
            if (need := at + 256 - len(owner)) > 0:
                owner += [-1] * (need + 4096)
                target += [0] * (need + 4096)
                skip += [0] * (need + 4096)
            if all(owner[at + b] < 0 for b in labels):
                break
            at, tries = at + 1, tries + 1
        if tries > 20:
            hint = at
        base[state.number] = at
        before = int(state.final)
        for b in labels:
            child = state.arcs[b]
            owner[at + b], target[at + b], skip[at + b] = state.number, child.number, before
            before += child.words
    final = np.array([s.final for s in order], np.uint8)
    ids = [entries[w] for w in words]
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    parts = [base, np.array(owner, np.int32), np.array(target, np.int32), np.array(skip, np.int32), final, ends, np.array([i for x in ids for i in x], np.int32)]
    return struct.pack(f"<{len(parts)}q", *(p.nbytes for p in parts)) + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """Word lookups in a compiled automaton that is mapped from a file, so that its pages are shared and loaded on demand."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as file:
            file.write(data)
            file.flush()
            self.pages = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        sizes, at, views = struct.unpack_from("<7q", self.pages), 56, []
        for k, size in enumerate(sizes):
            views.append(memoryview(self.pages)[at : at + size].cast("B" if k == 4 else "i"))
            at += size
        self.base, self.owner, self.target, self.skip, self.final, self.ends, self.ids = views

    def get(self, word: bytes) -> list[int] | None:
        state, number = 0, 0
        base, owner, target, skip = self.base, self.owner, self.target, self.skip
        for byte in word:
            slot = base[state] + byte
            if owner[slot] != state:
                return None
            number += skip[slot]
            state = target[slot]
        return list(self.ids[self.ends[number] : self.ends[number + 1]]) if self.final[state] else None
