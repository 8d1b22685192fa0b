"""A minimal acyclic transducer from words (bytes) to numbers, kept as flat arrays in a file that tasks map into memory.

Sorted words are added one by one: what the last word doesn't share with the next one is frozen, equal states become one
(so suffixes are shared), and outputs move towards the root, the smallest of a state's outputs going up; a word's number
is the sum along its path. The states are laid out as a double array: an arc by byte ``b`` of state ``s`` is the slot
``base[s] + b`` whose owner is ``s``. Looking words up goes byte by byte through all words of a batch at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np

#: A file starts with this, the length of its table of contents, and the table as JSON: name, type, size and place of each array.
MAGIC = b"TIDELEX1"
ALIGN = 64


class Builder:
    """Takes (word, number) in the words' order; words differ and aren't empty, numbers are 0 or more."""

    def __init__(self) -> None:
        self.registry: dict[tuple, int] = {}
        self.path: list[list] = [[[], -1]]  # of the last word's states: arcs [byte, state, output], final output or -1
        self.last = b""

    def _freeze(self, depth: int) -> None:
        while len(self.path) > depth + 1:
            arcs, final = self.path.pop()
            self.path[-1][0][-1][1] = self.registry.setdefault((final, *map(tuple, arcs)), len(self.registry))

    def add(self, word: bytes, number: int) -> None:
        if word <= self.last:
            raise ValueError("words have to be sorted, different and not empty")
        last, path = self.last, self.path
        same = 0
        for a, b in zip(word, last, strict=False):
            if a != b:
                break
            same += 1
        self._freeze(same)
        for i in range(same):
            arc = path[i][0][-1]
            rest = arc[2] - number
            if rest > 0:
                arc[2] = number
                below = path[i + 1]
                for a in below[0]:
                    a[2] += rest
                if below[1] >= 0:
                    below[1] += rest
            number -= arc[2]
        for b in word[same:]:
            path[-1][0].append([b, -1, number])
            path.append([[], -1])
            number = 0
        path[-1][1] = number
        self.last = word

    def states(self) -> list[tuple]:
        """(final output or -1, arc, arc, ...) by state number; the root is the last."""
        self._freeze(0)
        arcs, final = self.path[0]
        root = (final, *map(tuple, arcs))
        return [*self.registry, root]


def double_array(states: list[tuple]) -> dict[str, np.ndarray]:
    """base and final by state; owner, after (the next state) and output by slot. States with many arcs are placed first, each where it fits."""
    base = np.zeros(len(states), np.int32)
    used = bytearray(512)
    taken: list[tuple[int, int, int, int]] = []
    low, kind = 0, 0
    for s in sorted(range(len(states)), key=lambda s: (-len(states[s]), s)):
        arcs = states[s][1:]
        if not arcs:
            break
        if len(arcs) != kind:
            low, kind = 0, len(arcs)
        first = arcs[0][0]
        at, tries = max(low - first, 0), 0
        while True:
            at = used.find(0, at + first) - first
            if at < 0 or at + 512 > len(used):
                used.extend(bytes(len(used)))
                at = max(at, 0)
                continue
            if all(not used[at + a[0]] for a in arcs):
                break
            at, tries = at + 1, tries + 1
        if tries > 16 or kind == 1:  # what lies below is too full for states of this many arcs; those of fewer come back to it
            low = at + first
        base[s] = at
        for b, to, out in arcs:
            used[at + b] = 1
            taken.append((at + b, s, to, out))
    slots = np.full((3, len(used) + 256), -1, np.int32)
    if taken:
        t = np.array(taken, np.int64).T
        slots[:, t[0]] = t[1:]
    return {"base": base, "final": np.array([s[0] for s in states], np.int32), "owner": slots[0], "after": slots[1], "output": slots[2]}


def compiled(pairs: Iterable[tuple[bytes, int]]) -> dict[str, np.ndarray]:
    """The arrays of the transducer of (word, number) in any order; words differ."""
    builder = Builder()
    for word, number in sorted(pairs):
        builder.add(word, number)
    return double_array(builder.states())


def find(arrays: dict[str, np.ndarray], data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of the words data[start:end], none of them empty; -1 for those that aren't there."""
    base, final, owner, after, output = (arrays[k] for k in ("base", "final", "owner", "after", "output"))
    out = np.full(len(start), -1, np.int64)
    word, at, left = np.arange(len(start)), start, end - start
    state, total = np.full(len(start), len(base) - 1, np.int32), np.zeros(len(start), np.int32)
    depth = 0
    while len(word):
        arc = base.take(state)
        arc += data.take(at)
        going = owner.take(arc) == state
        if not going.all():
            word, at, left, total, arc = word[going], at[going], left[going], total[going], arc[going]
        total = total + output.take(arc)
        state = after.take(arc)
        at = at + 1
        depth += 1
        ended = left == depth
        if ended.any():
            last = final.take(state[ended])
            out[word[ended]] = np.where(last >= 0, total[ended] + last, -1)
            going = ~ended
            word, at, left, state, total = word[going], at[going], left[going], state[going], total[going]
    return out


def to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    places, at = [], 0
    for name, a in arrays.items():
        places.append((name, a.dtype.str, list(a.shape), at))
        at += -(-a.nbytes // ALIGN) * ALIGN
    head = json.dumps(places).encode()
    head += b" " * (-(len(MAGIC) + 8 + len(head)) % ALIGN)
    parts = [MAGIC, len(head).to_bytes(8, "little"), head]
    for a in arrays.values():
        parts += (np.ascontiguousarray(a).tobytes(), bytes(-a.nbytes % ALIGN))
    return b"".join(parts)


def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory: tasks of one machine share its pages, and only those that are read are loaded."""
    whole = np.memmap(path, np.uint8, "r").view(np.ndarray)
    if bytes(whole[: len(MAGIC)]) != MAGIC:
        raise ValueError(f"{path} is no lexicon")
    begin = len(MAGIC) + 8
    size = int.from_bytes(bytes(whole[len(MAGIC) : begin]), "little")
    places = json.loads(bytes(whole[begin : begin + size]))
    begin += size
    return {name: whole[begin + at : begin + at + int(np.prod(shape, dtype=np.int64)) * np.dtype(kind).itemsize].view(kind).reshape(shape) for name, kind, shape, at in places}
