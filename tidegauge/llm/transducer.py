"""A minimal acyclic transducer from words to id sequences.

Words are inserted in byte order and states with equal futures are shared as soon
as they are final in shape (suffix sharing). Every edge carries the number of
words that come before those reached through it, so the sum along a path is the
word's rank; the id outputs are stored flat by rank. The arrays are plain numpy
files, memory-mapped by every worker of a machine, and whole lists of words are
walked at once, one byte position a step.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np

PARTS = ("keys", "targets", "skips", "final", "offsets", "ids")


def compile_lexicon(entries: dict[str, list[int]]) -> dict[str, np.ndarray]:
    """The transducer's arrays for words and their ids. No entries: matches nothing."""
    words = sorted((w.encode(), w) for w in entries)
    register: dict[tuple, int] = {}
    final: list[bool] = []
    edges: list[tuple] = []
    reach: list[int] = []

    def close(node: list) -> int:
        """Shares or stores a finished node [is_final, [(byte, state)...]]."""
        shape = (node[0], *node[1])
        if shape not in register:
            register[shape] = len(final)
            final.append(node[0])
            edges.append(tuple(node[1]))
            reach.append(node[0] + sum(reach[t] for _, t in node[1]))
        return register[shape]

    path: list[list] = [[False, []]]  # open nodes along the last word
    last = b""
    for key, _ in words:
        same = 0
        while same < min(len(key), len(last)) and key[same] == last[same]:
            same += 1
        while len(path) - 1 > same:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], close(node)))
        for _ in key[same:]:
            path.append([False, []])
        path[-1][0] = True
        last = key
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((last[len(path) - 1], close(node)))
    root = close(path[0])

    rows = []
    for state, out in enumerate(edges):
        before = int(final[state])
        for byte, target in sorted(out):
            rows.append((state << 8 | byte, target, before))
            before += reach[target]
    table = np.array(rows, dtype=np.int64).reshape(-1, 3)
    outputs = [entries[w] for _, w in words]
    return {
        "keys": table[:, 0].copy(),
        "targets": table[:, 1].astype(np.int32),
        "skips": table[:, 2].astype(np.int32),
        "final": np.array([*final, root], dtype=np.int32),  # the root's number comes last
        "offsets": np.cumsum([0, *map(len, outputs)]).astype(np.int64),
        "ids": np.array([i for ids in outputs for i in ids], dtype="<u4"),
    }


def save(arrays: dict[str, np.ndarray], folder: Path, name: str) -> list[Path]:
    paths = []
    for part in PARTS:
        path = folder / f"{name}-{part}.npy"
        np.save(path, arrays[part])
        paths.append(path)
    return paths


class Lexicon:
    """Looks lists of words up in a compiled transducer."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.keys, self.targets, self.skips = arrays["keys"], arrays["targets"], arrays["skips"]
        self.final, self.root = arrays["final"][:-1], int(arrays["final"][-1])
        self.offsets, self.ids = arrays["offsets"], arrays["ids"]

    @classmethod
    def mapped(cls, find, name: str) -> Lexicon:
        """From files; ``find`` gives a file's place on this machine."""
        return cls({part: np.load(find(f"{name}-{part}.npy"), mmap_mode="r") for part in PARTS})

    def ranks(self, words: list[str]) -> np.ndarray:
        """Each word's rank in the lexicon, or -1."""
        if not words or not len(self.keys):
            return np.full(len(words), -1)
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        text = np.frombuffer(b"".join(raw), np.uint8)
        starts = np.cumsum(sizes) - sizes
        state, rank = np.full(len(raw), self.root, np.int64), np.zeros(len(raw), np.int64)
        alive, at = np.flatnonzero(sizes > 0), 0
        state[sizes == 0] = -1
        while len(alive):
            wanted = state[alive] << 8 | text[starts[alive] + at]
            found = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            ok = self.keys[found] == wanted
            state[alive] = np.where(ok, self.targets[found], -1)
            rank[alive] += np.where(ok, self.skips[found], 0)
            at += 1
            alive = alive[ok & (sizes[alive] > at)]
        done = (state >= 0) & (self.final[np.maximum(state, 0)] > 0)
        return np.where(done, rank, -1)

    def lookup(self, words: list[str]) -> list[bytes | None]:
        """Each word's ids as little-endian 32-bit integers, or None."""
        ranks = self.ranks(words)
        return [None if r < 0 else self.ids[self.offsets[r] : self.offsets[r + 1]].tobytes() for r in ranks.tolist()]
