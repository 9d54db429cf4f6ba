"""Word-piece counts by a linear longest-match automaton.

The vocabulary is a trie. Each state has a failure link (where matching goes on
after the longest pieces of what was read are taken off) and the number of pieces
taken off on that way. Reading a word follows one edge per byte and sums those
numbers, so the greedy count comes out in linear time without cutting pieces.

Words are runs without ASCII white space, read with the space before them, as in
the vocabulary. The automaton is compiled once on the driver, sent out as arrays
and memory-mapped; a task walks the distinct words of a block of texts at once.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.session import ship, table

PARTS = ("keys", "targets", "fails", "pops")
#: Texts handled at once, and bytes of words remembered by a worker.
BLOCK, REMEMBERED = 256, 24 << 20
#: Words longer than this are walked one by one.
LONG = 256


def vocabulary(path: str) -> list[bytes]:
    """The byte strings of a byte-level vocabulary file, without special tokens."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    special = {t["content"] for t in spec.get("added_tokens", [])}
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    return [bytes(byte[c] for c in token) for token in spec["model"]["vocab"] if token not in special and all(c in byte for c in token)]


def compile_automaton(pieces: list[bytes]) -> dict[str, np.ndarray]:
    """Edges, failure links and popped counts. Single bytes always count as pieces."""
    pieces = sorted({p for p in pieces if p} | {bytes([b]) for b in range(256)})
    children: list[dict[int, int]] = [{}]
    whole = [False]
    for piece in pieces:
        state = 0
        for byte in piece:
            if byte not in children[state]:
                children[state][byte] = len(children)
                children.append({})
                whole.append(False)
            state = children[state][byte]
        whole[state] = True
    fails, pops = [-1] * len(children), [0] * len(children)
    level = [0]
    while level:
        below = []
        for parent in level:
            for byte, state in children[parent].items():
                below.append(state)
                if whole[state]:
                    fails[state], pops[state] = 0, 1
                    continue
                at, popped = fails[parent], pops[parent]
                while at >= 0 and byte not in children[at]:
                    popped += pops[at]
                    at = fails[at]
                fails[state], pops[state] = (children[at][byte] if at >= 0 else -1), popped
        level = below
    edges = np.array(sorted((state << 8 | byte, target) for state, out in enumerate(children) for byte, target in out.items()), np.int64)
    return {"keys": edges[:, 0].copy(), "targets": edges[:, 1].astype(np.int32), "fails": np.array(fails, np.int32), "pops": np.array(pops, np.int32)}


class Counter:
    """Greedy piece counts of words."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.keys, self.targets, self.fails, self.pops = (arrays[p] for p in PARTS)
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.edges: dict[int, int] | None = None

    def counts(self, words: list[bytes]) -> list[int]:
        """Pieces of each word, in linear time."""
        long = [k for k, w in enumerate(words) if len(w) > LONG]
        out = self._walk([w if len(w) <= LONG else b"" for w in words])
        for k in long:
            out[k] = self._walk_one(words[k])
        return out.tolist()

    def _walk(self, words: list[bytes]) -> np.ndarray:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(sizes) - sizes
        state, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        at, alive = 0, np.flatnonzero(sizes > 0)
        while len(alive):
            byte, todo = text[starts[alive] + at], alive
            while len(todo):
                wanted = state[todo] << 8 | byte
                found = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
                ok = self.keys[found] == wanted
                state[todo[ok]] = self.targets[found[ok]]
                todo, byte = todo[~ok], byte[~ok]
                count[todo] += self.pops[state[todo]]
                state[todo] = self.fails[state[todo]]
            at += 1
            alive = alive[sizes[alive] > at]
        rest = np.flatnonzero(state)
        while len(rest):
            count[rest] += self.pops[state[rest]]
            state[rest] = self.fails[state[rest]]
            rest = rest[state[rest] > 0]
        return count

    def _walk_one(self, word: bytes) -> int:
        if self.edges is None:
            self.edges = dict(zip(self.keys.tolist(), self.targets.tolist(), strict=True))
        state = count = 0
        for byte in word:
            while (target := self.edges.get(state << 8 | byte)) is None:
                count += int(self.pops[state])
                state = int(self.fails[state])
            state = target
        while state:
            count += int(self.pops[state])
            state = int(self.fails[state])
        return count

    def block(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(words, pieces) of each text."""
        split = [t.encode().split() if t else [] for t in texts]
        if self.held > REMEMBERED:
            self.known.clear()
            self.held = 0
        new = list({w for s in split for w in s}.difference(self.known))
        self.known.update(zip(new, self.counts([b" " + w for w in new]), strict=True))
        self.held += 96 * len(new) + sum(map(len, new))
        look = self.known.__getitem__
        return [(len(s), sum(map(look, s))) for s in split]


_counters: dict[str, Counter] = {}


def _counter(name: str) -> Counter:
    if name not in _counters:
        _counters.clear()
        _counters[name] = Counter({p: np.load(SparkFiles.get(f"{name}-{p}.npy"), mmap_mode="r") for p in PARTS})
    return _counters[name]


def count_tokens(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_tokens), one per input row.

    Null and empty texts have no words and no tokens. Repeated rows come back
    repeated, an empty table gives no rows. Other columns are left out.
    """
    import public_tokenizers

    spark = docs.sparkSession
    ship(spark)
    name, folder = f"automaton-{uuid.uuid4().hex}", Path(tempfile.mkdtemp(prefix="spark-automaton-"))
    for part, array in compile_automaton(vocabulary(path or public_tokenizers.path("byte_bpe_50k.json"))).items():
        np.save(folder / f"{name}-{part}.npy", array)
        spark.sparkContext.addFile(str(folder / f"{name}-{part}.npy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(name)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                found = counter.block(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["doc_id", "n_words", "n_tokens"]
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece counts of all documents."""
    return count_tokens(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op10_token_counts": op10_token_counts}
