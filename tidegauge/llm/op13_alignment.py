"""Alignment of the tokens of two tokenizers by pointer jumping.

Both token sequences of a text cut the same bytes. Every token points to the token
of the other sequence that overlaps it farthest to the right, and a token that
ends where its partner ends is terminal. Doubling the pointers of a whole block of
texts at once (``succ = succ[succ]``) brings every token to the terminal one of its
component, which labels the group; a run of n overlapping tokens takes log2(n)
rounds.

Tokens come from words that a worker remembers: the byte-level vocabulary splits
texts by its own pattern, and no piece of the other one holds a space behind another
character, so its merges never cross the start of a run of spaces.

Id pairs are counted by Spark. The most frequent ones (a bounded number) are sent to
all tasks; links with any other pair are joined by a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegauge.llm.batches import blocks
from tidegauge.llm.columns import column
from tidegauge.llm.op3_bpe import _HIGH, _SPACE, _byte_symbols, _ranges
from tidegauge.llm.selection import threshold
from tidegauge.session import materialise, ship, table

#: Bytes of words remembered by a worker.
REMEMBERED = 48 << 20
#: Id pairs sent to all tasks; links with others are shuffled.
HEAD_PAIRS = 500_000
#: Groups with more links than this are counted by distinct ids of either side.
DENSE = 1024
#: Bits of an id in a pair.
ID_BITS = 22
_L, _N = _ranges("L"), _ranges("N")
#: The split of the byte-level vocabulary for texts whose characters are all below U+0300.
_PLAIN = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_SPACE}{_L}{_N}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_RUNS = re.compile(" +[^ ]*")


class Coders:
    """Both vocabularies, the bytes of their tokens, and the words met so far."""

    def __init__(self, byte_level: str, pieces: str) -> None:
        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        byte = {c: b for b, c in enumerate(_byte_symbols())}
        spec = json.loads(Path(byte_level).read_text(encoding="utf-8"))
        names = {i: t for t, i in spec["model"]["vocab"].items()}
        self.a_bytes = [bytes(byte[c] for c in names.get(i, "") if c in byte) for i in range(max(names) + 1)]
        self.merges = self._merges(spec["model"], names)
        self.b_bytes = [self._piece(i) for i in range(self.b.vocab_size())]
        self.sizes = [np.array([len(t) for t in tokens], np.int64) for tokens in (self.a_bytes, self.b_bytes)]
        #: Whether merges stay between the starts of runs of spaces.
        self.cuts = not any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.vocab_size()))
        self.known: tuple[dict, dict] = ({}, {})
        self.held = 0
        self.digits = _digit_table(max(len(self.a_bytes), len(self.b_bytes)))

    def _merges(self, model: dict, names: dict[int, str]) -> tiktoken.Encoding | None:
        """The same merges by rank, where ids rise with them: much faster for single words."""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = [model["vocab"].get(a + b, -1) for a, b in pairs]
        if made != sorted(set(made)) or any(len(self.a_bytes[i]) != 1 for i in names.keys() - set(made) if len(names[i]) == 1):
            return None
        ranks = {self.a_bytes[i]: i for i in made} | {self.a_bytes[i]: i for i in names if len(names[i]) == 1}
        return tiktoken.Encoding("words", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def words(self, text: str) -> list[str]:
        """The words of a text as the byte-level vocabulary splits it."""
        if not _HIGH.search(text):
            return _PLAIN.findall(text)
        return [text[a:b] for _, (a, b) in self.a.pre_tokenizer.pre_tokenize_str(text)]

    def runs(self, text: str) -> list[str]:
        """The text (with a space before it) cut before each run of spaces."""
        parts = text.split(" ")
        return [" " + p for p in parts] if "" not in parts else _RUNS.findall(" " + text)

    def _learn(self, side: int, new: list[str]) -> None:
        """Ids of words as bytes; None where the tokens' bytes are not the word's."""
        if side:
            found = self.b.encode([w[1:] for w in new], num_threads=1) if new else []
        elif self.merges:
            found = list(map(self.merges._encode_single_piece, new))
        else:
            found = [e.ids for e in self.a.encode_batch(new, add_special_tokens=False)]
        tokens = self.b_bytes if side else self.a_bytes
        for word, ids in zip(new, found, strict=True):
            packed = np.array(ids, "<u4").tobytes()
            self.known[side][word] = packed if b"".join(map(tokens.__getitem__, ids)) == word.encode() else None
            self.held += 160 + 2 * len(word) + len(packed)

    def _joined(self, side: int, words: list[str], text: str) -> bytes | None:
        """Ids of a text with a space before it, or None where their bytes differ from its own."""
        found = list(map(self.known[side].__getitem__, words))
        if None not in found:
            return b"".join(found)
        ids = self.b.encode(text) if side else self.a.encode(" " + text, add_special_tokens=False).ids
        tokens = self.b_bytes if side else self.a_bytes
        return np.array(ids, "<u4").tobytes() if b"".join(map(tokens.__getitem__, ids)) == (" " + text).encode() else None

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """The ids of each text by either vocabulary; none where a text has no tokens."""
        if self.held > REMEMBERED:
            self.known, self.held = ({}, {}), 0
        split = [(self.words(" " + t), self.runs(t) if self.cuts else [" " + t]) if t and "▁" not in t else None for t in texts]
        for side in (0, 1):
            self._learn(side, list({w for s in split if s for w in s[side]}.difference(self.known[side])))
        out = []
        for text, words in zip(texts, split, strict=True):
            pair = (self._joined(0, words[0], text), self._joined(1, words[1], text)) if words else (None, None)
            out.append((b"", b"") if None in pair else pair)
        return out


def _digit_table(size: int) -> np.ndarray:
    """Decimal digits of 0 to size - 1 from the left, zeros behind them, one place left for a mark."""
    width = len(str(size)) + 1
    return np.frombuffer(b"".join(str(i).encode().ljust(width, b"\0") for i in range(size)), np.uint8).reshape(size, width)


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """For all A, then all B tokens: the place of the terminal B token of their component."""
    n = len(a_ends)
    right_a, right_b = np.searchsorted(a_ends, b_ends), np.searchsorted(b_ends, a_ends)
    own = np.arange(n, n + len(b_ends))
    succ = np.concatenate((right_b + n, np.where(a_ends[right_a] > b_ends, right_a, own) if n else own))
    while not np.array_equal(following := succ[succ], succ):
        succ = following
    return succ - n


def _spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. in each run of the given lengths."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _links(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (text, A id, B id) keys of all links of groups, and how often each occurs."""
    a_from, b_from = np.cumsum(na) - na, np.cumsum(nb) - nb
    sparse = na * nb <= DENSE
    times = np.repeat(np.where(sparse, nb, 0), na)
    group = np.repeat(np.arange(len(na)), na)
    right = b[np.repeat(b_from[group], times) + _spread(times)]
    keys = np.repeat(doc[group] << 2 * ID_BITS | a << ID_BITS, times) | right
    keys.sort()
    keys, counts = _runs_of(keys, np.ones(len(keys), np.int64))
    dense = np.flatnonzero(~sparse)
    if not len(dense):
        return keys, counts
    parts, weights = [keys], [counts]
    for g in dense.tolist():
        left, n_left = np.unique(a[a_from[g] : a_from[g] + na[g]], return_counts=True)
        there, n_there = np.unique(b[b_from[g] : b_from[g] + nb[g]], return_counts=True)
        parts.append(((doc[g] << 2 * ID_BITS | left << ID_BITS)[:, None] | there[None, :]).ravel())
        weights.append((n_left[:, None] * n_there[None, :]).ravel())
    keys, counts = np.concatenate(parts), np.concatenate(weights)
    order = np.argsort(keys, kind="stable")
    return _runs_of(keys[order], counts[order])


def _runs_of(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array with the sums of their weights."""
    if not len(keys):
        return keys, weights
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(weights, first)


def align_block(coders: Coders, texts: list[str | None]) -> dict[str, np.ndarray | list]:
    """Tokens, groups and links of a block of texts.

    a, b: ids of all texts one after another; a_group, b_group: groups, numbered over
    the block; n_a, n_b, n_groups, n_links: of each text; keys, times: the distinct
    (text, A id, B id) with their occurrences; groups: each text's groups as
    ``a1,a2|b1;a3|b2,b3``.
    """
    coded = coders.encode(texts)
    n_a, n_b = (np.array([len(c[side]) // 4 for c in coded], np.int64) for side in (0, 1))
    a, b = (np.frombuffer(b"".join(c[side] for c in coded), "<u4").astype(np.int64) for side in (0, 1))
    a_ends, b_ends = np.cumsum(coders.sizes[0][a]), np.cumsum(coders.sizes[1][b])
    last = terminals(a_ends, b_ends)
    marks = np.zeros(len(b), np.int64)
    marks[last] = 1
    group = (np.cumsum(marks) - marks)[last]
    a_group, b_group = group[: len(a)], group[len(a) :]
    total = int(marks.sum())
    na, nb = np.bincount(a_group, minlength=total), np.bincount(b_group, minlength=total)
    doc = np.repeat(np.arange(len(texts)), n_b)[np.flatnonzero(marks)]
    keys, times = _links(a, b, na, nb, doc)
    n_links = np.zeros(len(texts), np.int64)
    np.add.at(n_links, doc, na * nb)

    a_from, b_from = np.cumsum(na) - na, np.cumsum(nb) - nb
    place_a, place_b = np.arange(len(a)) + b_from[a_group], np.arange(len(b)) + (a_from + na)[b_group]
    order = np.empty(len(a) + len(b), np.int64)
    mark = np.full(len(order), ord(","), np.uint8)
    order[place_a], order[place_b] = a, b
    mark[a_from + na + b_from - 1], mark[a_from + na + b_from + nb - 1] = ord("|"), ord(";")
    shown = coders.digits[order]
    width = (shown != 0).sum(axis=1)
    shown[np.arange(len(order)), width] = mark
    flat = shown.ravel()
    written = flat[flat != 0].tobytes()
    edges = np.concatenate(([0], np.cumsum(width + 1)))[np.concatenate(([0], np.cumsum(n_a + n_b)))].tolist()
    groups = [written[x : y - 1] if y > x else b"" for x, y in zip(edges, edges[1:], strict=False)]
    return {
        "a": a, "b": b, "a_group": a_group, "b_group": b_group, "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(doc, minlength=len(texts)), "n_links": n_links,
        "keys": keys, "times": times, "groups": groups,
    }


_coders: dict[tuple, Coders] = {}


def _worker(byte_level: str, pieces: str) -> Coders:
    if (byte_level, pieces) not in _coders:
        _coders.clear()
        _coders[byte_level, pieces] = Coders(SparkFiles.get(byte_level), SparkFiles.get(pieces))
    return _coders[byte_level, pieces]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values))


def align(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None, doc_id: str = "doc_id", text: str = "text", groups: bool = True) -> DataFrame:
    """Rows (row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times[, groups]), one per input row.

    ``row`` numbers the rows. ``pairs`` are the distinct linked ids (A shifted by
    ``ID_BITS``, plus B), ``times`` how many links of the text each has, ``groups`` the
    ids of each group as text. Texts that are null or empty, or whose tokens do not
    spell them, have no tokens: zeros, empty lists and an empty digest. Repeated rows
    come back repeated, an empty table gives no rows. Other columns are left out.
    """
    import public_tokenizers

    spark = docs.sparkSession
    ship(spark)
    byte_level, pieces = byte_level or public_tokenizers.path("byte_bpe_50k.json"), pieces or public_tokenizers.path("piece_bpe_32k.model")
    for path in (byte_level, pieces):
        spark.sparkContext.addFile(str(path))
    names = Path(byte_level).name, Path(pieces).name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = _worker(*names)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for low, high in blocks(texts):
                found, part = align_block(coders, texts[low:high]), batch.slice(low, high - low)
                sizes = np.bincount(found["keys"] >> 2 * ID_BITS, minlength=high - low)
                digests = [hashlib.sha256(g).hexdigest() if g else "" for g in found["groups"]]
                columns = [part.column(0), part.column(1), *(pa.array(found[c]) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(digests)]
                columns += [_lists(found["keys"] & (1 << 2 * ID_BITS) - 1, sizes), _lists(found["times"], sizes)]
                labels = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
                if groups:
                    columns.append(pa.array([g.decode() for g in found["groups"]], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, labels + ["groups"] * groups)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), column(doc_id).cast("long").alias("doc_id"), column(text).cast("string").alias("text"))
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    return rows.mapInArrow(run, schema + ", groups string" * groups)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Rows (pair, n, best): how many texts hold a pair, and whether no pair of its A id has more."""
    counts = materialise(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    a_id = F.shiftright("pair", ID_BITS)
    # At most one row for each id of the vocabulary.
    best = counts.groupBy(a_id.alias("a_id")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(best), a_id == F.col("a_id")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_counts(docs: DataFrame, head: int = HEAD_PAIRS, **options: str | None) -> DataFrame:
    """Rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one per input row.

    n_best: links whose pair has its A id's highest count; count_sum: the counts of all
    links. Of ties of count at the bound of ``head`` a hash decides which are sent out.
    """
    aligned = materialise(align(docs, groups=False, **options), "aligned")
    counts = materialise(pair_counts(aligned), "counts")
    rank = F.shiftleft(F.least("n", F.lit((1 << 42) - 1)), 20).bitwiseOR(F.xxhash64("pair").bitwiseAND((1 << 20) - 1))
    cut = threshold(counts.select(rank.alias("q")), head)
    frequent = F.lit(True) if cut is None else rank >= cut
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", "link.pairs", "link.times")
    known = counts.where(frequent).select(F.col("pair").alias("pairs"), "n", "best")
    sums = [F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")]
    found = links.join(F.broadcast(known), "pairs").groupBy("row").agg(*sums)
    if cut is not None:
        rare = links.join(F.broadcast(known.select("pairs")), "pairs", "left_anti")
        others = counts.where(~frequent).select(F.col("pair").alias("pairs"), "n", "best")
        found = found.unionByName(rare.join(others, "pairs").groupBy("row").agg(*sums)).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    rows = aligned.drop("pairs", "times").join(found, "row", "left")
    none = F.lit(0).cast("long")
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, their tokens by two vocabularies aligned."""
    return link_counts(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op13_alignment": op13_alignment}
