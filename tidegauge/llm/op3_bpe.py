"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

The most frequent words of the corpus (counted by Spark over every text) are
encoded once and compiled into a shared-suffix automaton with id outputs. Each
task memory-maps it, looks the distinct words of a block of texts up in one
vectorised walk, and merges the words it does not hold by the exact rule. The
tokenizer file is a parameter; it is sent to the executors and never copied into
this repository.
"""

from __future__ import annotations

import heapq
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from unicodedata import category

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegauge.llm.selection import threshold
from tidegauge.llm.transducer import Lexicon, compile_lexicon, save
from tidegauge.session import materialise, ship, table

#: Words in the lexicon: the bound of what comes to the driver.
LEXICON_WORDS = 120_000
#: Texts handled at once, and bytes of words and ids remembered by a worker.
BLOCK, REMEMBERED = 256, 48 << 20
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_SPACE = "\\t-\\r \\x85\\xa0"


def _ranges(kind: str) -> str:
    """The characters below U+0300 of a general category, as a class body."""
    return "".join(re.escape(chr(c)) for c in range(0x300) if category(chr(c))[0] == kind)


#: The split of the tokenizer for texts whose characters are all below U+0300.
_PLAIN = re.compile(f"{_CONTRACTIONS}|[{_ranges('L')}]+|[{_ranges('N')}]|[^{_SPACE}{_ranges('L')}{_ranges('N')}]+")
_HIGH = re.compile("[^\\x00-\\u02ff]")


class WordBpe:
    """Encodes and decodes as the tokenizer file says: word-final BPE on byte symbols."""

    def __init__(self, path: str, lexicon: Lexicon | None = None) -> None:
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = {pair: k for k, pair in enumerate(pairs)}
        self.end = spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in (self.vocab | self.special).items()}
        self.tokens = [names.get(i, "") for i in range(max(names) + 1)]
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.symbols = _byte_symbols()
        self.lexicon, self.known, self.held = lexicon, {}, 0

    def words(self, text: str) -> list[str]:
        """The normalised pieces of a text without special tokens."""
        if not _HIGH.search(text):
            return _PLAIN.findall(text.lower())
        text = self.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def segments(self, text: str) -> list[str]:
        """Pieces in order; special tokens stand as themselves behind a NUL mark."""
        if self.cut is None or "<|" not in text:
            return self.words(text)
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text)):
            out += ["\0" + part] if k % 2 else self.words(part)
        return out

    def merge(self, word: str) -> list[int]:
        """The ids of a word: always the pair of lowest rank, leftmost first."""
        if word[0] == "\0" and word[1:] in self.special:
            return [self.special[word[1:]]]
        parts = [self.symbols[b] for b in word.encode()]
        parts[-1] += self.end
        parts = self._merge_short(parts) if len(parts) <= 40 else self._merge_long(parts)
        return [self.vocab[p] for p in parts]

    def _merge_short(self, parts: list[str]) -> list[str]:
        rank, none = self.rank.get, len(self.rank)
        ranks = [rank(pair, none) for pair in zip(parts, parts[1:], strict=False)]
        while ranks and (low := min(ranks)) < none:
            k = ranks.index(low)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank((parts[k - 1], parts[k]), none)
            if k < len(ranks):
                ranks[k] = rank((parts[k], parts[k + 1]), none)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same by a heap over a linked list, for words of any length."""
        n, rank = len(parts), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, p) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if (r := rank(p)) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, k, pair = heapq.heappop(heap)
            right = after[k]
            if not alive[k] or right >= n or (parts[k], parts[right]) != pair:
                continue
            parts[k] += parts[right]
            alive[right] = False
            after[k] = after[right]
            if after[right] < n:
                before[after[right]] = k
            for a in (before[k], k):
                if a >= 0 and after[a] < n and (r := rank(p := (parts[a], parts[after[a]]))) is not None:
                    heapq.heappush(heap, (r, a, p))
        return [p for p, ok in zip(parts, alive, strict=True) if ok]

    def encode_block(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        pieces = [self.segments(t) if t else [] for t in texts]
        if self.held > REMEMBERED:
            self.known.clear()
            self.held = 0
        new = list(set().union(*pieces).difference(self.known))
        found = self.lexicon.lookup(new) if self.lexicon else [None] * len(new)
        for word, ids in zip(new, found, strict=True):
            self.known[word] = ids = ids if ids is not None else b"".join(i.to_bytes(4, "little") for i in self.merge(word))
            self.held += 128 + len(word) + len(ids)
        look = self.known.__getitem__
        return [b"".join(map(look, p)) for p in pieces]

    def decode(self, ids: bytes) -> str:
        """The text of ids; the file names no decoder, so tokens are joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, memoryview(ids).cast("I").tolist()))


def _byte_symbols() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    place = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}
    return [chr(place[b]) for b in range(256)]


_coders: dict[tuple, WordBpe] = {}


def _coder(vocabulary: str, lexicon: str | None) -> WordBpe:
    """One per worker process and lexicon."""
    key = (vocabulary, lexicon)
    if key not in _coders:
        _coders.clear()
        _coders[key] = WordBpe(SparkFiles.get(vocabulary), Lexicon.mapped(SparkFiles.get, lexicon) if lexicon else None)
    return _coders[key]


def build_lexicon(docs: DataFrame, path: str, text: str = "text", size: int = LEXICON_WORDS) -> str:
    """Compiles the ``size`` most frequent words of all texts and sends the files out."""
    spark = docs.sparkSession
    pieces = docs.select(F.explode(F.split(F.lower(F.col(text)), "[^\\p{L}]+")).alias("word")).where("word <> '' and length(word) <= 64")
    # A hash decides between words of one count, so about ``size`` words pass the threshold.
    rank = F.shiftleft(F.least("n", F.lit((1 << 38) - 1)), 24).bitwiseOR(F.xxhash64("word").bitwiseAND((1 << 24) - 1))
    counts = materialise(pieces.groupBy("word").agg(F.count("*").alias("n")).select("word", rank.alias("q")), "words")
    cut = threshold(counts.select("q"), size)
    top = counts if cut is None else counts.where(F.col("q") >= cut)
    coder = WordBpe(path)
    # A word is compiled only if the tokenizer's own split leaves it whole.
    frequent = [row["word"] for row in top.select("word").collect() if coder.words(row["word"]) == [row["word"]]]
    arrays = compile_lexicon({word: coder.merge(word) for word in frequent})
    name = f"lexicon-{uuid.uuid4().hex}"
    for file in save(arrays, Path(tempfile.mkdtemp(prefix="spark-lexicon-")), name):
        spark.sparkContext.addFile(str(file))
    return name


def encode(
    docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", lexicon_words: int = LEXICON_WORDS
) -> DataFrame:
    """Rows (doc_id, ids, decoded), one per input row.

    ids is binary, unsigned 32-bit little-endian; decoded is the text those ids
    decode to. Special tokens written in a text become their ids. A null text
    counts as empty and gives no ids. Repeated rows come back repeated, an empty
    table gives no rows. Other columns are left out.
    """
    import public_tokenizers

    spark, path = docs.sparkSession, path or public_tokenizers.path("word_bpe_49k.json")
    ship(spark)
    spark.sparkContext.addFile(str(path))
    lexicon, vocabulary = build_lexicon(docs, path, text, lexicon_words), Path(path).name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary, lexicon)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids = coder.encode_block(part.column(1).to_pylist())
                decoded = [coder.decode(i) for i in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded."""
    return digests(encode(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op3_bpe": op3_bpe}
