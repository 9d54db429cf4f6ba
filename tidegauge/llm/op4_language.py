"""Language identification with a small byte convolutional network, in numpy.

A text is cut into fixed-length byte windows, all of them. A window's bytes are
embedded, filters of several widths slide over it, each filter keeps its maximum,
and a softmax gives the window's language probabilities. A text's probabilities
are the mean over its windows, weighted by their bytes.

Training is plain gradient descent (Adam) in numpy on the driver, on a bounded
number of windows of labelled texts; prediction is one Arrow pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.llm.columns import column
from tidegauge.session import ship, table

WINDOW = 256
#: Even, so that a filter is a sum of terms of byte pairs.
WIDTHS = (2, 4, 6)
FILTERS, EMBEDDING = 8, 8
#: The bound of the training sample: texts of each language, two cuts of each.
SAMPLE = 800
#: Windows that go through the network at once.
BATCH = 64
UNKNOWN = "und"
#: The pipeline keeps a text if one language has more than this share of it; a text
#: in one language with long passages in others is still of a known language.
MIN_SHARE = 0.4
#: Bytes of text that a worker cuts into windows at once (a longer text is taken alone).
CHUNK = 1 << 22


class ByteConvNet:
    """Embedding, filters of several widths, max pooling over positions, softmax."""

    def __init__(self, labels: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.tables: dict[int, list[np.ndarray]] | None = None
        self.params = {"e": rng.normal(0, 0.5, (257, EMBEDDING)), "b": np.zeros(len(labels)), "o": rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(labels)))}
        for w in WIDTHS:
            self.params[f"k{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS))
            self.params[f"c{w}"] = np.zeros(FILTERS)
        self.params = {k: v.astype(np.float32) for k, v in self.params.items()}

    def _responses(self, x: np.ndarray) -> list[np.ndarray]:
        """Filter responses (windows, positions, filters) of each width."""
        p, out = self.params, []
        emb = p["e"][x]
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            flat = emb.reshape(-1, EMBEDDING) @ p[f"k{w}"].transpose(1, 0, 2).reshape(EMBEDDING, -1)
            flat = flat.reshape(*x.shape, w, FILTERS)
            total = flat[:, :n, 0].copy()
            for j in range(1, w):
                total += flat[:, j : j + n, j]
            out.append(total)
        return out

    def pair_tables(self) -> dict[int, list[np.ndarray]]:
        """For each width and even offset, what each pair of byte codes adds to the filters."""
        p = self.params
        out = {}
        for w in WIDTHS:
            terms = p["e"] @ p[f"k{w}"]  # (w, 257, filters)
            out[w] = [(terms[j][:, None] + terms[j + 1][None]).reshape(-1, FILTERS) for j in range(0, w, 2)]
        return out

    def probabilities(self, x: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        """Of windows of byte codes (256 fills up short ones), by table lookups."""
        turned = x.T.astype(np.int64)  # positions first, so that sums and maxima run over long rows
        pairs = np.ascontiguousarray(turned[:-1] * 257 + turned[1:])
        pooled = []
        for w in WIDTHS:
            n = len(turned) - w + 1
            parts = [np.take(t, pairs[2 * j : 2 * j + n], axis=0).reshape(n, -1) for j, t in enumerate(tables[w])]
            total = parts[0]
            for part in parts[1:]:
                total += part
            pooled.append(np.maximum(total.max(axis=0).reshape(len(x), FILTERS) + self.params[f"c{w}"], 0))
        scores = np.concatenate(pooled, axis=1) @ self.params["o"] + self.params["b"]
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.01, batch: int = 64, seed: int = 11) -> None:
        rng, p, self.tables = np.random.default_rng(seed), self.params, None
        mean = {k: np.zeros_like(v) for k, v in p.items()}
        var = {k: np.zeros_like(v) for k, v in p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                step += 1
                for k, g in self._gradients(x[rows], y[rows]).items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    var[k] = 0.999 * var[k] + 0.001 * g * g
                    p[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.params, len(x)
        peaks, pooled = [], []
        for w, r in zip(WIDTHS, self._responses(x), strict=True):
            peaks.append(r.argmax(axis=1))
            pooled.append(np.maximum(np.take_along_axis(r, peaks[-1][:, None, :], axis=1)[:, 0] + p[f"c{w}"], 0))
        hidden = np.concatenate(pooled, axis=1)
        scores = hidden @ p["o"] + p["b"]
        probs = np.exp(scores - scores.max(axis=1, keepdims=True))
        probs /= probs.sum(axis=1, keepdims=True)
        probs[np.arange(n), y] -= 1
        probs /= n
        grads = {"o": hidden.T @ probs, "b": probs.sum(axis=0), "e": np.zeros_like(p["e"])}
        back = (probs @ p["o"].T) * (hidden > 0)
        for i, w in enumerate(WIDTHS):
            d = back[:, i * FILTERS : (i + 1) * FILTERS]
            grads[f"c{w}"] = d.sum(axis=0)
            kernel = np.zeros_like(p[f"k{w}"])
            for j in range(w):
                codes = np.take_along_axis(x, peaks[i] + j, axis=1)  # the byte under the filter's peak
                kernel[j] = np.einsum("nfe,nf->ef", p["e"][codes], d)
                np.add.at(grads["e"], codes, d[:, :, None] * p[f"k{w}"][j].T[None])
            grads[f"k{w}"] = kernel
        return grads


def windows(raw: bytes, size: int = WINDOW) -> np.ndarray:
    """All windows of a text's bytes; the last is filled up with code 256."""
    codes = np.full(-(-len(raw) // size) * size, 256, np.int16)
    codes[: len(raw)] = np.frombuffer(raw, np.uint8)
    return codes.reshape(-1, size)


def has_letter(text: str | None) -> bool:
    """Whether a text has a character of a Unicode letter category; number signs are none."""
    return bool(text) and any(map(str.isalpha, text))


def predict(net: ByteConvNet, texts: list[str | None]) -> list[tuple[str, float]]:
    """(label, its probability) for each text; ``und`` and 0 without any letter."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    if not net.labels:
        return out
    if net.tables is None:
        net.tables = net.pair_tables()
    held, size = [], 0
    for k, text in enumerate(texts):
        if has_letter(text):
            held.append((k, text.lower().encode()))
            size += len(held[-1][1])
        if held and (size >= CHUNK or k == len(texts) - 1):
            for (at, _), row in zip(held, _shares(net, [raw for _, raw in held]), strict=True):
                out[at] = (net.labels[int(row.argmax())], float(row.max()))
            held, size = [], 0
    return out


def _shares(net: ByteConvNet, raw: list[bytes]) -> np.ndarray:
    """The probabilities of each text: the mean over its windows by their bytes."""
    cut = [windows(r) for r in raw]
    owner = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
    every = np.concatenate(cut)
    weight = (every < 256).sum(axis=1)
    total = np.zeros((len(cut), len(net.labels)))
    for at in range(0, len(every), BATCH):
        part = slice(at, at + BATCH)
        np.add.at(total, owner[part], net.probabilities(every[part], net.tables) * weight[part, None])
    return total / total.sum(axis=1, keepdims=True)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, seed: int = 7) -> ByteConvNet:
    """Fits a network on at most ``sample`` texts of each label.

    Rows are chosen by a hash of their id, label and text, so the choice does not
    depend on order or partitioning; rows that repeat all three count once. Of each
    text one window is taken, at a place the hash picks; a second, shorter cut of it
    teaches short texts. Rows without a text or label teach nothing, rows without an
    id are told apart by their text. Labels are the distinct values of ``lang``, and
    the network has an output for each; without any it knows none.
    """
    rows = docs.select(column(doc_id).cast("string").alias("id"), column(text).cast("string").alias("text"), column(lang).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}") & ~held_out(F.col("id"))).withColumn("h", F.xxhash64("id", "lang", "text"))
    start = F.pmod(F.col("h"), F.greatest(F.length("text") - WINDOW, F.lit(1))).cast("int")
    # Distinct rows to within a few in a hundred, which the 1.2 below leaves room for.
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    labels = sorted(counts)
    if not labels:
        return ByteConvNet([])
    # A threshold on the hash thins each label to about the bound; the least hashes of those are the sample.
    share = F.lit(1.0)
    for label, n in counts.items():
        share = F.when(F.col("lang") == label, F.lit(min(1.0, (1.2 * sample + 20) / max(n, 1)))).otherwise(share)
    order = F.xxhash64("h")
    near = rows.where(F.pmod(order, F.lit(1 << 20)) < share * (1 << 20)).select("lang", "h", F.substring("text", start + 1, F.lit(WINDOW)).alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(order, "h", "text"))
    taken = near.dropDuplicates(["lang", "h"]).withColumn("place", place).where(F.col("place") <= sample).orderBy("lang", "place").collect()
    x, y = [], []
    for row in taken:
        raw = row["text"].lower().encode()
        if raw:
            short = 8 + zlib.crc32(raw) % 80
            for piece in (raw[:WINDOW], raw[-short:]):
                x.append(windows(piece)[0])
                y.append(labels.index(row["lang"]))
    net = ByteConvNet(labels, seed)
    net.fit(np.array(x), np.array(y))
    return net


def identify(docs: DataFrame, net: ByteConvNet, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, lang_pred, score), one per input row, from the text alone.

    Null, empty and letter-free texts are ``und`` with score 0. Repeated rows come
    back repeated, an empty table gives no rows; with nothing to learn from every
    text is ``und``. Other columns are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((net.labels, net.params))  # a few tens of kilobytes, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, params = shared.value
        own = ByteConvNet(labels)
        own.params = params
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = predict(own, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"]
                )

    rows = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def language_stage(docs: DataFrame, languages: list[str] | None = None, min_share: float = MIN_SHARE) -> DataFrame:
    """The documents of known languages, with the predicted language where none is given.

    A document stays if the network gives one of ``languages`` (default: all that
    are labelled in ``docs``) more than ``min_share`` of its text. Texts without any letter
    (null and empty ones too), in other languages, or in no language by more than
    that share go. A null ``lang`` is filled with the prediction; other columns, of
    any name, stay as they are. Repeated rows stay or go together. Without labels
    nothing is known and no document stays.
    """
    net = train(docs)
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((net.labels, net.params))
    at, lang = docs.columns.index("text"), docs.columns.index("lang")
    wanted = set(net.labels if languages is None else languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, params = shared.value
        own = ByteConvNet(labels)
        own.params = params
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                found = predict(own, part.column(at).to_pylist())
                names = pa.array([f[0] for f in found], part.schema.field(lang).type)
                part = part.set_column(lang, part.schema.field(lang), pc.coalesce(part.column(lang), names))
                yield part.filter(pa.array([name in wanted and share > min_share for name, share in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op4_language": op4_language}
