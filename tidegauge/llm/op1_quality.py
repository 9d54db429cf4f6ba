"""Quality by importance resampling of hashed n-grams.

Two bag-of-n-gram models are fitted on hashed words and word pairs: one on the
target (labelled good and not toxic), one on the raw corpus (every text). A text's
log weight is the sum over its n-grams of the log ratio of the two, shrunk to zero
where it is small. The target model comes in two folds by a hash of the id, and a
text is weighed by the fold it is not in. Adding Gumbel
noise and taking the k largest sums samples k texts without replacement in
proportion to their weights.

k defaults to the share of the target among labelled rows, of all rows. The
threshold for k is found by counting in at most 4096 bins a round, so no sort of
the corpus meets in one task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.selection import threshold
from tidegauge.session import materialise, ship, table

#: Buckets of words and of word pairs.
WORD_BITS, PAIR_BITS = 18, 10
#: The bound of the labelled texts that the target model is fitted on.
TARGET_SAMPLE = 20_000
#: Counts added on both sides of a ratio, and the log ratio that counts as none:
#: differences in topic and language shares stay below it.
PRIOR, DEAD = 3.0, 0.4
_WORDS, _PAIRS = 1 << WORD_BITS, 1 << PAIR_BITS
_SIZE = _WORDS + _PAIRS
_TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Bytes of tokens that a worker remembers the hashes of.
_REMEMBERED = 16 << 20


class _TokenHashes(dict):
    held = 0

    def __missing__(self, token: str) -> int:
        self.held += 64 + len(token)
        if self.held > _REMEMBERED:
            self.clear()
            self.held = 64 + len(token)
        self[token] = found = xxhash.xxh64_intdigest(token, 5)
        return found


_hashes = _TokenHashes()


def features(text: str | None) -> np.ndarray:
    """Bucket of each word, then of each pair of neighbours; case and marks count."""
    tokens = _TOKEN.findall(text) if text else []
    h = np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    words = (h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - WORD_BITS)
    return np.concatenate([words, (pairs >> np.uint64(64 - PAIR_BITS)) + np.uint64(_WORDS)]).astype(np.int64)


def fold(name: object, text: str | None) -> int:
    """0 or 1 by the id, or by the text where there is no id."""
    return xxhash.xxh64_intdigest(str(name) if name is not None else text or "", 77) & 1


def _count(folds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, _SIZE), np.int64)
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                np.add.at(total[fold(name, text) % folds], features(text), 1)
        parts, some = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array(some), pa.array(total[parts, some])], ["fold", "bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, folds: int) -> np.ndarray:
    """Occurrences of every bucket in each fold (one or two) of a frame (id, text); a fixed-size array."""
    rows = texts.mapInArrow(_count(folds), "fold long, bucket long, n long").groupBy("fold", "bucket").agg(F.sum("n").alias("n"))
    found = rows.toPandas()
    total = np.zeros((folds, _SIZE))
    total[found["fold"], found["bucket"]] = found["n"]
    return total


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of each bucket, words and pairs each by themselves."""
    parts = []
    for half in (slice(0, _WORDS), slice(_WORDS, None)):
        p, q = target[half], raw[half]
        expected = q * (p.sum() / q.sum()) if q.sum() else q
        ratio = np.log((p + PRIOR) / (expected + PRIOR))
        parts.append(np.sign(ratio) * np.maximum(np.abs(ratio) - DEAD, 0))
    return np.concatenate(parts)


def gumbel(name: str) -> float:
    """A standard Gumbel number that depends on the name alone."""
    return float(-np.log(-np.log((xxhash.xxh64_intdigest(name, 9) + 0.5) / 2.0**64)))


def score(docs: DataFrame, ratio: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_grams, log_weight, noisy), one per input row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ratio.astype(np.float32))  # two megabytes, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            sizes, sums, noisy = [], [], []
            for name, text in zip(ids, texts, strict=True):
                found = features(text := text.as_py())
                sizes.append(len(found))
                sums.append(float(weights[1 - fold(name, text)][found].sum(dtype=np.float64)))
                noisy.append(sums[-1] + gumbel(str(name) if name is not None else text or ""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64()), pa.array(noisy, pa.float64())], ["doc_id", "n_grams", "log_weight", "noisy"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_grams long, log_weight double, noisy double")


def resample(
    docs: DataFrame, labels: DataFrame, k: int | None = None, doc_id: str = "doc_id", text: str = "text", sample: int = TARGET_SAMPLE
) -> DataFrame:
    """Rows (doc_id, n_grams, log_weight, noisy, selected), one per input row.

    ``labels`` has doc_id, quality and toxic; the target is quality 1 and toxic 0.
    Null and empty texts have weight 0 and are never selected. Rows tied at the
    threshold are all selected. Repeated rows come back repeated with equal values.
    Null labels count as not good. Without target labels nothing is selected; an
    empty table gives no rows. Other columns are left out.
    """
    ship(docs.sparkSession)
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(1)) == 0)).alias("good"))
    share = known.agg(F.count("*").alias("n"), F.count_if("good").alias("good")).first()
    # At most ``sample`` ids: a share of the hashes holds a few more, and the least of those count.
    near = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, (1.1 * sample + 100) / max(share["good"], 1))))
    target = known.where("good").where(near).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("_id"))
    chosen = docs.join(F.broadcast(target), F.col(doc_id) == F.col("_id"), "left_semi")
    pair = [F.col(doc_id).cast("long"), F.col(text).cast("string")]
    target_counts, raw_counts = bucket_counts(chosen.select(*pair), 2), bucket_counts(docs.select(*pair), 1)[0]
    ratio = np.stack([log_ratio(part, raw_counts) for part in target_counts])
    scored = materialise(score(docs, ratio, doc_id, text), "scored")
    # 2^-20 is the resolution at which keys count as tied.
    keys = scored.where("n_grams > 0").select(F.round(F.col("noisy") * (1 << 20)).cast("long").alias("q"))
    if k is None:
        k = round(docs.count() * share["good"] / share["n"]) if share["n"] else 0
    cut = threshold(keys, k)
    picked = F.lit(bool(k)) if cut is None else F.round(F.col("noisy") * (1 << 20)).cast("long") >= cut
    return scored.withColumn("selected", (F.col("n_grams") > 0) & picked)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, resampled towards the good labels."""
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_grams", "log_weight", "noisy", "selected", F.col("selected").alias("kept"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_quality": op1_quality}
