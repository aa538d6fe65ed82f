"""Quality rules: counted base rules, then a hashed n-gram log-likelihood ratio of trusted text to the raw corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import text_bytes

#: Characters of an n-gram, buckets, added count in each bucket, and the least mean ratio (natural log) of a kept text.
GRAM, BUCKETS, ADDED, LEAST = 3, 1 << 18, 1.0, -0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"


def base_counts(raw: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text (null: none of each)."""
    raw = raw or b""
    words = raw.split()
    chars = sum(map(len, words)) - sum(np.bincount(np.frombuffer(raw, np.uint8) >> 6, minlength=4)[2:3].tolist())
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of three words that the text has twice or more, the first included."""
    if len(words) <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    pairs = ids[:-2] * len(seen) + ids[1:-1]
    if len(seen) > 1_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, where, counts = np.unique(pairs * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[where] > 1
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def grams(text: bytes | None) -> np.ndarray:
    """Buckets of all windows of three code points."""
    points = np.frombuffer((text or b"").decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    if len(points) < GRAM:
        return np.zeros(0, np.int64)
    return (points[:-2] * 66931 + points[1:-1] * 1031 + points[2:]) % BUCKETS


def counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``(bucket, raw, target)``: n-grams over all documents, and over those whose id is in ``trusted(doc_id)``, distinct and not null.

    Both sides are dealt out by id, whatever their size: the ids grow with the labels. Rows without an id stay where they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text, good in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist()):
                for at in range(0, len(g := grams(text)), 1 << 20):
                    n = np.bincount(g[at : at + (1 << 20)], minlength=BUCKETS) if len(g) > 20_000 else None
                    if n is None:
                        np.add.at(raw, g, 1)
                        if good:
                            np.add.at(target, g, 1)
                    else:
                        raw += n
                        if good:
                            target += n
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = plain.where("doc_id is not null").join(trusted.withColumn("good", F.lit(True)).hint("shuffle_hash"), "doc_id", "left")
    flagged = own.select("text", F.coalesce("good", F.lit(False)).alias("good")).unionByName(plain.where("doc_id is null").select("text", F.lit(False).alias("good")))
    return flagged.mapInArrow(run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def trusted_ids(labels: DataFrame, most: int | None = None) -> DataFrame:
    """Ids labelled quality 1 and not toxic: all, or the first ``most`` by the MD5 of the id."""
    good = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return good if most is None else good.orderBy(F.md5(F.col("doc_id").cast("string"))).limit(most)


def ratios(table: list[tuple[int, int, int]]) -> np.ndarray:
    """Log ratio of a bucket's trusted to its raw share; buckets without a count have none.

    Added counts are in proportion to the two totals, so that a bucket seen in neither says nothing.
    """
    at, raw, target = (np.array(c, np.int64) for c in zip(*table)) if table else (np.zeros(0, np.int64),) * 3
    share = target.sum() / max(raw.sum(), 1)
    out = np.zeros(BUCKETS)
    if share:
        p = (target + ADDED * share) / (target.sum() + ADDED * share * BUCKETS)
        q = (raw + ADDED) / (raw.sum() + ADDED * BUCKETS)
        out[at] = np.log(p / q)
    return out


def judge(docs: DataFrame, labels: DataFrame, least: float = LEAST, most: int | None = None) -> DataFrame:
    """Base counts, base_failed, mean log ratio and verdict of every document.

    A text of under three characters has ratio 0; without a trusted document all ratios are 0. Null texts count
    nothing and fail the base rules. Repeated rows each get a row; extra columns are ignored.
    """
    rows = counts(docs, trusted_ids(labels, most)).collect()  # one row a bucket: bounded by BUCKETS
    shared = docs.sparkSession.sparkContext.broadcast(ratios([tuple(r) for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            found = []
            for raw in text_bytes(batch.column(1)):
                base, g = base_counts(raw), grams(raw)
                failed = base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEAT_PERCENT * base[0]
                mean = float(table[g].mean()) if len(g) else 0.0
                found.append((*base, failed, not failed and mean >= least, mean))
            cols = [pa.array(list(c)) for c in zip(*found)] if found else [pa.array([], t) for t in (*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "mean_ratio"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, mean_ratio double")
