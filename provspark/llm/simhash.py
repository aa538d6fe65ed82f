"""SimHash near-duplicates by anchor-point covering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import bounded_batches, each_text, materialize, text_bytes, words_of
from provspark.llm.components import connected_components
from provspark.llm.decontam import WordHashes, shingle_hashes

#: Most shingle hashes whose bits are spread out at once.
BLOCK = 1 << 15
#: Near copies: words of a shingle, least Jaccard similarity, MinHash bands and rows of a band. A pair at 0.8 shares no
#: band with probability (1 - 0.8^5)^32 = 3.0e-6.
NEAR_WIDTH, NEAR_LEAST, BANDS, BAND_ROWS = 5, 0.8, 32, 5
_SEEDS = np.random.default_rng(11).integers(0, 2**64, (2, BANDS * BAND_ROWS), np.uint64) | np.uint64(1)
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(raw: bytes | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash: bit b is set if more than half of the shingle hashes have it. No words: 0."""
    words = words_of(raw)
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= width:
        return digest(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes)[: len(words) - width + 1].tolist()
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, th: bool = False) -> DataFrame:
    """``(doc_id, fp[, th])`` of every document; the 64 bits as a signed long. Null or wordless text: 0. ``th`` adds a hash of the text."""
    names = ["doc_id", "fp", "th"][: 2 + th]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x, width, seed) for x in each_text(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64)), *([batch.column(2)] if th else [])], names)

    own = [F.col("doc_id").cast("long"), F.col("text").cast("string"), *([text_hash().alias("th")] if th else [])]
    return docs.select(*own).mapInArrow(run, ", ".join(f"{n} long" for n in names))


#: The code of one 32-bit half: the perfect Hamming [31, 26] code times the full code on bit 0. Bit position i in
#: 1..31 has parity column i. Covering radius 1; a word's syndrome names the bit that takes it to a code word.
HALF, RADIUS = 32, 1


def _syndrome(half: np.ndarray) -> np.ndarray:
    out = np.zeros(half.shape, np.uint64)
    for j in range(5):
        mask = np.uint64(sum(1 << i for i in range(1, HALF) if i >> j & 1))
        parity = half & mask
        for shift in (16, 8, 4, 2, 1):
            parity = parity ^ (parity >> np.uint64(shift))
        out |= (parity & np.uint64(1)) << np.uint64(j)
    return out


def home_anchor(half: np.ndarray) -> np.ndarray:
    """The nearest code word of each half word (uint64 holding 32 bits), at distance 1 or 0."""
    s = _syndrome(half)
    return half ^ np.where(s > 0, np.uint64(1) << s, np.uint64(0))


def anchors_within(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): every code word that may be the home of a word at distance <= 1 from the row's word.

    These are the code words within covering radius + 1 = 2: the home itself, the home with bit 0 turned,
    and, at syndrome s > 0, those reached by turning two bits i, j >= 1 with i xor j = s.
    """
    rows, s = np.arange(len(half)), _syndrome(half)
    home = half ^ np.where(s > 0, np.uint64(1) << s, np.uint64(0))
    out_rows, out = [rows, rows], [home, home ^ np.uint64(1)]
    for i in range(1, HALF):
        j = s ^ np.uint64(i)
        keep = (s > 0) & (j > np.uint64(i))
        out_rows.append(rows[keep])
        out.append(half[keep] ^ (np.uint64(1) << np.uint64(i)) ^ (np.uint64(1) << j[keep]))
    return np.concatenate(out_rows), np.concatenate(out)


def _anchored(fps: DataFrame, replicate: bool) -> DataFrame:
    """``(anchor, fp)``: each fingerprint at its home in either half, or at every anchor in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                fp = batch.column(0).slice(at, 8192).to_numpy(zero_copy_only=False).astype(np.int64)
                bits = fp.view(np.uint64)
                for k in (0, 1):
                    half = (bits >> np.uint64(32 * k)) & np.uint64(0xFFFFFFFF)
                    rows, anchor = anchors_within(half) if replicate else (np.arange(len(half)), home_anchor(half))
                    tagged = (anchor | (np.uint64(k) << np.uint64(32))).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(tagged), pa.array(fp[rows])], ["anchor", "fp"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long")


def links(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """``(a, b)``, a < b: all pairs of the given distinct fingerprints at 1 to 2 differing bits.

    At most 2 differing bits leave one 32-bit half with at most one, and there the two words share the home
    anchor of the first, so no pair is missed. Each fingerprint is sent to about 35 anchors; an anchor holds
    distinct fingerprints only, and those at its home differ from it in at most one bit of that half. The sides are
    merged, never broadcast: Spark's statistics take either for as small as the fingerprints, not for 35 times that.
    """
    if not 0 <= threshold <= 2:
        raise ValueError("the code covers thresholds 0 to 2")
    near = _anchored(fps, True).withColumnRenamed("fp", "b")
    home = _anchored(fps, False).withColumnRenamed("fp", "a")
    pairs = home.hint("merge").join(near, "anchor").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold))
    return pairs.select("a", "b")


def simhash_groups(docs: DataFrame, threshold: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs(doc_id, text, ...)``.

    Exact copies of a fingerprint are folded into one before any comparison, so a huge group of copies costs
    one row. Null and empty texts have fingerprint 0 and link like any other. component_id is the smallest
    doc_id of the component, null ids aside (null if it has no other). Repeated rows each get a row. Extra
    columns are ignored. An empty table gives an empty result. All sides grow with the table and are merged, never
    broadcast: copies and running ids take a byte or two a row in a file, by whose size Spark would go. The least
    ids are a table of their own, so that AQE can split a hot component.
    """
    fps = materialize(fingerprints(docs), "simhash")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    parts = connected_components(links(classes, threshold))
    labelled = classes.hint("merge").join(parts, classes.fp == parts.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    labels = materialize(labelled, "simhash-labels")
    least = materialize(labels.groupBy("component").agg(F.min("rep").alias("component_id")), "simhash-least")
    by_fp = labels.hint("merge").join(least, "component").select("fp", "component_id")
    return fps.hint("merge").join(by_fp, "fp").select("doc_id", "fp", "component_id")


def text_hash():
    return F.xxhash64(F.col("text").cast("string"))


def _keep_first(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Of each component of ``rows(doc_id, th, component)`` the row of ``docs`` with the smallest doc_id, then text hash; null ids come last.

    Rows are told apart by id and text, so a doc_id with two texts can lose one of them, rows without an id go like
    others, and of equal rows one stays.
    """
    key = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("th").alias("th"))
    first = materialize(rows.groupBy("component").agg(F.min(key).alias("k")).select("k.*"), "near-first")
    row = F.struct(*(F.col(f"`{n}`") for n in docs.columns)).alias("_row")
    own = docs.select(row, F.col("doc_id").cast("long").alias("_id"), text_hash().alias("_th"))
    same = lambda left, i, t: left[i].eqNullSafe(first["id"]) & (left[t] == first["th"])
    kept = own.join(first, same(own, "_id", "_th"), "left_semi")
    again = rows.groupBy("doc_id", "th").count().where("count > 1")
    if again.join(first, same(again, "doc_id", "th"), "left_semi").head(1):
        kept = kept.dropDuplicates(["_id", "_th"])
    return kept.select(*(F.col("_row")[n].alias(n) for n in docs.columns))


def keep_one(docs: DataFrame, threshold: int = 2) -> DataFrame:
    """One row of each group of fingerprints that link at ``threshold`` bits, as ``_keep_first`` chooses it."""
    signed = materialize(fingerprints(docs.select(F.col("doc_id"), F.col("text")), th=True), "simhash")
    parts = connected_components(links(signed.select("fp").distinct(), threshold))
    return _keep_first(docs, signed.join(parts, signed.fp == parts.node, "left").select("doc_id", "th", F.coalesce("component", "fp").alias("component")))


def bands(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingle hashes, each from BAND_ROWS smallest values; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    low = np.full(BANDS * BAND_ROWS, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 2048):
        low = np.minimum(low, (hashes[None, at : at + 2048] * _SEEDS[0][:, None] + _SEEDS[1][:, None]).min(axis=1))
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in low.reshape(BANDS, BAND_ROWS).T:
        keys = (keys ^ row) * _FOLD
        keys ^= keys >> np.uint64(31)
    return keys


def parities(hashes: np.ndarray) -> np.ndarray:
    """A set's parity bits, packed: bit i is whether an odd number of its hashes is i modulo the bits, 8 or more for each hash.

    Two sets' bits differ in no more places than the sets have elements that only one of them has.
    """
    bits = max(64, 1 << int(8 * len(hashes) - 1).bit_length()) if len(hashes) else 64
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little")


def folded(packed: np.ndarray, size: int) -> np.ndarray:
    """Parity bits (rows of bytes) as those of ``size`` bytes, a power of two below."""
    while packed.shape[-1] > size:
        half = packed.shape[-1] // 2
        packed = packed[..., :half] ^ packed[..., half:]
    return packed


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, th, fp, bands)`` of every document; th is a hash of the text as it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            made = [(fingerprint(x), bands(shingle_hashes(memo.of(words_of(x)), width)).view(np.int64)) for x in each_text(batch.column(2))]
            fps = np.array([f for f, _ in made], dtype=np.uint64)
            keys = pa.array([k for _, k in made], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64)), keys], ["doc_id", "th", "fp", "bands"])

    return docs.select(F.col("doc_id").cast("long"), text_hash().alias("th"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, th long, fp long, bands array<long>")


def _shingled(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``(th, s, n, odd)``: the distinct shingle hashes of each text in ``wanted(th)``, their number, and their ``parities``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.unique(shingle_hashes(memo.of(words_of(x)), width)) for x in text_bytes(part.column(1))]
                lists = pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))
                odd = pa.array([parities(x).tobytes() for x in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array([len(x) for x in sets], pa.int64()), odd], ["th", "s", "n", "odd"])

    # copies are folded before they are dealt out
    own = docs.select(text_hash().alias("th"), F.col("text").cast("string").alias("text")).dropDuplicates(["th"])
    return own.join(wanted, "th", "left_semi").select("th", "text").mapInArrow(run, "th long, s array<long>, n long, odd binary")


def near_links(docs: DataFrame, signed: DataFrame, given: DataFrame, width: int = NEAR_WIDTH, least: float = NEAR_LEAST, rounds: int = 2) -> DataFrame:
    """``(a, b)``: fingerprints that join, beside the links ``given``, all texts that share a band and are similar.

    Texts of a band are compared with one of them where the two are not yet in one component: first with the text that
    shares most bands with others, which near copies of one original have in common, then with another. What is still
    apart then goes through ``_across``. So a large group of near copies is joined without the square of its size in
    rows, and no pair that shares a band stays unjoined at ``least`` or more. Similarity is the Jaccard of the distinct 64-bit shingle hashes. Texts under ``width`` words have no
    band: they are near copies only if equal.
    """
    members = signed.select("th", "fp", F.explode("bands").alias("key")).distinct()
    shared = members.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n")
    members = materialize(members.join(shared, "key"), "near-members")
    weights = members.groupBy("th").agg(F.sum("n").alias("w"))
    members = materialize(members.drop("n").join(weights, "th"), "near-members")
    sets = materialize(_shingled(docs, members.select("th").distinct(), width), "near-sets")

    def similar(pairs: DataFrame) -> DataFrame:
        # statistics count an array as one element, so sets of any size could be broadcast
        one, other = (sets.select(F.col("th").alias(f"t{x}"), F.col("s").alias(f"s{x}")).hint("merge") for x in "ab")
        sized = pairs.join(one, "ta").join(other, "tb")
        both = F.size(F.array_intersect("sa", "sb"))
        return sized.where(both >= least * (F.size("sa") + F.size("sb") - both) - 1e-9).select("a", "b")

    def open_members(links: DataFrame) -> DataFrame:
        """Members of keys that still hold several components, with theirs."""
        parts = connected_components(links)
        labelled = members.join(parts, members.fp == parts.node, "left").select("key", "th", "fp", "w", F.coalesce("component", "fp").alias("c"))
        labelled = materialize(labelled, "near-labels")
        split = labelled.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
        return labelled.join(split, "key")

    found = given
    for k in range(rounds):
        rest = open_members(found)
        rank = F.struct("w", "th") if k == 0 else F.struct(F.xxhash64("th", F.lit(k)), "th")
        centre = rest.groupBy("key").agg(F.max_by(F.struct("th", "fp", "c"), rank).alias("x"))
        pairs = rest.join(centre, "key").where("c <> x.c").select(F.col("x.th").alias("ta"), F.col("th").alias("tb"), F.col("x.fp").alias("a"), F.col("fp").alias("b"))
        found = found.unionByName(materialize(similar(pairs.distinct()), "near-stars"))
    pairs = _across(open_members(found), sets.select("th", "n", "odd"), least)
    return found.unionByName(similar(materialize(pairs.distinct(), "near-pairs")))


def _across(rest: DataFrame, sets: DataFrame, least: float, block: int = 2000) -> DataFrame:
    """``(ta, tb, a, b)``: pairs of different components in a key of ``rest(key, th, fp, c)`` that may be similar.

    In each key the texts outside its largest component are a query set, held against all texts of the key in blocks
    of bounded size. A pair leaves its block unless sizes or parities show that it has too few shingles in common: none
    at ``least`` or more stays behind, and few others leave.
    """
    sizes = rest.groupBy("key", "c").agg(F.count("*").alias("k"))
    most = sizes.groupBy("key").agg(F.max_by("c", F.struct("k", "c")).alias("major"), F.sum("k").alias("all"), F.max("k").alias("top"))
    own = rest.join(most, "key").join(sets, "th")
    parts = lambda k: F.ceil(k / block).cast("int")
    na, nq = parts(F.col("all")), parts(F.col("all") - F.col("top"))
    place = lambda k, salt: F.pmod(F.xxhash64("th", F.lit(salt)), k).cast("int")
    asked = own.where("c <> major").withColumn("ba", F.explode(F.sequence(F.lit(0), na - 1))).withColumn("bq", place(nq, 1)).withColumn("side", F.lit(0))
    there = own.withColumn("bq", F.explode(F.sequence(F.lit(0), nq - 1))).withColumn("ba", place(na, 2)).withColumn("side", F.lit(1))
    names = ["key", "ba", "bq", "side", "th", "fp", "c", "n", "odd"]

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        side, th, fp, c, n = (table[x].to_numpy() for x in ("side", "th", "fp", "c", "n"))
        odd = table["odd"].to_pylist()
        width = np.array([len(x) for x in odd])
        shelves = {w: np.flatnonzero((width == w) & (side == 1)) for w in np.unique(width).tolist()}
        bits = {w: np.frombuffer(b"".join(odd[i] for i in at), np.uint8).reshape(-1, w) for w, at in shelves.items()}
        found = []
        for i in np.flatnonzero(side == 0).tolist():
            mine = np.frombuffer(odd[i], np.uint8)
            for w, at in shelves.items():
                near = (c[at] != c[i]) & (n[at] >= least * n[i] - 1e-9) & (n[i] >= least * n[at] - 1e-9)
                if near.any():
                    size, chosen = min(w, len(mine)), at[near]
                    apart = np.bitwise_count(folded(bits[w][near], size) ^ folded(mine, size)).sum(axis=1)
                    like = chosen[apart <= (n[i] + n[chosen]) * (1 - least) / (1 + least) + 1e-9]
                    found += [np.stack([np.full(len(like), th[i]), th[like], np.full(len(like), fp[i]), fp[like]])] if len(like) else []
        rows = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
        back = rows[0] > rows[1]  # a pair of two queries comes from either side
        rows[:, back] = rows[[1, 0, 3, 2]][:, back]
        return pa.table(dict(zip(("ta", "tb", "a", "b"), rows)))

    both = asked.select(*names).unionByName(there.select(*names))
    return both.groupBy("key", "ba", "bq").applyInArrow(run, "ta long, tb long, a long, b long")


def keep_near(docs: DataFrame, threshold: int = 2, width: int = NEAR_WIDTH, least: float = NEAR_LEAST) -> DataFrame:
    """One row of each group of near copies, as ``_keep_first`` chooses it.

    Near copies are texts within ``threshold`` bits, as in ``simhash_groups``, or of Jaccard similarity ``least`` or
    more over shingles of ``width`` words.
    """
    bounded_batches(docs.sparkSession)
    signed = materialize(_signed(docs, width), "near-signed")
    close = materialize(links(signed.select("fp").distinct(), threshold), "simhash-links")
    parts = connected_components(near_links(docs, signed, close, width, least))
    return _keep_first(docs, signed.join(parts, signed.fp == parts.node, "left").select("doc_id", "th", F.coalesce("component", "fp").alias("component")))
