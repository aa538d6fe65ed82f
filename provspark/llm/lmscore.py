"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

log p(word | history) = log p(class | history) + log p(group | class, history) + log p(word | class, group). A word's
class and its group in the class follow from its ending, by tables learned from which endings stand near each other.
The first two factors are log-linear over hashed features of the three words before (each by its place, two of them
skips, and the last two as a bigram), those of the second together with the class. The last factor is the added-one
share of the word among its group, one share kept for words not seen.

Texts are split and coded once, into a table of blocks that all later passes read: local word numbers, and each
distinct word's code (54 bits of a hash, 10 bits of ending).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import materialize, whole_texts

CLASSES, GROUPS, BUCKETS, TEMPLATES, ENDINGS = 32, 32, 4096, 4, 1024
ROUNDS, STEP, PRIOR, SHARE = 3, 0.4, 20.0, 0.45
#: Words, so many at most, whose counts go to every executor: the most frequent ones. All others are joined.
FREQUENT = 400_000
#: Bytes of texts, about, in a coded block; tokens that a pass works on at once.
BLOCK_BYTES, STRIDE = 8_000_000, 2048
_SALTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
#: Code of the end of a text; no word has ending 0.
END = np.uint64(0x5851F42D4C957F2D >> 10 << 10)
_PLACES = 64
_TABLE = np.random.default_rng(41).integers(0, 2**64, (_PLACES, 256), np.uint64).ravel()


def codes_of(words: pa.Array) -> np.ndarray:
    """Of distinct words (no empty ones): 54 bits of a tabulation hash, a longer word's of xxhash, and the ending in the low 10 bits."""
    words = words.cast(pa.large_binary())
    if not len(words):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    hashed = np.add.reduceat(_TABLE[np.minimum(place, _PLACES - 1) * 256 + data], starts) * _SALTS[0]
    for i in np.flatnonzero(sizes > _PLACES).tolist():
        hashed[i] = xxhash.xxh64_intdigest(words[i].as_py())
    hashed ^= hashed >> np.uint64(32)
    ends = starts + sizes - 1
    last = np.zeros(len(words), np.uint64)
    for k in range(3):
        last = last << np.uint64(8) | np.where(sizes > k, data[np.maximum(ends - k, 0)], 0).astype(np.uint64)
    last = ((last + np.uint64(1)) * _SALTS[1]) >> np.uint64(40)
    return hashed >> np.uint64(10) << np.uint64(10) | (last % np.uint64(ENDINGS - 1) + np.uint64(1))


def endings(codes: np.ndarray) -> np.ndarray:
    return (codes & np.uint64(ENDINGS - 1)).astype(np.int64)


class Block:
    """Texts coded: ``ids`` are the places of all their tokens, ends included, in ``words``; ``sizes`` their tokens."""

    def __init__(self, ids: np.ndarray, words: np.ndarray, sizes: np.ndarray):
        self.ids, self.words, self.sizes = ids, words, sizes
        self.starts = np.cumsum(sizes) - sizes

    @classmethod
    def of(cls, texts: pa.Array) -> Block:
        """Words with A-Z lower-cased of whole texts (null: empty), after each text an end."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(whole_texts(texts)))
        flat, offsets = split.flatten(), split.offsets.to_numpy()
        solid = np.diff(np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]) > 0 if len(flat) else np.zeros(0, bool)
        sizes = np.diff(np.concatenate([[0], np.cumsum(solid)])[offsets - offsets[0]])
        coded = (flat if solid.all() else flat.filter(pa.array(solid))).dictionary_encode()
        words = np.append(codes_of(coded.dictionary), END)
        ids = np.insert(coded.indices.to_numpy().astype(np.int32), np.cumsum(sizes), len(words) - 1)
        order = np.argsort(-np.bincount(ids, minlength=len(words)), kind="stable")  # small numbers for frequent words
        rank = np.empty(len(words), np.int32)
        rank[order] = np.arange(len(words), dtype=np.int32)
        return cls(rank[ids], words[order], sizes + 1)

    def packed(self) -> tuple[bytes, bytes, bytes]:
        """Numbers as three byte planes, codes, and sizes."""
        return self.ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes(), self.words.astype("<u8").tobytes(), self.sizes.astype("<u4").tobytes()

    @classmethod
    def unpacked(cls, ids: bytes, words: bytes, sizes: bytes) -> Block:
        planes = np.frombuffer(ids, np.uint8).reshape(3, -1)
        wide = np.zeros((planes.shape[1], 4), np.uint8)
        wide[:, :3] = planes.T
        return cls(wide.view("<u4").ravel().astype(np.int32), np.frombuffer(words, "<u8").astype(np.uint64), np.frombuffer(sizes, "<u4").astype(np.int64))

    def rows(self) -> list[np.ndarray]:
        """Of each token, the hash of each template's context; none sees another text's words. Before a text stand zeros."""
        h = self.words[self.ids]
        shifted = []
        for gap in (1, 2, 3):
            x = np.concatenate([np.zeros(gap, np.uint64), h[:-gap]]) if len(h) >= gap else np.zeros(len(h), np.uint64)
            for k in range(gap):
                x[(self.starts + k)[self.sizes > k]] = 0
            shifted.append(x[: len(h)])
        one, two, three = shifted
        return [(key + np.uint64(t + 1)) * _SALTS[t] for t, key in enumerate((one, two, three, one * _SALTS[3] + two))]


def first_rows(hashed: list[np.ndarray]) -> list[np.ndarray]:
    """Feature rows of the class factor."""
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    return [(k >> shift).astype(np.int32) + np.int32(t * BUCKETS) for t, k in enumerate(hashed)]


def second_rows(hashed: list[np.ndarray], classes: np.ndarray) -> list[np.ndarray]:
    """Feature rows of the group factor: the contexts together with the class."""
    own = (classes.astype(np.uint64) + np.uint64(1)) * _SALTS[2]
    shift = np.uint64(64 - BUCKETS.bit_length() - 1)
    return [(((k ^ own) * _SALTS[1]) >> shift).astype(np.int32) + np.int32(t * 4 * BUCKETS) for t, k in enumerate(hashed)]


def learn_classes(beside: np.ndarray, counts: np.ndarray, seed: int = 5, steps: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Ending -> class and ending -> group in it; the end is alone in class 0.

    Weighted k-means of the endings' neighbour shares (square roots); in a class the most frequent endings have a
    group each, the others share the last one.
    """
    weight = beside.sum(axis=1) + 1e-9
    points = np.sqrt(beside / weight[:, None]).astype(np.float32)[1:]
    weight, rng = weight[1:], np.random.default_rng(seed)
    centres = [points[int(weight.argmax())]]
    gap = np.full(len(points), np.inf)
    for _ in range(CLASSES - 2):
        gap = np.minimum(gap, ((points - centres[-1]) ** 2).sum(axis=1))
        chance = gap * weight
        total = chance.sum()
        centres.append(points[rng.choice(len(points), p=chance / total) if total > 0 else 0])
    centres, own = np.array(centres), np.zeros(len(points), np.int64)
    for _ in range(steps):
        own = ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
        for k in range(CLASSES - 1):
            if (mine := own == k).any():
                centres[k] = np.average(points[mine], axis=0, weights=weight[mine])
    class_of, group_of = np.concatenate([[0], own + 1]), np.zeros(ENDINGS, np.int64)
    for k in range(1, CLASSES):
        mine = np.flatnonzero(class_of == k)
        mine = mine[np.argsort(-counts[mine], kind="stable")]
        group_of[mine] = np.minimum(np.arange(len(mine)), GROUPS - 1)
    return class_of, group_of


class Softmax:
    """One factor: weights (rows, width) of hashed features and a bias (bias rows, width), all float32."""

    def __init__(self, seen: np.ndarray, bias_counts: np.ndarray, of_row: np.ndarray | None = None):
        """Start: each feature row pulls towards its own shares, smoothed; no data: all alike.

        ``bias_counts`` has one row, or one for each class. A row's own base share is that of all tokens together.
        """
        share = (bias_counts + 1.0) / (bias_counts + 1.0).sum(axis=1, keepdims=True)
        self.bias = np.log(share).astype(np.float32)
        base = np.broadcast_to(share[0], seen.shape) if of_row is None else of_row
        base = (base + 1e-6) / (base + 1e-6).sum(axis=1, keepdims=True)
        n = seen.sum(axis=1, keepdims=True)
        self.weights = np.clip(SHARE * (np.log((seen + PRIOR * base) / (n + PRIOR)) - np.log(base)), -15, 15).astype(np.float32)

    def update(self, seen: np.ndarray, expected: np.ndarray) -> None:
        """One step along the gradient of the log likelihood, seen - expected, scaled by the expected counts."""
        step = STEP * (seen - expected) / (np.maximum(seen, expected) + PRIOR)
        self.weights = np.clip(self.weights + step, -15, 15).astype(np.float32)

    def logits(self, rows: list[np.ndarray], bias: np.ndarray | None = None) -> np.ndarray:
        """Of each token its class logits; ``bias`` names its bias row, if there are several."""
        out = np.take(self.weights, rows[0], axis=0)
        for r in rows[1:]:
            out += np.take(self.weights, r, axis=0)
        out += self.bias[0] if bias is None else np.take(self.bias, bias, axis=0)
        return out


def log_share(z: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Of each row of logits, ln of the softmax at ``own``. Logits are sums of a few clipped weights: exp does not overflow."""
    at = z[np.arange(len(z)), own]
    np.exp(z, out=z)
    return at - np.log(z @ np.ones(z.shape[1], np.float32))


def drawn(z: np.ndarray, luck: np.ndarray) -> np.ndarray:
    """One class of each row of logits, drawn with its softmax probability by a number from 0 to 1."""
    np.exp(z, out=z)
    grown = z @ np.triu(np.ones((z.shape[1], z.shape[1]), np.float32))
    return (grown >= (luck * grown[:, -1])[:, None]).argmax(axis=1)  # the first place that luck does not pass


def _count(table: np.ndarray, rows: list[np.ndarray], own: np.ndarray) -> None:
    """Add the pairs of each template's feature rows and ``own``; a template has a range of rows of its own."""
    span, width = len(table) // TEMPLATES, table.shape[1]
    for t, r in enumerate(rows):
        cells = (r - np.int32(t * span)) * np.int32(width) + own.astype(np.int32)
        table[t * span : (t + 1) * span] += np.bincount(cells, minlength=span * width).reshape(span, width)


class Model:
    """The class factor, the group factor, and the tables from ending to class and group."""

    def __init__(self, first: Softmax, second: Softmax, class_of: np.ndarray, group_of: np.ndarray):
        self.first, self.second, self.class_of, self.group_of = first, second, class_of, group_of

    def log_p(self, block: Block) -> np.ndarray:
        """Of each token, ln p(class | history) + ln p(group | class, history)."""
        hashed, ends = block.rows(), endings(block.words)[block.ids]
        classes, groups = self.class_of[ends], self.group_of[ends]
        out = np.empty(len(ends))
        for i in range(0, len(ends), STRIDE):
            part = slice(i, i + STRIDE)
            h, c = [x[part] for x in hashed], classes[part]
            out[part] = log_share(self.first.logits(first_rows(h)), c)
            out[part] += log_share(self.second.logits(second_rows(h, c), c), groups[part])
        return out


def see(block: Block, class_of: np.ndarray, group_of: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
    """Add how often each feature row stands with each class, and each group."""
    hashed, ends = block.rows(), endings(block.words)[block.ids]
    classes, groups = class_of[ends], group_of[ends]
    _count(first, first_rows(hashed), classes)
    _count(second, second_rows(hashed, classes), groups)


def expect(block: Block, model: Model, first: np.ndarray, second: np.ndarray, seed: int = 0) -> None:
    """Add what the model expects in the places of ``see``: each token counts at one class, and one group, drawn from the model."""
    hashed, ends = block.rows(), endings(block.words)[block.ids]
    classes = model.class_of[ends]
    luck = np.random.default_rng(seed).random((2, len(ends)), np.float32)
    draws = np.empty((2, len(ends)), np.int64)
    for i in range(0, len(ends), STRIDE):
        part = slice(i, i + STRIDE)
        h, c = [x[part] for x in hashed], classes[part]
        draws[0, part] = drawn(model.first.logits(first_rows(h)), luck[0, part])
        draws[1, part] = drawn(model.second.logits(second_rows(h, c), c), luck[1, part])
    _count(first, first_rows(hashed), draws[0])
    _count(second, second_rows(hashed, classes), draws[1])


def held_out(modulus: int = 7, remainder: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == remainder, F.lit(False))


_CODED = "part long, held boolean, doc_ids array<long>, ids binary, words binary, sizes binary, counts binary, tokens long"


def coded(docs: DataFrame) -> DataFrame:
    """A row for each block of whole texts, held-out and training texts apart, with the words' counts in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        for batch in batches:
            for held in (False, True):
                mine = batch.filter(pc.equal(batch.column(2), held))
                sizes = np.cumsum(pc.fill_null(pc.binary_length(mine.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
                at = 0
                while at < len(mine):
                    to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK_BYTES, side="right")))
                    block = Block.of(mine.column(1).slice(at, to - at))
                    counts = np.bincount(block.ids, minlength=len(block.words)).astype("<u4").tobytes()
                    ids = pa.array([mine.column(0).slice(at, to - at).to_pylist()], pa.list_(pa.int64()))
                    packed = [pa.array([x], pa.binary()) for x in (*block.packed(), counts)]
                    yield pa.RecordBatch.from_arrays([pa.array([part << 32 | serial], pa.int64()), pa.array([held]), ids, *packed, pa.array([len(block.ids)], pa.int64())], [x.split()[0] for x in _CODED.split(", ")])
                    at, serial = to, serial + 1

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held", held_out())
    return plain.mapInArrow(run, _CODED)


def word_counts(train: DataFrame, most: int = 2_000_000) -> DataFrame:
    """``(word, c)``: every training word's code and count; a task sends each of its words once for each ``most`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, size = [], [], 0

        def out():
            distinct, at = np.unique(np.concatenate(words), return_inverse=True)
            total = np.bincount(at, np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(total)], ["word", "c"])

        for batch in batches:
            for w, c in zip(batch.column(0), batch.column(1)):
                words.append(np.frombuffer(w.as_py(), "<u8").astype(np.uint64))
                counts.append(np.frombuffer(c.as_py(), "<u4"))
                size += len(words[-1])
                if size >= most:
                    yield out()
                    words, counts, size = [], [], 0
        if words:
            yield out()

    return train.select("words", "counts").mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _summed(train: DataFrame, shapes: list[tuple[int, int]], collect) -> list[np.ndarray]:
    """Sums over all blocks of int64 tables of ``shapes`` that ``collect(tables, block, number)`` adds to.

    A task sends its tables once, compressed, in pieces; 64 are added up in a task, three times over.
    """
    pieces, total = 16, sum(r * c for r, c in shapes)
    step = -(-total // pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.zeros(step * pieces, np.int64)
        cuts = np.cumsum([0, *(r * c for r, c in shapes)])
        tables = [flat[a:b].reshape(s) for a, b, s in zip(cuts[:-1], cuts[1:], shapes)]
        for batch in batches:
            for part, ids, words, sizes in zip(*(batch.column(k) for k in range(4))):
                collect(tables, Block.unpacked(ids.as_py(), words.as_py(), sizes.as_py()), part.as_py())
        packed = [zlib.compress(flat[i * step : (i + 1) * step].astype("<i4" if flat.max(initial=0) < 1 << 31 else "<i8").tobytes(), 1) for i in range(pieces)]
        wide = 4 if flat.max(initial=0) < 1 << 31 else 8
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * pieces, pa.int64()), pa.array(range(pieces), pa.int32()), pa.array([wide] * pieces, pa.int32()), pa.array(packed, pa.binary())], ["part", "piece", "wide", "data"])

    def numbers(wide: int, data: bytes) -> np.ndarray:
        return np.frombuffer(zlib.decompress(data), "<i4" if wide == 4 else "<i8").astype(np.int64)

    def add(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        found = np.zeros(step, np.int64)
        for wide, data in zip(group["wide"].to_pylist(), group["data"]):
            found += numbers(wide, data.as_py())
        return pa.table({"part": pa.array([key[1].as_py()], pa.int64()), "piece": pa.array([key[0].as_py()], pa.int32()), "wide": pa.array([8], pa.int32()), "data": pa.array([zlib.compress(found.astype("<i8").tobytes(), 1)], pa.binary())})

    schema = "part long, piece int, wide int, data binary"
    sent = train.select("part", "ids", "words", "sizes").mapInArrow(run, schema)
    for _ in range(3):
        sent = sent.withColumn("part", F.floor(F.col("part") / 64).cast("long")).groupBy("piece", "part").applyInArrow(add, schema)
    flat = np.zeros(step * pieces, np.int64)
    for r in sent.collect():  # as many rows as pieces, of a fixed size, for each 262,144 input partitions
        flat[r.piece * step : (r.piece + 1) * step] += numbers(r.wide, r.data)
    cuts = np.cumsum([0, *(r * c for r, c in shapes)])
    return [flat[a:b].reshape(s) for a, b, s in zip(cuts[:-1], cuts[1:], shapes)]


def near_counts(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of endings one or two places apart in a text, both ways, and of each ending."""

    def collect(tables: list[np.ndarray], block: Block, _: int) -> None:
        e = endings(block.words)[block.ids]
        for gap, whole in ((1, e[:-1] != 0), (2, (e[:-2] != 0) & (e[1:-1] != 0))):
            tables[0] += np.bincount((e[:-gap] * ENDINGS + e[gap:])[whole], minlength=ENDINGS * ENDINGS).reshape(ENDINGS, ENDINGS)
        tables[1][0] += np.bincount(e, minlength=ENDINGS)

    beside, single = _summed(train, [(ENDINGS, ENDINGS), (1, ENDINGS)], collect)
    return (beside + beside.T).astype(float), single[0]


SHAPES = [(TEMPLATES * BUCKETS, CLASSES), (TEMPLATES * 4 * BUCKETS, GROUPS)]


def start(seen: list[np.ndarray], single: np.ndarray, class_of: np.ndarray, group_of: np.ndarray) -> Model:
    """The model of observed counts alone."""
    of_class, of_group = np.zeros((1, CLASSES)), np.zeros((CLASSES, GROUPS))
    np.add.at(of_class[0], class_of, single)
    np.add.at(of_group, (class_of, group_of), single)
    # a row of the group factor holds one class, save collisions: its base is that of the classes it is seen with
    share = (of_group + 1.0) / (of_group + 1.0).sum(axis=1, keepdims=True)
    at = np.argmax(seen[1] @ np.log(share).T, axis=1)
    return Model(Softmax(seen[0], of_class), Softmax(seen[1], of_group, share[at]), class_of, group_of)


def fit(train: DataFrame, class_of: np.ndarray, group_of: np.ndarray, single: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Observed feature counts over all training texts, then ``rounds`` gradient updates, each over its share of the
    blocks, so that together they see every text once."""
    spark = train.sparkSession
    model = start(_summed(train, SHAPES, lambda t, block, _: see(block, class_of, group_of, *t)), single, class_of, group_of)
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def collect(tables: list[np.ndarray], block: Block, number: int, shared=shared) -> None:
            see(block, class_of, group_of, *tables[:2])
            expect(block, shared.value, *tables[2:], seed=number)

        tables = _summed(train.where(F.pmod(F.xxhash64("part"), F.lit(rounds)) == k), SHAPES * 2, collect)
        model.first.update(tables[0], tables[2])
        model.second.update(tables[1], tables[3])
    return model


class Frequent:
    """Sorted codes of frequent words and their counts."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]

    def of(self, words: np.ndarray) -> np.ndarray:
        """Counts, 0 where a word is not among them."""
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.counts[at], 0)


def _frequent(counts: DataFrame, most: int) -> Frequent:
    """The words of the highest counts, as many whole counts as fit in ``most`` words."""
    tally = counts.groupBy("c").agg(F.count("*").alias("n"))
    above = tally.where(F.col("c") >= _least_count(tally, most)).agg(F.min("c")).first()[0]
    table = counts.where(F.col("c") >= above).toArrow() if above is not None else None
    if table is None:
        return Frequent(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return Frequent(table["word"].to_numpy().view(np.uint64), table["c"].to_numpy())


def _least_count(tally: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` words have it or more: by powers of two first, then exactly."""
    power = F.floor(F.log2(F.col("c").cast("double"))).cast("int")
    left, low = most, 0
    for r in tally.groupBy(power.alias("p")).agg(F.sum("n").alias("n")).orderBy(F.desc("p")).collect():  # 63 rows at most
        if r.n > left:
            low = r.p
            break
        left -= r.n
    else:
        return 0
    for r in tally.where(power == low).orderBy(F.desc("c")).limit(most + 1).toLocalIterator():  # distinct counts, each of a word at least
        if r.n > left:
            return r.c + 1
        left -= r.n
    return 1 << low


def learn(train: DataFrame, counts: DataFrame, rounds: int = ROUNDS) -> tuple[Model, np.ndarray, int, int]:
    """The model, each group's log10 denominator of its words' shares, all training tokens, and distinct ones.

    ``train`` has the coded blocks of the training texts, ``counts`` their ``word_counts``.
    """
    beside, single = near_counts(train)
    class_of, group_of = learn_classes(beside, single)
    kinds = np.zeros(ENDINGS, np.int64)
    for r in counts.groupBy(F.col("word").bitwiseAND(ENDINGS - 1).alias("e")).agg(F.count("*").alias("v")).collect():  # a row an ending
        kinds[r.e] += r.v
    size = np.zeros((CLASSES, GROUPS))
    np.add.at(size, (class_of, group_of), single + kinds)
    size[0, 0] = single[0]  # the end is alone in its class, and no word to come is
    return fit(train, class_of, group_of, single, rounds), np.log10(size + 1), int(single.sum()), int(kinds.sum())


def score(docs: DataFrame, rounds: int = ROUNDS, frequent: int = FREQUENT) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row, log10 scores.

    Learns from all documents that are not held out (a null id never is); scores all. A null or empty text is
    its end token alone. Repeated rows count and are scored each. With no training document every word is
    unknown. Words are told apart by 54 bits of a hash and their ending. Counts are exact: those of frequent words
    travel to the texts, the texts' other words travel to their counts.
    """
    spark = docs.sparkSession
    blocks = materialize(coded(docs), "lm-blocks")
    train = blocks.where(~F.col("held"))
    counts = materialize(word_counts(train), "lm-words")
    model, floor, total, distinct = learn(train, counts, rounds)
    shared = spark.sparkContext.broadcast((model, _frequent(counts, frequent), floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, top, floor = shared.value
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for held, ids, *packed in zip(*(batch.column(k) for k in range(5))):
                block = Block.unpacked(*(x.as_py() for x in packed))
                found = top.of(block.words)
                ends = endings(block.words)
                fixed = np.log10(found + 1) - floor[model.class_of[ends], model.group_of[ends]]
                sums = lambda values, block=block: np.add.reduceat(values, block.starts)
                classed = sums(model.log_p(block) / np.log(10) + (fixed - np.log10(found + 1))[block.ids])
                rare = (found == 0)[block.ids]
                text = np.repeat(np.arange(len(block.sizes)), block.sizes)
                # each text's rare words once, with their number
                pairs, times = np.unique(text[rare] * len(block.words) + block.ids[rare], return_counts=True)
                owner, word = np.divmod(pairs, max(len(block.words), 1))
                cuts = np.searchsorted(owner, np.arange(len(block.sizes) + 1))
                lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x)) for x in (block.words[word].view(np.int64), times.astype(np.int32))]
                n = len(block.sizes)
                keys = (part << 40) + at + np.arange(n)
                at += n
                cols = [pa.array(keys), ids.values, pa.array([held.as_py()] * n), pa.array(block.sizes), pa.array(sums((~rare).astype(np.int64))), pa.array(sums(np.log10(found + 1)[block.ids])), pa.array(classed), *lists]
                yield pa.RecordBatch.from_arrays(cols, ["key", "doc_id", "held_out", "n_tokens", "known", "counted", "classed", "rare", "times"])

    schema = "key long, doc_id long, held_out boolean, n_tokens long, known long, counted double, classed double, rare array<long>, times array<int>"
    first = materialize(blocks.select("held", "doc_ids", "ids", "words", "sizes").mapInArrow(run, schema), "lm-texts")
    uses = first.select("key", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("key", F.col("r.rare").alias("word"), F.col("r.times").alias("m"))
    found = uses.join(counts, "word").groupBy("key").agg(F.sum("m").alias("more"), F.sum(F.col("m") * F.log10(F.col("c") + 1)).alias("add"))
    whole = first.drop("rare", "times").join(found, "key", "left")
    logs = F.col("counted") + F.coalesce("add", F.lit(0.0))
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"),
        (logs + F.col("classed")).alias("score"),
    )
