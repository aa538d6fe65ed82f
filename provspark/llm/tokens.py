"""Whole-text encoding with a public tokenizer, fast on natural vocabularies."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from provspark.llm.common import whole_texts

#: A piece of a text: a line end or nothing, then no white space at either end.
_PIECE = re.compile(r"\n?\S(?:.*\S)?", re.DOTALL)
#: Letters whose normal form is one letter each; they make one pre-token, apart from the marks that may follow.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = ".,;:!?#*$%&"


@lru_cache(maxsize=4)
def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``flat[start : start + size]`` of each row, one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.arange(total, dtype=kind)
    at += np.repeat((start - (ends - size)).astype(kind), size)
    return flat[at]


class _Words:
    """The tokenizer's model on plain words: letters are mapped as its normalizer and pre-tokenizer map each of them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        full = _load(path)
        bare = json.load(open(path, encoding="utf-8"))
        bare |= {"added_tokens": [], "normalizer": None, "post_processor": None, "decoder": None}
        bare["pre_tokenizer"] = {"type": "Split", "pattern": {"String": "!"}, "behavior": "Isolated", "invert": False}
        self.model = Tokenizer.from_str(json.dumps(bare))
        self.mark = np.uint32(self.model.encode("!").ids[0])  # between words; no word of letters has it
        mapped = lambda c: "".join(x for x, _ in full.pre_tokenizer.pre_tokenize_str(full.normalizer.normalize_str(c) if full.normalizer else c))
        letters = {c: mapped(c) for c in map(chr, range(256)) if re.fullmatch(f"[{_LETTERS}]", c)}
        self.changed = {ord(c): m for c, m in letters.items() if c != m}
        self.lead = mapped(" ").strip()
        self.line = np.array(full.encode("\nab", add_special_tokens=False).ids[: -len(full.encode("ab", add_special_tokens=False).ids)], np.uint32)

    def ids(self, words: pa.Array, group: int = 2000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of a line end or nothing and letters, one after the other, and how many each has."""
        lines = pc.starts_with(words, "\n").to_numpy(zero_copy_only=False)
        spelled = pc.if_else(pa.array(lines), pc.utf8_ltrim(words, characters="\n"), pc.binary_join_element_wise(pa.scalar(self.lead, words.type), words, pa.scalar("", words.type)))
        cuts = pa.array([*range(0, len(words), group), len(words)], pa.int32())
        joined = pc.binary_join(pa.ListArray.from_arrays(cuts, spelled), pa.scalar("!", spelled.type))
        texts = [t.translate(self.changed) for t in joined.to_pylist()]
        flat, sizes = [], []
        for e in self.model.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(e.ids, np.uint32)
            marks = ids == self.mark
            flat.append(ids[~marks])
            sizes.append(np.diff(np.concatenate([[-1], np.flatnonzero(marks), [len(ids)]])) - 1)
        flat, sizes = np.concatenate(flat), np.concatenate(sizes)
        if len(self.line) and lines.any():
            first = (np.cumsum(sizes) - sizes)[lines]
            flat = np.insert(flat, np.repeat(first, len(self.line)), np.tile(self.line, int(lines.sum())))
            sizes = sizes + lines * len(self.line)
        return flat, sizes


class Encoder:
    """Encodes texts with add_special_tokens=False, as the library encodes each text as one string.

    The public BPE files' pre-tokenizers split before a single space or line end between two visible characters,
    whatever stands further left or right, so the pieces between such places are encoded apart and remembered, and
    a word apart from the marks that follow it. Words of plain letters go to the tokenizer's model directly. A text
    with other white space at a piece's end, or with the string of a special token, is encoded whole. A tokenizer
    that does not split so (see ``_splits``) encodes every text whole.

    A unit is a remembered run of ids: ``flat[start : start + size]``. Unit 0 is empty; ``known[i]`` is the piece of
    unit ``i``; a unit of size -1 is a piece whose text must be encoded whole.
    """

    _shared: dict[str, Encoder] = {}

    def __new__(cls, path: str, limit: int = 700_000):
        """One for each file in a Python worker, so that tasks share what is remembered."""
        if path not in cls._shared:
            cls._shared[path] = made = super().__new__(cls)
            made.tokenizer, made.limit = _load(path), limit
            made.special = [t.content for t in made.tokenizer.get_added_tokens_decoder().values()]
            made.words = _Words(path)
            made._forget()
            made.piecewise = made._splits()
        return cls._shared[path]

    def _forget(self) -> None:
        self.known = pa.array([""], pa.large_string())
        self.heads: dict[str, int] = {"": 0}  # the units of first pieces and of marks, which no space precedes
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.start, self.size, self.uses = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _splits(self) -> bool:
        """Whether a text of all kinds of pieces is encoded by pieces as it is whole."""
        probe = "Ab àé. c, D*** 12 x9\nÉf: gh's (i) \"j\" ßk!?\nlm n-o\np #$% q"
        if any(re.search(r"\s", t) for t in self.special):
            return False
        self.piecewise = True
        return self.encode([probe])[0] == np.array(self._plain([probe])[0], "<u4").tobytes()

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for at in range(0, len(texts), 20_000) for e in self.tokenizer.encode_batch_fast(texts[at : at + 20_000], add_special_tokens=False)]

    def _add(self, pieces: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """New units of the ids in ``flat``, known by ``pieces``."""
        at = len(self.start)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        held = np.maximum(sizes, 0)
        self.start = np.concatenate([self.start, self.used + np.cumsum(held) - held])
        self.size = np.concatenate([self.size, sizes])
        self.uses = np.concatenate([self.uses, np.zeros_like(sizes)])
        self.known = pa.concat_arrays([self.known, pieces.cast(pa.large_string())])
        self.used += len(flat)
        return np.arange(at, len(self.start))

    def _add_plain(self, pieces: pa.Array, texts: list[str]) -> np.ndarray:
        found = self._plain(texts)
        return self._add(pieces, np.array([x for ids in found for x in ids], np.uint32), np.array([len(ids) for ids in found], np.int64))

    def _trim(self) -> None:
        """Beyond the limit, only the half of the pieces that was used most stays."""
        if len(self.start) <= self.limit and self.used <= 16 * self.limit:
            return
        length = pc.fill_null(pc.binary_length(self.known), 0).to_numpy()
        units = np.flatnonzero((length > 0) & (length <= 64) & (self.size >= 0))
        units = units[np.argsort(-self.uses[units], kind="stable")[: self.limit // 2]]
        pieces, flat, sizes, uses = self.known.take(pa.array(units)), _ragged(self.flat, self.start[units], self.size[units]), self.size[units], self.uses[units] // 2
        self._forget()
        made = self._add(pieces, flat, sizes)
        self.uses[made] = uses

    def _nameless(self, texts: list[str]) -> np.ndarray:
        """Units of texts as they stand; no piece is looked up by them."""
        return self._add_plain(pa.nulls(len(texts), pa.large_string()), texts)

    def _learn(self, new: pa.Array) -> None:
        """Make units of distinct pieces that are not known yet."""
        parts = pc.extract_regex(new, f"^(?P<core>\n?[{_LETTERS}]+)(?P<tail>[{_MARKS}]*)$")
        plain = parts.is_valid()
        cores, tails, joined = parts.filter(plain).field("core"), parts.filter(plain).field("tail").dictionary_encode(), new.filter(plain)
        at = pc.index_in(cores, self.known)
        fresh = pc.unique(cores.filter(pc.is_null(at)))
        if len(fresh):
            at = pc.coalesce(at, pc.add(pc.index_in(cores, fresh), pa.scalar(len(self.start), pa.int32())))
            self._add(fresh, *self.words.ids(fresh))
        marks = tails.dictionary.to_pylist()
        unseen = [t for t in marks if t not in self.heads]
        self.heads.update(zip(unseen, self._nameless(unseen).tolist()))
        tailed = tails.indices.to_numpy()
        if len(marks) and "" in marks:
            more = tailed != marks.index("")
            at, joined, tailed = at.filter(pa.array(more)), joined.filter(pa.array(more)), tailed[more]
        if len(joined):
            pairs = np.stack([at.to_numpy(), np.array([self.heads[t] for t in marks])[tailed]], axis=1)
            sizes = self.size[pairs]
            self._add(joined, _ragged(self.flat, self.start[pairs].ravel(), sizes.ravel()), sizes.sum(axis=1))
        other = new.filter(pc.invert(plain)).to_pylist()
        odd = [p for p in other if self._apart(p)]
        self._add_plain(pa.array(odd, pa.large_string()), [p if p[0] == "\n" else f" {p}" for p in odd])
        rest = pa.array([p for p in other if not self._apart(p)], pa.large_string())
        self._add(rest, np.zeros(0, np.uint32), np.full(len(rest), -1, np.int64))

    def _apart(self, piece: str) -> bool:
        return bool(_PIECE.fullmatch(piece)) and not any(t in piece for t in self.special)

    def _units(self, pieces: pa.Array) -> np.ndarray:
        found = pc.index_in(pieces, self.known)
        if found.null_count:
            absent = pc.is_null(found)
            missing = pieces.filter(absent).dictionary_encode()
            before = len(self.start)
            self._learn(missing.dictionary)
            own = pc.index_in(missing.dictionary, self.known.slice(before)).to_numpy() + before
            out = pc.fill_null(found, 0).to_numpy().astype(np.int64)
            out[absent.to_numpy(zero_copy_only=False)] = own[missing.indices.to_numpy()]
            return out
        return found.to_numpy().astype(np.int64)

    def _head_units(self, heads: list[str], alone: np.ndarray) -> np.ndarray:
        """Of first pieces, -1 where the text must be encoded whole; an empty one is sound in an empty text only."""
        new = [h for h in dict.fromkeys(heads) if h not in self.heads and self._apart(h)]
        self.heads.update(zip(new, self._nameless(new).tolist()))
        found = np.array([self.heads.get(h, -1) for h in heads], np.int64)
        found[(found == 0) & ~alone] = -1
        return found

    def blocks(self, texts: pa.Array, end_id: int | None = None, most: int = 12_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For successive runs of texts (null: empty) of about ``most`` bytes: all their ids, and where each text's ids end."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
            yield self._block(whole_texts(texts.slice(at, to - at)), end_id)
            at = to
        pa.default_memory_pool().release_unused()  # what the columns of a block took

    def _block(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        if self.piecewise:
            flat, sizes = self._pieced(texts)
        else:
            found = self._plain(texts.to_pylist())
            flat, sizes = np.array([x for ids in found for x in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)
        ends = np.cumsum(sizes)
        if end_id is not None:
            flat = np.insert(flat, ends, np.uint32(end_id))
            ends = ends + np.arange(1, len(ends) + 1)
        return flat, ends

    def _pieced(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        self._trim()
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        first = split.offsets.to_numpy()
        first, pieces = first - first[0], split.flatten()
        units = self._units(pieces)
        units[first[:-1]] = self._head_units(pieces.take(pa.array(first[:-1])).to_pylist(), np.diff(first) == 1)
        # an empty piece further in is white space that the split does not know; unit 0 is right for empty texts alone
        bad = (units < 0) | (self.size[units] < 0) | (units == 0)
        bad[first[:-1]] &= units[first[:-1]] != 0
        whole = np.flatnonzero(np.logical_or.reduceat(bad, first[:-1]))
        if len(whole):
            counted, used = len(self.start), self.used
            made = self._nameless(texts.take(pa.array(whole)).to_pylist())  # all ids at the first piece, for this block
            own = np.zeros(len(texts), bool)
            own[whole] = True
            units[np.repeat(own, np.diff(first))] = 0
            units[first[whole]] = made
        sizes = self.size[units]
        flat = _ragged(self.flat, self.start[units], sizes)
        if len(whole):
            self.known, self.used = self.known.slice(0, counted), used
            self.start, self.size, self.uses = self.start[:counted], self.size[:counted], self.uses[:counted]
            units = units[units < counted]
        self.uses += np.bincount(units, minlength=len(self.uses))
        return flat, np.add.reduceat(sizes, first[:-1])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Of each text, its ids as little-endian unsigned 32-bit bytes."""
        out: list[bytes] = []
        for flat, ends in self.blocks(pa.array(texts, pa.large_string())) if texts else ():
            flat = flat.astype("<u4", copy=False)
            out += [flat[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        return out
