"""Whole-text encoding by the tokenizers library, each distinct piece of a run of texts once."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

from .common import text_chunks

_GLUE, _LETTER, _DIGIT, _MARK, _WHITE, _OTHER, _FOLLOWS = range(7)

#: What a byte belongs to. Texts are never cut beside glue: the apostrophe (it may begin a contraction), control bytes,
#: and characters of the lead bytes among which there is white space.
_KIND = np.full(256, _GLUE, dtype=np.uint8)
_KIND[np.r_[65:91, 97:123, 0xC3:0xC6]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[np.r_[33:39, 40:48, 58:65, 91:97, 123:127]] = _MARK
_KIND[[9, 10, 13, 32]] = _WHITE
_KIND[0xC6:0xF5] = _OTHER
_KIND[[0xE1, 0xE2, 0xE3]] = _GLUE
_KIND[0x80:0xC0] = _FOLLOWS

_SOLID = np.zeros(7, dtype=bool)
_SOLID[[_LETTER, _DIGIT, _MARK, _OTHER]] = True

#: How byte-level vocabularies spell the characters of two bytes that are letters here.
_SPELLED = {c: pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x180)}


def _kinds(raw: np.ndarray) -> np.ndarray:
    """The kind of each byte's character."""
    kind = _KIND[raw]
    two = np.flatnonzero((raw >= 0xC3) & (raw <= 0xC4))
    if len(two):
        # The signs of multiplication and division are no letters; the dotted capital I becomes two characters in lower case.
        two = two[two + 1 < len(raw)]
        after = raw[two + 1]
        odd = np.where(raw[two] == 0xC3, (after == 0x97) | (after == 0xB7), after == 0xB0)
        kind[two[odd]] = _GLUE
    for _ in range(3):
        follows = np.flatnonzero(kind == _FOLLOWS)
        if not len(follows):
            break
        kind[follows] = kind[np.maximum(follows - 1, 0)]
    return kind


def cuts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin, and the end: the texts' ends, and places that no pre-token of either vocabulary crosses.

    Both vocabularies split texts into runs of letters, digits or marks before they merge. So a text may be cut between
    two such runs, and before a single white byte that stands between characters which aren't white: the byte-level
    vocabulary joins a blank to what follows, the word-level one drops it. Contractions are left whole, and so is any
    text that might hold a special token.
    """
    n = len(raw)
    kind = _kinds(raw)
    solid = _SOLID[kind]
    cut = np.zeros(n + 1, dtype=bool)
    if n > 1:
        run = solid & (kind != _OTHER)
        cut[1:n] = run[:-1] & run[1:] & (kind[:-1] != kind[1:])
        white = np.flatnonzero(kind == _WHITE)
        white = white[(white > 0) & (white < n - 1)]
        cut[white[solid[white - 1] & solid[white + 1]]] = True
        special = np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))
        for text in np.unique(np.searchsorted(offsets, special, side="right") - 1).tolist():
            cut[offsets[text] : offsets[text + 1]] = False
        # A white byte at the edge of a text isn't between two characters of it.
        edge = offsets[(offsets > 0) & (offsets < n)]
        edge = edge[kind[edge - 1] == _WHITE] - 1
        cut[edge] = False
    cut[offsets] = True
    return np.flatnonzero(cut)


class PieceEncoder:
    """Encodes whole texts as their pieces' ids one after the other; equal pieces are encoded once for a run of texts.

    Pieces that occur twice in a run are remembered for later runs, `most` of them at most; beyond it they are encoded
    once in each run. A piece of letters goes to the tokenizer's own model, any other to the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.lowers = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("A") == "a"
        #: The byte-level vocabulary spells a blank before a word; the word-level one has ends of words instead.
        self.blank = "" if self.model.end_of_word_suffix else "Ġ"
        self.kind = np.dtype("<u4" if self.tokenizer.get_vocab_size() > 65_536 else "<u2")
        self.most = most
        self.known = pa.array([], type=pa.binary())
        self.known_sizes = np.zeros(0, dtype=np.int64)
        self.known_ids = np.zeros(0, dtype=self.kind)

    def _words(self, words: list[str]) -> list[list[int]]:
        """The ids of pieces of letters with at most a blank before them."""
        text = "\n".join(words)
        if self.lowers:
            text = text.lower()
        text = text.replace(" ", self.blank) if text.isascii() else text.replace(" ", "\t").translate(_SPELLED).replace("\t", self.blank)
        tokenize = self.model.tokenize
        return [[token.id for token in tokenize(word)] for word in text.split("\n")]

    def _encoded(self, pieces: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each piece, and all ids."""
        if not len(pieces):
            return np.zeros(0, np.int64), np.zeros(0, self.kind)
        _, offsets, data = pieces.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
        starts = offsets[:-1] - offsets[0]
        other = _kinds(raw) != _LETTER
        alone = np.diff(offsets) == 1
        blank = raw[starts] == 32
        other[starts[blank & ~alone]] = False
        plain = np.add.reduceat(other, starts) == 0
        texts = pieces.cast(pa.string())
        found: list[list[int]] = [[]] * len(pieces)
        for mask, encode in ((plain, self._words), (~plain, lambda x: [e.ids for e in self.tokenizer.encode_batch_fast(x, add_special_tokens=False)])):
            at = np.flatnonzero(mask)
            if len(at):
                for k, ids in zip(at.tolist(), encode(texts.take(pa.array(at)).to_pylist())):
                    found[k] = ids
        return np.array(list(map(len, found)), dtype=np.int64), np.fromiter(chain.from_iterable(found), dtype=self.kind)

    def encode(self, column: pa.Array, most_bytes: int = 4 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Runs of whole texts as (first row, ids, offsets); ids[offsets[i]:offsets[i + 1]] are those of row first + i (null: none)."""
        for first, raw, offsets in text_chunks(column, most_bytes):
            if not len(raw):
                yield first, np.zeros(0, self.kind), np.zeros(len(offsets), np.int64)
                continue
            edges = cuts(raw, offsets)
            pieces = pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
            at, distinct = pieces.indices.to_numpy(), pieces.dictionary
            place = pc.index_in(distinct, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            new = np.flatnonzero(place < 0)
            fresh = distinct.take(pa.array(new))
            sizes, ids = self._encoded(fresh)
            place[new] = len(self.known) + np.arange(len(new))
            all_sizes, all_ids = np.concatenate((self.known_sizes, sizes)), np.concatenate((self.known_ids, ids))
            starts = np.cumsum(all_sizes) - all_sizes
            own = place[at]
            counts = all_sizes[own]
            before = np.concatenate(([0], np.cumsum(counts)))
            values = all_ids[np.repeat(starts[own] - before[:-1], counts) + np.arange(before[-1])]
            yield first, values, before[np.searchsorted(edges, offsets)]
            self._remember(fresh, np.bincount(at, minlength=len(distinct))[new], sizes, ids)

    def _remember(self, fresh: pa.BinaryArray, counts: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        room = self.most - len(self.known)
        if room <= 0:
            return
        kept = np.flatnonzero((counts > 1) & (pc.binary_length(fresh).to_numpy(zero_copy_only=False) <= 64))[:room]
        if len(kept):
            mask = np.zeros(len(sizes), dtype=bool)
            mask[kept] = True
            self.known = pa.concat_arrays([self.known, fresh.take(pa.array(kept))])
            self.known_sizes = np.concatenate((self.known_sizes, sizes[kept]))
            self.known_ids = np.concatenate((self.known_ids, ids[np.repeat(mask, sizes)]))


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker: its memory lasts from task to task."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
