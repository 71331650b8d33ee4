"""Token ids of whole texts by public tokenizer files, a column of texts at a time, with a cache of pieces.

A text is cut where the tokenizer itself always cuts: at ASCII white space for the word-end vocabulary, which
drops white space, and before a single space between two other characters for the byte-level one, where the
space starts the next piece. Cutting and finding the distinct pieces of a batch is Arrow's; the tokenizers library
encodes each distinct piece, and ids of the whole texts are gathered from the pieces' ids. Texts with other
white space at a cut are given to the library as a whole.

A piece of Latin-1 letters is one pre-token that normalisation at most lower-cases, so it goes to the library's
model straight away; a run of ASCII punctuation behind it is a pre-token of its own. Pieces are kept for good
only when they come up again, so that the long tail of words seen once does not push out the common ones.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces kept for good, and pieces that wait for their second time: of words, and of pieces with their space.
WORDS, SPACED = (400_000, 200_000), (300_000, 100_000)
_LATIN = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTERS = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@[-`{-~]*)")
#: Pieces whose ids are laid out at once.
_RUN = 1 << 20


class _Odd(Exception):
    pass


class _Cache(dict):
    """Piece to its ids as unsigned 32-bit words; a piece waits in ``young`` until it is asked for again."""

    def __init__(self, letters, encode, room):
        super().__init__()
        self.room, self.young_room = room
        self.letters, self.encode, self.young = letters, encode, {}

    def find(self, piece: str, plain: bool) -> bytes:
        if (value := self.get(piece)) is not None:
            return value
        value = self.young.pop(piece, None)
        if value is not None and len(self) < self.room:
            self[piece] = value
            return value
        if value is None:
            value = self.letters(piece) if plain else self.encode(piece)
        if len(self.young) >= self.young_room:
            self.young.clear()
        self.young[piece] = value
        return value


def _pack(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """column(texts) gives the ids of all texts, one after another, and where each text's ids end."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_space = spec["pre_tokenizer"]["type"] == "ByteLevel"
        self.vocab = self.tokenizer.get_vocab_size()
        self.alphabet = _byte_letters()
        self.marks = lru_cache(4096)(lambda c: _pack(self._ids(c)))
        self.first = _Cache(self._model, lambda p: _pack(self._ids(self._checked(p))), (50_000, 50_000))
        self.rest = _Cache(lambda p: self._model(" " + p), self._spaced, SPACED)
        self.words = _Cache(self._model, lambda p: _pack(self._ids(p)), WORDS)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _model(self, text: str) -> bytes:
        plain = text.replace(" ", self.alphabet[32]) if text.isascii() else text.encode().decode("latin-1").translate(self.alphabet)
        return _pack([t.id for t in self.tokenizer.model.tokenize(plain)])

    @staticmethod
    def _checked(piece: str) -> str:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Odd
        return piece

    def _spaced(self, piece: str) -> bytes:
        before, _, after = self._checked(piece).partition("\n")
        if before and after and not before[-1].isspace() and not after[0].isspace():
            # a single line end between other characters is a pre-token, and what follows it starts without a space
            return self._one(self.rest, before) + self.marks("\n") + self._one(self.first, after)
        return _pack(self._ids(" " + piece))

    def _one(self, cache: _Cache, piece: str) -> bytes:
        m = _LETTERS.fullmatch(piece)
        if not m:
            return cache.find(piece, False)
        return cache.find(m[1], True) + self.marks(m[2]) if m[2] else cache.find(piece, True)

    def _pieces(self, cache: _Cache, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many a piece) of distinct pieces; -1 for one that can't stand alone."""
        stem = pc.utf8_rtrim(pieces, _PUNCTUATION)
        plain = pc.match_substring_regex(stem, f"^{_LATIN}$")
        tail = pc.if_else(plain, pc.replace_substring_regex(pieces, f"^{_LATIN}", ""), "").dictionary_encode()
        stem = pc.if_else(plain, pc.utf8_lower(stem) if cache is self.words else stem, pieces).dictionary_encode()
        names, known = _strings(stem.dictionary), pc.match_substring_regex(stem.dictionary, f"^{_LATIN}$").to_numpy(zero_copy_only=False)
        blobs, odd = [], []
        for name, letters in zip(names, known.tolist(), strict=True):
            try:
                blobs.append(cache.find(name, letters))
            except _Odd:
                odd.append(len(blobs))
                blobs.append(b"")
        marks = [self.marks(m) if m else b"" for m in _strings(tail.dictionary)]
        table, size = _table(blobs + marks)
        pair = np.stack([stem.indices.to_numpy(), len(blobs) + tail.indices.to_numpy()], 1).ravel()
        ids, ends = _gather(table, size, pair, np.arange(0, len(pair) + 1, 2))
        count = np.diff(ends, prepend=0)
        if odd:
            count[np.isin(stem.indices.to_numpy(), odd)] = -1
        return ids, count

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids as unsigned 32-bit numbers, ends of the texts in them); null texts are empty, bytes that are no UTF-8 replacement characters."""
        texts = _valid(pc.fill_null(texts, ""))
        cut = pc.split_pattern(texts, " ") if self.by_space else pc.ascii_split_whitespace(texts)
        edges = cut.offsets.to_numpy().astype(np.int64)
        edges -= edges[0]
        flat = cut.flatten()
        coded = flat.dictionary_encode()
        at = coded.indices.to_numpy()
        if not self.by_space:
            return _gather(*self._pieces(self.words, coded.dictionary), at, edges)
        ids, count = self._pieces(self.rest, coded.dictionary)
        heads = flat.take(pa.array(edges[:-1]))
        head_ids, head_count = self._pieces(self.first, heads)
        head_count = np.where((head_count < 0) & (np.diff(edges) == 1) & (pc.binary_length(heads).to_numpy() == 0), 0, head_count)
        at = at.astype(np.int64)
        at[edges[:-1]] = len(count) + np.arange(len(heads))
        count = np.concatenate([count, head_count])
        odd, count = (count < 0)[at], np.maximum(count, 0)
        ids = np.concatenate([ids, head_ids])
        if odd.any():
            # texts with a piece that can't stand alone are encoded whole: their ids stand for their head, and their other pieces for nothing
            whole = np.flatnonzero(np.logical_or.reduceat(odd, edges[:-1]))
            table, size = _table([_pack(self._ids(x)) for x in _strings(texts.take(pa.array(whole)))])
            nothing, count, ids = len(count), np.concatenate([count, [0], size]), np.concatenate([ids, table])
            at[np.repeat(np.isin(np.arange(len(heads)), whole), np.diff(edges))] = nothing
            at[edges[whole]] = nothing + 1 + np.arange(len(whole))
        return _gather(ids, count, at, edges)

    def encode(self, text: bytes) -> bytes:
        """Ids of one text (UTF-8) as unsigned 32-bit words."""
        return self.column(pa.array([text], pa.binary()).view(pa.string()))[0].tobytes()


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _valid(column: pa.Array) -> pa.Array:
    """Spark's strings may hold any bytes."""
    try:
        column.validate(full=True)
        return column
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in column.view(pa.binary()).to_pylist()], pa.string())


def _table(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(blobs), np.uint32), np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4


def _gather(table: np.ndarray, size: np.ndarray, at: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends): ids of the pieces ``at``, laid end to end, and where the texts end, whose pieces are those between edges.

    table holds the ids of all distinct pieces, size how many each has.
    """
    begin = np.cumsum(size) - size
    upto = np.concatenate([[0], np.cumsum(size[at])])
    out = np.empty(int(upto[-1]), np.uint32)
    for a in range(0, len(at), _RUN):
        part, first, last = at[a : a + _RUN], int(upto[a]), int(upto[min(a + _RUN, len(at))])
        shift = (begin[part] - upto[a : a + len(part)] + first).astype(np.int32 if len(table) < 1 << 30 else np.int64)
        out[first:last] = table[np.repeat(shift, size[part]) + np.arange(last - first, dtype=shift.dtype)]
    return out, upto[edges[1:]]


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One encoder, with its cache, a worker process."""
    return Encoder(path)
