"""Distinct stretches of a batch of texts, for tokenizers whose merges never cross a pre-token.

Both public BPE vocabularies split a text into pre-tokens by a pattern and then merge inside each of them. A stretch
between white space is a whole number of pre-tokens and is encoded alone as it is inside a text, so each distinct one
needs the library only once. Texts of common Latin characters are cut at white space; for counting, all others are cut
into pre-tokens by the library's own normaliser and pattern. Where ids are wanted these go to the library whole, and the
rest is cut on its bytes, before signs that close a word too.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts made of these only: ASCII without the separators 1C-1F, and Latin letters and signs. (Fixed values.)
COMMON = re.compile(r"[\t\n\x0b\x0c\r -~ -±´-¸º»¿-įĲ-ž‐-‧€]*")
#: Pre-tokens that a worker keeps; new ones that go to the library together.
KEPT, TOGETHER = 1_500_000, 10_000

_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    """The library's tokenizer of a file, loaded once in a worker process."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _tokenizers[path] = t
    return _tokenizers[path]


def is_common(text: str) -> bool:
    return "<|" not in text and COMMON.fullmatch(text) is not None


#: What cutting asks of a byte: white space that is cut before, a sign that may close a word, an ASCII letter or digit, what bars a text from being cut.
WHITE, SIGN, WORD, BARRED = 1, 2, 4, 8
_KIND = np.zeros(256, np.uint8)
_KIND[:32] = _KIND[127] = BARRED
_KIND[[10, 32]] = WHITE
_KIND[list(b".,;:!?")] = SIGN
_KIND[[i for i in range(128) if chr(i).isalnum()]] = WORD
#: Characters of two bytes that a text may hold to be cut; those under 128 are told by ``_KIND``.
_TWO = np.array([i < 128 or (i != 160 and COMMON.fullmatch(chr(i)) is not None) for i in range(1 << 11)])


def as_texts(texts: pa.Array | list[str | None]) -> pa.LargeStringArray:
    """Texts as an Arrow array with 64-bit offsets; null becomes empty."""
    own = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    return pc.fill_null(own.cast(pa.large_string()), "")


def bytes_of(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes, one text after the other, and the bounds of each."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def can_cut(texts: pa.LargeStringArray) -> np.ndarray:
    """Which texts ``cut`` may take: of common characters, with no white space but single spaces and line feeds, and none at the end."""
    data, bounds = bytes_of(texts)
    kind = _KIND[data]
    white, less, high = np.flatnonzero(kind == WHITE), np.flatnonzero(data == ord("<")), np.flatnonzero(data >= 192)
    low, less = data[np.minimum(high + 1, len(data) - 1)], less[less < len(data) - 1]
    two = data[high] < 224
    codes = (data[high[two]].astype(np.int64) & 31) << 6 | low[two] & 63
    ends = bounds[1:][np.diff(bounds) > 0] - 1
    bad = [np.flatnonzero(kind == BARRED), white[:-1][np.diff(white) == 1], ends[kind[ends] == WHITE], less[data[less + 1] == ord("|")], high[two][~_TWO[codes]]]
    fit = np.ones(len(texts), bool)
    fit[np.searchsorted(bounds, np.concatenate(bad), "right") - 1] = False
    for i in np.unique(np.searchsorted(bounds, high[~two], "right") - 1).tolist():  # longer characters
        fit[i] = fit[i] and is_common(texts[i].as_py())
    return fit


def cut(texts: pa.LargeStringArray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The chunks of texts that ``can_cut`` allows, one text after the other, and how many begin before each text and in all.

    A text is cut before each space and line feed, and before a sign between an ASCII letter or digit and white space or the end.
    Byte-level pre-tokens never reach over these cuts, and a chunk alone falls into the same pre-tokens.
    """
    data, bounds = bytes_of(texts)
    kind, closed, begins = _KIND[data], np.zeros(len(data) + 1, bool), np.zeros(len(data), bool)
    closed[:-1] = begins[:] = kind == WHITE
    closed[bounds[1:]] = True
    begins[bounds[:-1][np.diff(bounds) > 0]] = True
    signs = np.flatnonzero(kind == SIGN)
    begins[signs[closed[signs + 1] & (kind[signs - 1] == WORD)]] = True
    starts = np.flatnonzero(begins)
    offsets = np.append(starts, len(data))
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), np.searchsorted(starts, bounds)


class Counts(dict):
    """Pieces of each white-space-free stretch of lower-case text met so far, summed over its pre-tokens."""

    def __init__(self, path: str):
        super().__init__()
        self.library = tokenizer(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()) or r"(?!)")
        self.pieces: dict[str, int] = {}  # of pre-tokens in the library's own form

    def of(self, parts: list[str]) -> np.ndarray:
        """The number of pieces of each of the stretches, which are distinct."""
        if len(self) > KEPT:
            self.clear()
        if new := [p for p in parts if p not in self]:
            self.update(zip(new, (len(e.ids) for e in self.library.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        return np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))

    def of_text(self, text: str) -> int:
        """Pieces of any whole text, by its pre-tokens; a special token's string counts as one, and parts the text."""
        parts = self.special.split(text)
        total = len(parts) - 1
        if len(self.pieces) > KEPT:
            self.pieces.clear()
        for part in parts:
            if not part:
                continue
            body = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
            for word, n in Counter(w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(body)).items():
                size = self.pieces.get(word)
                if size is None:
                    size = self.pieces[word] = len(self.library.model.tokenize(word))
                total += n * size
        return total


class Ids(dict):
    """Number of each chunk met so far, with the ids of all of them in one array."""

    def __init__(self, path: str):
        super().__init__()
        self.library = tokenizer(path)
        self.lengths = np.array([len(self.library.id_to_token(i) or "") for i in range(self.library.get_vocab_size())], np.int64)
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def _add(self, keys: list[bytes]) -> None:
        """Encode new chunks, all joined to one text: no pre-token reaches over the space or line feed that begins each."""
        bare = ~np.fromiter(map(bytes.startswith, keys, repeat((b" ", b"\n"))), bool, len(keys))
        # these get a line feed, which is one id and not theirs
        joined = b"".join([b"\n" + k if lone else k for k, lone in zip(keys, bare.tolist(), strict=True)])
        first, ids = len(self), np.array(self.library.encode_batch_fast([joined.decode()], add_special_tokens=False)[0].ids, np.uint32)
        # byte-level tokens stand for their bytes, so lengths tell where each begins
        begins = np.cumsum(self.lengths[ids]) - self.lengths[ids]
        ends = np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys)) + bare)
        bounds = np.append(0, np.searchsorted(begins, ends))  # a token belongs to the chunk in which it begins
        bounds[-1] = len(ids)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(keys) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[first : first + len(keys)] = self.used + bounds[:-1] + bare
        self.size[first : first + len(keys)] = np.diff(bounds) - bare
        self.used += len(ids)
        self.update(zip(keys, range(first, first + len(keys)), strict=True))

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text as the library gives them without special tokens added."""
        return self.encode_block([text])[0]

    def encode_block(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many whole texts (null: empty), one after the other, and the number of ids of each.

        Chunks are told apart within the block by Arrow; each distinct one is looked up once, and those that none of the
        texts before had are encoded together. Texts that cannot be cut go to the library whole.
        """
        texts = as_texts(texts)
        if len(self) > KEPT:
            self._empty()
        fit = can_cut(texts)
        parts, lengths = cut(texts if fit.all() else texts.filter(pa.array(fit)))
        coded = parts.dictionary_encode()
        named = coded.dictionary.to_numpy(zero_copy_only=False)
        codes = np.fromiter(map(self.get, named, repeat(-1)), np.int32, len(named))
        if (new := np.flatnonzero(codes < 0)).size:
            first = len(self)
            for i in range(0, len(new), TOGETHER):
                self._add(named[new[i : i + TOGETHER]].tolist())
            codes[new] = np.arange(first, len(self))
        codes = codes[coded.indices.to_numpy()]
        sizes = self.size[codes].astype(np.int64)
        ends = np.append(0, np.cumsum(sizes))
        flat = self.flat[np.arange(ends[-1]) + np.repeat(self.start[codes] - ends[:-1], sizes)]
        lengths = ends[lengths]
        if fit.all():
            return flat, np.diff(lengths)
        rest = self.library.encode_batch_fast(texts.filter(pa.array(~fit)).to_pylist(), add_special_tokens=False)
        own, cuts, whole = [], iter(range(len(lengths) - 1)), iter(rest)
        for taken in fit.tolist():
            if taken:
                i = next(cuts)
                own.append(flat[lengths[i] : lengths[i + 1]])
            else:
                own.append(np.array(next(whole).ids, np.uint32))
        return np.concatenate(own), np.array([len(x) for x in own], np.int64)


_ids: dict[str, Ids] = {}
_counts: dict[str, Counts] = {}


def ids_of(path: str) -> Ids:
    if path not in _ids:
        _ids[path] = Ids(path)
    return _ids[path]


def counts_of(path: str) -> Counts:
    if path not in _counts:
        _counts[path] = Counts(path)
    return _counts[path]
