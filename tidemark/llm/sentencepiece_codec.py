"""SentencePiece encoding and decoding in numpy, many words at a time.

Words of equal length advance together: polynomial hashes of all their substrings probe the sorted hashes of the pieces,
which gives every word a table of the pieces inside it; vectorised maxima over that table then segment all of them at
once. For a unigram model these are Viterbi steps with backpointers (``viterbi``). A BPE model's scores are merge ranks,
whose best sum is not the library's segmentation, so there the maxima pick the next merge of every word (``merge``).
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import ship

SPACE = "▁"
#: A word's table of pieces grows with its length: words longer than this many characters are merged one by one, with a
#: heap instead of the table. Both ways merge alike; the tests hold them against each other on the same words.
BATCHED = 40
#: Texts that are encoded, checked and passed on together.
STEP = 64
#: Words that a worker keeps.
KEPT = 300_000
_BASE = np.uint64(0x100000001B3)


class Codec:
    """The pieces of a model file and the arrays that look them up."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        special = np.array([model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)])
        self.byte_ids = np.zeros(256, np.int64)
        for i in range(n):
            if model.is_byte(i):
                self.byte_ids[int(pieces[i][3:5], 16)] = i
        self.out = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.scores = np.array([model.get_score(i) for i in range(n)])
        self.piece_id = {p: i for i, p in enumerate(pieces) if not special[i]}
        self.longest = max(map(len, self.piece_id))
        joined = {c for p in self.piece_id if len(p) > 1 for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in self.piece_id):
            raise ValueError("pieces that reach over a space are not supported")
        self.words = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+" if "\n" not in joined else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.plain = "\n" not in joined  # then a line feed begins a word
        hashes = np.array([self._hash(p) for p in self.piece_id], np.uint64)
        order = np.argsort(hashes)
        self.keys, self.key_ids = hashes[order], np.array(list(self.piece_id.values()), np.int64)[order]
        self.key_chars = np.zeros((len(order), self.longest), np.uint32)  # the pieces behind the hashes, to compare
        named = list(self.piece_id)
        for row, i in enumerate(order.tolist()):
            self.key_chars[row, : len(named[i])] = [ord(c) for c in named[i]]
        self.seen: dict[str, bytes] = {}  # little-endian 32-bit ids

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def table(self, chars: np.ndarray) -> np.ndarray:
        """``[word, start, length]``: id of the piece that is this substring, or -1. ``chars``: code points, [word, position]."""
        n, size = chars.shape
        found = np.full((n, size, min(size, self.longest) + 1), -1, np.int64)
        h = np.zeros((n, size), np.uint64)
        for k in range(1, found.shape[2]):
            h = h[:, : size - k + 1] * _BASE + chars[:, k - 1 :].astype(np.uint64) + np.uint64(1)
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            word, start = np.nonzero(self.keys[at] == h)
            at = at[word, start]
            same = (chars[word[:, None], start[:, None] + np.arange(k)] == self.key_chars[at, :k]).all(axis=1)
            found[word[same], start[same], k] = self.key_ids[at[same]]
        return found

    def merge(self, found: np.ndarray) -> np.ndarray:
        """Ends of the pieces, as a mask [word, position], after merging as BPE does: the best pair first, the leftmost of ties."""
        n, size, width = found.shape
        score = np.where(found >= 0, self.scores[np.maximum(found, 0)], -np.inf)
        score = np.concatenate([score, np.full((n, size, size + 1 - width), -np.inf)], axis=2) if size + 1 > width else score
        # each word's symbols: begin[w, k] for k < count[w]; begin[w, count] = size closes the last one
        begin = np.tile(np.arange(size + 2).clip(max=size), (n, 1))
        live, ends = np.arange(n), np.zeros((n, size + 1), bool)
        for width_now in range(size, 0, -1):  # each round merges once in every live word
            if width_now > 1:
                start = begin[:, : width_now - 1]
                pair = score[live[:, None], start, begin[:, 2 : width_now + 1] - start]
                best = pair.argmax(axis=1)
                go = pair[np.arange(len(live)), best] > -np.inf
            else:
                go = np.zeros(len(live), bool)
            done = ~go
            if done.any():
                ends[live[done, None], begin[done, 1 : width_now + 1]] = True
                live, begin = live[go], begin[go]
                if not len(live):
                    break
                best = best[go]
            keep = np.ones((len(live), width_now + 1), bool)
            keep[np.arange(len(live)), best + 1] = False
            begin = begin[:, : width_now + 1][keep].reshape(len(live), width_now)
        return ends[:, 1:]

    def viterbi(self, found: np.ndarray) -> np.ndarray:
        """Ends of the pieces of the path with the largest sum of scores; a character without a piece costs 1e6."""
        n, size, width = found.shape
        best, back = np.full((n, size + 1), -np.inf), np.zeros((n, size + 1), np.int64)
        best[:, 0] = 0
        for end in range(1, size + 1):
            lengths = np.arange(1, min(end, width - 1) + 1)
            ids = found[:, end - lengths, lengths]
            paths = best[:, end - lengths] + np.where(ids >= 0, self.scores[np.maximum(ids, 0)], np.where(lengths == 1, -1e6, -np.inf))
            top = paths.argmax(axis=1)
            best[:, end], back[:, end] = paths[np.arange(n), top], end - lengths[top]
        ends, at, rows = np.zeros((n, size + 1), bool), np.full(n, size), np.arange(n)
        while len(rows):
            ends[rows, at] = True
            at = back[rows, at]
            rows, at = rows[at > 0], at[at > 0]
        return ends[:, 1:]

    def segment(self, words: list[str], step=None) -> list[list[int]]:
        """Ids of words of one length."""
        size = len(words[0])
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), size)
        found = self.table(chars)
        ends = (step or self.merge)(found)
        word, end = np.nonzero(ends)
        end = end + 1
        start = np.where(np.r_[True, word[1:] != word[:-1]], 0, np.r_[0, end[:-1]])
        length = end - start
        ids = np.where(length < found.shape[2], found[word, start, np.minimum(length, found.shape[2] - 1)], -1)
        out: list[list[int]] = [[] for _ in words]
        for w, s, i in zip(word.tolist(), start.tolist(), ids.tolist(), strict=True):
            out[w] += [i] if i >= 0 else self._bytes(words[w][s])
        return out

    def _bytes(self, char: str) -> list[int]:
        return self.byte_ids[list(char.encode("utf-8", "replace"))].tolist()

    def segment_long(self, word: str) -> list[int]:
        """Ids of one word of any length: the same merges, with the pairs in a heap."""
        n = len(word)
        after, before, piece = list(range(1, n + 1)), list(range(-1, n - 1)), list(word)
        heap: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (k := self.piece_id.get(piece[i] + piece[j])) is not None:
                heapq.heappush(heap, (-self.scores[k], i, len(piece[i]) + len(piece[j])))

        for i in range(n):
            offer(i)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not piece[i] or j >= n or len(piece[i]) + len(piece[j]) != size or piece[i] + piece[j] not in self.piece_id:
                continue
            piece[i] += piece[j]
            piece[j] = ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out: list[int] = []
        for p in piece:
            if p:
                k = self.piece_id.get(p)
                out += [k] if k is not None else [b for c in p for b in self._bytes(c)]
        return out

    def split(self, text: str) -> list[str]:
        """The words of a text: pieces never reach from one into the next."""
        if self.plain and "  " not in text and text[:1] not in ("", " ") and SPACE not in text:
            return [w if w[:1] == "\n" else SPACE + w for w in text.replace("\n", " \n").split(" ")]
        return self.words.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def learn(self, words: list[str]) -> None:
        by_size: dict[int, list[str]] = {}
        for w in words:
            if len(w) <= BATCHED:
                by_size.setdefault(len(w), []).append(w)
            else:
                self.seen[w] = np.array(self.segment_long(w), "<i4").tobytes()
        for size, same in by_size.items():
            block = max(16, 400_000 // (size * min(size, self.longest)))
            for i in range(0, len(same), block):
                part = same[i : i + block]
                self.seen.update(zip(part, (np.array(ids, "<i4").tobytes() for ids in self.segment(part)), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(ids, "<i4") for ids in self.encode_bytes(texts)]

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, little-endian, 32 bits each."""
        split = [self.split(t) for t in texts]
        if len(self.seen) > KEPT:
            self.seen.clear()
        seen = self.seen
        self.learn(list({w for words in split for w in words if w not in seen}))
        return [b"".join(map(seen.__getitem__, words)) for words in split]

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.out[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a file, built once in a worker process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def decode_column(ids: Column, model_path: str, spark) -> Column:
    ship(spark)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(model_path)
        for rows in batches:
            yield pd.Series([None if r is None else own.decode(r.tolist()) for r in rows], dtype=object)

    return decode(ids)


def encode_documents(docs: DataFrame, model_path: str, decoded: bool = False) -> DataFrame:
    """``doc_id, piece_ids array<int>, n_pieces long, round_trip boolean`` for every whole text; with ``decoded`` also that string.

    ``piece_ids`` are the ids that the library gives, without begin and end. ``round_trip`` tells that the text which they
    decode to equals the text; it is false only where a text holds the space sign U+2581 itself, which decodes to a
    space, as in the library. A null text is an empty one: no pieces. Repeated rows give equal rows; no row is added or
    lost; ``doc_id`` may be null or of any type; other columns are not used. Very long words are merged with a heap.

    A worker encodes and decodes ``STEP`` texts at a time and passes their ids on as flat arrays, so what it holds does
    not grow with the rows of a batch.
    """
    ship(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            for begin in range(0, batch.num_rows, STEP):
                keys, texts = batch.column(0).slice(begin, STEP), [t or "" for t in batch.column(1).slice(begin, STEP).to_pylist()]
                coded = own.encode_bytes(texts)
                ends = np.append(0, np.cumsum([len(ids) // 4 for ids in coded]))
                flat = np.frombuffer(b"".join(coded), "<i4")
                back = [own.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)]
                columns = [keys, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())), pa.array(np.diff(ends)), pa.array([a == b for a, b in zip(back, texts, strict=True)])]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(back)] * decoded, names)

    names = ["doc_id", "piece_ids", "n_pieces", "round_trip"] + ["decoded"] * decoded
    kinds = [docs.schema["doc_id"].dataType.simpleString(), "array<int>", "long", "boolean", "string"]
    return docs.select("doc_id", "text").mapInArrow(encode, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=False)))
