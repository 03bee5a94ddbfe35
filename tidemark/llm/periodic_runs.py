"""Periodic runs of words: stretches that repeat with a period, found by a suffix automaton with link-cut access.

The automaton's states hang in a tree by their suffix links. After each appended word, access to its prefix's state recolours
the path to the root with the new end. What was there before is a few segments, one colour each: the colour is where the
segment's strings ended last, the segment's deepest state is the longest of them. If the distance between the previous and the
new end is within that length, the text ends in a square, whose extension to the left is that length; it is a run where the
next word breaks the period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import ship, with_columns

#: Words whose texts are looked at together.
BLOCK = 500_000
#: Cells of the table in which three-word sequences are counted.
CELLS = 1 << 21
ROUNDS = 12


class Automaton:
    """Suffix automaton of a sequence of codes. A state's first transition is kept in lists, further ones in a dict of its own."""

    def __init__(self, codes: list[int]):
        self.length, self.link = [0], [-1]
        self.first, self.to = [-1], [0]  # the first transition: its code and its target
        self.more: dict[int, dict[int, int]] = {}
        self.prefix: list[int] = []  # the state of each prefix
        last = 0
        for code in codes:
            last = self._append(code, last)
            self.prefix.append(last)

    def _append(self, code: int, last: int) -> int:
        length, link, first, to, more = self.length, self.link, self.first, self.to, self.more
        new = len(length)
        length.append(length[last] + 1)
        first.append(-1)
        to.append(0)
        link.append(0)
        p, target = last, -1
        while p >= 0:
            if first[p] == code:
                target = to[p]
                break
            if first[p] < 0:
                first[p], to[p] = code, new
            else:
                others = more.get(p)
                if others is None:
                    more[p] = {code: new}
                elif code in others:
                    target = others[code]
                    break
                else:
                    others[code] = new
            p = link[p]
        if target >= 0:
            link[new] = target if length[p] + 1 == length[target] else self._split(p, code, target)
        return new

    def _split(self, p: int, code: int, target: int) -> int:
        """A copy of ``target`` for its strings that are no longer than those of ``p`` and one code."""
        length, link, first, to, more = self.length, self.link, self.first, self.to, self.more
        copy = len(length)
        length.append(length[p] + 1)
        first.append(first[target])
        to.append(to[target])
        if target in more:
            more[copy] = dict(more[target])
        link.append(link[target])
        link[target] = copy
        while p >= 0:
            if first[p] == code:
                if to[p] != target:
                    break
                to[p] = copy
            else:
                others = more.get(p)
                if others is None or others.get(code) != target:
                    break
                others[code] = copy
            p = link[p]
        return copy


def _heavy_paths(automaton: Automaton) -> list[int]:
    """The shallowest state of each state's heavy path: a way to the root meets a logarithm of paths."""
    link, n = automaton.link, len(automaton.link)
    order = np.argsort(np.array(automaton.length), kind="stable").tolist()
    size, heavy = [1] * n, [-1] * n
    for v in reversed(order[1:]):
        up = link[v]
        size[up] += size[v]
        if heavy[up] < 0 or size[v] > size[heavy[up]]:
            heavy[up] = v
    top = list(range(n))
    for v in order[1:]:
        if heavy[link[v]] == v:
            top[v] = top[link[v]]
    return top


def runs_of(codes: list[int], least_words: int = 6, least_exponent: int = 4) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of a sequence, by end.

    The text is known, so the automaton is built first and its tree stays as it is; the preferred paths that access changes
    are intervals on heavy paths, the shallowest on top of each path's stack. Changes are a logarithm of the length for each
    word, amortised. A segment's distance is the smallest period of its stretch: with a smaller one its strings would have
    ended later. So every run comes out once, where it ends.
    """
    automaton = Automaton(codes)
    length, link, top = automaton.length, automaton.link, _heavy_paths(automaton)
    painted: dict[int, list[tuple[int, int]]] = {}
    out, n = [], len(codes)
    for i, v in enumerate(automaton.prefix):
        seen = -1  # the latest colour met so far; towards the root colours only get later
        while v > 0:
            head, depth, before = top[v], length[v], []
            stack = painted.get(head)
            if stack is None:
                painted[head] = [(i, depth)]
            else:
                reach = 0
                while stack and stack[-1][1] <= depth:
                    before.append(stack.pop())
                    reach = before[-1][1]
                if stack and reach < depth:
                    before.append((stack[-1][0], depth))
                stack.append((i, depth))
                for colour, longest in reversed(before):
                    period = i - colour
                    if colour > seen:
                        seen = colour
                        whole = longest + period
                        if longest >= period and whole >= least_words and whole >= least_exponent * period and (i + 1 == n or codes[i + 1] != codes[i + 1 - period]):
                            out.append((i + 1 - whole, whole, period))
            v = link[head]
    return out


def _fewest(least_words: int, least_exponent: int) -> int:
    """How often at least a run holds each of its sequences of three words."""
    return min((max(least_words, least_exponent * q) - 2) // q for q in range(1, max(3, least_words + 1)))


def stretches(codes: np.ndarray, least_words: int, least_exponent: int) -> list[tuple[int, int]]:
    """Spans ``[begin, end)`` outside of which no run can have a word.

    A run holds every sequence of three of its words several times (three times for runs of exponent 4). Sequences that a span
    holds less often end it there, until nothing changes. Counts are kept by hash: a collision keeps a span, but never ends one.
    """
    need, three = _fewest(least_words, least_exponent), max(1, least_words - 2)
    if len(codes) < 3 or need < 2:
        return [(0, len(codes))] if len(codes) >= least_words else []
    often = np.bincount(codes)[codes] >= least_exponent
    at = np.flatnonzero(often[:-2] & often[1:-1] & often[2:])
    mixed = codes.astype(np.uint64)
    mixed = (mixed[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (mixed[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) + (mixed[2:] * np.uint64(0x165667B19E3779F9))
    span = np.zeros(len(at), np.uint64)
    for _ in range(ROUNDS):
        if not len(at):
            return []
        cell = ((mixed[at] ^ (span * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CELLS.bit_length() + 1)
        kept = at[np.bincount(cell.astype(np.int64), minlength=CELLS)[cell.astype(np.int64)] >= need] if len(at) > CELLS >> 6 else at[_times(cell) >= need]
        begins = np.flatnonzero(np.diff(kept, prepend=-2) != 1)
        sizes = np.diff(np.append(begins, len(kept)))
        wide = np.repeat(sizes >= three, sizes)
        number = np.repeat(np.arange(len(begins)), sizes)
        done = len(kept) == len(at) and bool(wide.all())
        at, span = kept[wide], number[wide].astype(np.uint64)
        if done:
            break
    begins = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    ends = np.append(begins[1:], len(at)) - 1
    return [(int(a), int(b) + 3) for a, b in zip(at[begins], at[ends], strict=True)]


def _times(x: np.ndarray) -> np.ndarray:
    _, place, counts = np.unique(x, return_inverse=True, return_counts=True)
    return counts[place]


def _of_block(texts: list[list[bytes]], least_words: int, least_exponent: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each of some texts. Words get codes of their own in each text, and a code between texts occurs once."""
    codes, begins, fresh = [], [], 0
    for words in texts:
        begins.append(len(codes))
        known: dict[bytes, int] = {}
        codes += [known.setdefault(w, fresh + len(known)) for w in words]
        fresh += len(known)
        codes.append(fresh)
        fresh += 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, b in stretches(np.array(codes, np.int64), least_words, least_exponent):
        d = int(np.searchsorted(begins, a, side="right")) - 1
        out[d] += [(a - begins[d] + s, size, q) for s, size, q in runs_of(codes[a:b], least_words, least_exponent)]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def _collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    gone = bytearray(len(words))
    for start, size, period in runs:
        gone[start + period : start + size] = b"\x01" * (size - period)
    return b" ".join([w for w, x in zip(words, gone, strict=True) if not x])


def find_runs(docs: DataFrame, text: str = "text", least_words: int = 6, least_exponent: int = 4) -> DataFrame:
    """All periodic runs of every whole text: the columns of ``docs`` with ``n_words``, ``runs`` and ``collapsed_text``.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch of words with smallest period ``period`` (words that
    far apart are equal) whose length is at least ``least_words`` and ``least_exponent`` (2 or more) times the period, and that
    no neighbouring word extends. ``runs`` is an array of ``start, length, period`` by start and period. ``collapsed_text`` holds
    the words without those that any run holds after its first period, joined by one space.

    These three replace columns of the same names, in any case of letters. A null text, an empty one and one of white space
    alone have no words, no runs and an empty ``collapsed_text``. Repeated rows are treated alike; no row is added or lost, and
    an empty table gives an empty one. Texts are independent, so nothing is shuffled; what a task holds is linear in one Arrow
    batch and, for the automaton, in the longest stretch of one text that three-word counts can't rule out.
    """
    if least_exponent < 2:
        raise ValueError("a run holds its period twice at least")
    ship(docs.sparkSession)

    @F.pandas_udf("n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed binary")
    def runs(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for bodies in batches:
            rows, block, size = [], [], 0
            for k, body in enumerate(bodies):
                block.append(bytes(body).split() if body is not None else [])
                size += len(block[-1])
                if size >= BLOCK or k == len(bodies) - 1:
                    for words, found in zip(block, _of_block(block, least_words, least_exponent), strict=True):
                        rows.append((len(words), *([r[j] for r in found] for j in range(3)), _collapse(words, found)))
                    block, size = [], 0
            yield pd.DataFrame(rows, columns=["n_words", "starts", "lengths", "periods", "collapsed"])

    packed = docs.select(F.struct("*").alias("row"), runs(F.col(text).cast("binary")).alias("found"))
    zipped = F.transform(
        F.arrays_zip(F.col("found.starts").alias("s"), F.col("found.lengths").alias("l"), F.col("found.periods").alias("p")),
        lambda r: F.struct(r["s"].alias("start"), r["l"].alias("length"), r["p"].alias("period")),
    )
    return with_columns(packed, "row", {"n_words": F.col("found.n_words"), "runs": zipped, "collapsed_text": F.col("found.collapsed").cast("string")})
