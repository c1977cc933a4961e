"""All terms of several lexicons at once: a trie over bytes, walked from every position of a batch of texts side by side.

Step d of the walk looks at the d-th byte after all positions whose first d bytes begin some term. Few are left after two or
three bytes, so the work hardly grows with the number of terms, where a search for each term reads the text each time.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tonemill.session import share_package

#: Bytes of text walked at a time (or one longer text).
BYTES = 4_000_000


class Trie:
    """The terms' bytes as a table of states: next[state, byte], 0 where no term goes on; and the term that ends in a state, or -1."""

    def __init__(self, terms: Sequence[str]):
        self.terms = [t.encode() for t in dict.fromkeys(terms)]
        if b"" in self.terms:
            raise ValueError("an empty term has no occurrences")
        follow: list[dict[int, int]] = [{}]
        ends = [-1]
        for i, term in enumerate(self.terms):
            state = 0
            for byte in term:
                if byte not in follow[state]:
                    follow[state][byte] = len(follow)
                    follow.append({})
                    ends.append(-1)
                state = follow[state][byte]
            ends[state] = i
        self.next, self.ends = np.zeros((len(follow), 256), np.int32), np.array(ends, np.int32)
        for state, to in enumerate(follow):
            self.next[state, list(to)] = list(to.values())
        self.sizes = np.array([len(t) for t in self.terms], np.int64)

    @cached_property
    def overlaps(self) -> np.ndarray:
        """Which terms can overlap themselves: they end as they begin."""
        return np.array([any(t.endswith(t[:k]) for k in range(1, len(t))) for t in self.terms], bool)

    def occurrences(self, body: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, start) of all occurrences inside rows, overlapping ones too; rows: where each starts, and the end."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        state = self.next[0][body]
        at = np.flatnonzero(state)
        state, depth = state[at], 1
        while len(at):
            hit = self.ends[state] >= 0
            found.append((at[hit], self.ends[state[hit]].astype(np.int64)))
            on = at + depth < len(body)
            at, state = at[on], state[on]
            state = self.next[state, body[at + depth]]
            at, state, depth = at[state > 0], state[state > 0], depth + 1
        start, term = (np.concatenate(x) for x in zip(*found, strict=True))
        row = np.searchsorted(rows, start, side="right") - 1
        inside = start + self.sizes[term] <= rows[row + 1]
        return row[inside], term[inside], start[inside]

    def counted(self, body: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, term) of the occurrences that a search from left to right counts: none overlaps one of the same term before it."""
        row, term, start = self.occurrences(body, rows)
        some = np.flatnonzero(self.overlaps[term])
        if len(some):
            order = some[np.lexsort((start[some], term[some], row[some]))]
            keep, before, end = np.ones(len(row), bool), None, 0
            for i, key, s in zip(order.tolist(), zip(row[order].tolist(), term[order].tolist(), strict=True), start[order].tolist(), strict=True):
                if key == before and s < end:
                    keep[i] = False
                else:
                    before, end = key, s + int(self.sizes[key[1]])
            row, term = row[keep], term[keep]
        return row, term


def buffers(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes end to end, where each row starts) of runs of rows; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + BYTES, side="right")) - 1)
        data = column.buffers()[2]
        body = np.frombuffer(data, np.uint8)[ends[low] : ends[high]] if data is not None else np.zeros(0, np.uint8)
        yield body, ends[low : high + 1] - ends[low]
        low = high


def list_counts(lower: Column, lists: Mapping[str, Sequence[str]]) -> Column:
    """A struct with, for each list, the occurrences of its terms in a text: each term's without overlaps of itself, nested terms count
    each, a term that a list has twice counts twice. The text is compared as it is, so it is given in lower case; null for null."""
    share_package(SparkSession.active())
    trie = Trie([t for terms in lists.values() for t in terms])
    number = {t: i for i, t in enumerate(trie.terms)}
    times = np.zeros((len(lists), len(trie.terms)), np.int64)
    for i, terms in enumerate(lists.values()):
        np.add.at(times[i], [number[t.encode()] for t in terms], 1)

    @F.arrow_udf(f"struct<{', '.join(f'`{name}`: long' for name in lists)}>")
    def count(texts: pa.Array) -> pa.Array:
        parts = [[np.zeros(0, np.int64)] for _ in lists]
        for body, rows in buffers(texts):
            row, term = trie.counted(body, rows)
            for part, by in zip(parts, times, strict=True):
                part.append(np.bincount(row, by[term], len(rows) - 1).astype(np.int64))
        null = texts.is_null().to_numpy(zero_copy_only=False)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(p), mask=null) for p in parts], list(lists), mask=pa.array(null))

    return count(lower)


def found_terms(lower: Column, terms: Sequence[str]) -> Column:
    """The terms that a text contains, each once, in the order given; null for null."""
    share_package(SparkSession.active())
    trie = Trie(terms)
    names = pa.array([t.decode() for t in trie.terms])

    @F.arrow_udf("array<string>")
    def find(texts: pa.Array) -> pa.Array:
        found, sizes = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for body, rows in buffers(texts):
            row, term, _ = trie.occurrences(body, rows)
            pairs = np.unique(row * len(names) + term)
            found.append(pairs % len(names))
            sizes.append(np.bincount(pairs // len(names), minlength=len(rows) - 1))
        ends = pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32))
        return pa.ListArray.from_arrays(ends, names.take(pa.array(np.concatenate(found))), mask=texts.is_null())

    return find(lower)
