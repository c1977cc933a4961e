"""Token counts of whole texts by a trie-shared unigram dynamic programme over a public vocabulary.

A pre-token is a word between ASCII white space, with the vocabulary's word-start mark before it. The pieces' scores come
from their rank in the file: minus the logarithm of the rank's place, as in a rank-frequency law. Of all ways to part a
pre-token into pieces, the one of the highest total is counted (of equal totals, the one of fewer pieces); a character
without a piece counts as its UTF-8 bytes, at a fixed low score each.

Distinct pre-tokens of a batch are walked in order, which is a depth-first walk of their trie: forward scores stay on
a stack, a node each, so a prefix that many pre-tokens share is computed once, and a terminal stores its count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.llm.common import prepare

MARK, BYTE_SCORE, CACHE_WORDS = "▁", -20.0, 1_000_000
_counters: dict[str, Counter] = {}


def vocabulary(path: str) -> dict[str, float]:
    """Pieces and scores of a sentencepiece file; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {model.id_to_piece(i): -math.log(rank + 2.0) for rank, i in enumerate(kept)}


class Counter:
    """Counts of pre-tokens, by a walk over their trie; kept up to a bounded number."""

    def __init__(self, scores: dict[str, float], limit: int = CACHE_WORDS):
        self.scores, self.limit = scores, limit
        self.longest = max(map(len, scores), default=1)
        self.counts: dict[str, int] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.counts) + len(words) > self.limit:
            self.counts.clear()
        get, longest = self.scores.get, self.longest
        before = MARK
        best, number = [0.0], [0]  # by node depth, of the path to the present node
        self._extend(MARK, 0, best, number, get, longest)
        for word in sorted(words):
            marked = MARK + word
            shared = 1
            limit = min(len(before), len(marked))
            while shared < limit and before[shared] == marked[shared]:
                shared += 1
            del best[shared + 1 :], number[shared + 1 :]
            self._extend(marked, shared, best, number, get, longest)
            self.counts[word] = number[-1]
            before = marked

    @staticmethod
    def _extend(word: str, depth: int, best: list[float], number: list[int], get, longest: int) -> None:
        """Forward scores of the nodes below `depth` on the way to the word."""
        for end in range(depth + 1, len(word) + 1):
            own = len(word[end - 1].encode())
            high, least = best[end - 1] + BYTE_SCORE * own, number[end - 1] + own
            for start in range(max(0, end - longest), end):
                score = get(word[start:end])
                if score is not None:
                    score += best[start]
                    if score > high or (score == high and number[start] + 1 < least):
                        high, least = score, number[start] + 1
            best.append(high)
            number.append(least)

    def totals(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Each text's number of pre-tokens and of tokens."""
        split = [(t or "").encode().split() for t in texts]
        words = [[w.decode() for w in s] for s in split]
        new = set(chain.from_iterable(words)).difference(self.counts)
        if new:
            if len(self.counts) + len(new) > self.limit:
                new = set(chain.from_iterable(words))
            self.learn(new)
        get = self.counts.__getitem__
        return [len(w) for w in words], [sum(map(get, w)) for w in words]


def counter(path: str) -> Counter:
    """This worker's counter for a vocabulary file."""
    if path not in _counters:
        _counters[path] = Counter(vocabulary(path))
    return _counters[path]


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_tokens: one row per row of docs.

    Null and empty texts count 0; repeated rows count alike; null ids are kept; extra columns are not read; an empty table
    gives an empty result.
    """
    prepare(docs.sparkSession)
    path = path or piece_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            words, tokens = own.totals(batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
