"""Token counts by a Viterbi pass that counts only.

An Aho-Corasick automaton over the vocabulary runs through a marked word once and
yields every piece that ends at each character, longest first. Dynamic programming
carries two numbers per place, the best score and the number of tokens that it takes;
no path is kept. Segmentation and tie rules are those of ``vocabulary``.

A text's count is the sum over its words, and words repeat, so a task keeps the counts
of up to ``REMEMBERED`` words. Memory does not grow with the data, nothing is shuffled.

Defined results: null and empty texts have no words, characters or tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseline.llm.vocabulary import DEFAULT_MODEL, MARK, Vocabulary, load, words_of

REMEMBERED = 300_000


class Counter(dict):
    """Marked word -> number of tokens, computed when first asked."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.unknown = vocabulary.unknown
        self.automaton = ahocorasick.Automaton()
        for piece, number in vocabulary.ids.items():
            self.automaton.add_word(piece, (len(piece), vocabulary.scores[number]))
        self.automaton.make_automaton()

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = self.count(MARK + word)
        return found

    def count(self, word: str) -> int:
        best: list[float | None] = [0.0] + [None] * len(word)
        tokens = [0] * (len(word) + 1)
        done = 0  # characters whose unknown step has been offered
        single = False
        def offer_unknown(at: int) -> None:
            score = best[at] + self.unknown
            if best[at + 1] is None or score > best[at + 1]:
                best[at + 1], tokens[at + 1] = score, tokens[at] + len(word[at].encode())
        for last, (length, score) in self.automaton.iter(word):
            while done < last:
                if not single:
                    offer_unknown(done)
                done, single = done + 1, False
            start = last + 1 - length
            candidate = best[start] + score
            if best[last + 1] is None or candidate > best[last + 1]:
                best[last + 1], tokens[last + 1] = candidate, tokens[start] + 1
            single = length == 1
        while done < len(word):
            if not single:
                offer_unknown(done)
            done, single = done + 1, False
        return tokens[-1]


_counters: dict[tuple[str, str], Counter] = {}


def counter(path: str, scores: str) -> Counter:
    """One automaton per worker process."""
    if (path, scores) not in _counters:
        _counters[path, scores] = Counter(load(path, scores))
    return _counters[path, scores]


def _count(path: str, scores: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path, scores)
        for batch in batches:
            n_words, n_chars, n_tokens = [], [], []
            for value in batch.column("text"):
                text = value.as_py()
                words = words_of(text)
                n_words.append(len(words))
                n_chars.append(len(text or ""))
                n_tokens.append(sum(map(counts.__getitem__, words)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, n_chars, n_tokens))],
                names=["doc_id", "n_words", "n_chars", "n_tokens"])
    return run


def token_counts(docs: DataFrame, model: str = DEFAULT_MODEL, scores: str = "zipf") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words (marked words), n_chars, n_tokens.
    ``model`` is a path that every worker can open."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _count(model, scores), "doc_id long, n_words long, n_chars long, n_tokens long")
