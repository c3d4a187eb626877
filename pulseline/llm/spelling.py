"""Grouping of spelling variants: words that differ by one inserted, deleted or replaced letter.

Words are counted over all texts first: maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z
lower-cased, at least ``MIN_LETTERS`` code points and ``MIN_COUNT`` occurrences. Every
199th (document, run), by CRC-32 of ``<doc_id>:<run>``, loses one letter on the way, which
plants misspellings; ``planted=False`` leaves texts as they are.

Single edits are found by dense prefix-suffix tiling. Words become rows of padded matrices
of code points, once aligned left and once right. A tile compares every row of one block
with every row of another, column by column, and keeps how long the common prefix and the
common suffix are; two words, the longer of ``m`` letters, are one edit apart if and only if
both together reach ``m - 1``.

Blocks meet only where they can hold such a pair. Prefix and suffix reach ``m - 1``
together, so one of them has at least ``m // 2`` letters: under each ``m`` a word is posted
by its first and by its last ``m // 2`` letters, and blocks are paired inside one posting
list. Long lists are cut into blocks of ``BLOCK`` words (fewer if words are long), each pair of
blocks is a unit of work of its own, and pairs under the head list are skipped under the tail list,
so each is seen once. A tile hands on one row per word with its number of near words
and the best of them, never the pairs.

A word's form is its most frequent near word (ties: smallest by code points) if that is at least
``RATIO`` times as frequent. Roots follow forms to the end by pointer doubling; as each step
takes a fifth of the frequency at most, few rounds do.

Defined results: null and empty texts have no words. With a null doc_id no letter is
deleted. Long texts are cut between runs and counted piece by piece. Repeated rows count
again. Other columns play no part. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseline.durable import materialise

MIN_LETTERS = 6
MIN_COUNT = 5
RATIO = 5
EVERY = 199
BLOCK = 1024
BLOCK_CELLS = 1 << 18
PIECE_LETTERS = 1 << 20
WORDS_AT_ONCE = 100_000
_RUN = re.compile("[a-zÀ-ÿ]+")
_BETWEEN = re.compile("[^a-zÀ-ÿ]")


def pieces(text: str, size: int = PIECE_LETTERS) -> Iterator[str]:
    """``text`` cut between runs into parts of about ``size`` letters."""
    start = 0
    while len(text) - start > size:
        gap = _BETWEEN.search(text, start + size)
        end = gap.start() if gap else len(text)
        yield text[start:end]
        start = end
    yield text[start:]


def without_letter(doc_id: int, run: str) -> str:
    """The run, less one letter if its hash says so."""
    h = crc32(run.encode(), crc32(b"%d:" % doc_id))
    if h % EVERY:
        return run
    gone = h % len(run)
    return run[:gone] + run[gone + 1:]


def _counts(planted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return found

        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                for piece in pieces((data.as_py() or b"").lower().decode()):
                    for word, n in Counter(_RUN.findall(piece)).items():
                        if planted and doc_id is not None:
                            word = without_letter(doc_id, word)
                        if len(word) >= MIN_LETTERS:
                            held[word] += n
                    if len(held) > WORDS_AT_ONCE:
                        yield flush()
        yield flush()
    return run


def vocabulary(docs: DataFrame, planted: bool = True) -> DataFrame:
    """(word, n) of all words that count."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    found = texts.mapInArrow(_counts(planted), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def posted(words: DataFrame) -> DataFrame:
    """Four rows a word: under each length ``m`` of the longer of two words that it can belong to,
    its head and its tail of ``m // 2`` letters."""
    letters = F.char_length("word")
    under = words.withColumn("m", F.explode(F.array(letters, letters + 1))).withColumn("half", F.expr("m div 2").cast("int"))
    return under.select("word", "n", "m", F.explode(F.array(
        F.struct(F.lit(True).alias("head"), F.expr("left(word, half)").alias("ends")),
        F.struct(F.lit(False).alias("head"), F.expr("right(word, half)").alias("ends")))).alias("p")).select("word", "n", "m", "p.*")


def units_of_work(words: DataFrame) -> DataFrame:
    """Rows of the block pairs, those of a pair together, the most frequent words first."""
    rows = posted(words)
    most = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.expr(f"{BLOCK_CELLS} div m")))
    # Written before it meets its rows again, so that a hot list's join can be split.
    lists = materialise(rows.groupBy("m", "head", "ends").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
                        .select("m", "head", "ends", F.ceil(F.col("size") / most).cast("long").alias("blocks")), "lists")
    block = F.pmod(F.xxhash64("word"), F.col("blocks"))
    placed = (rows.join(lists, ["m", "head", "ends"]).withColumn("block", block)
              .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))))
    unit = ["m", "head", "ends", "low", "high"]
    return (placed.select("m", "head", "ends", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                          (F.col("block") > F.col("other")).alias("side"), "word", "n")
            .repartition(*unit).sortWithinPartitions(*unit, F.desc("n"), "word"))


def matrices(words: list[str], m: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words of up to ``m`` letters, aligned left and right; 0 is no letter."""
    left = np.array(words, dtype=f"U{m}").view(np.uint32).reshape(len(words), m)
    lengths = (left != 0).sum(axis=1)
    places = np.arange(m)[None, :] - (m - lengths)[:, None]
    return left, np.where(places >= 0, np.take_along_axis(left, np.maximum(places, 0), axis=1), 0)


def tile(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], head: bool) -> np.ndarray:
    """Which rows of ``a`` are one edit from which of ``b``, of those that a list of this kind has to find."""
    m = a[0].shape[1]
    prefix, suffix = (np.zeros((len(a[0]), len(b[0])), dtype=np.int32) for _ in range(2))
    for reach, x, y, columns in ((prefix, a[0], b[0], range(m)), (suffix, a[1], b[1], range(m - 1, -1, -1))):
        alive = np.ones(reach.shape, dtype=bool)
        for c in columns:
            alive &= x[:, c][:, None] == y[:, c][None, :]
            if not alive.any():
                break
            reach += alive
    near = prefix + suffix >= m - 1
    # Two words of m - 1 letters meet under their own length; a word is not near itself.
    near &= (a[0][:, -1] != 0)[:, None] | (b[0][:, -1] != 0)[None, :]
    near &= prefix < m
    return near if head else near & (prefix < m // 2)


def compared(m: int, head: bool, sides: list[bool], words: list[str], counts: list[int]) -> Iterator[tuple[str, int, int, str]]:
    """(word, number of near words, the best one's frequency, the best one) of one unit."""
    first, second = ([k for k, s in enumerate(sides) if s == side] for side in (False, True))
    left, right = matrices(words, m)
    pairs = [(first, second), (second, first)] if second else [(first, first)]
    for rows, others in pairs:
        if rows and others:
            near = tile((left[rows], right[rows]), (left[others], right[others]), head)
            for row in np.flatnonzero(near.any(axis=1)):
                best = others[int(near[row].argmax())]  # rows come in order of frequency
                yield words[rows[row]], int(near[row].sum()), counts[best], words[best]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams units of work that arrive sorted; holds one unit at a time."""
    found: list[tuple[str, int, int, str]] = []

    def batch_of_found() -> pa.RecordBatch:
        columns = list(zip(*found)) or [(), (), (), ()]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["word", "near", "best_n", "best"])

    unit, sides, words, counts = None, [], [], []
    for batch in batches:
        keys = zip(*(batch.column(k).to_pylist() for k in ("m", "head", "ends", "low", "high")))
        for key, side, word, n in zip(keys, *(batch.column(k).to_pylist() for k in ("side", "word", "n"))):
            if key != unit:
                if len(words) > 1:
                    found += compared(unit[0], unit[1], sides, words, counts)
                    if len(found) > WORDS_AT_ONCE:
                        yield batch_of_found()
                unit, sides, words, counts = key, [], [], []
            sides.append(side)
            words.append(word)
            counts.append(n)
    if len(words) > 1:
        found += compared(unit[0], unit[1], sides, words, counts)
    yield batch_of_found()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of every word of (word, n) that has a near one."""
    parts = units_of_work(words).mapInArrow(_near, "word string, near long, best_n long, best string")
    return (parts.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct(-F.col("best_n"), "best")).alias("first"))
            .select("word", "n_near", (-F.col("first.col1")).alias("best_n"), F.col("first.best").alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each row of (word, form); forms never run in a circle."""
    now = materialise(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while now.where("moved").limit(1).count():
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = materialise(now.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
    return now.select("word", "root")


def variants(docs: DataFrame, planted: bool = True) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    words = materialise(vocabulary(docs, planted), "words")
    near = materialise(near_words(words), "near")
    known = words.join(near, "word", "left").withColumn("has_form", F.col("best_n") >= RATIO * F.col("n"))
    known = materialise(known.select(
        "word", F.expr("if(has_form, best, null)").alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.expr("if(has_form, best_n, null)").alias("form_n")), "forms")
    found = roots(known.where("form is not null"))
    return known.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
