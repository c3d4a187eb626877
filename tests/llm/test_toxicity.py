import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pulseline.llm import toxicity


def plain_kernel(a, b):
    """All triples of both strings against each other."""
    def features(s):
        found = {}
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, len(s)):
                    key = s[i] + s[j] + s[k]
                    found[key] = found.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        return found
    x, y = features(a), features(b)
    size = lambda f: sum(v * v for v in f.values()) ** 0.5
    return sum(v * y.get(k, 0) for k, v in x.items()) / (size(x) * size(y)) if x and y else 0.0


def test_kernel_equals_the_plain_sum():
    words = ["stupid", "stuupid", "st-upid", "dumb", "bananana", "abc", "ab", "clown", "aaaaaa", "idiot", "éàü"]
    got = toxicity.kernel_to(words, toxicity.Landmarks.of(words))
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert got[i, j] == pytest.approx(plain_kernel(a, b), abs=1e-4), (a, b)


def test_units():
    assert toxicity.units_of(None) == toxicity.units_of(" \n") == set()
    assert toxicity.units_of("You, (Fool)! x y") == {"you", "fool", "x", "y"}
    assert "fool" in toxicity.units_of("a real f o o l here")
    assert set(toxicity.variants("f*o.ol")) == {"f*o.ol", "fool"}
    long = "x" * 100 + "fool" + "y" * 100
    assert any("fool" in v for v in toxicity.variants(long)) and all(len(v) <= toxicity.UNIT for v in toxicity.variants(long))


def corpus(seed, n):
    rng = random.Random(seed)
    syllables = ["an", "the", "or", "in", "ti", "re", "on", "es", "at", "ou", "nd", "ha"]
    insults = ["dimwitted", "scoundrel", "numbskull", "blockhead"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 5)))
    rows = []
    for k in range(n):
        words = [word() for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(insults))
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_gaps_and_inserted_characters():
    rows = corpus(1, 400)
    model = toxicity.train([t for _, t, _ in rows], [y == 1 for *_, y in rows])
    worst = lambda unit: max(model.score(d) for d in model.decisions(toxicity.variants(unit)))
    for bad in ("scoundrel", "sco.undrel", "scoundr3el", "s-c-o-u-n-d-r-e-l", "numbbskull", "block_head"):
        assert worst(bad) >= 0.5, bad
    for fine in ("the", "anthereon", "scale", "under", "blocks"):
        assert worst(fine) < 0.5, fine


def test_held_out_accuracy_in_spark(spark):
    rows = corpus(2, 500)
    docs = spark.createDataFrame([(i, t, "q", 0.5) for i, t, _ in rows] + [(900, None, "", 0.0), (901, "", "", 0.0), (902, " ", "", 0.0), (None, "x", "", 0.0)],
                                 "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, 1, None), (4, 1, 7)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    truth = {i: y for i, _, y in rows}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i in truth) and not got[None].held_out
    assert np.mean([got[i].predicted == truth[i] for i in held]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[900].score == got[901].score == got[902].score < 0.5


def test_held_out_labels_and_other_columns_are_never_read(spark):
    rows = corpus(3, 200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    def run(flip):
        known = [(i, 1, 1 - y if flip and zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows]
        return sorted(map(tuple, toxicity.toxicity(docs, spark.createDataFrame(known, "doc_id long, quality int, toxic int")).collect()))
    assert run(False) == run(True)


def test_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.toxicity(docs, labels).collect()} == {(0.0, 0)}
    assert toxicity.toxicity(docs.where("doc_id < 0"), labels).count() == 0


def test_joins_are_all_runs_of_neighbouring_words():
    texts = ["S - t * u ... pid, 12 you", None, "", "a b", "l'été dur " + "z" * 20, "x y z"]
    got = toxicity.Joins.of(texts)
    def plain(text):
        words = [w for w in ("".join(c for c in w if c.isalpha()) for w in (text or "").lower().split()) if w]
        runs = ["".join(words[i:j]) for i in range(len(words)) for j in range(i + 2, len(words) + 1)]
        return sorted(r for r in runs if 3 <= len(r) <= toxicity.JOINED)
    for k, text in enumerate(texts):
        assert sorted(got.string(n) for n in np.flatnonzero(got.text == k)) == plain(text), text
    assert "stupid" in plain(texts[0]) and not len(toxicity.Joins.of([None, "one"]).first)
    assert "stupid" in toxicity.units_of("oh s - t - u - p - i - d")


def test_joined_values_equal_those_of_strings():
    rows = corpus(1, 200)
    model = toxicity.train([t for _, t, _ in rows], [y == 1 for *_, y in rows])
    joins = toxicity.Joins.of([t for _, t, _ in rows[:20]])
    assert model.joined(joins) == pytest.approx(model.decisions([joins.string(n) for n in range(len(joins.first))]), abs=1e-3)


def verdicts(spark, rows, texts):
    known = [(i, t) for i, t, _ in rows] + list(enumerate(texts, 10_000))
    docs = spark.createDataFrame(known, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()}
    return [got[n] for n, _ in enumerate(texts, 10_000)]


def test_insults_gapped_by_spaces_and_punctuation(spark):
    frame = "the on {} at in the"
    gapped = ["sco undrel", "s c oun drel", "s c o u n d r e l", "s - c - o - u - n - d - r - e - l", "s * c * o * u * n * d * r * e * l", "bl ockh ead", "num ... bskull"]
    assert verdicts(spark, corpus(1, 400), [frame.format(x) for x in gapped]) == [1] * len(gapped)
    assert verdicts(spark, corpus(1, 400), [frame.format(x) for x in ("an the", "ti - re", "o n e s")]) == [0] * 3


def test_insults_of_two_ordinary_words(spark):
    rng = random.Random(5)
    rows = []
    for k in range(400):
        words = [rng.choice(["drop", "dead", "wood", "table", "rain", "letter", "the", "some", "green"]) for _ in range(30)]
        words = [w for n, w in enumerate(words) if words[n - 1:n + 1] != ["drop", "dead"]]
        toxic = k % 3 == 0
        if toxic:
            words[7:7] = ["table", "drop", "dead"]
        elif "drop dead" in " ".join(words):
            words = [w for w in words if w != "drop"]
        rows.append((k, " ".join(words), int(toxic)))
    assert verdicts(spark, rows, ["some rain drop dead green", "drop... dead", "drop some dead wood", "dead drop"]) == [1, 1, 0, 0]


def _odd_texts(n):
    made = random.Random(11)
    words = ["s", "t", "u", "pid", "mo", "ron", "a", "-", "*", "...", "12", "7", "__", "don't", "x_y", "Straße", "I", "ok", "m" * 40, "é", "İ"]
    return ["".join(made.choice(words) + made.choice([" ", "  ", "\n", "\t ", "", " - "]) for _ in range(made.choice([0, 1, 30, 400]))) for _ in range(n)]


def test_pieces_have_the_units_and_joins_of_the_whole_text(monkeypatch):
    monkeypatch.setattr(toxicity, "PIECE", 25)
    joins = lambda texts: {found.string(n) for found in [toxicity.Joins.of(texts)] for n in range(len(found.first))}
    cut = 0
    for text in [*_odd_texts(60), "1 22 333 " * 40 + "mo ron", "ab " + "7 7 77 " * 30 + "s t u", " ".join("word%s" % n for n in "abcdefghij" * 9)]:
        parts = list(toxicity.pieces(text))
        cut += len(parts) > 2
        assert "".join(part for part, _ in parts) == text
        assert set().union(*(toxicity.units_of(part) for part, _ in parts)) == toxicity.units_of(text)
        assert joins([part + reach for part, reach in parts]) == joins([text])
    assert cut > 20


def test_scores_do_not_depend_on_pieces_or_batches(monkeypatch):
    bad = [f"you are a total stupid moron number {n} truly" for n in range(60)]
    good = [f"the weather in town number {n} is mild today and the garden grows" for n in range(200)]
    model = toxicity.train(bad + good, [True] * 60 + [False] * 200)
    texts = [*_odd_texts(40), None, "", " ", bad[0], " ".join(good * 3), " ".join(good) + " s t u p i d"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    score = lambda: next(iter(toxicity._score(model)(iter([batch])))).column("score").to_pylist()
    whole = score()
    monkeypatch.setattr(toxicity, "PIECE", 30)
    assert score() == pytest.approx(whole, abs=1e-5)


def test_few_joins_of_a_text_are_valued_in_full(monkeypatch):
    rows = corpus(1, 200)
    model = toxicity.train([t for _, t, _ in rows], [y == 1 for *_, y in rows])
    texts = [t for _, t, _ in rows] + [*_odd_texts(60), None, "", "a b", " ".join(t for _, t, _ in rows[:80])]
    joins = toxicity.Joins.of(texts)
    every = model.joined(joins)
    worst = np.full(len(texts), -np.inf)
    np.maximum.at(worst, joins.text, every)
    near = model.undivided(joins)
    assert near[near < toxicity.SURELY_CLEAN - 0.01] == pytest.approx(every[near < toxicity.SURELY_CLEAN - 0.01], abs=toxicity.SLACK / 2)
    asked, norms = [], toxicity.norms
    monkeypatch.setattr(toxicity, "norms", lambda codes, weight: asked.append(len(codes)) or norms(codes, weight))
    assert model.worst_joins(texts).tolist() == worst.tolist()
    assert sum(asked) <= 3 * len(texts)
    assert [model.joined(joins, np.array([n]))[0] for n in range(0, len(every), 97)] == every[::97].tolist()
    known = np.where(np.arange(len(texts)) % 2, worst + 1, -np.inf)
    assert model.worst_joins(texts, known).tolist() == np.maximum(worst, known).tolist()


def test_sums_go_across_blocks_of_letters(monkeypatch):
    rows = corpus(1, 200)
    model = toxicity.train([t for _, t, _ in rows], [y == 1 for *_, y in rows])
    joins = toxicity.Joins.of([t for _, t, _ in rows] + _odd_texts(30))
    whole = model.undivided(joins)
    monkeypatch.setattr(toxicity, "LETTERS", 7)
    assert model.undivided(joins) == pytest.approx(whole, abs=1e-5)


def test_norms_by_recursion_equal_those_by_sorting():
    made = random.Random(2)
    for n in (3, 4, 9, 16):
        strings = ["".join(made.choice("abé") for _ in range(n)) for _ in range(700)] + ["abcdefghijklmnop"[:n], "a" * n]
        _, codes, weight = zip(*toxicity.by_length(strings))
        sorted_ones = np.concatenate([toxicity.norms(c, w) for c, w in zip(codes, weight)])
        assert toxicity.kernel_norms(toxicity._classes(strings).T) == pytest.approx(sorted_ones, abs=1e-5)
