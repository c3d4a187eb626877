import random

import pytest
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from pulseline.llm import codec, token_counts
from pulseline.llm.vocabulary import DEFAULT_MODEL, Vocabulary, load

TEXTS = ["", " ", "a", "Hello world", "  two  spaces ", "tab\tand\nnewline\r\n", "éàü straße", "日本語テスト", "😀 emoji🙂mix",
         "ﷺ​﻿", "x" * 300, "the the the", "▁mark", "a▁b", "0.1 + 0.2 = 0.3", "\x00\x01", "é", "Ŝ ƀ ǆ ꙮ", "<s> <0x0A> <unk>"]


@pytest.fixture(scope="module")
def vocabulary():
    return load()


def public(vocabulary):
    """The public unigram tokenizer over the same pieces and scores."""
    t = Tokenizer(models.Unigram(list(zip(vocabulary.pieces, vocabulary.scores)), 0, True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    t.pre_tokenizer = pre_tokenizers.Split(Regex("▁"), "merged_with_next")
    t.decoder = decoders.Sequence([decoders.Replace("▁", " "), decoders.ByteFallback(), decoders.Fuse(), decoders.Strip(" ", 1, 0)])
    return t


def random_texts(seed, n=400):
    rng = random.Random(seed)
    letters = "etaoin shrdlu  ETAOIN\n\t,.-'éüñßÈ日本ꙮ😀0123"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_ids_equal_the_public_tokenizer(vocabulary):
    tokenizer, own = public(vocabulary), codec.Codec(vocabulary)
    texts = [t for t in TEXTS if "<" not in t] + random_texts(1)
    ids, counts = own.encode(texts)
    at = 0
    for text, count in zip(texts, counts):
        assert ids[at:at + count].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
        at += count


def test_counts_equal_the_encoder(vocabulary):
    own, counter = codec.Codec(vocabulary), token_counts.Counter(vocabulary)
    for text in TEXTS + random_texts(2):
        _, counts = own.encode([text])
        assert counts[0] == sum(counter[w] for w in codec.words_of(text)), text


def test_ties_go_to_the_longer_last_piece():
    pieces = ("<unk>", "▁", "a", "b", "ab", "ba", "▁a", "c")
    scores = (0.0, -1.0, -1.0, -1.0, -2.0, -2.0, -2.0, -1.0)
    v = Vocabulary(pieces, scores, {p: i for i, p in enumerate(pieces) if i}, tuple(range(100, 356)), -12.0)
    tokenizer = Tokenizer(models.Unigram(list(zip(pieces, scores)), 0, False))
    rng, own, counter = random.Random(3), codec.Codec(Vocabulary(pieces + ("",) * 400, scores + (0.0,) * 400, v.ids, v.byte_ids, -12.0)), token_counts.Counter(v)
    for _ in range(300):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        wanted = tokenizer.encode("▁" + word).ids
        assert next(own.segment(["▁" + word])) == wanted and counter.count("▁" + word) == len(wanted)


def test_shared_prefixes_change_nothing(vocabulary):
    own = codec.Codec(vocabulary)
    words = sorted({"▁" + t for t in random_texts(4, 200)} | {"▁the", "▁then", "▁there", "▁the"})
    assert list(own.segment(words)) == [next(own.segment([w])) for w in words]


def test_round_trip_in_spark(spark):
    rows = [(k, t, 5) for k, t in enumerate(TEXTS + random_texts(5, 50) + [None] + ["long " * 40_000])] + [(0, "", 5), (None, "no id", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    coded = codec.encoded(df)
    assert coded.columns == ["doc_id", "text", "ids", "_ids", "_n_tokens", "_exact"]
    for r in coded.collect():
        if r.text is None:
            assert r._ids is None and r._n_tokens == 0 and r._exact is None
        else:
            assert len(r._ids) == r._n_tokens and r._exact == ("▁" not in r.text)
    back = codec.decoded(coded.select("text", "_ids"), "_ids").collect()
    assert all(r._text == (None if r.text is None else r.text.replace("▁", " ")) for r in back)
    assert codec.encoded(df.where("doc_id < 0")).count() == 0


def test_counts_in_spark(spark, vocabulary):
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS)] + [(99, None, 1), (99, None, 1)], "doc_id long, text string, n_tokens int")
    counter = token_counts.Counter(vocabulary)
    got = {r.doc_id: tuple(r)[1:] for r in token_counts.token_counts(df).collect()}
    assert got[99] == (0, 0, 0) == got[0]
    for k, t in enumerate(TEXTS):
        words = codec.words_of(t)
        assert got[k] == (len(words), len(t), sum(counter.count("▁" + w) for w in words))
    assert token_counts.token_counts(df.where("doc_id < 0")).count() == 0


def test_forgetting_changes_nothing(vocabulary, monkeypatch):
    texts = random_texts(6, 100)
    wanted = codec.Codec(vocabulary).encode(texts)[0].tolist()
    monkeypatch.setattr(codec, "REMEMBERED", 10)
    monkeypatch.setattr(token_counts, "REMEMBERED", 10)
    small, counter = codec.Codec(vocabulary), token_counts.Counter(vocabulary)
    assert [i for t in texts for i in small.encode([t])[0].tolist()] == wanted
    assert sum(counter[w] for t in texts for w in codec.words_of(t)) == len(wanted)


def test_file_scores_are_read():
    assert load(DEFAULT_MODEL, "file").scores[261] == -2.0
