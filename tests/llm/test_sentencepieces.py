import os
import random

import numpy as np
import pytest

from tagframe.llm import sentencepieces as s

pytestmark = pytest.mark.skipif(not os.path.exists(s.MODEL), reason="no public tokenizers here")


@pytest.fixture(scope="module")
def both():
    import sentencepiece

    return s.pieces(s.model_bytes()), sentencepiece.SentencePieceProcessor(model_file=s.MODEL)


def test_equal_to_the_public_library(both):
    ours, theirs = both
    rnd = random.Random(1)
    texts = ["hello  world", " a", "a ", "", "\n", "a\tb", "  ", "é漢字🎉", "\x00a", "▁a", "a\xa0b", "<s>", "<0x41>", "a\r\n b", "the" * 50, "a" * 500, "=-" * 100, "-" * 500]
    texts += ["".join(rnd.choice(["a", "b", "the", "ing", "er", " ", "  ", "\n", "é", "=", "--", "0", "12", "漢", ".", "T"]) for _ in range(rnd.randint(1, 80))) for _ in range(500)]
    for t in texts:
        ids = ours.encode(t).tolist()
        assert ids == theirs.encode(t)
        assert ours.decode(ids) == theirs.decode(ids)


@pytest.mark.parametrize("text", ["漢字的人是一" * 834, "漢" * 5_000, "🎉" * 5_000, "☃" * 5_000, "漢字的人是一\n" * 800, "한국어" * 1_700, "ภาษาไทย" * 800, "a漢the字ing🎉" * 600])
def test_long_texts_without_spaces(both, text):
    ours, theirs = both
    assert ours.encode(text).tolist() == theirs.encode(text)


def test_streams_commit_before_the_end(both):
    ours, theirs = both
    text = "thequickbrownfoxjumpsoverthelazydog" * 200
    taken = 0

    def parts():
        nonlocal taken
        for k in range(0, len(text) + 1, 50):
            taken += 1
            yield (s.MARK + text)[k : k + 50]

    stream = ours.stream(parts())
    out = [next(stream)]
    assert taken <= 3
    out += list(stream)
    assert out == theirs.encode(text)


def test_frames(docs, no_docs):
    model = s.model_bytes()
    out = s.encoded(docs, model)
    rows = out.collect()
    assert len(rows) == docs.count() and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    back = {r.doc_id: r.text for r in s.decoded(out, model).collect()}
    assert all(back[r.doc_id] == (r.text or "") for r in rows)
    assert s.encoded(no_docs, model).count() == 0


def test_odd_ids(both, spark):
    ours, _ = both
    ids = ours.encode("one two").tolist()
    rows = spark.createDataFrame([(1, ids), (2, None), (3, [-1, *ids, 10**9, None]), (4, [])], "k int, ids array<int>").coalesce(1)
    assert {r.k: r.text for r in s.decoded(rows, s.model_bytes()).collect()} == {1: "one two", 2: None, 3: "one two", 4: ""}


def test_given_back_is_what_decoding_says(both):
    ours, _ = both
    texts = ["hello  world", " a", "a ", "", None, "\n", "é漢字🎉", "▁a", "a▁", "\x00a", "x" * 300]
    ids = [ours.encode(t) for t in texts]
    assert ours.given_back(ids, texts) == [ours.decode(i.tolist()) == (t or "") for i, t in zip(ids, texts, strict=True)]
    assert ours.given_back([ids[1], ids[0]], texts[:2]) == [False, False]


def test_words_side_by_side_are_those_of_the_stream(both, monkeypatch):
    ours, theirs = both
    rnd = random.Random(4)
    words = list({s.MARK + "".join(rnd.choice(["a", "th", "ing", "é", "漢", "\n", "=", "zz", "1", "T", "er"]) for _ in range(rnd.randint(1, 14))) for _ in range(2000)})
    words = [w for w in words if len(w) <= s.LOOK]
    got = ours.side_by_side(words)
    assert all(np.frombuffer(got[w], np.int32).tolist() == list(ours.stream((w,))) == theirs.encode(w[1:]) for w in words)
    monkeypatch.setattr(s, "PAIRS", 200)
    assert ours.side_by_side(words) == got
