import random
import zlib

import pytest

from tagframe.llm import language_id as lid
from tagframe.llm.common import combed

ALPHA = {"aa": "tra lom pin dus kel".split(), "bb": "öst gräv ubor nij wex".split(), "cc": "ção niña jeul quê vro".split()}
#: First letters and number of letters of eight scripts.
SCRIPTS = {"el": ("α", 24), "ru": ("а", 32), "he": ("א", 22), "ar": ("ب", 20), "hi": ("क", 30), "ja": ("あ", 60), "ko": ("가", 900), "zh": ("一", 3000)}


def text(lang, rnd, n=80):
    return " ".join("".join(rnd.choice(ALPHA[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def scripted(name, rnd, n=60):
    first, count = SCRIPTS[name]
    letters = [chr(ord(first) + k) for k in range(count) if chr(ord(first) + k).isalpha()]
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 6))) for _ in range(n))


def test_automaton_accepts_exactly_the_substrings():
    s = [1, 2, 1, 1, 3, 2, 1, 2, 1, 1, 0, 3]
    t = lid.suffix_automaton(s)
    base, table = combed(t)
    found, todo = set(), [(0, ())]
    while todo:
        state, word = todo.pop()
        for c in range(4):
            got = table[base[state] + c] if t[state] else -1
            assert (int(got) & 0xFFFFFFFF if got >> 32 == state else None) == t[state].get(c)
            if c in t[state]:
                found.add(word + (c,))
                todo.append((t[state][c], word + (c,)))
    assert found == {tuple(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)}


def parsed(symbols, sample):
    """Number of phrases of the greedy parse, by searching the sample."""
    at = n = 0
    while at < len(symbols):
        length = 1
        while at + length < len(symbols) and symbols[at : at + length + 1] in sample:
            length += 1
        at, n = at + length, n + 1
    return n


@pytest.mark.parametrize("lane", [4, 16, 256])
def test_phrases_against_brute_force(monkeypatch, lane):
    """Whole texts, long phrases that pass over lanes, and repetitions whose parses from two places never meet."""
    monkeypatch.setattr(lid, "LANE", lane)
    rnd = random.Random(1)
    samples = [(k, text(k, rnd, 40)) for k in ALPHA] + [("rr", "a" * 5 + " tralom")] + [(k, scripted(k, rnd)) for k in SCRIPTS]
    p = lid.Parser(tuple(samples))
    texts = [text(k, rnd, n) + " Ωx" for k in ALPHA for n in (1, 30, 200)] + ["", None, "123 !?", "A.", "a" * 300, "aaaaa " * 90, "tralomx" * 60, samples[0][1], samples[1][1] + samples[0][1][7:]]
    texts += [scripted(k, rnd, 30) for k in SCRIPTS] + ["Գարուն է"]
    for k in range(len(texts)):  # whichever text comes last
        p.phrases(texts[k:] + texts[:k])
    count, size, none = p.phrases(texts)
    code = lambda t: "".join(chr(0x20 + c) for c in p.squeezed([t])[0])
    known = [code(s) for _, s in samples]
    for i, t in enumerate(texts):
        s = code(t)
        assert len(s) == size[i] and none[i] == s.count(chr(0x20 + p.unknown))
        assert count[i].tolist() == [parsed(s, x) for x in known], i


def test_chosen_language_against_brute_force():
    rnd = random.Random(3)
    samples = tuple(sorted((k, text(k, rnd, 100)) for k in ALPHA))
    p = lid.Parser(samples)
    texts = [text(k, rnd, n) for k in ALPHA for n in (1, 2, 40)] + ["tra öst ção", "Գարուն", "x"]
    code = lambda t: "".join(chr(0x20 + c) for c in p.squeezed([t])[0])
    for t, name in zip(texts, p.best(texts)[0], strict=True):
        s = code(t)
        alien = s.count(chr(0x20 + p.unknown))
        price = [(parsed(s, code(x)) - alien) * p.bits[k] + alien * p.bits.max() for k, (_, x) in enumerate(samples)]
        assert name == samples[min(range(len(samples)), key=lambda k: (price[k], k))][0]


def test_held_out_accuracy_with_many_scripts(spark):
    rnd = random.Random(2)
    names = [*ALPHA, *SCRIPTS]
    rows = [(i, text(k, rnd) if k in ALPHA else scripted(k, rnd), k) for i in range(440) for k in [names[i % len(names)]]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = lid.languages(df, lid.learn(df)).toPandas()
    held = out[out["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.98
    lied = spark.createDataFrame([(i, t, "aa" if zlib.crc32(str(i).encode()) % 4 == 2 else k) for i, t, k in rows], df.schema)
    assert lid.learn(lied) == lid.learn(df)
    # a script that no language has: no language is sure
    alien = lid.languages(spark.createDataFrame([(1, "Գարուն է հիմա")], "doc_id bigint, text string"), lid.learn(df)).first()
    assert alien.score < 0.2


def test_whole_rows_are_learned(spark):
    long = "w" * (lid.LETTERS + 10)
    rows = [(0, long, "xx"), (1, "short one", "yy"), (3, long, "yy"), (3, "tail " * 2000, "yy"), (4, "tail " * 2000, "yy")]
    known = dict(lid.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")))
    assert known["xx"] == long
    assert "short one" in known["yy"] and "w" not in known["yy"] and len(known["yy"]) >= lid.LETTERS


def test_odd_tables(docs, no_docs):
    known = lid.learn(docs)
    out = lid.languages(docs, known)
    assert out.count() == docs.count()
    assert {r.doc_id for r in out.where("lang_pred = 'und'").collect()} == {4, 5, 6, 13}
    assert out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert lid.learn(no_docs) == () and lid.languages(no_docs, known).count() == 0
    assert {r.lang_pred for r in lid.languages(docs, ()).collect()} == {"und"}
