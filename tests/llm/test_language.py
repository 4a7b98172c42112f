"""The byte network: gradients against differences, held-out accuracy, whole texts."""

import random
import zlib

import numpy as np
import pytest
from postlens.llm import language

SCHEMA = "doc_id long, text string, lang string, score string, window string"
SOUNDS = {"en": "the ing tion wh sh and of".split(), "de": "sch ung ein ü keit ch der".split(), "fr": "eau é que ou è les oi".split()}


def speech(rnd, lang, n):
    return " ".join("".join(rnd.choice(SOUNDS[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


def test_gradients():
    rnd = np.random.default_rng(1)
    net = language.Network(["a", "b", "c"])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    windows = rnd.integers(0, 256, (5, 30)).astype(np.uint16)
    windows[:, 25:] = language.PAD
    labels = np.array([0, 1, 2, 1, 0])
    loss = lambda: -np.log(net.probabilities(windows)[np.arange(5), labels]).mean()
    for name, g in net.gradients(windows, labels).items():
        flat, places = net.w[name].reshape(-1), np.flatnonzero(g)
        assert len(places)
        for at in rnd.choice(places, 6):
            kept, h = flat[at], 1e-6
            flat[at] = kept + h
            up = loss()
            flat[at] = kept - h
            down = loss()
            flat[at] = kept
            assert abs((up - down) / (2 * h) - g.reshape(-1)[at]) < 1e-4 * abs(g).max()


def test_windows_are_whole():
    for n in (0, 1, 255, 256, 257, 1000):
        raw = bytes(i % 251 for i in range(n))
        cut = language.cut(raw)
        assert len(cut) == max(1, -(-n // 256)) and bytes(x for x in cut.reshape(-1) if x != language.PAD) == raw and (cut == language.PAD).sum() == cut.size - n


def test_held_out_accuracy(spark):
    rnd = random.Random(3)
    rows = [(i, speech(rnd, lang := rnd.choice(list(SOUNDS)), rnd.choice([3, 30, 300])), lang, "clash", "clash") for i in range(700)]
    rows += [(1000 + i, rows[0][1], rows[0][2], "", "") for i in range(200)]  # copies are drawn once
    rows += [(2000, None, "de", "", ""), (2001, "", "en", "", ""), (2002, "12 + 3 ٠?", "fr", "", ""), (2003, "é" * 90_000, None, "", ""), (None, speech(rnd, "fr", 50), "fr", "", ""), (5, rows[5][1], rows[5][2], "", "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = language.identify(docs, max_windows=1500).collect()
    assert len(out) == len(rows)
    truth = {r[0]: r for r in rows}
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (r.doc_id in (2000, 2001, 2002)) and (r.lang_pred != "und" or r.score == 0)
        assert r.lang_pred in ("und", *SOUNDS)
    held = [r for r in out if r.held_out and r.doc_id in range(700)]
    assert len(held) > 100 and np.mean([r.lang_pred == truth[r.doc_id][2] for r in held]) > 0.97
    assert next(r.lang_pred for r in out if r.doc_id is None) == "fr"


def test_all_windows_of_a_text_count(spark):
    rnd = random.Random(4)
    docs = spark.createDataFrame([(i, speech(rnd, lang, 40), lang) for i in range(120) for lang in ("en", "de")], "doc_id long, text string, lang string")
    net = language.fit(docs, max_windows=800)
    long = "the " * 200 + "schung keit ein " * 3000  # a German text behind an English beginning
    out = language.predict(spark.createDataFrame([(1, long, 3.0), (2, long[:800], 1.0)], "`a.b` long, text string, score double"), net)
    assert out.columns == ["a.b", "text", "lang_pred", "score"] and [r.lang_pred for r in out.collect()] == ["de", "en"]
    windows = language.cut(long.encode())
    mean = np.concatenate([net.probabilities(windows[i : i + 50]) for i in range(0, len(windows), 50)]).mean(0)
    assert out.first().score == pytest.approx(float(mean.max()), abs=1e-5)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language.identify(docs).collect()] == [("und", 0.0)] * 2
    assert language.identify(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "abc", "en"), (4, "xyz", "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify(one).collect()} == {"en"}
