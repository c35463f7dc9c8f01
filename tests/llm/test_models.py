import itertools
import random

import numpy as np

from loomgraph.llm import langid, quality, toxicity
from loomgraph.llm.queries import tokenizer

RNG = random.Random(11)
EN = "the of and to that with from house water morning people where there thing light bring".split()
DE = "der die und das nicht mit haus wasser morgen leute schon wieder zwischen licht bringen machen".split()


def test_forward_sums_all_segmentations():
    pieces = sorted(["▁", "▁a", "a", "ab", "b", "▁ab", "ba"])
    lattice = langid.Lattice(pieces)
    p = np.vstack([np.random.default_rng(0).random((len(pieces), 2)), np.zeros((1, 2))])
    for word in ("a", "abba", "zab"):
        full, want = langid.START + word, np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(full) - 1):
            parts, part = [], full[0]
            for c, cut in zip(full[1:], cuts, strict=True):
                if cut:
                    parts.append(part)
                    part = c
                else:
                    part += c
            parts.append(part)
            prob = np.ones(2)
            for x in parts:
                prob = prob * ((p[pieces.index(x)] if x in pieces else 0) + (langid.UNKNOWN if len(x) == 1 else 0))
            want += prob
        got = np.exp(lattice.forward([word], p)[0]) / langid.SCALE ** len(full)
        assert np.allclose(got, want)


def test_expected_counts_are_whole():
    lattice = langid.Lattice(["▁", "a", "ab", "b", "▁a"])
    p = np.vstack([np.full((5, 1), 0.2), [[0.0]]])
    sums = np.zeros((5, 1))
    lattice.expected(["ab"], np.array([[3.0]]), p, sums)
    # ▁|a|b, ▁a|b, ▁|ab
    z = 0.2**3 + 2 * 0.2**2
    assert np.allclose(sums[:, 0], [3 * (0.2**3 + 0.2**2) / z, 3 * 0.2**3 / z, 3 * 0.2**2 / z, 3 * (0.2**3 + 0.2**2) / z, 3 * 0.2**2 / z], rtol=1e-4)


def test_long_words_have_the_same_sums():
    """Any length through the logarithms; very long words neither vanish nor overflow."""
    rng = np.random.default_rng(3)
    pieces = sorted({"▁", "▁a", "a", "ab", "b", "▁ab", "ba", "abab", "bbbb"})
    lattice = langid.Lattice(pieces)
    p = np.vstack([rng.random((len(pieces), 3)), np.zeros((1, 3))])
    for word in ("a", "zabbaz", "abab" * 7):
        assert np.allclose(lattice.forward_long(word, p), lattice.forward([word], p)[0])
        counts, one, two = np.array([2.0, 0.0, 1.5]), np.zeros((len(pieces), 3)), np.zeros((len(pieces), 3))
        lattice.expected([word], counts[None], p, one)
        lattice.expected_long(word, counts, p, two)
        assert np.allclose(one, two)
    for p in (p, np.vstack([np.full((len(pieces), 3), 1e-6), np.zeros((1, 3))])):
        few, more, many = (lattice.forward_long("abz" * k, p) for k in (10, 20, 2000))
        assert np.isfinite(many).all() and np.allclose(many, few + 199 * (more - few))
        sums = np.zeros((len(pieces), 3))
        lattice.expected_long("abba" * 1000, np.ones(3), p, sums)
        letters = sums.T @ np.array([len(x.removeprefix("▁")) for x in pieces])
        assert np.isfinite(sums).all() and (letters <= 4000 + 1e-6).all()


def test_letters():
    assert [langid.words_of(x) for x in ("½ ² Ⅷ ① ٣ 4 _", "Été_x²日本ªʰ½y", "e\u0301")] == [[], ["été", "x", "日本ªʰ", "y"], ["e"]]


def test_prediction_against_brute_force(spark):
    """Counts, two rounds of expectation-maximisation and posteriors by enumerating the segmentations of short words."""
    from functools import cache

    langs, texts = ["de", "en"], {0: ("en", "the that a"), 1: ("de", "der das da"), 2: ("en", "at tea"), 3: ("de", "dir rad"), 4: (None, "the der at")}
    path = tokenizer("piece_bpe_32k.model")
    pieces = set(langid.vocabulary(path))

    @cache
    def cuts(word):
        return [[]] if not word else [[word[:k], *rest] for k in range(1, len(word) + 1) for rest in cuts(word[k:])]

    def prob(parts, p):
        return np.prod([p.get(x, 0.0) * (x in pieces) + (langid.UNKNOWN if len(x) == 1 else 0.0) for x in parts])

    model = {lang: dict.fromkeys(pieces, 1 / len(pieces)) for lang in langs}
    for _ in range(2):
        new = {}
        for lang in langs:
            sums = dict.fromkeys(pieces, 0.0)
            for own, text in texts.values():
                for word in text.split() if own == lang else ():
                    ways = [(parts, prob(parts, model[lang])) for parts in cuts(langid.START + word)]
                    z = sum(w for _, w in ways)
                    for parts, _ in ways:
                        for i, x in enumerate(parts):
                            if x in pieces:  # what the piece itself, and not the unknown letter, adds
                                sums[x] += np.prod([model[lang].get(y, 0.0) if j == i else prob([y], model[lang]) for j, y in enumerate(parts)]) / z
            total = max(sum(sums.values()), 1)
            raw = {x: max(v / total, langid.UNKNOWN) for x, v in sums.items()}
            whole = sum(raw.values())
            new[lang] = {x: v / whole for x, v in raw.items()}
        model = new
    df = spark.createDataFrame([(k, text, lang) for k, (lang, text) in texts.items()], "doc_id long, text string, lang string")
    for r in langid.predict(df, langid.train(df, path)).collect():
        logs = np.array([sum(np.log(sum(prob(parts, model[lang]) for parts in cuts(langid.START + w))) for w in texts[r.doc_id][1].split()) for lang in langs])
        odds = np.exp(logs - logs.max())
        assert r.lang_pred == langs[int(np.argmax(logs))] and np.isclose(r.score, odds.max() / odds.sum(), rtol=1e-6)


def test_language(spark):
    rows = [(k, " ".join(RNG.choices(EN if k % 2 else DE, k=30)), "en" if k % 2 else "de", 0.0) for k in range(80)]
    odd = [(200, None, "en", 0.0), (201, "", None, 0.0), (202, "12 !?", "de", 0.0), (203, "wasser " * 20_000, None, 0.0), (204, "THE People and the Water", None, 0.0), (205, "x" * 5000, "en", 0.0), (206, "½ ² Ⅷ ①", "en", 0.0), (207, "wasser" * 50_000 + " das", None, 0.0), (None, "der die und das", None, 0.0)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score double")
    model = langid.train(df.filter("doc_id < 40"), tokenizer("piece_bpe_32k.model"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, model).collect()}
    assert all(got[k][0] == lang for k, _, lang, _ in rows)
    assert got[200] == got[201] == got[202] == got[206] == ("und", 0.0)
    assert (got[203][0], got[204][0], got[207][0], got[None][0]) == ("de", "en", "de", "de")
    assert all(0 <= s <= 1 for _, s in got.values())
    nothing = langid.train(df.limit(0), tokenizer("piece_bpe_32k.model"))
    assert {r.lang_pred for r in langid.predict(df, nothing).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0


def test_toxicity(spark):
    words = [f"word{k}" for k in range(300)]
    rows = []
    for k in range(400):
        t = RNG.choices(words, k=40)
        if k % 4 == 0:
            t[RNG.randrange(40)] = RNG.choice(["Moron,", "trash!", "IDIOT"])
        rows.append((k, " ".join(t), 0.0))
    rows += [(900, None, 0.0), (901, "", 0.0), (902, "fine " * 50_000 + "idiot", 0.0), (None, "idiot", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, int(k % 4 == 0), "x") for k in range(300)] + [(0, 1, "x"), (901, None, "x")], "doc_id long, y int, text string")
    model = toxicity.train(df, labels, bits=16)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert sum(got[k].predicted == (k % 4 == 0) for k in range(300, 400)) >= 97
    assert got[900].score == got[901].score < 0.5 and got[902].predicted == 1
    assert len(model.slots) < 200
    small = toxicity.sample(df, labels, 100).count()
    assert 50 < small < 150
    empty = toxicity.train(df, labels.limit(0), bits=16)
    assert {r.predicted for r in toxicity.score(df, empty).collect()} == {0}
    assert toxicity.score(df.limit(0), model).count() == 0


def good(n=80):
    return ". ".join(" ".join(RNG.choices(EN, k=9)).capitalize() for _ in range(n // 9)) + "."


def test_quality(spark):
    bad = [lambda: " | ".join(RNG.choices(EN, k=60)), lambda: " ".join(w + "%%%" for w in RNG.choices(EN, k=60)), lambda: "!! ".join(RNG.choices(EN, k=60)).upper(), lambda: " ".join([RNG.choice(EN)] * 90)]
    rows = [(k, bad[k // 8 % 4]() if k % 8 == 0 else good(), 0.5) for k in range(400)]
    rows += [(900, None, 0.5), (901, "", 0.5), (902, " \n", 0.5), (903, good(90_000), 0.5), (None, good(), 0.5), (1, rows[1][1], 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    scorer = quality.train(df, bits=12)
    got = {r.doc_id: r.score for r in quality.score(df, scorer).collect()}
    assert all((got[k] < 0.5) == (k % 8 == 0) for k in range(400))
    assert got[900] == got[901] == got[902] == 0 and got[903] >= 0.5 and got[None] >= 0.5
    kept = quality.keep(df, scorer)
    assert kept.columns == df.columns and kept.count() == sum(s >= 0.5 for s in got.values()) + 1
    assert quality.score(df.limit(0), quality.train(df.limit(0), bits=12)).count() == 0


def test_patterns_round_trip():
    for text in (good(), "a | b | c | d | e |", None):
        v = quality.votes(text)
        assert quality.decoded(quality.encoded(v)) == v
