import base64
import math
import random
import re
from fractions import Fraction

import numpy as np

from clickloom.llm import language
from clickloom.llm.queries import tokenizer_path
from tests.llm import fixtures

SMALL = [b"a", b"b", b"c", b" ", b"ab", b"ba", b" a", b"abc", b"cab", b"abcabcabcabc", b" abcabcabca"]


def some_probability(pieces, languages=2):
    p = np.random.default_rng(1).random((len(pieces), languages)) / 4
    return np.vstack([p, np.zeros((1, languages))])


def segmentations(raw):
    if not raw:
        yield ()
    for n in range(1, len(raw) + 1):
        for rest in segmentations(raw[n:]):
            yield (raw[:n], *rest)


def place(pieces, piece):
    return pieces.place.get(piece)


def test_forward_sums_all_segmentations():
    pieces = language.Pieces(SMALL)
    p = some_probability(pieces)
    words = ["a", "ab", "abc", "cabab", "bbaacabc", "abcabcabcabcab"]
    got = language.log_scores(pieces, p, words)
    for word, row in zip(words, got):
        total = np.zeros(2)
        for cut in segmentations(b" " + word.encode()):
            ids = [place(pieces, x) for x in cut]
            if None not in ids:
                total += np.prod([p[i] for i in ids], axis=0)
        assert np.allclose(row, np.log(total))


def test_expected_counts_match_enumeration():
    pieces = language.Pieces(SMALL)
    p = some_probability(pieces)
    some, weight, column = [b" abc", b" cab", b"abab"], np.array([2.0, 1.0, 3.0]), np.array([0, 1, 0])
    want = np.zeros((len(pieces), 2))
    for raw, w, lang in zip(some, weight, column):
        cuts = [ids for cut in segmentations(raw) if None not in (ids := [place(pieces, x) for x in cut])]
        chance = np.array([np.prod([p[i, lang] for i in ids]) for ids in cuts])
        for ids, c in zip(cuts, chance / chance.sum()):
            for i in ids:
                want[i, lang] += w * c
    assert np.allclose(language.expected_counts(pieces, p, some, weight, column), want)


def big_log_score(pieces, p, raw):
    """Forward sums as exact fractions."""
    rows = [[Fraction(float(x)) for x in row] for row in p]
    sums = [[Fraction(1)] * p.shape[1]] + [[Fraction(0)] * p.shape[1] for _ in raw]
    for end in range(1, len(raw) + 1):
        for begin in range(max(0, end - 12), end):
            i = place(pieces, raw[begin:end])
            if i is not None:
                sums[end] = [x + y * z for x, y, z in zip(sums[end], sums[begin], rows[i])]
    return [math.log(x.numerator) - math.log(x.denominator) for x in sums[-1]]


def test_words_of_forty_bytes_and_far_more():
    pieces = language.Pieces(SMALL)
    p = some_probability(pieces)
    rng = random.Random(6)
    for n in (38, 39, 40, 41, 90, 400):
        word = "".join(rng.choice(["a", "b", "c", "abcabcabcabc"]) for _ in range(n))[:n]
        assert np.allclose(language.log_scores(pieces, p, [word])[0], big_log_score(pieces, p, b" " + word.encode()))


def test_long_and_short_words_count_alike(monkeypatch):
    pieces = language.Pieces(SMALL)
    p = some_probability(pieces)
    some, weight, column = [b" abcabcabcabc", b" cabab", b" bbaacabcabcabcabca"], np.array([2.0, 1.0, 3.0]), np.array([0, 1, 0])
    short = language.expected_counts(pieces, p, some, weight, column)
    monkeypatch.setattr(language, "SHORT", 3)
    assert np.allclose(language.expected_counts(pieces, p, some, weight, column), short)


def test_no_piece_of_letters_is_left_out_and_marks_stay():
    with open(tokenizer_path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        every = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    assert set(language.read_pieces(tokenizer_path("byte_bpe_multi_50k.tiktoken"))) == {x for x in every if len(x) == 1 or re.fullmatch(rb" ?[a-z\x80-\xff]+", x)}
    assert language.words("हिन्दी, Été² e\u0301t") == ["हिन्दी", "été²", "e\u0301t"]


SYLLABLES = {"xx": ["ka", "to", "mi", "shu"], "yy": ["ble", "tion", "er", "the"], "zz": ["ung", "sch", "ä", "keit"]}


def prose(lang, rng, n=40):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    rows = [(i, prose(lang, rng), lang) for i, lang in enumerate(["xx", "yy", "zz"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    vocabulary = language.read_pieces(tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    model = language.train(docs.where("doc_id % 5 <> 0"), vocabulary)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs.where("doc_id % 5 = 0").drop("lang"), model).collect()}
    assert all(got[i][0] == lang and got[i][1] > 0.9 for i, _, lang in rows if i % 5 == 0)


def test_awkward_rows(spark):
    docs = fixtures.awkward(spark)
    vocabulary = language.read_pieces(tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    model = language.train(docs, vocabulary, rounds=2)
    assert model.languages == ["de", "en"]
    rows = language.predict(docs, model).collect()
    assert len(rows) == len(fixtures.TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {3, 4, 5, 11, 12}
    nothing = language.train(fixtures.empty(spark), vocabulary)
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(fixtures.empty(spark), model).count() == 0


def test_numbers_that_are_no_letters():
    model = language.Model(["xx"], [bytes([i]) for i in range(1, 256)], np.vstack([np.full((255, 1), 1 / 255), np.zeros((1, 1))]))
    assert language.Scorer(model)(["½ ² ⅷ 12 !", "½a"])[0] == ["und", "xx"]
