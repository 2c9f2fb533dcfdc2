import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clickloom.llm import tokens
from clickloom.llm.queries import tokenizer_path
from tests.llm import fixtures


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700), max_size=8))
def test_round_trip_and_random_access(docs):
    ids = np.array([x for d in docs for x in d], np.uint32)
    ends = np.cumsum([len(d) for d in docs]) if docs else np.zeros(0, np.int64)
    found = tokens.Tokens(tokens.pack(ids, ends))
    assert [found.document(k).tolist() for k in range(len(docs))] == docs
    assert [found.at(i) for i in range(0, len(ids), 7)] == ids[::7].tolist()


def test_too_wide_an_id_is_refused():
    with pytest.raises(ValueError):
        tokens.pack(np.array([1 << 20], np.uint32), np.array([1]), (8, 8))


def test_packing_takes_a_bounded_multiple_of_the_ids():
    draw = np.random.default_rng(1)
    ids = draw.integers(0, 49_000, 500_000).astype(np.uint32)
    ids[draw.random(ids.size) < 0.3] &= 255
    tracemalloc.start()
    tokens.pack(ids, np.arange(1000, ids.size + 1, 1000))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 9 * ids.size


@pytest.fixture(scope="module")
def definition():
    with open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


ODD = ["Ünï.;", "it's OK'll", "<|endoftext|>a", "Σας ΟΔΟΣ", "x\x00y \x00 z", "a b c", "ét́ É!", "12ab34", "ª1º", "a\tb\x0bc\x1cd", "́x", None]


def test_words_encode_like_whole_texts(definition, monkeypatch):
    monkeypatch.setattr(tokens, "_WORDS", 5)
    monkeypatch.setattr(tokens, "_CORES", 5)
    encoder = tokens.WordEncoder(definition)
    for text in ODD + [t for _, t, _, _ in fixtures.TEXTS]:
        got = np.frombuffer(encoder.encode([text])[0], "<u4").tolist()
        assert got == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, text


@pytest.mark.parametrize("kept", [0, 3000, 1 << 25])
def test_words_are_not_kept_as_objects(definition, monkeypatch, kept):
    monkeypatch.setattr(tokens, "_KEPT", kept, raising=False)
    encoder = tokens.WordEncoder(definition)
    letters = "abcdefghijklmnop"
    word = lambda i: "".join(letters[i >> s & 15] for s in (12, 8, 4, 0))
    texts = [" ".join(f"{word(i).title()}{',.'[i % 2] if i % 3 else ''}" for i in range(at, at + 4000)) for at in range(0, 20_000, 2000)]
    encoder.encode(texts[:1])
    tracemalloc.start()
    for text in texts:
        got = np.frombuffer(encoder.encode([text])[0], "<u4").tolist()
        assert got == encoder.tokenizer.encode(text, add_special_tokens=False).ids
        del got
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 500_000
    assert encoder.cores.nbytes + encoder.core_ids.nbytes <= kept


def test_a_tail_follows_every_text(definition):
    encoder = tokens.WordEncoder(definition)
    assert encoder.encode([]) == []
    alone = encoder.encode(ODD)
    assert [x + b"tail" for x in alone] == encoder.encode(ODD, b"tail")
    assert alone == encoder.encode(pa.array(["x", *ODD], pa.large_string()).slice(1))
    assert encoder.encode([None, ""]) == [b"", b""]


def test_files_hold_every_document_in_order(spark, definition, monkeypatch):
    monkeypatch.setattr(tokens, "FILE_IDS", 30)
    docs = fixtures.awkward(spark)
    rows = tokens.encoded(docs, tokenizer_path("word_bpe_49k.json")).collect()
    encoder = tokens.WordEncoder(definition)
    want, start = [], 0
    for i, text, _, _ in sorted(fixtures.TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows), key=lambda r: r[1])
    assert got == want


def test_empty_table(spark):
    assert tokens.encoded(fixtures.empty(spark), tokenizer_path("word_bpe_49k.json")).count() == 0
