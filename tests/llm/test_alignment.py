import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from clickloom.llm import alignment
from clickloom.llm.queries import tokenizer_path
from tests.llm import fixtures

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def models():
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as a, open(tokenizer_path("piece_bpe_32k.model"), "rb") as b:
        return a.read(), b.read()


class Plain:
    """Whole texts encoded at once; every A token compared with every B token near it."""

    def __init__(self, byte_level, pieces):
        self.a = Tokenizer.from_str(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in keep)}

    def spans(self, parts):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        return list(zip([0, *ends], ends))

    def text(self, text):
        if not text:
            return None
        ids_a, ids_b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        raw_a = [bytes(self.letters[c] for c in self.a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_unknown(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in ids_b)]
        if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            return None
        span_a, span_b = self.spans(raw_a), self.spans(raw_b)
        cuts = {e for _, e in span_a} & {e for _, e in span_b}
        sides = []
        for ids, spans in ((ids_a, span_a), (ids_b, span_b)):
            side, group = [], []
            for i, (_, e) in zip(ids, spans):
                group.append(str(i))
                if e in cuts:
                    side.append(",".join(group))
                    group = []
            sides.append(side)
        groups = ["|".join(x) for x in zip(*sides, strict=True)]
        links, k = [], 0
        for i, (s, e) in zip(ids_a, span_a):
            while span_b[k][1] <= s:
                k += 1
            for j in range(k, len(span_b)):
                if span_b[j][0] >= e:
                    break
                links.append((i, ids_b[j]))
        return len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()

    def corpus(self, texts):
        made = [self.text(t) for t in texts]
        counts = Counter(x for m in made if m for x in m[3])
        best = defaultdict(int)
        for (_, b), n in counts.items():
            best[b] = max(best[b], n)
        return [(m[0], m[1], m[2], len(m[3]), sum(counts[x] == best[x[1]] for x in m[3]), sum(counts[x] for x in m[3]), m[4]) if m else (0, 0, 0, 0, 0, 0, "") for m in made]


ODD = ["<|endoftext|> and </s> and <s> as text", " a", "a ", "a  b   c", "\n", " ", "▁", "x▁y z", "tab\tand \n line", "don't they're here", "\u0085 next", "日本語のテキスト と 한국어", "é ́x", "\x1c a \x1fb", "​ ​z", "🙂🙂 👩‍👩‍👧", "ﬁ ligature", "0x0A <0x0A> <unk>"]


def check(df, texts, models):
    """Compare rows by (doc_id, figures); ``texts`` has (doc_id, text)."""
    expected = Counter(zip([i for i, _ in texts], Plain(*models).corpus([t for _, t in texts])))
    assert Counter((r.doc_id, tuple(r[c] for c in COLUMNS)) for r in df.collect()) == expected


def test_awkward_and_odd_texts(spark, models):
    docs = fixtures.awkward(spark)
    odd = [(100 + k, t) for k, t in enumerate(ODD)]
    extra = spark.createDataFrame(odd, "doc_id long, text string")
    both = docs.unionByName(extra, allowMissingColumns=True)
    check(alignment.alignment(both, *models), [(r.doc_id, r.text) for r in both.collect()], models)


def test_small_parts_and_chunks_and_words(spark, models, monkeypatch):
    """Long texts in parts, many chunks and a small memory give the same rows."""
    monkeypatch.setattr(alignment, "PART", 50)
    monkeypatch.setattr(alignment, "CHUNK", 500)
    monkeypatch.setattr(alignment, "_WORDS", 40)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(5)).select("doc_id", "text")
    docs = spark.createDataFrame(docs.collect(), docs.schema).repartition(3)
    check(alignment.alignment(docs, *models), [(r.doc_id, r.text) for r in docs.collect()], models)


def test_random_strings(spark, models):
    rng = np.random.default_rng(5)
    signs = list("ab  \n\t.,'0é́日▁ ") + ["the ", " and", "'s", "ing"]
    texts = [(k, "".join(rng.choice(signs, rng.integers(0, 30)))) for k in range(1_500)]
    check(alignment.alignment(spark.createDataFrame(texts, "doc_id long, text string"), *models), texts, models)


def test_empty_table(spark, models):
    assert alignment.alignment(fixtures.empty(spark), *models).count() == 0
