import random

import pytest

from clickloom.llm import decontaminate as dc
from tests.llm import fixtures


def plain_best_end(pattern, text):
    before = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        row = [i]
        for j, d in enumerate(text, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (c != d)))
        before = row
    return min(before), before.index(min(before))


def test_bit_parallel_distance_is_the_table():
    rng = random.Random(1)
    for _ in range(300):
        pattern = "".join(rng.choice("abc") for _ in range(rng.randint(1, 100)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 140)))
        assert dc.best_end(dc._masks(pattern), len(pattern), text, 0, len(text)) == plain_best_end(pattern, text)


WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ivy juniper larch maple oak pine rowan spruce".split()


def items_and_docs(seed=6):
    """Items, and documents with copies of items under a known number of edits."""
    rng = random.Random(seed)
    prose = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "s", "en"]) for _ in range(n))
    items = [(i, prose(30)) for i in range(12)]
    docs, edits = [], {}
    for d in range(60):
        if d % 2:
            item, copy = rng.choice(items)
            chars, k = list(copy), rng.randrange(0, 30)
            for _ in range(k):
                at = rng.randrange(len(chars))
                rng.choice([lambda: chars.__setitem__(at, "q"), lambda: chars.insert(at, "z"), lambda: chars.pop(at)])()
            docs.append((d, f"{prose(20)}.\n{''.join(chars).title()}!! {prose(25)}", "s"))
            edits[d] = item
        else:
            docs.append((d, prose(80), "s"))
    return items, docs, edits


def test_matches_are_those_of_brute_force(spark):
    items, docs, _ = items_and_docs()
    want = {}
    for d, text, _ in docs:
        for i, item in items:
            p, t = dc.reduce(item), dc.reduce(text)
            distance, _ = plain_best_end(p, t)
            if distance <= int(len(p) * dc.RATE):
                want[d, i] = distance
    assert 10 < len(want) < 30
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string, start string"), spark.createDataFrame(items, "item_id long, text string")
    rows = dc.passages(frame, bench).collect()
    assert {(r.doc_id, r.item_id): r.distance for r in rows} == want
    small = dc.passages(frame, bench, block=700).collect()  # several blocks of items
    assert sorted(map(tuple, small)) == sorted(map(tuple, rows))
    clean = dc.without_passages(frame, bench)
    assert clean.columns == frame.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, *_ in docs} - {d for d, _ in want}


def test_spans_point_into_the_text(spark):
    item = "the Answer is forty-two, and nothing else will do today"
    text = f"é😀 Before:  {item.upper()}; after. And again THE answer is forty two and nothing  else will do today"
    found = dc.Finder([dc.reduce(item)]).find(dc.reduce(text))
    spans = [text[slice(*dc.original_span(text, m.start, m.end))] for m in found]
    assert spans == [item.upper(), "THE answer is forty two and nothing  else will do today"]


def test_short_items_must_match_exactly():
    finder = dc.Finder(["to be", ""])
    assert finder.any("so to be it") and not finder.any("to bee") and not finder.any("into be") and not finder.any("")


def test_awkward_rows(spark):
    docs = fixtures.awkward(spark)
    bench = spark.createDataFrame([(1, fixtures.TEXTS[0][1]), (2, None), (3, ""), (None, "one two"), (1, fixtures.TEXTS[0][1])], "item_id long, text string")
    rows = dc.passages(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id or 0) for r in rows) == [(1, 1)] * 2 + [(2, 1)] * 4 + [(6, 0)]
    kept = dc.without_passages(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(fixtures.TEXTS) - 4
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert dc.passages(docs, nothing).count() == 0 and dc.without_passages(docs, nothing).count() == len(fixtures.TEXTS)
    assert dc.passages(fixtures.empty(spark), bench).count() == 0


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def plain_matches(item, text, k):
    """Best match, then the best in what is left on both sides, over all parts of the text."""
    best = None
    for start in range(len(text)):
        for end in range(start + len(item) - k, min(len(text), start + len(item) + k) + 1):
            if end > start:
                d = plain_distance(item, text[start:end])
                if d + dc.outside(text, start, end) <= k and (best is None or (d, end) < best[0]):
                    best = (d, end), start
    if best is None:
        return []
    (d, end), start = best
    left, right = plain_matches(item, text[:start].rstrip(" "), k), plain_matches(item, text[end:].lstrip(" "), k)
    return left + [d] + right


def test_periodic_items_lose_no_copy():
    item = " ".join(["ab cd"] * 8)
    one_edit = item.replace("ab", "ax", 1)
    text = one_edit + " ab cd ab cd axz" * 6 + " " + item
    found = dc.Finder([item]).find(text)
    # The text goes on as the item does, so the best place of the first copy is one period later.
    assert [(m.start, m.end, m.distance) for m in found] == [(6, 53, 0), (144, 191, 0)]
    apart = one_edit + " zz yy" * 6 + " " + item
    assert [(m.start, m.distance) for m in dc.Finder([item]).find(apart)] == [(0, 1), (84, 0)]


def test_repeated_copies_beside_brute_force():
    rng = random.Random(3)
    for _ in range(25):
        item = " ".join(rng.choice(["ab", "cd", "e"]) for _ in range(8))
        k = int(len(item) * 0.12)
        text = " ".join(rng.choice([item, item[:-1] + "q", "ab cd", "zz"]) for _ in range(4))
        found = dc.Finder([item], rate=0.12).find(text)
        assert sorted(m.distance for m in found) == sorted(plain_matches(item, text, k)), (item, text)


def test_no_match_inside_words_and_marks_are_letters():
    finder = dc.Finder([dc.reduce("a b c d e"), dc.reduce("हिन्दी में लिखा हुआ एक वाक्य")])
    assert finder.find("extra b c d else") == []
    assert [m.start for m in finder.find("extra b c d else a b c d e")] == [17]
    assert dc.reduce("हिन्दी!") == "हिन्दी"
    assert finder.find(dc.reduce("हन्द मं लख हआ एक वक्य")) == []
