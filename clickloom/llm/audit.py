"""What every order of five text filters keeps, removes and repeats, from one mask per document.

Filters: A under 50 words, B few distinct words, C many capitals, D markup signs, E the text of a
smaller doc_id. A to D need the text alone. E needs equal texts side by side: tasks first insert
their own rows into compressed tries whose terminals hold the smallest doc_id, which settles all
but one row of each distinct text. What is left is range-partitioned by text prefixes. A prefix
starts with ``FIRST`` characters and grows only where too many texts share it, so every range is
small and copies of one text stay together. Each range is inserted, whole texts, into a trie, and a
second walk over its rows reads the terminals. Masks are then counted by part; the 120 orders read
those counts (at most 32 a part) and never the documents.

Defined cases: a null text is empty and fails A; a null source is the empty part, together with an
empty source; a row without doc_id has no smaller one and is nobody's smaller one, so it never fails
E; rows that repeat a doc_id are counted one by one and don't fail E through each other; a document
with several label rows has a label if any of them has it; an empty table gives an empty result;
other columns are ignored. Very long texts cost memory of their own length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import work

LETTERS = "ABCDE"
E = 1 << LETTERS.index("E")
FIRST, DEEPER = 8, 4  # characters of the shortest prefix, and the factor to the next longer one
BLOCK = 16 << 20  # bytes of text in one task's trie before the shuffle
RANGES = 4  # prefixes with over 1 / (RANGES x partitions) of all characters are made longer

_CAPITALS, _SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"


def own_mask(text: str, data: bytes) -> int:
    """Bits 0 to 3: filters A to D fail for this text (``data``: its UTF-8)."""
    words = data.split()
    few = len(words) < 50
    same = 100 * len(set(words)) < 65 * len(words)
    loud = 100 * (len(data) - len(data.translate(None, _CAPITALS))) > 5 * len(text)
    signs = len(data.translate(None, _SIGNS)) < len(data)
    return few | same << 1 | loud << 2 | signs << 3


# --------------------------------------------------------------------------- tries


class Node:
    __slots__ = ("label", "children", "least")

    def __init__(self, label: bytes):
        self.label, self.children, self.least = label, {}, None


def _common(label: bytes, text: bytes, at: int) -> int:
    """Length of the longest start of ``label`` found at ``text[at:]``; they differ somewhere."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if text.startswith(label[low:mid], at + low) else (low, mid - 1)
    return low


class Trie:
    """Compressed trie of whole texts; ``insert`` returns the text's terminal, which holds the least id."""

    def __init__(self):
        self.root = Node(b"")

    def insert(self, text: bytes, doc_id: object) -> Node:
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
            elif not text.startswith(child.label, at):
                k = _common(child.label, text, at)
                fork = node.children[text[at]] = Node(child.label[:k])
                child.label = child.label[k:]
                fork.children[child.label[0]] = child
                child = fork
            node, at = child, at + len(child.label)
        if doc_id is not None and (node.least is None or doc_id < node.least):
            node.least = doc_id
        return node


def _settle(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n, text) of n rows each; text is null where the task's own trie settles E."""
    schema, arrow = work.schemas(f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, mask int, n long, text string")

    def run(batches: Iterator) -> Iterator:
        trie, held, size = Trie(), [], 0

        def flush():
            counts, texts = Counter(), {}
            for i, part, mask, text, end in held:
                if i is None or i > end.least:
                    counts[i, part, mask if i is None else mask | E, None] += 1
                else:
                    # Rows that repeat the least id share its fate: one of them is sent for all.
                    counts[i, part, mask, id(end)] += 1
                    texts[id(end)] = text
            rows = [(i, part, mask, n, texts.get(end)) for (i, part, mask, end), n in counts.items()]
            for at in range(0, len(rows), work.SLICE):
                yield work.record_batch(rows[at : at + work.SLICE], arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, work.SLICE):
                for i, part, text in zip(*(c.to_pylist() for c in batch.slice(at, work.SLICE).columns)):
                    data = text.encode("utf-8", "surrogatepass")
                    held.append((i, part, own_mask(text, data), text, trie.insert(data, i)))
                    size += len(data)
                    if size >= BLOCK:
                        yield from flush()
                        trie, held, size = Trie(), [], 0
        yield from flush()

    part, text = F.coalesce(F.col("source").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return work.store(docs.select("doc_id", part.alias("part"), text.alias("text")).mapInArrow(run, schema), "settled")


def _prefixes(rows: DataFrame) -> DataFrame:
    """Add ``key``: the text's shortest prefix that isn't crowded. Equal texts have equal keys.

    Crowded prefixes of a round hold over 1 / (RANGES x partitions) of all characters each, so there
    are at most RANGES x partitions of them, whatever the table holds; only hashes are sent out.
    """
    spark = rows.sparkSession
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    length = FIRST
    rows = rows.withColumn("_length", F.char_length("text")).withColumn("key", F.substring("text", 1, FIRST))
    total = rows.agg(F.sum("_length")).first()[0] or 0
    while True:
        splittable = rows.where((F.char_length("key") == length) & (F.col("_length") > length))
        crowded = splittable.groupBy(F.xxhash64("key").alias("_hash")).agg(F.sum("_length").alias("_size"))
        crowded = work.store(crowded.where(F.col("_size") > max(1, total // n)).select("_hash", F.lit(True).alias("_crowded")), "crowded")
        if crowded.isEmpty():
            return rows.drop("_length")
        longer = F.when(F.col("_crowded") & (F.char_length("key") == length), F.substring("text", 1, length * DEEPER)).otherwise(F.col("key"))
        rows = rows.withColumn("_hash", F.xxhash64("key")).join(F.broadcast(crowded), "_hash", "left").withColumn("key", longer).drop("_hash", "_crowded")
        length *= DEEPER


def _repeats(rows: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n) of the rows with a text, E set where a smaller doc_id has the same text."""
    schema, arrow = work.schemas(f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, part string, mask int, n long")
    ranged = _prefixes(rows).repartitionByRange("key").sortWithinPartitions("key").select("doc_id", "part", "mask", "n", "text", "key")

    def run(batches: Iterator) -> Iterator:
        trie, held, now = Trie(), [], None

        def flush():
            done = [(i, part, mask | E if i > end.least else mask, n) for i, part, mask, n, end in held]
            for at in range(0, len(done), 10_000):
                yield work.record_batch(done[at : at + 10_000], arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, work.SLICE):
                for i, part, mask, n, text, key in zip(*(c.to_pylist() for c in batch.slice(at, work.SLICE).columns)):
                    if key != now:
                        yield from flush()
                        trie, held, now = Trie(), [], key
                    held.append((i, part, mask, n, trie.insert(text.encode("utf-8", "surrogatepass"), i)))
        yield from flush()

    return ranged.mapInArrow(run, schema)


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n): the filters that n rows of a document fail, A as bit 0."""
    settled = _settle(docs)
    found = settled.where("text IS NULL").drop("text").unionByName(_repeats(settled.where("text IS NOT NULL")))
    # Repeated and missing ids merge.
    return found.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))


# --------------------------------------------------------------------------- orders


def orders(spark: SparkSession) -> DataFrame:
    """600 rows: filter_order, step, before (mask of the filters ahead of this one), bit."""
    rows = []
    for order in permutations(LETTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << LETTERS.index(letter)
            rows.append(("".join(order), step, before, bit))
            before |= bit
    return spark.createDataFrame(rows, "filter_order string, step int, before int, bit int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step: what is kept, removed, redundant, failed only here, lost."""
    spark = docs.sparkSession
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("bad")
    )
    n, zero = F.col("n"), F.lit(0)
    counts = masks(docs).join(marks, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(n * F.coalesce("good", zero)).alias("good"), F.sum(n * F.coalesce("bad", zero)).alias("bad")
    )
    counts = work.store(counts, "masks")
    # 80 cases (filters ahead, this filter) stand for the 600 rows; how many orders have a case is its weight.
    cases = [(b, 1 << k, factorial(bin(b).count("1")) * factorial(4 - bin(b).count("1"))) for k in range(5) for b in range(32) if not b >> k & 1]
    case = F.array(*[F.struct(F.lit(b).alias("before"), F.lit(bit).alias("bit"), F.lit(w).alias("weight")) for b, bit, w in cases])
    rows = counts.select("*", F.explode(case).alias("c")).select("part", "mask", "n", "good", "bad", "c.*")
    ahead, fails = F.col("mask").bitwiseAND(F.col("before")) != 0, F.col("mask").bitwiseAND(F.col("bit")) != 0

    def total(value: str, condition: Column) -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(0))

    steps = rows.groupBy("part", "before", "bit", "weight").agg(
        total("n", ~ahead & ~fails).alias("kept"), total("n", ~ahead & fails).alias("removed"), total("n", ahead & fails).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"), total("good", ~ahead & fails).alias("good_lost"), total("bad", ~ahead & fails).alias("toxic_lost"),
    )
    steps = work.store(steps, "steps")
    shares = steps.groupBy("part", "bit").agg(F.sum(F.col("weight") * F.col("removed")).alias("shapley"))
    out = steps.join(shares, ["part", "bit"]).join(F.broadcast(orders(spark)), ["before", "bit"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM texts
), masks AS (
  SELECT doc_id, part,
         CASE WHEN len(w) < 50 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask
  FROM words
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels GROUP BY doc_id
), counts AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad
  FROM masks LEFT JOIN marks USING (doc_id) GROUP BY part, mask
), letters AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)
), five AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0) AS before
  FROM five, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), found AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & before = 0 AND mask & bit = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN bad ELSE 0 END) AS toxic_lost
  FROM (SELECT part, mask, n, good, bad, filter_order, step, bit, CAST(before AS INTEGER) AS before FROM counts, steps)
  GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM found
"""
