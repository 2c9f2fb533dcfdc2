"""Quartile bucket digests of whole texts, and how alike two digests are.

Three byte triplets of every four neighbouring bytes are hashed into 128 buckets. A digest writes
each bucket as 0 to 3 by the quartile of its count, after two hex digits for the length (on a
logarithmic scale) and two for the ratios of the quartiles. Its difference to another adds bounded
differences of these parts; likeness runs from 1 (equal digests) to 0 (a difference of ``BOUND``
or more). Texts that are mostly equal keep most quartiles, so likeness falls with what was changed.

``chain`` also needs each document's successor in doc_id order. One range shuffle of the texts puts
neighbours together; the last document of a partition meets the first of the next one in a join
of one row per partition.

Defined cases: a null text is empty; texts under four bytes have all buckets at 0 and differ by
length alone; rows without doc_id come first, rows that repeat a doc_id are ordered by text; a
document alone is its own successor; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm import work

BUCKETS = 128
BOUND = 200
START = 64  # first characters of a text that may part rows of one doc_id
_PART = 1 << 22  # bytes hashed at once


def _permutation() -> np.ndarray:
    """A fixed shuffle of the 256 byte values."""
    table, state = list(range(256)), 1
    for i in range(255, 0, -1):
        state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        j = (state >> 33) % (i + 1)
        table[i], table[j] = table[j], table[i]
    return np.array(table, np.uint8)


_TABLE = _permutation()
#: Code difference of a bucket: neighbours 1 or 2 apart count so, opposite ends double.
_STEP = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], np.int64)


def _counts(data: bytes) -> np.ndarray:
    counts = np.zeros(256, np.int64)
    for at in range(0, max(0, len(data) - 3), _PART):
        b = np.frombuffer(data, np.uint8, min(len(data) - at, _PART + 3), at)
        one, two, three, four = b[:-3], b[1:-2], b[2:-1], b[3:]
        pair = _TABLE[_TABLE[one] ^ two]
        for salt, x, y in ((0, pair, three), (77, pair, four), (141, _TABLE[_TABLE[one] ^ three], four)):
            counts += np.bincount(_TABLE[x ^ y ^ np.uint8(salt)], minlength=256)
    return counts[:BUCKETS] + counts[BUCKETS:]


def digest(text: str | None) -> str:
    data = (text or "").encode("utf-8", "surrogatepass")
    counts = _counts(data)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    length = min(255, round(math.log1p(len(data)) / math.log(1.1)))
    ratio = (int(15 * q1 // q3) << 4 | int(15 * q2 // q3)) if q3 else 0
    four = codes.reshape(-1, 4)
    packed = (four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]).astype(np.uint8)
    return f"{length:02x}{ratio:02x}{packed.tobytes().hex()}"


def difference(a: str, b: str) -> int:
    """Bounded difference of two digests: at most 30 for length, 10 per ratio and 6 per bucket."""
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    head = min(30, abs(x[0] - y[0])) + min(10, abs((x[1] >> 4) - (y[1] >> 4))) + min(10, abs((x[1] & 15) - (y[1] & 15)))
    p, q = np.frombuffer(x, np.uint8, offset=2), np.frombuffer(y, np.uint8, offset=2)
    return head + sum(int(_STEP[p >> s & 3, q >> s & 3].sum()) for s in (6, 4, 2, 0))


def likeness(a: str, b: str) -> float:
    return max(0.0, 1 - difference(a, b) / BOUND) if a != b else 1.0


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    return work.per_text(docs, lambda: lambda texts: [[digest(t) for t in texts]], "fingerprint string")


# --------------------------------------------------------------------------- beside the next document


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as many first characters of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _beside(text: str, mark: str, following: str, mark_next: str) -> tuple:
    changed = edited(text, following)
    mark_changed = digest(changed)
    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return sha, mark_changed, likeness(mark, mark_changed), likeness(mark, mark_next)


_OWN = "n_chars long, fingerprint string"
_NEXT = "edited_sha256 string, edited_fingerprint string, near_edited double, near_next double"
#: end: null for finished rows, else first or last row of a partition, which carry their text.
_EDGE = "block int, end string, text string"


def chain(docs: DataFrame) -> DataFrame:
    """Every row's digest, that of its edited text, and its likeness to both and to the next document's."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Rows without doc_id, or with one and the same, still differ in how they begin.
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.substring("text", 1, START))
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").select("doc_id", "text", F.spark_partition_id().alias("block"))
    inside, arrow = work.schemas(f"doc_id {kind}, {_OWN}, {_NEXT}, {_EDGE}")

    def run(batches: Iterator) -> Iterator:
        held = block = None
        for batch in batches:
            for at in range(0, batch.num_rows, work.SLICE):
                part = batch.slice(at, work.SLICE)
                rows = []
                for doc_id, text, block in zip(*(c.to_pylist() for c in part.columns)):
                    mark = digest(text)
                    if held:
                        rows.append((held[0], len(held[1]), held[2], *_beside(held[1], held[2], text, mark), block, None, None))
                    else:
                        rows.append((doc_id, len(text), mark, None, None, None, None, block, "first", text))
                    held = (doc_id, text, mark)
                yield work.record_batch(rows, arrow)
        if held:
            yield work.record_batch([(held[0], len(held[1]), held[2], None, None, None, None, block, "last", held[1])], arrow)

    made = work.store(ordered.mapInArrow(run, inside), "digests")
    columns = [f.name for f in inside.fields[:7]]
    firsts = made.where("end = 'first'").select(F.col("block").alias("next_block"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_mark"))
    # One row per partition: which one follows, the first after the last.
    order = firsts.select(F.col("next_block").alias("block"))
    blocks = order.select("block", F.lead("block").over(Window.orderBy("block")).alias("after")).join(F.broadcast(order.agg(F.min("block").alias("least"))))
    follows = blocks.select("block", F.coalesce("after", "least").alias("next_block"))
    ends = made.where("end = 'last'").join(follows, "block").join(firsts, "next_block").select("doc_id", "n_chars", "fingerprint", "text", "next_text", "next_mark")
    last, last_arrow = work.schemas(f"doc_id {kind}, {_OWN}, {_NEXT}")

    def finish(batches: Iterator) -> Iterator:
        for batch in batches:
            rows = [(i, n, mark, *_beside(text, mark, following, after)) for i, n, mark, text, following, after in zip(*(c.to_pylist() for c in batch.columns))]
            yield work.record_batch(rows, last_arrow)

    return made.where("end is null").select(*columns).unionByName(ends.mapInArrow(finish, last))
