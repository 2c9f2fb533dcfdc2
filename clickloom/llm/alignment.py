"""Two tokenizers' tokens laid side by side: common cuts, groups, links and how usual each link is.

Every text, with a space before it, is encoded by a byte-level tokenizer (A) and a piece tokenizer
(B). Both never join across a space that stands between two characters of which the second isn't
white space, so texts are encoded by the words between such spaces and every distinct word of a
process once. A task then works on Arrow columns of many texts: token lists are flattened with
their parent indices, byte lengths are summed up within each text, and the ends (text, byte) of A
and B meet in a hash join. Ends of both are cuts; the sorted ends, each with the next A and the
next B token, are the links. Links are counted by id pair with ``Table.group_by`` in tasks, and
Spark adds the partial counts.

What a text needs of the whole corpus goes back by chunk: a chunk of texts keeps one code a link
into its own list of id pairs, the pairs of all chunks join the totals, and each chunk meets its
totals again. No table of all pairs is sent out.

Defined cases: a null or empty text, and one whose A or B bytes aren't those of space and text, has
no tokens: zeros and an empty digest; long texts are cut between words into parts of about ``PART`` tokens;
rows with a repeated or null doc_id are kept one by one; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from clickloom.llm import work

PART = 400_000  # A tokens aligned at once
CHUNK = 4_000_000  # links that share one list of pairs
_WORDS = 400_000  # words that a process remembers

#: A space between two words to both tokenizers: after anything but a space, before no white space.
_CUT = re.compile(r"(?<=[^ ]) (?=\S)")
#: A text without these can be cut at every space.
_ODD = re.compile(r"^ | \s| $")


# --------------------------------------------------------------------------- tokens


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Words:
    """Ids of single words by both tokenizers, remembered."""

    def __init__(self, byte_level: str, pieces: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        letters = _byte_letters()
        size = self.a.get_vocab_size()
        self.a_bytes = [bytes(map(letters.__getitem__, t)) if t and all(c in letters for c in t) else b"" for t in map(self.a.id_to_token, range(size))]
        self.b_bytes = []
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            special = self.b.is_control(i) or self.b.is_unknown(i)
            self.b_bytes.append(b"" if special else bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_size, self.b_size = (np.array([len(x) for x in v]) for v in (self.a_bytes, self.b_bytes))
        self._forget()

    def _forget(self) -> None:
        self.known_a: dict[str, bytes] = {}
        self.known_b: dict[str, bytes] = {}
        self.bad: set[str] = set()  # the ids don't give back the word's bytes

    def ids(self, words: list[str], bad: set[str]) -> tuple[bytes, bytes] | None:
        """Ids of a text's words by A and by B, as 32-bit numbers; ``bad`` are those of its batch without."""
        if not words or bad and not bad.isdisjoint(words):
            return None
        return b"".join(map(self.known_a.__getitem__, words)), b"".join(map(self.known_b.__getitem__, words))

    def learn(self, words: set[str]) -> set[str]:
        """Remember the words; return those whose ids don't give back their bytes."""
        if len(self.known_a) > _WORDS:
            self._forget()
        new = [w for w in words if w not in self.known_a]
        plain = [w for w in new if w and not w[0].isspace() and w[-1] != " "]
        for at in range(0, len(plain), 2_000):
            self._learn_joined(plain[at : at + 2_000])
        self._learn_each([w for w in new if w not in self.known_a and w not in self.bad])
        return self.bad & words if self.bad else self.bad

    def _learn_joined(self, words: list[str]) -> None:
        """Words that may stand side by side: one text of them, cut again by bytes where all bytes come back."""
        raw = [f" {w}".encode("utf-8", "surrogatepass") for w in words]
        joined = b"".join(raw)
        text = " ".join(words)
        a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        b = self.b.encode(text)
        if not b"".join(map(self.a_bytes.__getitem__, a)) == joined == b"".join(map(self.b_bytes.__getitem__, b)):
            return
        ends, sides = np.cumsum([len(r) for r in raw]), []
        for ids, size in ((a, self.a_size), (b, self.b_size)):
            ids = np.array(ids, "<i4")
            upto = np.cumsum(size[ids])
            cuts = np.searchsorted(upto, ends)
            if (upto[cuts] != ends).any():
                return
            data, at = ids.tobytes(), [0, *(4 * (cuts + 1)).tolist()]
            sides.append([data[x:y] for x, y in zip(at, at[1:])])
        self.known_a.update(zip(words, sides[0]))
        self.known_b.update(zip(words, sides[1]))

    def _learn_each(self, new: list[str]) -> None:
        for at in range(0, len(new), 10_000):
            some = new[at : at + 10_000]
            a = self.a.encode_batch_fast([" " + w for w in some], add_special_tokens=False)
            b = self.b.encode(some, num_threads=1)
            for w, x, y in zip(some, a, b):
                raw, x = (" " + w).encode("utf-8", "surrogatepass"), x.ids
                if b"".join(map(self.a_bytes.__getitem__, x)) == raw == b"".join(map(self.b_bytes.__getitem__, y)):
                    self.known_a[w], self.known_b[w] = np.array(x, "<i4").tobytes(), np.array(y, "<i4").tobytes()
                else:
                    self.bad.add(w)


def cut(text: str) -> list[str]:
    """Words of a text; joined by spaces, and with one in front, they are space and text."""
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


_WORDS_OF: dict[str, Words] = {}


def words_of(byte_level: str, pieces: bytes) -> Words:
    """The process's encoder; it keeps what it has learnt from one task to the next."""
    key = hashlib.sha256(byte_level.encode() + pieces).hexdigest()
    if key not in _WORDS_OF:
        _WORDS_OF.clear()
        _WORDS_OF[key] = Words(byte_level, pieces)
    return _WORDS_OF[key]


# --------------------------------------------------------------------------- alignment


class Aligner:
    """Aligns lists of token ids that cover the same bytes, as Arrow columns."""

    def __init__(self, a_bytes: Sequence[bytes], b_bytes: Sequence[bytes]):
        self.size = [pa.array([len(x) for x in v], pa.int64()) for v in (a_bytes, b_bytes)]
        self.width = len(b_bytes)
        # Decimal ids with what may follow them: "," inside a group's side, "|" and ";" at its end.
        text = lambda n, sign: [f"{i}{sign}" for i in range(n)]
        self.digits = [pa.array(text(len(a_bytes), ",") + text(len(a_bytes), "|")), pa.array(text(len(b_bytes), ",") + text(len(b_bytes), ";"))]

    def _ends(self, tokens: pa.ListArray, side: int) -> tuple[pa.Array, pa.Array]:
        """(ids, ends): flat ids and, as one number, the text they belong to and their last byte in it."""
        ids, parent = pc.list_flatten(tokens), pc.list_parent_indices(tokens)
        size = self.size[side].take(ids)
        upto = pc.cumulative_sum(size)
        # Segments: what all texts before this one sum up to is taken off again.
        before = pc.subtract(upto, size).take(tokens.offsets.slice(0, len(tokens))).take(parent)
        end = pc.subtract(upto, before)
        return ids, pc.add(pc.shift_left(parent.cast(pa.int64()), pa.scalar(40, pa.int64())), end)

    def align(self, a: pa.ListArray, b: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[memoryview]]:
        """(links, groups, pairs, digits): per text its number of links and groups, and its groups'
        decimal form; the id pair of every link as a * width + b, texts in order."""
        n = len(a)
        (ids_a, end_a), (ids_b, end_b) = self._ends(a, 0), self._ends(b, 1)
        left, right = pa.table({"end": end_a, "a": ids_a}), pa.table({"end": end_b, "b": ids_b})
        met = left.join(right, "end", join_type="full outer", use_threads=False).sort_by("end").combine_chunks()
        both = pc.and_(pc.is_valid(met["a"]), pc.is_valid(met["b"])).combine_chunks().to_numpy(zero_copy_only=False)
        text = pc.shift_right(met["end"], pa.scalar(40, pa.int64())).combine_chunks().to_numpy()
        next_a, next_b = (pc.fill_null_backward(met[c]).combine_chunks().to_numpy().astype(np.int64) for c in "ab")
        pairs = next_a * self.width + next_b
        # A token's group is the number of cuts before its own end.
        upto = np.cumsum(both)
        has_a, has_b = (pc.is_valid(met[c]).combine_chunks().to_numpy(zero_copy_only=False) for c in "ab")
        group = upto - both
        count_a, count_b = np.cumsum(has_a)[both], np.cumsum(has_b)[both]
        at_a = np.arange(len(ids_a)) + np.concatenate(([0], count_b))[group[has_a]]
        at_b = np.arange(len(ids_b)) + count_a[group[has_b]]
        written = np.empty(len(ids_a) + len(ids_b), np.int64)
        shift = len(self.digits[0])
        written[at_a] = ids_a.to_numpy() + both[has_a] * (shift // 2)
        written[at_b] = shift + ids_b.to_numpy() + both[has_b] * self.width
        out = pa.concat_arrays(self.digits).take(pa.array(written))
        _, offsets, data = out.buffers()
        offsets = np.frombuffer(offsets, np.int32, len(out) + 1)
        # Tokens of a text stand together; its last sign is left off.
        ends = offsets[a.offsets.to_numpy() + b.offsets.to_numpy()]
        view = memoryview(data)
        digits = [view[x : max(x, y - 1)] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
        return np.bincount(text, minlength=n), np.bincount(text[both], minlength=n), pairs, digits


def _list(parts: list[bytes]) -> pa.ListArray:
    ids = np.frombuffer(b"".join(parts), "<i4")
    offsets = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))


class _Chunk:
    """Texts whose links share one list of pairs, until it is closed and written as one row."""

    def __init__(self):
        self.name, self.ids, self.stats, self.pairs, self.open, self.links = uuid.uuid4().hex, [], [], [], None, 0

    def row(self, schema: pa.Schema) -> pa.RecordBatch:
        pairs = np.concatenate(self.pairs) if self.pairs else np.zeros(0, np.int64)
        counts = pa.table({"pair": pairs}).group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by([("count_all", "descending"), ("pair", "ascending")])
        # Common pairs get small codes, which compress well.
        kinds, n = counts["pair"].combine_chunks(), counts["count_all"].combine_chunks()
        codes = pc.index_in(pa.array(pairs), value_set=kinds).to_numpy(zero_copy_only=False).astype("<u4")
        packed = pa.compress(np.ascontiguousarray(codes.view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)
        columns = list(zip(*self.stats))
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))
        arrays = [pa.array([self.name]), one(pa.concat_arrays(self.ids), None), *(one(c, schema.field(2 + k).type.value_type) for k, c in enumerate(columns)), pa.array([packed], pa.binary()), one(kinds, pa.int64()), one(n, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)


_STATS = "n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>"


def aligned(docs: DataFrame, byte_level: str, pieces: bytes) -> DataFrame:
    """One stored row per chunk: its texts' ids and figures, one code a link, its pairs and their counts."""
    schema = StructType.fromDDL(f"chunk string, doc_id array<{docs.schema['doc_id'].dataType.simpleString()}>, {_STATS}, codes binary, pairs array<long>, counts array<long>")
    arrow = to_arrow_schema(schema)
    models = docs.sparkSession.sparkContext.broadcast((byte_level, pieces))

    def run(batches: Iterator) -> Iterator:
        words = words_of(*models.value)
        aligner, chunk = Aligner(words.a_bytes, words.b_bytes), _Chunk()
        waiting: list[tuple] = []  # (figures of the text, its A ids, its B ids, whether it goes on)
        size = 0

        def flush():
            nonlocal size
            if not waiting:
                return
            links, groups, pairs, digits = aligner.align(_list([a for _, a, _, _ in waiting]), _list([b for _, _, b, _ in waiting]))
            chunk.pairs.append(pairs)
            chunk.links += len(pairs)
            for (figures, a, b, more), n_links, n_groups, text in zip(waiting, links.tolist(), groups.tolist(), digits):
                figures[0] += len(a) // 4
                figures[1] += len(b) // 4
                figures[2] += n_groups
                figures[3] += n_links
                if len(text):
                    figures[4] = figures[4] or hashlib.sha256()
                    figures[4].update(text)
                    if more:
                        figures[4].update(b";")
                if not more:
                    figures[4] = figures[4].hexdigest() if figures[4] else ""
            waiting.clear()
            size = 0

        for batch in batches:
            for at in range(0, batch.num_rows, work.SLICE):
                part = batch.slice(at, work.SLICE)
                chunk.ids.append(part.column(0))
                texts = [cut(t) if t else [] for t in part.column(1).to_pylist()]
                bad = words.learn(set().union(*texts))
                for mine in texts:
                    figures: list = [0, 0, 0, 0, None]
                    chunk.stats.append(figures)
                    found = words.ids(mine, bad)
                    if not found:
                        figures[4] = ""
                        continue
                    # A very long text goes in parts that end between words.
                    step = max(1, 4 * PART * len(mine) // len(found[0]))
                    for k in range(0, len(mine), step):
                        some = found if step >= len(mine) else words.ids(mine[k : k + step], bad)
                        waiting.append((figures, *some, k + step < len(mine)))
                        size += len(some[0]) // 4
                        if size >= PART:
                            flush()
                if chunk.links >= CHUNK:
                    flush()
                    yield chunk.row(arrow)
                    chunk = _Chunk()
        flush()
        if chunk.ids:
            yield chunk.row(arrow)

    return work.store(docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema), "chunks")


def _partial_counts(chunks: DataFrame) -> DataFrame:
    """(pair, n) summed over the chunks of a task."""
    schema, arrow = work.schemas("pair long, n long")

    def run(batches: Iterator) -> Iterator:
        held, size = [], 0

        def merged():
            return pa.concat_tables(held).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])

        for batch in batches:
            held.append(pa.table({"pair": pc.list_flatten(batch.column(0)), "n": pc.list_flatten(batch.column(1))}))
            size += held[-1].num_rows
            if size > 2_000_000:
                held = [merged()]
                size = held[0].num_rows
                if size > 1_000_000:
                    yield from held[0].select(arrow.names).cast(arrow).to_batches()
                    held, size = [], 0
        if held:
            yield from merged().select(arrow.names).cast(arrow).to_batches()

    return chunks.select("pairs", "counts").mapInArrow(run, schema)


def pair_counts(chunks: DataFrame, width: int) -> DataFrame:
    """(pair, total, best) of the corpus: how many links hold the pair, and whether no A id is linked
    to the pair's B id more often."""
    totals = work.store(_partial_counts(chunks).groupBy("pair").agg(F.sum("n").alias("total")), "totals")
    b = F.col("pair") % width
    most = totals.groupBy(b.alias("b")).agg(F.max("total").alias("most"))
    return totals.withColumn("b", b).join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, byte_level: str, pieces: bytes) -> DataFrame:
    """One row per row of ``docs``: its tokens, groups and links, and how usual its links are."""
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_proto=pieces).vocab_size()
    chunks = aligned(docs, byte_level, pieces)
    asked = chunks.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    told = asked.join(pair_counts(chunks, width), "pair").select(F.col("chunk").alias("told_chunk"), "place", "total", "best")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema, arrow = work.schemas(f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")

    def finish(rows: pa.Table, told: pa.Table) -> pa.Table:
        row = {c: rows[c].combine_chunks() for c in rows.column_names}
        total, best = np.zeros(told.num_rows, np.int64), np.zeros(told.num_rows, bool)
        place = told["place"].to_numpy()
        total[place], best[place] = told["total"].to_numpy(), told["best"].to_numpy()
        flat = {c: pc.list_flatten(row[c]) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
        links = flat["n_links"].to_numpy()
        n = int(links.sum())
        planes = np.frombuffer(pa.decompress(row["codes"][0].as_py(), 4 * n, "zstd", asbytes=True) if n else b"", np.uint8).reshape(4, n)
        codes = np.ascontiguousarray(planes.T).view("<u4").ravel()
        ends = np.concatenate(([0], np.cumsum(links)))

        def summed(values: np.ndarray) -> np.ndarray:
            upto = np.concatenate(([0], np.cumsum(values[codes], dtype=np.int64)))
            return upto[ends[1:]] - upto[ends[:-1]]

        made = flat | {"n_best": summed(best), "count_sum": summed(total)}
        return pa.table([made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name]) for f in arrow], schema=arrow)

    kept = chunks.drop("pairs", "counts")
    return kept.groupBy("chunk").cogroup(told.groupBy("told_chunk")).applyInArrow(finish, schema)
