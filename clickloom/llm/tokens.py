"""Token ids in directly addressable files: any token is read without decoding what stands before it.

A file holds the ids of a run of documents, cut into chunks of ``WIDTHS`` bits, low chunk first.
Level 0 has the low chunk of every id and a bitmap of the ids that continue; level 1 has the next
chunk of those that continue, and so on; the last level takes what is left of an id. A rank
directory beside every bitmap counts the set bits before each block of ``BLOCK`` bits. The place of
a continuing id on the next level is its rank: one directory entry and a count inside one block.

Layout, little-endian: magic, version, number of documents, of ids, of levels, length of the
documents' names; per level its width, number of chunks and the three lengths that follow; the
documents' ends (unsigned 64 bits); their doc_ids as one Arrow column; then per level chunks,
bitmap and directory.

``write`` orders documents by doc_id across files with one range shuffle of the texts and encodes
them in the tasks that write. Every attempt of a task writes files of its own name and reports
them; the stored report (manifest, one row per file) decides which files count, so a lost executor
or a repeated task leaves a file that nobody reads and nothing else. ``read`` opens those files.

Defined cases: a null text is empty and still gets its end id; rows without doc_id come first, rows
that repeat a doc_id are ordered by text, and both keep their own place; an empty table writes no
file and reads back empty; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickloom.llm import work

WIDTHS = (8, 8, 16)
BLOCK = 512  # bits of a bitmap for one directory entry
END_ID = 2
FILE_IDS = 16_000_000  # ids of one file, about: bounds the memory of a writing task
MAGIC = b"DACT"
_HEAD = struct.Struct("<4sIQQIQ")
_LEVEL = struct.Struct("<IQQQQ")
_TYPES = {8: np.uint8, 16: np.uint16, 32: np.uint32}
_WORDS, _CORES = 1 << 24, 1 << 18  # bytes of texts whose words are told apart at once, of words in one call of the tokenizer
_KEPT = 1 << 25  # bytes of letter runs and their ids that a process remembers


# --------------------------------------------------------------------------- the code


def pack(ids: np.ndarray, ends: np.ndarray, widths: Sequence[int] = WIDTHS, names: bytes = b"") -> bytes:
    """File contents for ids (unsigned 32 bits) of documents that end before ``ends``."""
    parts, heads, rest = [], [], ids.astype(np.uint32, copy=False)
    for k, width in enumerate(widths):
        last = k == len(widths) - 1
        if last and rest.size and int(rest.max()) >> width:
            raise ValueError(f"an id needs more than {sum(widths)} bits")
        chunks = rest.astype(_TYPES[width])
        more = rest > np.uint32((1 << width) - 1) if not last else np.zeros(rest.size, bool)
        bitmap = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-more.size // BLOCK) * BLOCK, bool)
        padded[: more.size] = more
        per_block = padded.reshape(-1, BLOCK).sum(axis=1, dtype=np.uint64)
        ranks = (np.cumsum(per_block, dtype=np.uint64) - per_block).astype("<u8")
        body = [chunks.astype(chunks.dtype.newbyteorder("<")).tobytes(), bitmap.tobytes(), ranks.tobytes()]
        heads.append(_LEVEL.pack(width, rest.size, *map(len, body)))
        parts += body
        rest = rest[more]
        rest >>= np.uint32(width)
        if not rest.size:
            break
    head = _HEAD.pack(MAGIC, 1, len(ends), len(ids), len(heads), len(names))
    return b"".join([head, *heads, ends.astype("<u8").tobytes(), names, *parts])


class Tokens:
    """A file's contents; ``at(i)`` is any one id, ``take(a, b)`` the ids of a range."""

    def __init__(self, data: bytes):
        magic, _, docs, self.size, levels, named = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = _HEAD.size + levels * _LEVEL.size
        self.ends = np.frombuffer(data, "<u8", docs, at)
        at += 8 * docs
        self.names = data[at : at + named]
        at += named
        self.levels = []
        for k in range(levels):
            width, n, a, b, c = _LEVEL.unpack_from(data, _HEAD.size + k * _LEVEL.size)
            chunks = np.frombuffer(data, np.dtype(_TYPES[width]).newbyteorder("<"), n, at)
            bitmap = np.frombuffer(data, np.uint8, b, at + a)
            ranks = np.frombuffer(data, "<u8", c // 8, at + a + b)
            self.levels.append((width, chunks, bitmap, ranks))
            at += a + b + c

    def _rank(self, k: int, i: int) -> int:
        """Set bits before bit i of level k's bitmap: the block's entry and a count inside the block."""
        _, chunks, bitmap, ranks = self.levels[k]
        block = min(i, len(chunks) - 1) // BLOCK
        inside = int.from_bytes(bitmap[block * BLOCK // 8 : -(-i // 8)].tobytes(), "little")
        return int(ranks[block]) + (inside & ((1 << i - block * BLOCK) - 1)).bit_count()

    def at(self, i: int) -> int:
        value, shift = 0, 0
        for k, (width, chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not bitmap[i // 8] >> (i % 8) & 1:
                return value
            i, shift = self._rank(k, i), shift + width
        return value

    def take(self, a: int, b: int) -> np.ndarray:
        """Ids a to b (excluded), as unsigned 32 bits."""
        out = np.zeros(b - a, np.uint32)
        where, shift = np.arange(b - a), 0
        for k, (width, chunks, bitmap, _) in enumerate(self.levels):
            if a >= b:
                break
            out[where] |= chunks[a:b].astype(np.uint32) << np.uint32(shift)
            bits = np.unpackbits(bitmap[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            where, shift = where[bits], shift + width
            a = self._rank(k, a) if where.size else 0
            b = a + where.size
        return out

    def document(self, k: int) -> np.ndarray:
        return self.take(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


# --------------------------------------------------------------------------- encoding


def _runs(lengths: pa.Array, limit: int) -> list[tuple[int, int]]:
    """Bounds of runs of values that are about ``limit`` bytes long together, one value at least."""
    before = np.cumsum(lengths.to_numpy(zero_copy_only=False), dtype=np.int64) - lengths.to_numpy(zero_copy_only=False)
    cuts = (np.flatnonzero(np.diff(before // limit)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(lengths)])) if len(lengths) else []


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space and never joins across it.

    Such a tokenizer gives a text the ids of its words, one after the other, so every distinct word
    of a batch is encoded once. Words are told apart and put together again as Arrow columns; only
    distinct ones, or their parts, become Python objects. Letter runs stay known from one batch to the
    next, as two Arrow columns of at most ``_KEPT`` bytes together.
    """

    #: Latin letters, each one code point also after composition, then ASCII signs: to the tokenizer two
    #: runs of their own, the first lower-cased. (Contractions need an apostrophe and are not of this form.)
    PLAIN = r"^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<signs>[!-&(-/:-@\[-`{-~]*)$"

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        # Only for a tokenizer that treats the two runs of a plain word apart.
        probe = ("Aé", ".;")
        self.splits = self._ids("".join(probe)) == self._ids(probe[0].lower()) + self._ids(probe[1])
        self.cores, self.core_ids = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _look_up(self, words: pa.Array) -> pa.Array:
        """Ids of every word, encoded on its own, as little-endian unsigned 32 bits."""
        ids, counts = [np.zeros(0, "<u4")], [np.zeros(1, np.int64)]
        for a, b in _runs(pc.binary_length(words), _CORES):
            made = self.tokenizer.encode(words.slice(a, b - a).to_pylist(), is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(made.ids, "<u4"))
            counts.append(np.bincount(np.array(made.word_ids, np.int64), minlength=b - a))
        ends = 4 * np.cumsum(np.concatenate(counts))
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(ids))])

    def _remember(self, words: pa.Array) -> pa.Array:
        """Ids of letter runs; only those not known yet are encoded."""
        places = pc.index_in(words, self.cores)
        missing = places.is_null().to_numpy(zero_copy_only=False)
        new = words.filter(pa.array(missing))
        known, ids = pa.concat_arrays([self.cores, new]), pa.concat_arrays([self.core_ids, self._look_up(new)])
        places = np.where(missing, len(self.cores) + np.cumsum(missing) - 1, pc.fill_null(places, 0).to_numpy())
        full = known.nbytes + ids.nbytes > _KEPT
        self.cores, self.core_ids = (pa.array([], known.type), pa.array([], ids.type)) if full else (known, ids)
        return ids.take(pa.array(places))

    def encode(self, texts: Sequence[str | None] | pa.Array, tail: bytes = b"") -> list[bytes]:
        """Ids of every text as little-endian unsigned 32 bits, and ``tail``."""
        texts = pc.fill_null(texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        # White space to the tokenizer and to Unicode alike; what else may separate stays in the word.
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        seen = split.values.dictionary_encode()
        words = seen.dictionary
        parts = pc.extract_regex(words, self.PLAIN)
        plain = parts.is_valid().to_numpy(zero_copy_only=False) & self.splits
        parts = parts.filter(pa.array(plain))
        cores, signs = pc.utf8_lower(parts.field("core")).dictionary_encode(), parts.field("signs").dictionary_encode()
        known = pc.binary_join_element_wise(
            self._remember(cores.dictionary).take(cores.indices), self._look_up(signs.dictionary).take(signs.indices), pa.scalar(b"", pa.large_binary())
        )
        table = pa.concat_arrays([known, self._look_up(words.filter(pa.array(~plain))), pa.array([tail], pa.large_binary())])
        # Places in the table: of a distinct word, of every word, and of the tail after each text.
        place = np.where(plain, np.cumsum(plain), len(known) + np.cumsum(~plain)).astype(np.int32) - np.int32(1)
        ends = split.offsets.to_numpy()[1:].astype(np.int64)
        ids = table.take(pa.array(np.insert(place[seen.indices.to_numpy()], ends, len(table) - 1)))
        _, bounds, data = ids.buffers()
        bounds = np.frombuffer(bounds, np.int64, len(ids) + 1)[np.append(0, ends + np.arange(1, len(ends) + 1))].tolist()
        return [data[a:b].to_pybytes() for a, b in zip(bounds, bounds[1:])] if data else [b""] * len(ends)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(definition: str) -> WordEncoder:
    """The process's encoder; it keeps what it has learnt from one task to the next."""
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(definition)
    return _ENCODERS[key]


_MANIFEST = "file string, block int, seq long, documents long, n_tokens long"


def write(docs: DataFrame, definition: str, where: str, end_id: int = END_ID, widths: Sequence[int] = WIDTHS) -> DataFrame:
    """Write the ids of all documents below ``where``; the stored manifest: one row per file.

    ``definition`` is the tokenizer as JSON text, so tasks need no file of it. ``block`` and ``seq``
    order the files.
    """
    ordered = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered = ordered.select("doc_id", "text", F.spark_partition_id().alias("block"))
    schema, arrow = work.schemas(_MANIFEST)
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator) -> Iterator:
        store, path = work.open_store(where)
        encode, tail = encoder(shared.value).encode, np.array([end_id], "<u4").tobytes()
        held, ids, size, files, block = [], [], 0, 0, None

        def flush():
            name = f"{uuid.uuid4().hex}.dac"
            ends, raw = np.cumsum([len(x) // 4 for x in held]), b"".join(held)
            held.clear()
            names = pa.BufferOutputStream()
            with pa.ipc.new_stream(names, pa.schema([("doc_id", ids[0].type)])) as out:
                out.write_batch(pa.record_batch([pa.concat_arrays(ids)], names=["doc_id"]))
            store.create_dir(path, recursive=True)
            with store.open_output_stream(f"{path}/{name}") as out:
                out.write(pack(np.frombuffer(raw, "<u4"), ends, widths, names.getvalue().to_pybytes()))
            return work.record_batch([(name, block, files, len(ends), int(ends[-1]))], arrow)

        for batch in batches:
            block = batch.column(2)[0].as_py()
            for a, b in _runs(pc.binary_length(batch.column(1)), _WORDS):
                codes = encode(batch.column(1).slice(a, b - a), tail)
                for at in range(0, b - a, work.SLICE):
                    some = codes[at : at + work.SLICE]
                    ids.append(batch.column(0).slice(a + at, len(some)))
                    held += some
                    size += sum(map(len, some)) // 4
                    if size >= FILE_IDS:
                        yield flush()
                        ids, size, files = [], 0, files + 1
        if held:
            yield flush()

    return work.store(ordered.mapInArrow(run, schema), "manifest")


def starts(manifest: DataFrame) -> DataFrame:
    """(file, first): ids before each file. One row per file meets in the window."""
    before = Window.orderBy("block", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first"))


def read(spark: SparkSession, manifest: DataFrame, where: str, id_kind: str = "long") -> DataFrame:
    """One row per document from the files: doc_id, file, place (in its file), start, n_tokens, ids_crc32."""
    files = work.store(starts(manifest), "starts")
    schema, arrow = work.schemas(f"doc_id {id_kind}, file string, place long, start long, n_tokens long, ids_crc32 long")

    def run(batches: Iterator) -> Iterator:
        store, path = work.open_store(where)
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{path}/{name}") as f:
                    tokens = Tokens(f.read())
                ids = pa.ipc.open_stream(tokens.names).read_all().column(0).combine_chunks()
                ends = tokens.ends.astype(np.int64)
                lengths = np.diff(ends, prepend=0)
                sums = [zlib.crc32(tokens.document(k).astype("<u4").tobytes()) for k in range(len(ends))]
                columns = [ids, [name] * len(ends), np.arange(len(ends)), first + ends - lengths, lengths, sums]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return files.repartition(max(1, min(files.count(), 100_000)), "file").mapInArrow(run, schema)


def encoded(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write all documents' ids with the tokenizer file at ``tokenizer`` and read the files back."""
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    spark = docs.sparkSession
    where = work.folder(spark, "tokens")
    return read(spark, write(docs, definition, where, end_id), where, docs.schema["doc_id"].dataType.simpleString())
