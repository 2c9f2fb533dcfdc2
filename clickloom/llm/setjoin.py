"""Exact Jaccard join of five-word shingle sets by set relations: skipped blocks and derived answers.

Two sets link when 5 x intersection >= 4 x union. Tokens are 64-bit shingle hashes.

1. ``shingled``: one pass over the texts gives every row its set's size and digest; rows of one
   digest are one set from here on. A set that can link shares at least lead(4/5 n) tokens of its
   first n - ceil(4/5 n) + lead(n) tokens (in hash order) with another set's first tokens, so only
   those are sent, as arrays by token range, and counted. A token met twice in a task's own block
   is counted there and sent once, so a token of very many sets stays as small as there are blocks.
2. What is left (``survivors``) is ordered by token frequency, rare first. The index has the tokens
   of the prefix filter with their positions.
3. Every list names its most shared set as pivot, and every set computes its overlap with the one
   pivot named most in its lists, its home. The difference to the home is stored: the tokens that
   the home has and the set lacks, and those that the set adds.
4. Lists that still hold several components are read in blocks sorted by size and position. A pair of
   blocks is skipped when no sizes or no positions in it can reach the needed overlap. Answers
   towards a common home bound a pair's overlap from both sides, and an odd sketch of the tokens
   bounds it from above; a pair that this leaves open is answered from the stored differences (same
   home) or from both whole sets.
5. Links become components. A class of equal sets is a single node; no link is lost.

Defined cases: an empty set (null text, no words) links with nothing, also not with its like; fewer
words than five are one token of their own kind; a null doc_id gets its component's id but never
names one; rows that repeat a doc_id are nodes by their texts; an empty table gives an empty result;
other columns are ignored. A chance collision of 64-bit tokens inside one pair of sets (about one in
10^13 pairs of 1,000 tokens) could change a count by one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm import work
from clickloom.llm.components import components

SHINGLE = 5
PART, WHOLE = 4, 5  # similarity of 4/5
LEAD = 10  # first tokens sent beyond the prefix: one in so many of the set
BLOCK = 1_000_000  # tokens of a task's block in the first pass
_WORDS = 500_000  # words whose hashes a process remembers
_FEW = 128  # entries of a block of an index list
_NOBODY = 0xFFFF
SKETCH = 16  # 64-bit words of a set's sketch

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


# --------------------------------------------------------------------------- sets


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _Hashes()


def tokens(text: str | None) -> np.ndarray:
    """Sorted distinct tokens (unsigned 64 bits) of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    ids = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(words))
    if not k:
        return ids
    h = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ ids[i : i + len(h)]) * _ODD[i]
        h ^= h >> np.uint64(29)
    return np.unique(h)


def digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def _least(n: int) -> int:
    """Tokens of a set of n that a set linked to it holds at least."""
    return -(-PART * n // WHOLE)


def lead(n: int) -> int:
    return max(1, n // LEAD)


def shingled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, blocks), stored once: per row doc_id, row_key, digest, n and its place (block, nr) with the
    number of its first tokens met elsewhere in the block; per block and token range the tokens sent."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    ranges = max(64, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema, arrow = work.schemas(f"doc_id {kind}, row_key long, digest binary, n long, block string, nr int, local int, token_range int, tokens binary, owners binary")

    def run(batches: Iterator) -> Iterator:
        held, firsts, places, size, block = [], [], {}, 0, uuid.uuid4().hex

        def flush():
            found = np.concatenate(firsts) if firsts else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(firsts), dtype=np.uint16), [len(f) for f in firsts])
            order = np.argsort(found)
            found, owner = found[order], owner[order]
            new = np.ones(len(found), bool)
            new[1:] = found[1:] != found[:-1]
            alone = new & np.append(new[1:], True)
            local = np.bincount(owner[~alone], minlength=len(firsts))
            found, owner = found[new], np.where(alone, owner, np.uint16(_NOBODY))[new]
            for at in range(0, len(held), 10_000):
                yield work.record_batch([(i, key, d, n, block, nr, int(local[nr]) if nr >= 0 else 0, None, None, None) for i, key, d, n, nr in held[at : at + 10_000]], arrow)
            ranged = ((found >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            cuts = np.searchsorted(ranged, np.arange(ranges + 1))
            sent = [(None, None, None, None, block, None, None, r, found[a:b].tobytes(), owner[a:b].tobytes()) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]
            for at in range(0, len(sent), 50):
                yield work.record_batch(sent[at : at + 50], arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, work.SLICE):
                for i, key, text in zip(*(c.to_pylist() for c in batch.slice(at, work.SLICE).columns)):
                    mine = tokens(text)
                    name, n = digest(mine), len(mine)
                    if n and name not in places:
                        places[name] = len(firsts)
                        firsts.append(mine[: n - _least(n) + lead(n)])
                        size += len(firsts[-1])
                    held.append((i, key, name, n, places[name] if n else -1))
                    if size >= BLOCK or len(firsts) >= _NOBODY:
                        yield from flush()
                        held, firsts, places, size, block = [], [], {}, 0, uuid.uuid4().hex
        yield from flush()

    made = work.store(_keyed(docs).select("doc_id", "row_key", "text").mapInArrow(run, schema), "shingled")
    rows = made.where("token_range IS NULL").select("doc_id", "row_key", "digest", "n", "block", "nr", "local")
    return rows, made.where("token_range IS NOT NULL").select("block", "token_range", "tokens", "owners")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("row_key"))


def _met_elsewhere(blocks: DataFrame) -> DataFrame:
    """(block, nr, met): first tokens of a set that another block has too."""
    packed, arrow_packed = work.schemas("block string, sets binary, counts binary")

    def run(batches: Iterator) -> Iterator:
        held, now = [], None

        def flush():
            found = np.concatenate([np.frombuffer(t, np.uint64) for _, t, _ in held])
            owner = np.concatenate([np.frombuffer(o, np.uint16) for _, _, o in held]).astype(np.int64)
            source = np.repeat(np.arange(len(held)), [len(t) // 8 for _, t, _ in held])
            order = np.argsort(found)
            same = found[order][1:] == found[order][:-1]
            twice = np.zeros(len(found), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            twice &= owner != _NOBODY
            places, counts = np.unique(source[twice] << 16 | owner[twice], return_counts=True)
            cuts = np.searchsorted(places >> 16, np.arange(len(held) + 1))
            sets = (places & 0xFFFF).astype(np.uint16)
            rows = [(block, sets[a:b].tobytes(), counts[a:b].astype(np.uint32).tobytes()) for (block, _, _), a, b in zip(held, cuts[:-1], cuts[1:]) if a < b]
            return work.record_batch(rows, arrow_packed)

        for batch in batches:
            for block, r, t, o in zip(*(c.to_pylist() for c in batch.columns)):
                if r != now:
                    if held:
                        yield flush()
                    held, now = [], r
                held.append((block, t, o))
        if held:
            yield flush()

    schema, arrow = work.schemas("block string, nr int, met int")

    def add(batches: Iterator) -> Iterator:
        """Sums by set of a block; its rows, one a token range, stand together."""
        total, now = np.zeros(_NOBODY, np.int64), None

        def flush():
            nr = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array([now] * len(nr), pa.string()), pa.array(nr.astype(np.int32)), pa.array(total[nr].astype(np.int32))], schema=arrow)

        for batch in batches:
            for block, sets, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if block != now:
                    if now is not None:
                        yield flush()
                    total[:], now = 0, block
                total[np.frombuffer(sets, np.uint16)] += np.frombuffer(counts, np.uint32)
        if now is not None:
            yield flush()

    dealt = blocks.select("block", "token_range", "tokens", "owners").repartition("token_range").sortWithinPartitions("token_range")
    return dealt.mapInArrow(run, packed).repartition("block").sortWithinPartitions("block").mapInArrow(add, schema)


def survivors(docs: DataFrame, rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """(sid, digest, n, tokens, sketch): the sets that may have a link, tokens as sorted signed longs."""
    n, led = F.col("n"), F.floor(F.ceil(F.col("n") * PART / WHOLE) / LEAD)
    alive = F.coalesce("met", F.lit(0)) + F.col("local") >= F.greatest(led, F.lit(1))
    chosen = rows.where(n > 0).join(_met_elsewhere(blocks), ["block", "nr"], "left").where(alive)
    chosen = work.store(chosen.groupBy("digest").agg(F.min("row_key").alias("row_key")), "chosen")
    schema, arrow = work.schemas("digest binary, n long, tokens array<long>, sketch binary")

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for at in range(0, batch.num_rows, work.SLICE):
                out = []
                for name, text in zip(*(c.to_pylist() for c in batch.slice(at, work.SLICE).columns)):
                    mine = tokens(text)
                    if digest(mine) == name:  # not so if two rows share a key by chance
                        out.append((name, len(mine), mine.view(np.int64), sketch(mine)))
                yield work.record_batch(out, arrow)

    # Most rows are left out before the shuffle of the texts.
    asked = _keyed(docs).select("row_key", "text").where(work.may_be_in(chosen, "row_key"))
    texts = asked.join(chosen, "row_key").select("digest", "text")
    sets = work.store(texts.mapInArrow(run, schema).withColumn("sid", F.monotonically_increasing_id()), "sets")
    # Rows of a table that are equal in doc_id and text share a key; only then a set is there twice.
    twice = sets.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return sets if twice.isEmpty() else work.store(sets.dropDuplicates(["digest"]), "sets")


def sketch(found: np.ndarray) -> bytes:
    """Parity of the tokens by bit place: two sketches differ in at most as many bits as their sets in tokens."""
    place = (found * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 10)
    odd = np.bincount(place.astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


# --------------------------------------------------------------------------- index and homes


def index(sets: DataFrame) -> DataFrame:
    """(token, sid, n, pos, shared): the prefix of every set in order of token frequency, without tokens of one set only."""
    each = sets.select("sid", "n", F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    known = each.join(often, "token").groupBy("sid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("known"))
    shared = F.size("known")
    # Tokens of one set only come first in the order.
    alone = F.col("n") - shared
    kept = F.greatest(F.col("n") - F.ceil(F.col("n") * PART / WHOLE) + 1 - alone, F.lit(0)).cast("int")
    found = known.select("sid", "n", alone.alias("alone"), shared.alias("shared"), F.posexplode(F.slice("known", F.lit(1), kept)).alias("at", "k"))
    return work.store(found.select(F.col("k.token").alias("token"), "sid", "n", (F.col("alone") + F.col("at")).alias("pos"), "shared"), "index")


def _needed(n: Column, m: Column) -> Column:
    """The least overlap of linked sets of these sizes."""
    return F.ceil((n + m) * PART / (PART + WHOLE))


def homes(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """(sid, home, n, n_home, overlap, lacks, adds): every set beside the pivot that its lists name most."""
    central = F.struct((F.col("shared") / F.col("n")).alias("share"), (-F.col("sid")).alias("least"))
    pivots = entries.groupBy("token").agg(F.max_by(F.struct(F.col("sid").alias("home"), F.col("n").alias("m"), F.col("pos").alias("p")), central).alias("pivot"), F.count(F.lit(1)).alias("size"))
    named = entries.join(pivots.where("size > 1").select("token", "pivot.*"), "token").where("sid <> home")
    possible = F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("p")) >= _needed(F.col("n"), F.col("m"))
    votes = named.where(possible).groupBy("sid", "home").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("sid").agg(F.max_by("home", F.struct("votes", (-F.col("home")).alias("least"))).alias("home"))
    mine = best.join(sets.select("sid", "n", "tokens"), "sid")
    theirs = sets.select(F.col("sid").alias("home"), F.col("n").alias("n_home"), F.col("tokens").alias("home_tokens"))
    both = mine.join(theirs, "home").select("sid", "home", "n", "n_home", F.array_except("home_tokens", "tokens").alias("lacks"), F.array_except("tokens", "home_tokens").alias("adds"))
    return work.store(both.withColumn("overlap", F.col("n") - F.size("adds")), "homes")


# --------------------------------------------------------------------------- what is left


def _open_pairs(n, pos, comp, home, overlap, n_home, sketches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, linked) of one list's entries, sorted by size and position, that may link or surely do."""
    starts = range(0, len(n), _FEW)
    rest = n - pos
    low, high, most = ([f(x[a : a + _FEW]) for a in starts] for f, x in ((min, n), (max, n), (max, rest)))
    for p, a in enumerate(starts):
        for q in range(p, len(starts)):
            if WHOLE * high[p] < PART * low[q]:
                break  # all later sets are too large
            if (PART + WHOLE) * min(most[p], most[q]) < PART * (low[p] + low[q]):
                continue  # no positions of these blocks leave enough tokens
            i, j = np.arange(a, min(a + _FEW, len(n)))[:, None], np.arange(q * _FEW, min((q + 1) * _FEW, len(n)))[None, :]
            need = -(-PART * (n[i] + n[j]) // (PART + WHOLE))
            keep = (comp[i] != comp[j]) & (np.minimum(rest[i], rest[j]) >= need) & (np.minimum(n[i], n[j]) >= need)
            if p == q:
                keep &= i < j
            i, j = (x[keep] for x in np.broadcast_arrays(i, j))
            need = need[keep]
            same = (home[i] == home[j]) & (home[i] >= 0)
            upper = np.minimum(overlap[i], overlap[j]) + np.minimum(n[i] - overlap[i], n[j] - overlap[j])
            differ = np.bitwise_count(sketches[i] ^ sketches[j]).sum(axis=1, dtype=np.int64)
            keep = ~(same & (upper < need)) & (n[i] + n[j] - differ >= 2 * need)
            i, j, need, same = i[keep], j[keep], need[keep], same[keep]
            if i.size:
                yield i, j, same & (overlap[i] + overlap[j] - n_home[i] >= need)


def remaining(entries: DataFrame, sets: DataFrame, near: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, linked) of sets in different components so far that share a list and may link."""
    of = F.coalesce("root", "sid").alias("comp")
    state = sets.select("sid", "sketch").join(labels.withColumnRenamed("node", "sid"), "sid", "left").join(near.select("sid", "home", "overlap", "n_home"), "sid", "left")
    state = work.store(state.select("sid", "sketch", of, F.coalesce("home", F.lit(-1)).alias("home"), F.coalesce("overlap", F.lit(0)).alias("overlap"), F.coalesce("n_home", F.lit(0)).alias("n_home")), "state")
    marked = work.store(entries.join(state.drop("sketch"), "sid"), "marked")
    several = marked.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("token")
    live = marked.join(several, "token", "left_semi").join(state.select("sid", "sketch"), "sid")
    schema, arrow = work.schemas("a long, b long, linked boolean")

    def run(batches: Iterator) -> Iterator:
        names = ["n", "pos", "comp", "home", "overlap", "n_home"]
        held, now = [], None

        def flush():
            table = pa.Table.from_batches(held)
            columns = [table[c].to_numpy().astype(np.int64) for c in names]
            sids = table["sid"].to_numpy()
            sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(-1, SKETCH)
            for i, j, linked in _open_pairs(*columns, sketches):
                a, b = np.minimum(sids[i], sids[j]), np.maximum(sids[i], sids[j])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(linked)], schema=arrow)

        for batch in batches:
            token = batch.column("token").to_numpy()
            cuts = [0, *(np.flatnonzero(token[1:] != token[:-1]) + 1).tolist(), len(token)]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                if held and token[x] != now:
                    yield from flush()
                    held = []
                now = token[x]
                held.append(batch.slice(x, y - x))
        if held:
            yield from flush()

    dealt = live.select("token", "sid", "n", "pos", "comp", "home", "overlap", "n_home", "sketch").repartition("token").sortWithinPartitions("token", "n", "pos")
    return work.store(dealt.mapInArrow(run, schema).groupBy("a", "b").agg(F.max("linked").alias("linked")), "remaining")


def _answered(pairs: DataFrame, sets: DataFrame, near: DataFrame) -> DataFrame:
    """(a, b) of the open pairs that link: by their differences to a common home, or by both whole sets."""
    open_ = pairs.where(~F.col("linked")).select("a", "b")
    own = near.select("sid", "home", "n", "n_home", "lacks", "adds")
    x, y = own.select(*[F.col(c).alias(f"x_{c}") for c in own.columns]), own.select(*[F.col(c).alias(f"y_{c}") for c in own.columns])
    same_home = near.select("sid", "home")
    ends = open_.join(same_home.select(F.col("sid").alias("a"), F.col("home").alias("home_a")), "a", "left").join(same_home.select(F.col("sid").alias("b"), F.col("home").alias("home_b")), "b", "left")
    ends = work.store(ends.select("a", "b", F.coalesce(F.col("home_a") == F.col("home_b"), F.lit(False)).alias("same")), "open")
    derived = ends.where("same").join(x, F.col("a") == F.col("x_sid")).join(y, F.col("b") == F.col("y_sid"))
    overlap = F.col("x_n_home") - F.size("x_lacks") - F.size("y_lacks") + F.size(F.array_intersect("x_lacks", "y_lacks")) + F.size(F.array_intersect("x_adds", "y_adds"))
    derived = derived.where(overlap >= _needed(F.col("x_n"), F.col("y_n"))).select("a", "b")
    left, right = (sets.select(F.col("sid").alias(s), F.col("n").alias(f"n_{s}"), F.col("tokens").alias(f"t_{s}")) for s in "ab")
    whole = ends.where("NOT same").select("a", "b").join(left, "a").join(right, "b")
    whole = whole.where(F.size(F.array_intersect("t_a", "t_b")) >= _needed(F.col("n_a"), F.col("n_b"))).select("a", "b")
    return derived.unionByName(whole).unionByName(pairs.where("linked").select("a", "b"))


def classes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    rows, blocks = shingled(docs)
    sets = survivors(docs, rows, blocks)
    entries = index(sets)
    near = homes(entries, sets)
    first = near.where(F.col("overlap") >= _needed(F.col("n"), F.col("n_home"))).select(F.col("sid").alias("a"), F.col("home").alias("b"))
    first = work.store(first, "first_links")
    more = work.store(_answered(remaining(entries, sets, near, components(first)), sets, near), "more_links")
    roots = components(first.unionByName(more))
    named = rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least"))
    group = sets.select("digest", "sid").join(roots.withColumnRenamed("node", "sid"), "sid")
    named = work.store(named.join(group.select("digest", "root"), "digest", "left"), "named")
    least = named.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("component_least"))
    of_set = named.join(least, "root", "left").select("digest", F.coalesce("component_least", "least").alias("component_id"))
    full = rows.where("n > 0").select("doc_id", "n", "digest").join(of_set, "digest")
    return full.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(
        rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    )
