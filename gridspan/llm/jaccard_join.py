"""N-gram Jaccard self-join: a size-aware heavy-light join, and the components that its links form.

Documents are sets of hashed word shingles. Two sets of n and m shingles whose Jaccard similarity is t
or more share at least t * max(n, m); so, in any fixed order of shingles, they share their first k
common ones within the first n - ceil(t * n) + k of each. From this two kinds of keys follow:

* light sets (fewer shingles than the boundary) enumerate all subsets of size 2 of that prefix, k = 2;
* heavy sets scan inverted lists of single shingles of the prefix, k = 1. Light sets that can be similar
  to a heavy one have those keys as well.

An entry also knows its set's size and its place in the set's order. The first shingle that two similar
sets have in common lies early enough in both for the rest to hold all they must share; a list gives a
pair only where that holds, so shared passages, which come late, give next to none.

The boundary minimises rows written plus list entries scanned, from the counted sizes and list lengths.
Shingles that very many documents share come last in the order, so that lists stay short; which ones
those are changes the cost, never the result.

A candidate pair is first held against the sets' parity signatures, a bit per bucket of hashes that says
whether an odd number of shingles fell into it: bits that differ are at most the shingles that differ,
so too many of them prove a pair dissimilar. Full sets are read for the pairs that are left alone.

All links are found without all pairs of a list being written. Sets that are equal become one. Each
list first links its members to its two hubs and to their neighbours by size and by name; sets that verified links join are one component, and a
list within one component is done. In lists of at least four members that still hold several components
each member meets a few drawn ones of other components; then what is left of such lists gives its
remaining pairs across components, which are verified too. So every pair that
could connect two components has been compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .histogram_sort import discard, written

WORDS, PERCENT = 5, 75
#: Greatest boundary tried between light and heavy sets.
MOST_LIGHT = 64
#: A shingle counts towards the late ones from so many in one batch, and is one from so many in all.
BATCH_COUNT, LATE_COUNT = 2, 8
#: At most so many shingles are broadcast as late ones (8 MB), the most frequent first.
LATE_ENTRIES = 1_000_000
#: Up to so many rows of numbers are broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Members of a list that one task pairs; longer lists are dealt into blocks of this size.
BLOCK = 4_000
#: Others that a member of a list in several components meets before all pairs across them are given.
DRAWN = 8
#: Words of 64 bits in a sketch, the shortest signature.
SKETCH = 8
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: An odd factor for each place in a run.
_FACTORS = np.random.default_rng(20240229).integers(0, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles gathered before they are counted or sent on.
CHUNK = 2_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of a word that are hashed eight at a time over all words at once; longer words by themselves.
LONG_WORD = 64
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word: its length, then eight bytes at a time mixed in."""
    joined = b" ".join(words) + b" "
    # Eight bytes from each place on, as one number.
    eight = np.ndarray((len(joined),), "<u8", joined + bytes(8), strides=(1,))
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate((np.zeros(1, np.int64), ends[:-1] + 1))
    lengths = ends - starts
    hashes = lengths.astype(np.uint64)
    at = np.arange(len(words))
    for done in range(0, LONG_WORD, 8):
        at = at[lengths[at] > done]
        if not len(at):
            return hashes
        hashes[at] = _mix(hashes[at] * _STEP + (eight[starts[at] + done] & _MASKS[np.minimum(lengths[at] - done, 8)]))
    for k in at[lengths[at] > LONG_WORD].tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(words[k])
    return hashes


def _distinct(hashes: np.ndarray) -> np.ndarray:
    hashes = np.sort(hashes)
    fresh = np.ones(len(hashes), bool)
    np.not_equal(hashes[1:], hashes[:-1], out=fresh[1:])
    return hashes[fresh]


def _combined(own: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words, from the words' hashes; the width is part of it, so that a short text's only run is no other text's."""
    runs = np.full(len(own) - width + 1, (width * int(_STEP)) & (1 << 64) - 1, np.uint64)
    for k in range(width):
        runs += own[k : k + len(runs)] * _FACTORS[k]
    return _mix(runs)


def shingle_sets(texts: list[bytes], width: int = WORDS) -> list[np.ndarray]:
    """Of each text the sorted hashes of its distinct runs of ``width`` words, in lower case in ASCII; fewer words make one run."""
    split = [t.lower().split() for t in texts]
    words = [w for own in split for w in own]
    own = word_hashes(words) if words else np.empty(0, np.uint64)
    runs = _combined(own, width) if len(own) >= width else own[:0]
    out, at = [], 0
    for n in map(len, split):
        out.append(_distinct(runs[at : at + n - width + 1]) if n >= width else _combined(own[at : at + n], n) if n else own[:0])
        at += n
    return out


def shingles(data: bytes, width: int = WORDS) -> np.ndarray:
    return shingle_sets([data], width)[0]


#: Bytes of texts that are hashed together.
TOGETHER = 1 << 18


def sets_in(column: pa.Array) -> Iterator[np.ndarray]:
    """The sets of a column of texts, in order."""
    held, size = [], 0
    for value in column:
        held.append(text := value.as_py())
        size += len(text)
        if size > TOGETHER:
            yield from shingle_sets(held)
            held, size = [], 0
    yield from shingle_sets(held)


def set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def least_common(n: int, percent: int = PERCENT) -> int:
    """Shingles that a set of n shares with any set similar to it, at least."""
    return -(-percent * n // 100)


def signature(hashes: np.ndarray) -> bytes:
    """Parity bits of the hashes' last digits; two bits or more for each shingle."""
    bits = max(64 * SKETCH, 1 << (2 * len(hashes) - 1).bit_length())
    return np.packbits((np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def sketch(signature_bytes: bytes) -> list[int]:
    """A parity signature of one fixed size, for join conditions."""
    bits, size = int.from_bytes(signature_bytes, "little"), len(signature_bytes) * 8
    while size > 64 * SKETCH:
        size //= 2
        bits = (bits >> size) ^ (bits & (1 << size) - 1)
    return np.frombuffer(bits.to_bytes(8 * SKETCH, "little"), np.int64).tolist()


def least_different(x: bytes, y: bytes) -> int:
    """A number of shingles that is in one set alone, at least."""
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    n, m = len(x) * 8, len(y) * 8
    while n > m:  # the parity of two buckets together
        n //= 2
        a = (a >> n) ^ (a & (1 << n) - 1)
    while m > n:
        m //= 2
        b = (b >> m) ^ (b & (1 << m) - 1)
    return (a ^ b).bit_count()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def describe(texts: DataFrame) -> DataFrame:
    """A row doc_id, n, sid, signature, sketch for each document, and rows token, count for shingles that are frequent in a batch."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("signature", pa.binary()), ("sketch", pa.list_(pa.int64())), ("token", pa.int64()), ("count", pa.int64())])

    def out(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    def frequent(sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
        often = counts >= BATCH_COUNT
        if often.any():
            yield out(int(often.sum()), token=tokens[often].view(np.int64), count=counts[often])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, sids, signatures, sets, seen, size = [], [], [], [], set(), 0
            for hashes in sets_in(batch.column(1)):
                sid = set_id(hashes)
                ns.append(len(hashes))
                sids.append(sid)
                signatures.append(signature(hashes))
                if sid not in seen:
                    seen.add(sid)
                    sets.append(hashes)
                    size += len(hashes)
                if size > CHUNK:
                    yield from frequent(sets)
                    sets, size = [], 0
            if sets:
                yield from frequent(sets)
            yield out(batch.num_rows, doc_id=batch.column(0), n=ns, sid=sids, signature=signatures, sketch=[sketch(x) for x in signatures])

    return texts.mapInArrow(walk, "doc_id long, n long, sid long, signature binary, sketch array<long>, token long, count long")


def choose_boundary(sizes: dict[int, int], scanned: float, percent: int = PERCENT) -> int:
    """The size from which sets are heavy: least rows written plus list entries scanned. ``scanned``: other entries of a list, on average."""

    def cost(x: int) -> float:
        light = sum(k * math.comb(n - least_common(n, percent) + 2, 2) for n, k in sizes.items() if 3 <= n < x)
        heavy = sum(k * (n - least_common(n, percent) + 1) * (1 + scanned) for n, k in sizes.items() if n >= least_common(x, percent))
        return light + heavy

    return min(range(3, MOST_LIGHT + 1), key=lambda x: (cost(x), x))


def keys_of(hashes: np.ndarray, late: np.ndarray, boundary: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a set, single shingles of its prefix, pairs of them, or both; and the place of each.

    The place of a pair is one before its second shingle's, as if its first were next to it. ``late``: sorted shingles that come last in the order.
    """
    n = len(hashes)
    if n < 3:  # equal sets alone are similar
        return hashes[:0], np.empty(0, np.int64)
    if len(late):
        at = np.minimum(np.searchsorted(late, hashes), len(late) - 1)
        is_late = late[at] == hashes
        hashes = np.concatenate((hashes[~is_late], hashes[is_late]))
    spare = n - least_common(n, percent)
    parts, places = [], []
    if n < boundary:
        a, b = np.triu_indices(min(n, spare + 2), 1)
        parts.append(_mix(hashes[a] * np.uint64(0xD6E8FEB86659FD93) + _mix(hashes[b])))
        places.append(b - 1)
    if n >= least_common(boundary, percent):
        parts.append(hashes[: spare + 1])
        places.append(np.arange(spare + 1, dtype=np.int64))
    return np.concatenate(parts), np.concatenate(places)


ENTRY = pa.schema([("key", pa.int64()), ("sid", pa.int64()), ("place", pa.int64())])
ENTRY_DDL = "key long, sid long, place long"


def _entries(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(3)], schema=ENTRY)


def list_entries(texts: DataFrame, late: np.ndarray, boundary: int) -> DataFrame:
    """Rows key, sid, place: entries of the inverted lists, sets that a batch repeats once. ``place``: the set's size times 2**32, plus the place in its order."""
    shared = texts.sparkSession.sparkContext.broadcast(late)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = shared.value
        for batch in batches:
            seen, rows, size = set(), [], 0
            for hashes in sets_in(batch.column(1)):
                if (sid := set_id(hashes)) in seen:
                    continue
                seen.add(sid)
                own, places = keys_of(hashes, late, boundary)
                rows.append(np.column_stack((own.view(np.int64), np.full(len(own), sid, np.int64), places + (len(hashes) << 32))))
                size += len(own)
                if size > CHUNK // 4:
                    yield _entries(np.concatenate(rows))
                    rows, size = [], 0
            if size:
                yield _entries(np.concatenate(rows))

    return texts.mapInArrow(walk, ENTRY_DDL)


def shared_lists(entries: DataFrame) -> DataFrame:
    """The entries of lists that hold two sets or more. Lists are streams of sorted rows: none is held in memory."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 3), np.int64)  # the last row, and before it the row of the same list, if any
        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            known = max(0, len(held) - 1)
            rows = np.concatenate((held, rows))
            if not len(rows):
                continue
            fresh = np.ones(len(rows), bool)
            fresh[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
            rows = rows[fresh]
            same = rows[1:, 0] == rows[:-1, 0]
            inside = np.zeros(len(rows), bool)
            inside[1:] |= same
            inside[:-1] |= same
            done = rows[known:-1][inside[known:-1]]
            held = rows[-2:] if len(rows) > 1 and same[-1] else rows[-1:]
            if len(done):
                yield _entries(done)
        if len(held) == 2:
            yield _entries(held[1:])

    return entries.repartition("key").sortWithinPartitions("key", "sid").mapInArrow(walk, ENTRY_DDL)


def can_match(x: Column, y: Column, percent: int = PERCENT) -> Column:
    """Whether the sets of two entries can be similar if they have nothing in common before these places."""
    n, m = F.shiftright(x, 32), F.shiftright(y, 32)
    i, j = x.bitwiseAND(F.lit(0xFFFFFFFF)), y.bitwiseAND(F.lit(0xFFFFFFFF))
    common = F.floor((percent * (n + m) + (99 + percent)) / (100 + percent))
    return (F.least(n - i, m - j) >= common) & (100 * F.least(n, m) >= percent * F.greatest(n, m))


def blocks_of(members: Column) -> Column:
    """Into how many blocks a list is dealt."""
    return F.ceil(members / BLOCK).cast("int")


def block_of(sid: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(sid), blocks).cast("int")


def can_be_near(x: Column, y: Column, a: Column, b: Column, percent: int = PERCENT) -> Column:
    """Whether the sketches a, b of the sets of two entries allow their similarity: bits that differ are at most the shingles that do."""
    total = F.shiftright(x, 32) + F.shiftright(y, 32)
    different = sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(SKETCH)), F.lit(0))
    return 100 * (total - different) >= percent * (total + different)


def open_lists(lists: DataFrame, hubs: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """key, block, blocks, sid, place, label, sketch: entries of the lists that hold several components. Lists of up to three sets have had all their pairs compared."""
    labelled = lists.join(hubs.where("members > 3").select("key"), "key").join(labels, "sid", "left").select("key", "sid", "place", F.coalesce("label", "sid").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("p"), F.max("label").alias("q"), F.count("*").alias("members")).where("p < q").select("key", blocks_of(F.col("members")).alias("blocks"))
    return labelled.join(mixed, "key").withColumn("block", block_of(F.col("sid"), F.col("blocks"))).join(classes.select("sid", "sketch"), "sid")


def full_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """sid and hashes of the sets whose sid is in ``wanted``, once each. ``wanted`` has with each sid the least id of a document that has that set.

    Only those documents' texts are read anew, where ``wanted`` is small enough to broadcast.
    """
    spark = texts.sparkSession
    few = wanted.count() <= BROADCAST_ROWS
    if few:
        texts = texts.join(F.broadcast(wanted.select(F.col("least").alias("id")).distinct()), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    shared = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in wanted.select("sid").toLocalIterator()], np.int64)) if few else None)
    schema = pa.schema([("sid", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = shared.value
        chosen = None if chosen is None else set(chosen.tolist())
        for batch in batches:
            seen, sids, sets = set(), [], []
            for hashes in sets_in(batch.column(1)):
                sid = set_id(hashes)
                if sid not in seen and (chosen is None or sid in chosen):
                    seen.add(sid)
                    sids.append(sid)
                    sets.append(hashes.view(np.int64))
            for at in range(0, len(sids), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(sids[at : at + 2000], pa.int64()), pa.array(sets[at : at + 2000], pa.list_(pa.int64()))], schema=schema)

    sets = texts.mapInArrow(walk, "sid long, hashes array<long>")
    if not few:
        sets = sets.join(wanted.select("sid"), "sid", "left_semi")
    return sets.groupBy("sid").agg(F.first("hashes").alias("hashes"))


def plausible(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs a, b that sizes and signatures do not rule out. ``classes`` has sid, n and signature."""
    x, y = classes.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("signature").alias("sa")), classes.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("sb"))
    sized = pairs.join(x, "a").join(y, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # With d shingles in one set alone, (n - d) / 2 of n in both together are common.
            keep = [100 * (n - d) >= percent * (n + d) for n, d in ((n + m, least_different(p, q)) for n, m, p, q in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=schema).filter(pa.array(keep, pa.bool_()))

    return sized.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(walk, "a long, b long")


def verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs a, b whose similarity is ``percent`` or more."""
    left = written(plausible(pairs, classes, percent), "jaccard-plausible")
    if left.isEmpty():
        return left
    wanted = classes.select("sid", "least").join(left.select(F.col("a").alias("sid")).union(left.select("b")).distinct(), "sid", "left_semi")
    sets = written(full_sets(texts, wanted), "jaccard-full")
    both = left.join(sets.select(F.col("sid").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("sid").alias("b"), F.col("hashes").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """sid, label for each node of ``edges`` (a, b): the least node of its component. Alternates large and small stars, each written."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "components")
    mark = None
    while True:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("w"), "u", "m")
        before, edges = edges, written(small.select(F.col("w").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "components")
        discard(before)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            return edges.select(F.col("u").alias("sid"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("sid"), F.col("v").alias("label")).distinct())
        mark = now


def link_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach, its own included) of each row.

    Null, empty and blank texts have no shingles and no links. A null id is never a component's name while the component has
    another; rows that repeat an id or a text get a row each. An empty table gives no rows. Sets are told apart by a
    64-bit hash, and so are words and shingles. Very long texts have as many shingles as they have, none left out. Other
    columns, whatever their names, are not carried along.
    """
    return _linked(docs, id_col, text_col)[0]


def _linked(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``link_components``, and sid, label, component_id of each set: the label names the component, whatever the ids."""
    spark = docs.sparkSession
    texts = _texts(docs, id_col, text_col)
    described = written(describe(texts), "jaccard-sets")
    rows = described.where("sid is not null")

    tokens = described.where("token is not null").groupBy("token").agg(F.sum("count").alias("count"))
    squares = tokens.agg(F.sum(F.col("count").cast("double") * F.col("count"))).first()[0] or 0.0
    entries = rows.agg(F.sum("n")).first()[0] or 0
    sizes = {r["size"]: r["count"] for r in rows.where("n >= 3").groupBy(F.least("n", F.lit(2 * MOST_LIGHT)).alias("size")).count().collect()}
    boundary = choose_boundary(sizes, squares / max(1, entries))
    late = tokens.where(F.col("count") >= LATE_COUNT).orderBy(F.desc("count"), "token").limit(LATE_ENTRIES).select("token")
    late = np.sort(np.array([r[0] for r in late.collect()], np.int64).view(np.uint64))

    lists = written(shared_lists(list_entries(texts, late, boundary)), "jaccard-lists")
    classes = written(rows.where("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("least")), "jaccard-classes")

    entry = F.struct("sid", "place")
    hubs = written(lists.groupBy("key").agg(F.min(entry).alias("low"), F.max(entry).alias("high"), F.count("*").alias("members")), "jaccard-hubs")
    # A long list is chained by blocks, each with neighbours of its own: which pairs come first changes the cost, never the result.
    member = lists.join(hubs.where("members > 2").select("key", "low", "high", blocks_of(F.col("members")).alias("blocks")), "key").withColumns({"own": entry, "block": block_of(F.col("sid"), F.col("blocks"))})
    by_size, by_sid = Window.partitionBy("key", "block").orderBy("place", "sid"), Window.partitionBy("key", "block").orderBy("sid")
    chained = member.withColumns({f"after{k}": F.lag("own", k).over(by_size) for k in (1, 2)} | {f"near{k}": F.lag("own", k).over(by_sid) for k in (1, 2)})
    # One pass gives a member's pairs with its hubs and neighbours; those that cannot match never become rows.
    others = F.filter(F.array("low", "high", "after1", "after2", "near1", "near2"), lambda x: x.isNotNull() & (x["sid"] != F.col("sid")) & can_match(F.col("place"), x["place"]))
    paired = chained.select("sid", F.explode(F.array_distinct(F.transform(others, lambda x: x["sid"]))).alias("other")).select(F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b"))
    # Lists of two sets are their hubs.
    two = hubs.where((F.col("members") == 2) & can_match(F.col("low.place"), F.col("high.place"))).select(F.col("low.sid").alias("a"), F.col("high.sid").alias("b"))
    first = two.unionByName(paired)
    tested = written(first.distinct(), "jaccard-pairs")
    links = written(verified(tested, classes, texts), "jaccard-links")
    labels = components(links)

    # Lists that still hold several components: first each member meets a few others of other components, drawn anew, so
    # that a group of near copies in many parts grows together before all pairs across its parts are given.
    drawn = open_lists(lists, hubs, labels, classes)
    turn = Window.partitionBy("key", "block").orderBy(F.xxhash64("sid", F.lit(1)))
    entry = F.struct("sid", "place", "label", "sketch")
    met = drawn.withColumns({f"other{k}": F.lag(entry, k).over(turn) for k in range(1, DRAWN + 1)})
    chosen = F.filter(F.array(*[f"other{k}" for k in range(1, DRAWN + 1)]), lambda x: x.isNotNull() & (x["label"] != F.col("label")) & can_match(F.col("place"), x["place"]) & can_be_near(F.col("place"), x["place"], F.col("sketch"), x["sketch"]))
    few = met.select("sid", F.explode(F.array_distinct(F.transform(chosen, lambda x: x["sid"]))).alias("other")).select(F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b"))
    few = written(few.distinct().join(tested, ["a", "b"], "left_anti"), "jaccard-drawn")
    if not few.isEmpty():
        tested = tested.unionByName(few)
        more = written(verified(few, classes, texts), "jaccard-links")
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)

    # What is left gives all pairs across components. A long list is dealt into blocks, and each pair of blocks is a list: a
    # pair of entries meets in the one of its own two blocks.
    dealt = open_lists(lists, hubs, labels, classes).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = written(dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "sid", "place", "label", "sketch"), "jaccard-rest")
    own_blocks = (F.least("x.block", "y.block") == F.col("x.i")) & (F.greatest("x.block", "y.block") == F.col("x.j"))
    near = can_be_near(F.col("x.place"), F.col("y.place"), F.col("x.sketch"), F.col("y.sketch"))
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j")) & own_blocks & (F.col("x.sid") < F.col("y.sid")) & (F.col("x.label") != F.col("y.label")) & can_match(F.col("x.place"), F.col("y.place")) & near
    across = written(rest.alias("x").join(rest.alias("y"), meet).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"), "jaccard-across")
    if not across.isEmpty():
        more = written(verified(across, classes, texts), "jaccard-links")
        if not more.isEmpty():
            labels = components(links.unionByName(more))

    named = classes.join(labels, "sid", "left").select("sid", F.coalesce("label", "sid").alias("label"), "least")
    names = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_set = named.select("sid", "label").join(names, "label").select("sid", "label", "component_id")
    found = rows.join(by_set.drop("label"), "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return found, by_set


def sid_of(text: Column) -> Column:
    """The id of a text's set of shingles, null for texts that have none."""

    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([set_id(x) if len(x) else None for x in sets_in(batch)], pa.int64())

    return of(F.coalesce(text, F.lit("")).cast("binary"))


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component one row, one with the least id, with the columns of ``docs``. Rows without shingles (null, empty and blank texts) stay.

    An empty table stays empty.

    Where an id is null or in several rows, the set decides which component a row belongs to. Rows of a component that share its
    least id go but for the one of least set and text hash; null ids come last.
    """
    linked, by_set = _linked(docs, id_col, text_col)
    linked = written(linked, "jaccard-linked")
    ids = F.col(id_col).cast("long")
    # Null ids are told by themselves: as one key they would land in one task.
    again = written(linked.where("doc_id is not null").groupBy(F.col("doc_id").alias("__again")).agg(F.count("*").alias("n")).where("n > 1").select("__again"), "jaccard-again")
    repeats, nulls = again.count(), not linked.where("doc_id is null").isEmpty()
    found = written(linked.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "jaccard-gone")
    gone = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    if not repeats and not nulls:
        return docs.join(gone, ids == gone["__gone"], "left_anti")

    few = F.broadcast(again) if repeats <= BROADCAST_ROWS else again
    unclear = docs.where(ids.isNull()).unionByName(docs.join(few, ids == few["__again"], "left_semi"))
    clear = docs.where(ids.isNotNull()).join(few, ids == few["__again"], "left_anti").join(gone, ids == gone["__gone"], "left_anti")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    unclear = written(unclear.select(row, ids.alias("__id"), sid_of(F.col(text_col)).alias("__sid"), F.xxhash64(text_col).alias("__text")), "jaccard-unclear")
    apart = unclear.where("__sid is null").select("__row.*")
    sets = by_set.join(unclear.select(F.col("__sid").alias("sid")).where("sid is not null").distinct(), "sid", "left_semi")
    least = unclear.join(sets, F.col("__sid") == F.col("sid")).where("__id <=> component_id").groupBy("label").agg(F.min_by("__row", F.struct("__sid", "__text")).alias("__row"))
    return clear.unionByName(apart).unionByName(least.select("__row.*"))
