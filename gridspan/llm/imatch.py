"""I-Match document fingerprints.

Terms whose inverse document frequency lies in a band make the lexicon. A document's distinct terms in
the lexicon, sorted, are hashed once for each of several random lexicon subsets. Subsets come in halving
sizes, down to one that holds a term of the lexicon or none, so that documents of any length have some that
hold few of their terms: those survive edits. Only these are compared; denser ones differ after any edit.

Document frequencies are counted over all documents: each task sums its own before the shuffle. The
lexicon is broadcast; a term in it occurs in at least ``least`` of all documents, so it has at most
(mean distinct terms of a document) / ``least`` entries, however large the corpus. With a mean of 500 terms that
is 500,000 entries at most: 4 MB broadcast, and in each Python worker a table of subsets of some 40 MB.

A document without a term in the lexicon takes all its terms in their place, in the subsets of the first size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .histogram_sort import written

#: Share of documents that hold a term: the band of inverse document frequencies is -log of these.
LEAST, MOST = 0.001, 0.1
#: Subsets per size.
COPIES = 4
#: Sizes that are compared before the sparsest one in which half of the subsets or more hold a term.
DENSER = 3
SEED = 20240229
EDGES = b".,;:!?()[]{}|\"'"
#: Terms of documents that are gathered before they are counted: 16 MB.
COUNT_ENTRIES = 2_000_000
HEX = 8
EMPTY = "0" * HEX


class Terms:
    """Texts to the hashes of their terms. Nothing is kept from text to text: a hash costs less than a dictionary's miss."""

    def terms(self, data: bytes) -> np.ndarray:
        """The sorted 64-bit hashes of a text's distinct terms: what stands between ASCII white space, in lower case in ASCII, without edge punctuation."""
        terms = set(map(bytes.strip, set(data.lower().split()), repeat(EDGES)))
        terms.discard(b"")
        # Unsigned hashes less 2**63, in signed numbers.
        found = np.fromiter(map(xxhash.xxh64_intdigest, terms, repeat(SEED)), np.uint64, len(terms)) ^ np.uint64(1 << 63)
        return np.sort(found.view(np.int64))


_memo = Terms()


def term_frequencies(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """term (64-bit hash) and n, the number of documents that hold it."""
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            terms, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(terms), pa.array(counts, pa.int64())], schema=schema)

        for batch in batches:
            for value in batch.column(0):
                held.append(terms := _memo.terms(value.as_py()))
                size += len(terms)
                if size > COUNT_ENTRIES:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon_of(docs: DataFrame, *, text_col: str = "text", least: float = LEAST, most: float = MOST) -> np.ndarray:
    """The sorted hashes of the terms in the band."""
    total = docs.count()
    band = term_frequencies(docs, text_col=text_col).where(F.col("n").between(F.lit(least * total), F.lit(most * total)))
    return np.sort(np.array([r[0] for r in band.select("term").toLocalIterator()], np.int64))


def halvings(lexicon: np.ndarray) -> int:
    """Sizes of subsets, one at least: no document has more terms than the lexicon, so the sparsest subset has one of any document's at the mean, or fewer."""
    return max(1, len(lexicon).bit_length())


def subset_masks(lexicon: np.ndarray) -> np.ndarray:
    """For each lexicon term, a row of booleans: the subsets that hold it. Subset k has one term in 2**(k // COPIES + 1)."""
    x = lexicon.astype(np.uint64)
    masks = np.empty((len(x), COPIES * halvings(lexicon)), bool)
    for k in range(masks.shape[1]):
        z = x + np.uint64((SEED + k) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        masks[:, k] = (z >> np.uint64(32)) % np.uint64(2 << k // COPIES) == 0
    return masks


class Fingerprinter:
    def __init__(self, lexicon: np.ndarray):
        self.lexicon, self.masks = lexicon, subset_masks(lexicon)

    def __call__(self, data: bytes) -> str:
        """Subset hashes as hexadecimal digits, one after the other; an empty subset's digits are zeros."""
        terms = _memo.terms(data)
        rows = np.searchsorted(self.lexicon, terms)
        rows = rows[self.lexicon[np.minimum(rows, len(self.lexicon) - 1)] == terms] if len(self.lexicon) else rows[:0]
        if len(rows):
            # The lexicon is sorted, so places of sorted terms are sorted.
            subset, at = np.nonzero(self.masks[rows].T)
            data, ends = self.lexicon[rows[at]].tobytes(), (8 * np.cumsum(np.bincount(subset, minlength=self.masks.shape[1]))).tolist()
        else:
            # No term in the band: all terms stand in, in each subset of the first size.
            all_terms, rest = terms.tobytes(), self.masks.shape[1] - COPIES
            data, ends = all_terms * COPIES, [len(all_terms) * k for k in range(1, COPIES + 1)] + [len(all_terms) * COPIES] * rest
        return "".join(hashlib.blake2b(data[start:end], digest_size=HEX // 2).hexdigest() if start < end else EMPTY for start, end in zip([0, *ends], ends))


def likeness(a: str, b: str) -> float:
    """Among the subsets of compared sizes that either document has terms in, the part with equal hashes; 1 for equal fingerprints.

    Where the subsets of a size begin to be empty tells how many terms a document has: sizes are compared from DENSER before that on.
    """
    if a == b:
        return 1.0
    pairs = [(a[i : i + HEX], b[i : i + HEX]) for i in range(0, len(a), HEX)]
    used = [x != EMPTY or y != EMPTY for x, y in pairs]
    sparse = max((k for k in range(0, len(used), COPIES) if 2 * sum(used[k : k + COPIES]) >= COPIES), default=0)
    first = max(0, sparse - DENSER * COPIES)
    n = sum(used[first:])
    return sum(x == y for (x, y), u in zip(pairs[first:], used[first:], strict=True) if u) / n if n else 0.0


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lexicon: np.ndarray | None = None) -> DataFrame:
    """doc_id and fingerprint of each row. Equal texts have equal fingerprints; null and empty texts have all zeros.

    Null ids and repeated rows are kept; an empty table gives no rows; very long texts are read whole. Other columns, whatever
    their names, are not carried along.
    """
    chosen = lexicon_of(docs, text_col=text_col) if lexicon is None else lexicon
    shared = docs.sparkSession.sparkContext.broadcast(chosen)
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Fingerprinter(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([of(v.as_py()) for v in batch.column(1)], pa.string())], schema=schema)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(fingerprint, "doc_id long, fingerprint string")


def edited_text(text: str, after: str) -> str:
    """The last quarter of the code points replaced by as many from the start of ``after``, or by all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


COMPARED = pa.schema(
    [("part", pa.int32()), ("edge", pa.string()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())]
)
COMPARED_DDL = "part int, edge string, doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, text string"
OUT_ROWS = 2000


def _digits(column: str) -> Column:
    return F.lower(F.hex(column))


def _result(compared: DataFrame) -> DataFrame:
    """Fingerprints are bytes on disk, half as long as their digits."""
    return compared.select("doc_id", "n_chars", "edited_sha256", _digits("fingerprint").alias("fingerprint"), _digits("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next")


def _record(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), COMPARED, strict=True)], schema=COMPARED)


def _compared(of: Fingerprinter, doc_id, text: str, own: str, after: str, after_print: str) -> tuple:
    edited = edited_text(text, after)
    edited_print = of(edited.encode())
    return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), bytes.fromhex(own), bytes.fromhex(edited_print), likeness(own, edited_print), likeness(own, after_print)


def compare_with_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lexicon: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.

    The next document is the one with the next higher id, ties by hash of the text, null ids first; after the last comes the
    first, and a single document is its own next one. Null and empty texts have no terms; repeated rows follow one another; an
    empty table gives no rows; very long texts are read whole; other columns, whatever their names, are not carried along.
    Texts are dealt once, compressed, by ranges of ids and text hashes, so that one id in many rows is divided too, and each task
    walks its range in order. The last row of a range waits for the first of the next one; those two rows per task are written with
    their texts and joined afterwards.
    """
    spark = docs.sparkSession
    chosen = lexicon_of(docs, text_col=text_col) if lexicon is None else lexicon
    shared = spark.sparkContext.broadcast(chosen)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        smaller = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([smaller(v.as_py()) for v in batch.column(2)], pa.binary())], schema=batch.schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, part, plain = Fingerprinter(shared.value), TaskContext.get().partitionId(), zstandard.ZstdDecompressor().decompress
        held, rows = None, []
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                text = plain(value.as_py()).decode("utf-8", "replace")
                own = of(text.encode())
                if held is None:
                    rows.append((part, "first", doc_id, len(text), None, bytes.fromhex(own), None, None, None, text))
                else:
                    rows.append((part, None, *_compared(of, *held, text, own), None))
                held = doc_id, text, own
                if len(rows) >= OUT_ROWS:
                    yield _record(rows)
                    rows = []
        if held is not None:
            rows.append((part, "last", held[0], len(held[1]), None, bytes.fromhex(held[2]), None, None, None, held[1]))
            yield _record(rows)

    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("high"), text.cast("binary").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.mapInArrow(compress, "doc_id long, high long, text binary").repartitionByRange(parts, "doc_id", "high").sortWithinPartitions("doc_id", "high", "text")
    walked = written(dealt.mapInArrow(walk, COMPARED_DDL), "imatch-ranges")

    filled = sorted(r[0] for r in walked.where("edge = 'first'").select("part").collect())
    following = spark.createDataFrame([(p, filled[(i + 1) % len(filled)]) for i, p in enumerate(filled)], "part int, next_part int")
    first = walked.where("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), _digits("fingerprint").alias("next_print"))
    last = walked.where("edge = 'last'").join(F.broadcast(following), "part").join(first, "next_part").select("doc_id", "text", _digits("fingerprint").alias("fingerprint"), "next_text", "next_print")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Fingerprinter(shared.value)
        for batch in batches:
            rows = [(None, None, *_compared(of, *row.values()), None) for row in batch.to_pylist()]
            if rows:
                yield _record(rows)

    return _result(walked.where("edge is null").unionByName(last.mapInArrow(finish, COMPARED_DDL)))
