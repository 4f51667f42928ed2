"""Hierarchical multi-length packing.

Documents are tokenised where they are read and packed by the task that read them: nothing is
shuffled, so the cost stays linear and an executor that is lost only repeats its own input splits.
A document goes to the tier of the smallest window that holds it. The longest tier is packed first;
a window's gap takes the longest piece of a shorter tier that fits whole, and if none fits, a piece
is cut to fill it. So every window of a tier is full. Only the last tokens of a task, fewer than one
window, are left: they fill ever shorter power-of-two windows, twelve at most, without padding.
Windows of one tier are dealt to step groups of equal tokens so that their attention costs are alike.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocab import word_memo

TIERS = (512, 1024, 2048, 4096)
SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long, tier int, step_group long, sequence_cost long"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64()), ("sequence_cost", pa.int64())]
)
#: Rows of an output batch; with pieces of at most 4096 ids, 64 MB at most.
OUT_ROWS = 4096
#: Bytes of ids that wait for windows before these are packed: 2 million tokens.
POOL_BYTES = 8 << 20


class TierPacker:
    """Packs pieces ``(length, order, doc_id, start, doc_tokens, ids)``; ``pool`` is kept sorted by length."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers, self.pool, self.order = tuple(sorted(tiers)), [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, longest = len(ids) // 4, self.tiers[-1]
        for start in range(0, total, longest):
            self._put(doc_id, start, total, ids[4 * start : 4 * (start + longest)])

    def _put(self, doc_id, start, total, ids) -> None:
        self.order += 1
        insort(self.pool, (len(ids) // 4, self.order, doc_id, start, total, ids))

    def _cut(self, at: int, room: int) -> tuple:
        """The head of ``room`` ids of the piece at ``at``; its rest goes back to the pool."""
        _, order, doc_id, start, total, ids = self.pool.pop(at)
        self._put(doc_id, start + room, total, ids[4 * room :])
        return room, order, doc_id, start, total, ids[: 4 * room]

    def _fill(self, size: int) -> tuple[list[tuple], int]:
        window, gap = [], size
        while gap and self.pool:
            fits = bisect_left(self.pool, (gap + 1,))
            window.append(self.pool.pop(fits - 1) if fits else self._cut(-1, gap))
            gap -= window[-1][0]
        return window, gap

    def full(self) -> Iterator[tuple[int, list[tuple]]]:
        """All windows that can be filled; the rest, less than a window, stays in the pool."""
        while self.pool:
            size = self.tiers[bisect_left(self.tiers, self.pool[-1][0])]
            window, gap = self._fill(size)
            if gap:
                for piece in window:
                    insort(self.pool, piece)
                return
            yield size, window

    def rest(self) -> Iterator[tuple[int, list[tuple]]]:
        """What ``full`` left, in windows of the powers of two that add up to it."""
        left = sum(piece[0] for piece in self.pool)
        while left:
            size = 1 << (left.bit_length() - 1)
            yield size, self._fill(size)[0]
            left -= size


def step_groups(windows: list[tuple[int, list[tuple]]], step_tokens: int) -> list[tuple[int, int]]:
    """(group, cost) of each window: windows of a tier by falling cost, dealt back and forth over its groups."""
    costs = [sum(p[0] * p[0] for p in pieces) for _, pieces in windows]
    by_tier, out, first = defaultdict(list), [(0, 0)] * len(windows), 0
    for k, (size, _) in enumerate(windows):
        by_tier[size].append(k)
    for size, members in sorted(by_tier.items()):
        groups = -(-len(members) // max(1, step_tokens // size))
        for rank, k in enumerate(sorted(members, key=lambda k: -costs[k])):
            lap, at = divmod(rank, groups)
            out[k] = first + (groups - 1 - at if lap % 2 else at), costs[k]
        first += groups
    return out


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, tiers: tuple[int, ...] = TIERS, step_tokens: int = 32 * 4096, spell_special: bool = False) -> DataFrame:
    """One row per piece of a document: where it starts in the document, and in which sequence at which offset it lies.

    ``tiers`` are window sizes, powers of two. Null and empty texts are ``end_id`` alone; a null id stays
    null; repeated rows are packed once each; other columns, whatever their names, are not carried along. An empty table gives
    no rows. A text of any length is cut into pieces of the longest window and a rest. ``sequence_id`` and
    ``step_group`` hold the task's number in their upper bits: unique, not gapless. A step group holds windows of
    one tier with ``step_tokens`` tokens at most, and at least one window. Texts that hold a special token's string get that
    token, as the tokenizer does when loaded; ``spell_special`` spells such strings out, so that texts can't forge them.
    """
    if any(t < 1 or t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    end = end_id.to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, packer = word_memo(path, spell_special), TierPacker(tiers)
        context = TaskContext.get()
        sequence = group = (context.partitionId() if context else 0) << 33

        def rows(windows):
            nonlocal sequence, group
            out = []
            dealt = step_groups(windows, step_tokens)
            for (size, pieces), (own, cost) in zip(windows, dealt, strict=True):
                offset = 0
                for n, _, doc_id, start, total, ids in pieces:
                    out.append((doc_id, start, n, total, ids, sequence, offset, size, group + own, cost))
                    offset += n
                sequence += 1
                if len(out) >= OUT_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)
                    out = []
            group += 1 + max((g for g, _ in dealt), default=-1)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)

        for batch in batches:
            waiting = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, ids := memo.encode(text.as_py()) + end)
                waiting += len(ids)
                if waiting > POOL_BYTES:
                    yield from rows(list(packer.full()))
                    waiting = 0
            yield from rows(list(packer.full()))
        yield from rows(list(packer.rest()))

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(pack, SCHEMA)
