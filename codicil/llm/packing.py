"""Best-fit packing of documents into sequences, after a dominance reduction.

Only documents longer than a sequence are cut.  What is packed is described by its
histogram of lengths, which has at most ``capacity`` entries however large the corpus
is; the plan is made from it on the driver:

1. Reduction (Martello and Toth): a sequence holding the item and at most one more is
   fixed for good where it provably dominates every other sequence with that item: the
   two fill it exactly, nothing else fits, or at most one more item fits and the largest
   that does is taken (also if two more fit, but never more than the best single one).
2. Best-fit decreasing of the remainder, a whole class of equal items at a time.

The plan is a list of patterns, each with its number of sequences.  Pieces are then
numbered within their length (in hashed buckets, so a length that a third of all
pieces share is not gathered in one task) and the number gives sequence and offset.
"""

from __future__ import annotations

import bisect
import functools
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codicil.llm.shared import stage

KNOWN_CHUNKS = 1_000_000  # of a worker; some 200 bytes each
KNOWN_BYTES = 96 << 20
BUCKET_ROWS = 200
MAX_BUCKETS = 4_096

Pattern = tuple[int, tuple[tuple[int, int], ...]]  # number of sequences, ((length, items of it), ...)


def _chunks(raw: bytes) -> list[bytes]:
    if b"<|" in raw:  # added tokens mind the case
        return raw.split()
    return raw.lower().split() if raw.isascii() else [c.lower() if c.isascii() else c for c in raw.split()]


class ChunkEncoder:
    """Ids of whole texts by the tokenizers library, each distinct chunk encoded once.

    For tokenizers that lower texts and drop white space: a text's ids are those of its
    chunks between ASCII white space, one after the other.  Only ASCII chunks are lowered
    before the tokenizer sees them: it composes marks first, and some compose with small
    letters only.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > KNOWN_CHUNKS or self.held > KNOWN_BYTES:
            self.known.clear()
            self.held = 0
        cut = [_chunks(t.encode("utf-8")) for t in texts]
        new = sorted({c for chunks in cut for c in chunks}.difference(self.known))
        for i in range(0, len(new), 2048):
            part = new[i : i + 2048]
            for chunk, found in zip(part, self.tokenizer.encode_batch_fast([c.decode("utf-8") for c in part], add_special_tokens=False), strict=True):
                self.known[chunk] = np.array(found.ids, np.uint32).tobytes()
                self.held += len(chunk) + 4 * len(found.ids)
        known = self.known.__getitem__
        return [b"".join(map(known, chunks)) for chunks in cut]


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)  # kept by the worker from task to task


def cut_pieces(documents: DataFrame, path: str, end_id: int, capacity: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: ``id, piece, start, length, ids_crc32``; every text ends with ``end_id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(path), np.uint32(end_id).tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, rows = batch.slice(i, 256), []
                for key, ids in zip(part.column(0).to_pylist(), encoder.encode([t.as_py() or "" for t in part.column(1)]), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        rows.append((key, k, at // 4, len(own) // 4, zlib.crc32(own)))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["id", "piece", "start", "length", "ids_crc32"])

    texts = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return texts.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


class _Lengths:
    """Numbers of items left, by length."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.left = {k: v for k, v in counts.items() if v > 0}
        self.order = sorted(self.left)

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.order.remove(length)

    def smallest(self, n: int, without: int) -> list[int]:
        """The ``n`` smallest items besides one of length ``without``."""
        out: list[int] = []
        for length in self.order:
            out += [length] * min(n - len(out), self.left[length] - (length == without))
            if len(out) == n:
                break
        return out

    def largest_fitting(self, room: int, without: int) -> int | None:
        i = bisect.bisect_right(self.order, room) - 1
        while i >= 0:
            length = self.order[i]
            if self.left[length] > (length == without):
                return length
            i -= 1
        return None

    def best_pair(self, room: int, without: int) -> int:
        """Largest sum of two items that fits, 0 if none does."""
        best, low, high = 0, 0, len(self.order) - 1
        while low <= high:
            a, b = self.order[low], self.order[high]
            have = self.left[a] - (a == without), self.left[b] - (b == without)
            if a + b > room or have[1] < 1:
                high -= 1
            elif have[0] < 1 or (low == high and have[0] < 2):
                low += 1
            else:
                best, low = max(best, a + b), low + 1
        return best


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Patterns that some best packing holds, and the numbers of items that remain."""
    items, fixed = _Lengths(counts), []

    def fix(length: int, other: int | None) -> None:
        if other is None:
            n = items.left[length]
            fixed.append((n, ((length, 1),)))
        elif other == length:
            n = items.left[length] // 2
            fixed.append((n, ((length, 2),)))
            items.take(length, n)
        else:
            n = min(items.left[length], items.left[other])
            fixed.append((n, ((length, 1), (other, 1))))
            items.take(other, n)
        items.take(length, n)

    for length in list(items.order):  # exact pairs, whatever else fits
        other = capacity - length
        if length <= other and items.left.get(length) and items.left.get(other, 0) > (length == other):
            fix(length, other)
    changed = True
    while changed:
        changed = False
        for length in items.order[::-1]:
            while items.left.get(length):
                room = capacity - length
                small = items.smallest(3, length)
                if not small or small[0] > room:
                    fix(length, None)
                elif len(small) < 2 or sum(small[:2]) > room:
                    fix(length, items.largest_fitting(room, length))
                elif len(small) < 3 or sum(small) > room:
                    single = items.largest_fitting(room, length)
                    if single is None or single < items.best_pair(room, length):
                        break
                    fix(length, single)
                else:
                    break
                changed = True
    return fixed, items.left


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing; equal items and equal sequences are handled together."""
    open_at: dict[int, list[tuple[int, Counter]]] = {}
    rooms: list[int] = []  # sorted keys of open_at
    done: list[tuple[int, Counter]] = []

    def put(room: int, n: int, held: Counter) -> None:
        if not room:
            done.append((n, held))
        elif room in open_at:
            open_at[room].append((n, held))
        else:
            open_at[room] = [(n, held)]
            bisect.insort(rooms, room)

    for length in sorted((k for k, v in counts.items() if v > 0), reverse=True):
        left = counts[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                room, n, held = capacity, left, Counter()  # as many new ones as are needed
            else:
                room = rooms[i]
                n, held = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room], rooms[i]
            each = room // length
            full = min(n, left // each)
            if full:
                put(room - each * length, full, held + Counter({length: each}))
                left -= full * each
                n -= full
            if n and 0 < left < each:
                put(room - left * length, 1, held + Counter({length: left}))
                left, n = 0, n - 1
            if n and held:
                put(room, n, held)
    done += [g for own in open_at.values() for g in own]
    return [(n, tuple(sorted(held.items(), reverse=True))) for n, held in done]


def slots_of(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For each length and stretch of its items: first item, first sequence, items a sequence, offset."""
    rows, used, first = [], Counter(), 0
    for n, held in patterns:
        offset = 0
        for length, each in held:
            rows.append((length, used[length], first, each, offset))
            used[length] += n * each
            offset += length * each
        first += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "item", "sequence", "each", "offset"), table.T, strict=True))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (with ``id, piece, start, length, ids_crc32``) and ``sequence_id, offset``.

    No length may exceed ``capacity``.  Sequences are numbered from 0 and filled from
    offset 0 without gaps.  Repeated rows are packed as often as they occur; an empty
    table gives no rows.
    """
    histogram = pieces.groupBy("length").count()
    counts = {r["length"]: r["count"] for r in histogram.collect()}  # at most `capacity` rows
    fixed, rest = reduce_by_dominance(counts, capacity)
    slots = slots_of(fixed + best_fit(rest, capacity))

    # The number of a piece among those of its length: bucket offsets, then the place in the bucket.
    buckets = F.broadcast(histogram.select("length", F.least(F.lit(MAX_BUCKETS), F.ceil(F.col("count") / BUCKET_ROWS)).cast("long").alias("buckets")))
    dealt = pieces.join(buckets, "length").withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), "buckets")).drop("buckets")
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    starts = sizes.select("length", "bucket", before.alias("before"))  # at most MAX_BUCKETS rows a length
    place = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece", "start", "ids_crc32")).cast("long") - 1
    numbered = dealt.withColumn("place", place).join(starts, ["length", "bucket"])
    numbered = numbered.select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("item"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.searchsorted(slots["length"], np.arange(capacity + 2))
        for batch in batches:
            length, item = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "item"))
            at = np.empty(len(length), np.int64)
            for own in np.unique(length):
                mask, a, b = length == own, low[own], low[own + 1]
                at[mask] = a + np.searchsorted(slots["item"][a:b], item[mask], "right") - 1
            nth = item - slots["item"][at]
            each = slots["each"][at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(slots["sequence"][at] + nth // each), pa.array(slots["offset"][at] + nth % each * length)],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    return numbered.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(documents: DataFrame, path: str, end_id: int = 1, capacity: int = 4096, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Tokenises whole texts, cuts the longer ones and packs the pieces; see ``pack``.

    A null text counts as empty and gives one piece with the end id alone.
    """
    return pack(stage(cut_pieces(documents, path, end_id, capacity, id_column, text_column), "pieces"), capacity)
