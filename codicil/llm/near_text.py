"""Near-duplicate documents by a signature-coordinate inverted join.

1. Each text becomes the set of its word shingles (64-bit hashes), its size, a
   128-bit key of the whole set and ``COORDINATES`` min-hash values.
2. Documents with equal sets are one class; only classes go on.
3. Every class is posted under each (coordinate, value) pair.  Pairs that no other
   class has are dropped (skip).  Of the rest a class keeps its rarest ones: two
   classes agreeing in ``MATCHES`` coordinates or more must share one of the first
   ``COORDINATES - MATCHES + 1`` in this order (prefix).
4. Each posting list links its members to a few pivots of the list.  A pair goes on
   if its signatures agree in ``MATCHES`` coordinates, its sizes allow the similarity
   and its parity sketches do (below), and is then confirmed on the full sets.
5. Lists whose members are not yet in one component give the pairs across components,
   under the same condition and each pair in its first list only; these are confirmed
   as well.

So no list yields all of its pairs: members already connected are never compared
again, and of others only pairs that are links or nearly so come out.

The parity sketch has a bit for each of ``PARITY_BITS`` classes of shingles, telling
whether their number is odd.  Bits in which two sketches differ cannot outnumber the
shingles in which the sets differ, and that number decides the similarity: a pair
refused by it is certainly no link.  A pair at similarity 0.8 misses ``MATCHES`` of 32 coordinates with a
probability below 0.0001, one at 0.85 below 0.000001.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil.llm.graph import components
from codicil.llm.shared import stage

COORDINATES = 32
MATCHES = 16
PARITY_BITS = 1024
PIVOTS = 3
SECTION_BYTES = 1 << 18  # of texts hashed together
LONG_WORD = 256

_GOLDEN = 0x9E3779B97F4A7C15
_WORD = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values (two multiply-xorshift rounds)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_SEEDS = _mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(_GOLDEN))
_FACTORS = _SEEDS | np.uint64(1)


_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LETTERS = _mix(np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64) + np.uint64(1))  # A-Z count as a-z
_BASE = int(_SEEDS[0]) | 1


def _powers(base: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(SECTION_BYTES, base, np.uint64)))


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes.

    Some texts are hashed together: a word's hash is what its bytes add to a running sum of
    powers, so it costs a few array operations on all bytes and none of its own.
    """

    def __init__(self, width: int) -> None:
        self.width = width
        self.up, self.down = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))

    def __call__(self, text: str | bytes | None) -> np.ndarray:
        return self.all([text])[0]

    def all(self, texts: list) -> list[np.ndarray]:
        """The shingles of each text."""
        texts = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t or b"" for t in texts]
        found: list[np.ndarray] = []
        first, size = 0, 0
        for i, text in enumerate(texts):
            if size and size + len(text) + 1 > SECTION_BYTES:
                found += self._section(texts[first:i])
                first, size = i, 0
            size += len(text) + 1
        return found + (self._section(texts[first:]) if first < len(texts) else [])

    def _section(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(texts) == 1 and len(texts[0]) >= SECTION_BYTES:  # words of a long text, in runs that end at a blank
            hashes = np.concatenate([self._hashes(np.frombuffer(run, np.uint8))[1] for run in _runs(texts[0])])
            bounds = [0, len(hashes)]
        else:
            ends = np.cumsum([len(t) + 1 for t in texts])
            starts, hashes = self._hashes(np.frombuffer(b" ".join(texts) + b" ", np.uint8))
            bounds = np.append(0, np.searchsorted(starts, ends)).tolist()
        whole = _joined(hashes, self.width) if len(hashes) >= self.width else None
        out = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a < self.width:
                own = _joined(hashes[a:b], b - a, b - a) if b > a else np.empty(0, np.uint64)
            else:
                own = np.sort(whole[a : b - self.width + 1])
                own = own[np.append(True, own[1:] != own[:-1])]
            out.append(own)
        return out

    def _hashes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word starts, and its hash."""
        inside = np.concatenate([[False], ~_SPACE[data], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        if len(data) > SECTION_BYTES:  # one word without end
            return starts, np.array([self._long(data, a, b) for a, b in zip(starts, ends)], np.uint64)
        total = np.append(np.uint64(0), np.cumsum(_LETTERS[data] * self.up[: len(data)]))
        hashes = _mix((total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))
        for i in np.flatnonzero(ends - starts > LONG_WORD):  # sums of powers tell short words apart
            hashes[i] = self._long(data, starts[i], ends[i])
        return starts, hashes

    @staticmethod
    def _long(data: np.ndarray, start: int, end: int) -> int:
        return xxhash.xxh64_intdigest(data[start:end].tobytes().lower())


def _runs(text: bytes) -> Iterator[bytes]:
    """A text cut at blanks into runs of at most ``SECTION_BYTES``, longer only where a word is."""
    at = 0
    while at < len(text):
        end = min(at + SECTION_BYTES, len(text))
        if end < len(text):
            last = _BLANK.search(text[at:end][::-1])
            if last:
                end -= last.start()
            else:
                further = _BLANK.search(text, end)
                end = further.start() if further else len(text)
        yield text[at:end]
        at = end


def _joined(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hashes of each run of ``width`` words."""
    count = len(hashes) - width + 1
    out = np.full(count, seed, np.uint64)
    for i in range(width):
        out = _mix(out * np.uint64(_GOLDEN) + hashes[i : i + count])
    return out


def _parity(shingles: np.ndarray) -> np.ndarray:
    counts = np.bincount((shingles >> np.uint64(40)).astype(np.int64) % PARITY_BITS, minlength=PARITY_BITS)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(COORDINATES, _WORD)
    for i in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[i : i + 4096, None] * _FACTORS[None, :]).min(axis=0))
    return _mix(least ^ _SEEDS)


def _shingled(shingler: Shingler, texts: pa.Array) -> Iterator[np.ndarray]:
    """Each text's shingles, some texts at a time."""
    texts = texts.cast(pa.binary())
    for i in range(0, len(texts), 64):
        yield from shingler.all(texts.slice(i, 64).to_pylist())


_PROFILE = pa.schema(
    [("id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("keys", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64()))]
)


def profiles(documents: DataFrame, width: int, id_column: str, text_column: str) -> DataFrame:
    """One row per document: set size, key of the set, coordinate values, 8 bits of each, parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            sizes, nodes, keys, sketches, parities = [], [], [], [], []
            for found in _shingled(shingler, batch.column(1)):
                sizes.append(len(found))
                if not len(found):
                    nodes.append(None), keys.append(None), sketches.append(None), parities.append(None)
                    continue
                nodes.append(xxhash.xxh3_128_digest(found.tobytes()))
                values = _signature(found)
                keys.append(values.view(np.int64))
                sketches.append((values & np.uint64(0xFF)).astype(np.uint8).view(np.int64))
                parities.append(_parity(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()),
                 pa.array(keys, _PROFILE.field("keys").type), pa.array(sketches, _PROFILE.field("sketch").type), pa.array(parities, _PROFILE.field("parity").type)], schema=_PROFILE,
            )

    text = F.col(text_column).cast("string")
    narrow = documents.select(F.col(id_column).cast("long").alias("id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"))
    return narrow.mapInArrow(run, "id long, text_hash long, n_shingles long, node binary, keys array<long>, sketch array<long>, parity array<long>")


def _differing(a: Column, b: Column) -> Column:
    """Coordinates whose 8 bits differ, from the packed signatures."""

    def word(i: int) -> Column:
        x = a[i].bitwiseXOR(b[i])
        for step in (4, 2, 1):  # the lowest bit of a byte gathers its other bits
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    return sum((word(i) for i in range(1, COORDINATES // 8)), word(0))


def _plausible(similarity: int) -> Column:
    """Sizes and parities allow the similarity (in hundredths) and enough coordinates agree."""
    small, large = F.least("a.n_shingles", "b.n_shingles"), F.greatest("a.n_shingles", "b.n_shingles")
    odd = sum((F.bit_count(F.col("a.parity")[i].bitwiseXOR(F.col("b.parity")[i])) for i in range(1, PARITY_BITS // 64)), F.bit_count(F.col("a.parity")[0].bitwiseXOR(F.col("b.parity")[0])))
    near = odd * (100 + similarity) <= (small + large) * (100 - similarity)
    return (small * 100 >= large * similarity) & near & (_differing(F.col("a.sketch"), F.col("b.sketch")) <= COORDINATES - MATCHES)


def postings(classes: DataFrame) -> DataFrame:
    """``(key, node)`` for the prefix of every class that enough other classes touch."""
    posted = classes.select("node", F.explode("keys").alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    kept = posted.join(shared, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("own"))
    prefix = F.slice("own", 1, F.size("own") - (MATCHES - 1))  # at most COORDINATES entries
    return kept.where(F.size("own") >= MATCHES).select("node", F.explode(prefix).alias("own")).select("own.key", "node")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs of nodes whose full sets reach the similarity, in integers."""
    first = sets.select(F.col("node").alias("left"), F.col("shingles").alias("left_set"))
    second = sets.select(F.col("node").alias("right"), F.col("shingles").alias("right_set"))
    both = F.size(F.array_intersect("left_set", "right_set")).cast("long")
    union = (F.size("left_set") + F.size("right_set")).cast("long") - F.col("both")
    joined = pairs.join(first, "left").join(second, "right").select("left", "right", "left_set", "right_set", both.alias("both"))
    return joined.where(F.col("both") * 100 >= union * similarity).select("left", "right")


def _sets(documents: DataFrame, classes: DataFrame, posted: DataFrame, width: int, id_column: str, text_column: str) -> DataFrame:
    """``(node, shingles)`` of the classes that were posted, from one document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                found = list(_shingled(shingler, batch.column(0).slice(i, 512)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in found], pa.binary()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))],
                    names=["node", "shingles"],
                )

    wanted = classes.join(posted.select("node").distinct(), "node", "left_semi").select(F.col("id").alias("wanted"), F.lit(True).alias("hit"))
    texts = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    texts = texts.join(wanted.select("wanted").distinct(), F.col("id").eqNullSafe(F.col("wanted")), "left_semi").select("text")
    return texts.mapInArrow(run, "node binary, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles"))


def near_duplicate_classes(
    documents: DataFrame, width: int = 5, similarity: int = 80, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per document ``id, text_hash, n_shingles, component, component_id, kept``; ``similarity`` is in hundredths.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  Fewer words than
    ``width`` make one shingle; a null, empty or blank text has an empty set and is
    linked with nothing.  Equal sets are linked.  ``component_id`` is the smallest id
    reachable by links, ``component`` (null for an empty set) tells components without any id apart.  Rows are kept if they carry it (rows repeating an id repeat
    their result; a row without an id is kept if its class has no id at all).  Other
    columns of ``documents`` are not read.  An empty table gives no rows.
    """
    profiled = stage(profiles(documents, width, id_column, text_column), "profiles")
    classes = stage(
        profiled.where("node is not null").groupBy("node").agg(
            F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.first("parity").alias("parity"),
        ),
        "classes",
    )
    links = class_links(documents, classes, width, similarity, id_column, text_column)
    joined = components(links, "left", "right")
    roots = classes.select("node", "id").join(joined, "node", "left").select("node", "id", F.coalesce("component", "node").alias("component"))
    least = roots.groupBy("component").agg(F.min("id").alias("component_id"))
    named = roots.join(least, "component").select("node", "component", "component_id")
    out = profiled.select("id", "text_hash", "n_shingles", "node").join(named, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", "text_hash", "n_shingles", "component", own.alias("component_id")).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def class_links(documents: DataFrame, classes: DataFrame, width: int, similarity: int, id_column: str, text_column: str) -> DataFrame:
    """Confirmed links that connect the same classes as all links would."""
    posted = stage(postings(classes), "postings")
    prefixes = posted.groupBy("node").agg(F.collect_list("key").alias("prefix"))  # at most COORDINATES keys a node
    signed = stage(classes.select("node", "n_shingles", "sketch", "parity").join(prefixes, "node"), "signed")
    sets = stage(_sets(documents, classes, posted, width, id_column, text_column), "sets")

    starred = _signed_pairs(_stars(posted), signed, similarity)
    links = stage(_confirmed(starred, sets, similarity), "star-links")
    open_lists = _open_lists(posted, links)
    rest = stage(open_lists.join(signed, "node"), "open-lists")
    first_key = F.array_min(F.array_intersect("a.prefix", "b.prefix")) == F.col("a.key")
    same_list = (F.col("a.key") == F.col("b.key")) & (F.col("a.component") < F.col("b.component"))
    across = rest.alias("a").join(rest.alias("b"), same_list & _plausible(similarity) & first_key)
    across = across.select(F.least("a.node", "b.node").alias("left"), F.greatest("a.node", "b.node").alias("right"))
    return stage(links.unionAll(_confirmed(across, sets, similarity)), "links")


def _stars(lists: DataFrame) -> DataFrame:
    """Pairs of each member of a list with the list's pivots, each pair once."""
    marks = [F.min_by("node", F.xxhash64("node", "key", F.lit(i))) for i in range(PIVOTS)]
    pivots = lists.groupBy("key").agg(F.array_distinct(F.array(*marks)).alias("pivots"))
    pairs = lists.join(pivots, "key").select("node", F.explode("pivots").alias("pivot")).where("node != pivot")
    return pairs.select(F.least("node", "pivot").alias("left"), F.greatest("node", "pivot").alias("right")).distinct()


def _open_lists(posted: DataFrame, links: DataFrame) -> DataFrame:
    """``key, node, component`` of the lists whose members are in several components."""
    joined = components(links, "left", "right")
    marked = posted.join(joined, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    several = marked.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    return stage(marked.join(several.select("key"), "key", "left_semi"), "open-lists")


def _signed_pairs(pairs: DataFrame, signed: DataFrame, similarity: int) -> DataFrame:
    fields = F.struct("n_shingles", "sketch", "parity")
    a, b = signed.select(F.col("node").alias("left"), fields.alias("a")), signed.select(F.col("node").alias("right"), fields.alias("b"))
    return pairs.join(a, "left").join(b, "right").where(_plausible(similarity)).select("left", "right")
