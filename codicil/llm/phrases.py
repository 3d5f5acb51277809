"""Phrases that words form together, by set-oriented mining of sorted occurrence relations.

Relation ``k`` says at which places which frequent phrase of ``k`` words begins.  It is a
written table, nested by block: a row holds one block's places in ascending order and,
beside them, the phrases (packed integers, byte by byte of equal weight and compressed, which Spark moves as a whole).  A block is a run of ``BLOCK_WORDS`` places of any texts; a
piece's end takes a place of its own, so neighbouring places are neighbouring words of
one piece, and the words behind a block's end that its last phrases reach into are
repeated as a look-ahead.  Texts and pieces of any length are cut into blocks, so a
task holds one block at a time.

Length ``k + 1`` follows from length ``k`` by a merge join of relation ``k`` with
itself on neighbouring places: both phrases of ``k`` words must be frequent.  Each block counts its own distinct candidates and deals
them out by a hash of the phrase, a row of arrays for each part; a part adds up its
candidates over all blocks and answers each block with those that reach ``min_count``,
which alone stay in the relation before the next length.  Phrases are compared as
numbers that stand for exactly one text each, never as hashes.  A word that makes up a
third of a corpus is one entry a block.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codicil.llm.shared import stage

BLOCK_WORDS = 1 << 18
PART_WORDS = 1 << 20  # places whose candidates meet in one part
UNDETERMINED = "und"

_LEVEL = 9  # what is packed is moved or written several times
_PLAINLY = 0x80  # marks numbers that are not compressed
_BREAK, _SKIP, _AHEAD = -1, -2, -3  # an item below _SKIP is look-ahead: _AHEAD minus its code
_PUNCTUATION = b".,;:!?\n\x0b\x0c\r"
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_PLAIN = bytes.maketrans(_PUNCTUATION + b"\t" + _UPPER, b"\n" * len(_PUNCTUATION) + b" " + _LOWER)

_BLOCK = pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("count", pa.int64()), ("size", pa.int64()), ("items", pa.binary()), ("langs", pa.list_(pa.string())), ("totals", pa.list_(pa.int64()))])
_BLOCK_DDL = "block long, keys binary, count long, size long, items binary, langs array<string>, totals array<long>"
# Places in order, the phrase at each (a number of the block), and the block's phrases' ids; the first ``own`` places are not look-ahead.
_RELATION = pa.schema([("block", pa.int64()), ("own", pa.int64()), ("size", pa.int64()), ("places", pa.binary()), ("grams", pa.binary()), ("count", pa.int64()), ("ids", pa.binary())])
_RELATION_DDL = "block long, own long, size long, places binary, grams binary, count long, ids binary"
_DEALT_WORDS = "part long, block long, count long, codes binary, n binary, keys binary"
_DEALT_PHRASES = "part long, block long, count long, codes binary, n binary, first binary, last binary"


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes each as all of them need."""
    low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    for kind in (np.int8, np.int16, np.int32):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return values.astype(kind)
    return values.astype(np.int64)


def _packed(values: np.ndarray) -> bytes:
    """A byte that gives the numbers' width, then their bytes: all lowest ones first, compressed if that pays."""
    values = np.ascontiguousarray(_narrow(values))
    raw = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    packed = pa.Codec("zstd", compression_level=_LEVEL).compress(raw, asbytes=True) if len(raw) > 16 else raw
    return bytes([values.itemsize]) + packed if len(packed) < len(raw) else bytes([values.itemsize | _PLAINLY]) + raw


def _unpacked(value: pa.Scalar, count: int) -> np.ndarray:
    """``count`` numbers of any width."""
    if not count:
        return np.empty(0, np.int64)
    packed = value.as_buffer()
    width, raw = packed[0] & ~_PLAINLY, packed.slice(1)
    if not packed[0] & _PLAINLY:
        raw = pa.decompress(raw, decompressed_size=count * width, codec="zstd")
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, count).T).view(f"i{width}").ravel()


def _packed_lines(lines: list[bytes]) -> bytes:
    """Four bytes that give the size of the joined lines, then these, compressed."""
    raw = b"\n".join(lines)
    return len(raw).to_bytes(4, "little") + pa.Codec("zstd", compression_level=_LEVEL).compress(raw, asbytes=True)


def _lines(value: pa.Scalar) -> list[bytes]:
    packed = value.as_buffer()
    size = int.from_bytes(packed.slice(0, 4).to_pybytes(), "little")
    return pa.decompress(packed.slice(4), decompressed_size=size, codec="zstd", asbytes=True).split(b"\n")


def _steps(values: np.ndarray, starts: Sequence[int] | np.ndarray = (0,)) -> np.ndarray:
    """Differences of rising numbers, from 0 at each of ``starts``: small where the numbers are close."""
    out = np.diff(values, prepend=0)
    heads = np.asarray(starts)[np.asarray(starts) < len(values)]
    out[heads] = values[heads]
    return _narrow(out)


def _summed(value: pa.Scalar, count: int) -> np.ndarray:
    return np.cumsum(_unpacked(value, count), dtype=np.int64)


def _packed_slices(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary column whose rows are the slices of ``values`` from each start to the next."""
    return pa.array([_packed(values[a:b]) for a, b in zip(starts, [*starts[1:], len(values)], strict=True)], pa.binary())


def _listed(values: pa.Array, nulls: int) -> pa.Array:
    """A list column: all of ``values``, then ``nulls`` rows without."""
    return pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), pa.nulls(nulls, pa.list_(values.type))])


class _Codes(dict):
    """Codes of the words of one language in one block, given out as words turn up."""

    def __init__(self, lang: str, keys: list[str]) -> None:
        super().__init__({b"": _SKIP, b"\n": _BREAK})
        self.lang, self.keys = lang.replace("\t", "\tt").replace("\n", "\tn"), keys  # on one line

    def __missing__(self, word: bytes) -> int:
        self.keys.append(f"{word.decode('utf-8', 'replace')} {self.lang}")
        code = self[word] = len(self.keys) - 1
        return code


class _Block:
    def __init__(self) -> None:
        self.keys: list[str] = []  # "word language"; words have no blank
        self.items: list[np.ndarray] = []
        self.size = 0
        self.codes: dict[str, _Codes] = {}
        self.totals: dict[str, int] = {}

    def add(self, lang: str, tokens: list[bytes], ahead: list[bytes]) -> None:
        codes = self.codes.get(lang)
        if codes is None:
            codes = self.codes[lang] = _Codes(lang, self.keys)
        items = np.fromiter(map(codes.__getitem__, tokens), np.int32, len(tokens))
        items = items[items != _SKIP]
        further = np.array([_AHEAD - codes[w] for w in ahead], np.int32)
        self.items += [items, further, np.array([_BREAK], np.int32)]
        self.size += len(items) + 1
        self.totals[lang] = self.totals.get(lang, 0) + int((items >= 0).sum())


def _ahead(tokens: list[bytes], at: int, words: int) -> list[bytes]:
    """The next ``words`` words of the piece that goes on at ``at``."""
    found: list[bytes] = []
    while at < len(tokens) and len(found) < words and tokens[at] != b"\n":
        if tokens[at]:
            found.append(tokens[at])
        at += 1
    return found


def _blocks(documents: DataFrame, text_column: str, lang_column: str, longest: int, block_words: int) -> DataFrame:
    texts = documents.select(
        F.coalesce(F.col(lang_column).cast("string"), F.lit(UNDETERMINED)).alias("lang"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 32, _Block()

        def closed() -> pa.RecordBatch:
            items = np.concatenate(block.items)
            columns = [[number], [_packed_lines([k.encode() for k in block.keys])], [len(block.keys)], [len(items)], [_packed(items)], [list(block.totals)], [list(block.totals.values())]]
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _BLOCK, strict=True)], schema=_BLOCK)

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                tokens, at = text.as_py().translate(_PLAIN).replace(b"\n", b" \n ").split(b" "), 0
                name = lang.as_py()
                while at < len(tokens):
                    end = min(len(tokens), at + max(block_words - block.size, 1))
                    block.add(name, tokens[at:end], _ahead(tokens, end, longest - 1))
                    at = end
                    if block.size >= block_words or at < len(tokens):  # look-ahead ends a block
                        yield closed()
                        number, block = number + 1, _Block()
        if block.size:
            yield closed()

    return texts.mapInArrow(run, _BLOCK_DDL)


def _dealt(block: int, part: np.ndarray, n: np.ndarray, keys: dict[str, np.ndarray] | list[bytes]) -> pa.RecordBatch:
    """A row for each part that a block has candidates for: their numbers in the block, their counts and keys."""
    order = np.argsort(part, kind="stable")
    parts, starts = np.unique(part[order], return_index=True)
    sizes = np.diff(np.append(starts, len(order)))
    columns = {"part": pa.array(parts.astype(np.int64)), "block": pa.array(np.full(len(parts), block)), "count": pa.array(sizes)}
    columns |= {"codes": _packed_slices(_steps(order, starts), starts), "n": _packed_slices(n[order], starts)}
    if isinstance(keys, dict):
        columns |= {"first": _packed_slices(_steps(keys["first"][order], starts), starts), "last": _packed_slices(keys["last"][order], starts)}
    else:
        columns["keys"] = pa.array([_packed_lines([keys[i] for i in order[a : a + size]]) for a, size in zip(starts, sizes, strict=True)], pa.binary())
    return pa.RecordBatch.from_pydict(columns)


def _word_counts(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's words; look-ahead does not count."""
        for batch in batches:
            for block, keys, count, size, items in zip(*batch.columns, strict=True):
                if count.as_py():
                    own, words = _unpacked(items, size.as_py()), _lines(keys)
                    part = np.fromiter((zlib.crc32(w) % parts for w in words), np.int64, len(words))
                    yield _dealt(block.as_py(), part, np.bincount(own[own >= 0], minlength=len(words)), words)

    return run


def _relation(row: Sequence[pa.Scalar]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """own, places, grams, ids"""
    _, own, size, places, grams, count, ids = row
    size = size.as_py()
    return own.as_py(), _summed(places, size), _unpacked(grams, size), _summed(ids, count.as_py())


def _merged(places: np.ndarray, grams: np.ndarray, ids: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge join of a relation with itself on the next place.

    Returned are the rows that have a neighbour, their candidates as numbers of this block, and
    for each candidate the ids of its two phrases and its part.  Candidates are numbered part by part, and
    in a part by their phrases' ids, so what a part gets of a block is a run of numbers.
    """
    rows = np.flatnonzero(np.diff(places) == 1)
    width = int(grams.max()) + 1 if len(grams) else 1
    pairs, number = np.unique(grams[rows].astype(np.int64) * width + grams[rows + 1], return_inverse=True)
    first, last = ids[pairs // width].astype(np.int64), ids[pairs % width].astype(np.int64)
    mixed = (first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (last.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    part = ((mixed >> np.uint64(29)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    new = np.empty(len(order), np.int32)
    new[order] = np.arange(len(order), dtype=np.int32)
    return rows, new[number], first[order], last[order], part[order]


def _candidate_counts(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's candidates of one word more; look-ahead does not count."""
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                own, places, grams, ids = _relation(row)
                rows, number, first, last, part = _merged(places, grams, ids, parts)
                if len(first):
                    yield _dealt(row[0].as_py(), part, np.bincount(number[rows < own], minlength=len(first)), {"first": first, "last": last})

    return run


Grouped = tuple[np.ndarray, dict[str, pa.Array]]  # the number of each entry's group, the groups' keys


def _words_grouped(dealt: pa.Table) -> Grouped:
    keys = pa.array([w.decode() for row in dealt.column("keys") for w in _lines(row)], pa.string()).dictionary_encode()
    return keys.indices.to_numpy().astype(np.int64), {"keys": keys.dictionary}


def _phrases_grouped(dealt: pa.Table) -> Grouped:
    sizes = dealt.column("count").to_pylist()
    first = np.concatenate([_summed(v, n) for v, n in zip(dealt.column("first"), sizes, strict=True)])
    last = np.concatenate([_unpacked(v, n) for v, n in zip(dealt.column("last"), sizes, strict=True)]).astype(np.int64)
    order = np.lexsort((last, first))
    own = np.append(True, (np.diff(first[order]) != 0) | (np.diff(last[order]) != 0))
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(own) - 1
    heads = order[own]
    return group, {"first": pa.array(first[heads]), "last": pa.array(last[heads])}


def _frequent(min_count: int, parts: int, grouped: Callable[[pa.Table], Grouped], last: bool):
    def run(dealt: pa.Table) -> pa.Table:
        """One part over all blocks: what is frequent there (a row without block), and, but for the last length, each block's share of it."""
        sizes = dealt.column("count").to_pylist()
        group, keys = grouped(dealt)
        codes = np.concatenate([_summed(v, n) for v, n in zip(dealt.column("codes"), sizes, strict=True)])
        n = np.concatenate([_unpacked(v, n) for v, n in zip(dealt.column("n"), sizes, strict=True)])
        total = np.bincount(group, n).astype(np.int64)  # exact below 2^53
        often = total >= min_count
        ids = (np.cumsum(often) - 1) * parts + dealt.column("part")[0].as_py()
        groups = {"id": pa.array(ids[often]), "n": pa.array(total[often])} | {k: v.filter(pa.array(often)) for k, v in keys.items()}
        if last:
            none = {"block": pa.nulls(1, pa.int64()), "count": pa.array([0]), "codes": pa.nulls(1, pa.binary()), "ids": pa.nulls(1, pa.binary())}
            return pa.table(none | {name: _listed(v, 0) for name, v in groups.items()})
        kept = often[group]
        row = np.repeat(np.arange(len(sizes)), sizes)[kept]
        starts = np.searchsorted(row, np.arange(len(sizes)))
        shares = {"codes": _steps(codes[kept], starts), "ids": _steps(ids[group[kept]], starts)}
        columns = {"block": pa.concat_arrays([pa.array([None], pa.int64()), *dealt.column("block").chunks]), "count": pa.array([0, *np.diff(np.append(starts, len(row))).tolist()], pa.int64())}
        columns |= {name: pa.concat_arrays([pa.nulls(1, pa.binary()), _packed_slices(v, starts)]) for name, v in shares.items()}
        return pa.table(columns | {name: _listed(v, len(sizes)) for name, v in groups.items()})

    return run


_NOTHING = _RELATION.empty_table()


def _renumbered(kept: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """New numbers of a block's old codes (-1: not frequent) in the order of their ids, and the frequent ones' ids."""
    sizes = kept.column("count").to_pylist()
    codes = np.concatenate([_summed(v, n) for v, n in zip(kept.column("codes"), sizes, strict=True)])
    ids = np.concatenate([_summed(v, n) for v, n in zip(kept.column("ids"), sizes, strict=True)])
    order = np.argsort(ids)
    new = np.full(size, -1, np.int32)
    new[codes[order]] = np.arange(len(codes), dtype=np.int32)
    return new, ids[order]


def _table(block: int, own: int, places: np.ndarray, grams: np.ndarray, ids: np.ndarray) -> pa.Table:
    row = [block, own, len(places), _packed(_steps(places)), _packed(grams), len(ids), _packed(_steps(ids))]
    return pa.Table.from_arrays([pa.array([v], t.type) for v, t in zip(row, _RELATION, strict=True)], schema=_RELATION)


def _frequent_words(blocks: pa.Table, kept: pa.Table) -> pa.Table:
    """Relation 1 of a block: the places of its frequent words."""
    if not blocks.num_rows or not kept.num_rows:
        return _NOTHING
    block, count, size, items = (blocks.column(c)[0] for c in ("block", "count", "size", "items"))
    items = _unpacked(items, size.as_py()).astype(np.int64)
    new, ids = _renumbered(kept, count.as_py())
    word = np.where(items <= _AHEAD, _AHEAD - items, items)
    number = np.where(word >= 0, new[word], -1)
    places = np.flatnonzero(number >= 0)
    return _table(block.as_py(), int((items[places] >= 0).sum()), places, number[places], ids)


def _frequent_phrases(parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(relations: pa.Table, kept: pa.Table) -> pa.Table:
        """The next relation of a block: its candidates that are frequent everywhere together."""
        if not relations.num_rows or not kept.num_rows:
            return _NOTHING
        row = [c[0] for c in relations.columns]
        own, places, grams, ids = _relation(row)
        rows, number, first, _, _ = _merged(places, grams, ids, parts)
        new, ids = _renumbered(kept, len(first))
        grams = new[number]
        rows, grams = rows[grams >= 0], grams[grams >= 0]
        return _table(row[0].as_py(), int((rows < own).sum()), places[rows], grams, ids)

    return run


def _agreed(dealt: DataFrame, keys: dict[str, str], min_count: int, parts: int, purpose: str, last: bool = False) -> tuple[DataFrame, DataFrame]:
    """``id, n`` and the keys of the frequent groups, and each block's frequent numbers (none for the ``last`` length, which is read once)."""
    grouped = _words_grouped if "keys" in keys else _phrases_grouped
    names = {"id": "long", "n": "long"} | keys
    ddl = ", ".join(["block long, count long, codes binary, ids binary"] + [f"{c} array<{t}>" for c, t in names.items()])
    found = dealt.groupBy("part").applyInArrow(_frequent(min_count, parts, grouped, last), ddl)
    found = found if last else stage(found, purpose)
    groups = found.where("block is null").select(F.inline(F.arrays_zip(*names)))
    return groups, found.where("block is not null and count > 0").select("block", "count", "codes", "ids")


def _extended(relation: DataFrame, kept: DataFrame, function) -> DataFrame:
    """Semi-join: only what is frequent stays in the blocks."""
    return relation.groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(function, _RELATION_DDL)


def frequent_phrases(
    documents: DataFrame, min_count: int, longest: int, text_column: str = "text", lang_column: str = "lang", block_words: int = BLOCK_WORDS
) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, n`` of all phrases of 1 to ``longest`` words that occur ``min_count`` times, and ``lang, n`` of all words.

    Words are what white space (blanks and tabs) leaves of the pieces between
    punctuation and line ends, with A-Z in lower case.  Occurrences overlap and stay within a piece.  Null texts
    are empty, a null language is ``und``; repeated rows count each time; other columns are not read.
    """
    blocks = stage(_blocks(documents, text_column, lang_column, longest, block_words), "phrase-blocks")
    parts = max(1, blocks.count() * min(block_words, BLOCK_WORDS) // PART_WORDS)
    totals = blocks.select(F.inline(F.arrays_zip("langs", "totals"))).groupBy(F.col("langs").alias("lang")).agg(F.sum("totals").alias("n"))
    counts = blocks.select("block", "keys", "count", "size", "items").mapInArrow(_word_counts(parts), _DEALT_WORDS)
    frequent, kept = _agreed(counts, {"keys": "string"}, min_count, parts, "frequent-1")
    blank = F.instr("keys", " ")
    lang = F.replace(F.replace(F.expr("substring(keys, instr(keys, ' ') + 1)"), F.lit("\tn"), F.lit("\n")), F.lit("\tt"), F.lit("\t"))
    phrases = frequent.select("id", lang.alias("lang"), F.substring("keys", F.lit(1), blank - 1).alias("phrase"), F.lit(1).alias("words"), "n")
    found, function = [phrases], _frequent_words
    relation = blocks.select("block", "count", "size", "items")
    for k in range(1, longest):
        last = k == longest - 1
        relation = _extended(relation, kept, function)
        relation = relation if last else stage(relation, f"occurrences-{k}")  # the last one is read once
        frequent, kept = _agreed(relation.mapInArrow(_candidate_counts(parts), _DEALT_PHRASES), {"first": "long", "last": "long"}, min_count, parts, f"frequent-{k + 1}", last)
        ahead = phrases.select(F.col("id").alias("first"), "lang", F.col("phrase").alias("_first"))
        behind = phrases.select(F.col("id").alias("last"), F.substring_index("phrase", " ", -1).alias("_last"))
        longer = frequent.join(ahead, "first").join(behind, "last")
        phrases = stage(longer.select("id", "lang", F.concat_ws(" ", "_first", "_last").alias("phrase"), F.lit(k + 1).alias("words"), "n"), f"phrases-{k + 1}")
        found.append(phrases)
        function = _frequent_phrases(parts)
    everything = found[0]
    for own in found[1:]:
        everything = everything.unionByName(own)
    return everything.drop("id"), totals


def _exact(value: str | Column) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("decimal(20,0)")


def _between(first: Column, last: Column) -> Column:
    """The words numbered ``first`` to ``last`` of column ``w`` as one phrase."""
    return F.array_join(F.slice("w", first, last - first + 1), " ")


def _scored(phrases: DataFrame) -> DataFrame:
    """``lang, phrase, words, a, l, r, score`` of the candidates by their lowest-scoring cut."""
    sizes = phrases.select("lang", "phrase", "n")
    cuts = phrases.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = cuts.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", _between(F.lit(1), F.col("k")).alias("left"), _between(F.col("k") + 1, F.col("words")).alias("right"))
    cuts = cuts.join(sizes.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(sizes.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    cuts = cuts.withColumns({"_product": _exact("a") * F.lit(2_000_000).cast("decimal(7,0)"), "_sum": _exact("l") + _exact("r")})
    cuts = cuts.withColumn("score", F.expr("_product div _sum"))
    return cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def _longest_holders(phrases: DataFrame) -> DataFrame:
    """``lang, phrase, n``: the most occurrences that a longer candidate has which holds ``phrase``."""
    longer = phrases.where("words > 2").select("lang", "words", "n", F.split("phrase", " ").alias("w"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda at: _between(at, at + size - 1))))
    return longer.select("lang", F.explode(spans).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def collocations(
    documents: DataFrame, min_count: int = 30, longest: int = 4, top: int = 2000, held_percent: int = 80, text_column: str = "text", lang_column: str = "lang", block_words: int = BLOCK_WORDS
) -> DataFrame:
    """The best phrases of 2 to ``longest`` words of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase that occurs ``a`` times scores ``2000000 * a // (l + r)`` by the cut into a
    first part (``l`` times) and a rest (``r`` times) where that is lowest.  A phrase is left out if
    a longer one that holds it has ``held_percent`` of its occurrences.  Ties: more
    occurrences, then the phrase in byte order.  A language without such phrases has no row.
    """
    phrases, totals = frequent_phrases(documents, min_count, longest, text_column, lang_column, block_words)
    found = _scored(phrases).join(_longest_holders(phrases), ["lang", "phrase"], "left")
    free = F.col("longer").isNull() | (_exact("longer") * F.lit(100) < _exact("a") * F.lit(held_percent))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.where(free).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
