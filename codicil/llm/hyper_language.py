"""Language of a text by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (seeded by its code point, so all tasks
agree without a table).  An n-gram's vector binds its letters' vectors, each permuted
(rotated) by its place, by multiplication; a text's vector is the bundle, the sum over
all its n-grams; a language's prototype bundles the unit vectors of its training
texts.  The language of a text is the prototype with the largest cosine.

Letters are lower-cased; whatever is no letter separates words, and each stretch of it
counts as one sign, also at both ends.  Texts are read whole, in slices whose sums are
added up, so a task's memory depends on ``SLICE`` and ``ROWS`` and not on a text's
length.  Training sums one vector a language and task before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
LETTERS = 3  # of an n-gram
SEED = 0x5EED
ROWS = 256
SLICE = 1 << 17  # characters
UNDETERMINED = "und"

_BLANK = 0


class Encoder:
    """Text vectors; remembers the vectors of the letters that it has met."""

    def __init__(self, dimensions: int = DIMENSIONS, letters: int = LETTERS, seed: int = SEED) -> None:
        self.dimensions, self.letters, self.seed = dimensions, letters, seed
        self._number = np.full(0x110000, -1, np.int32)  # of a code point; _BLANK for what is no letter
        self._vectors = np.empty((0, dimensions), np.int8)
        self._rotated: list[np.ndarray] = []
        self._add([-1])

    def _add(self, points: list[int]) -> None:
        drawn = [np.random.default_rng([self.seed, p + 1]).integers(0, 2, self.dimensions, np.int8) * 2 - 1 for p in points]
        self._vectors = np.vstack([self._vectors, *drawn])
        self._rotated = [np.roll(self._vectors, self.letters - 1 - i, axis=1) for i in range(self.letters)]

    def _numbers(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        found = self._number[points]
        if (found < 0).any():
            fresh = np.unique(points[found < 0]).tolist()
            known = [p for p in fresh if chr(p).isalpha()]
            self._number[fresh] = _BLANK
            self._number[known] = np.arange(len(self._vectors), len(self._vectors) + len(known))
            self._add(known)
            found = self._number[points]
        return found

    def slices(self, text: str) -> Iterator[np.ndarray]:
        """The numbers of a text's signs; each slice but the first repeats the last signs of the one before."""
        tail = np.array([_BLANK], np.int32)
        for at in range(0, len(text) + 1, SLICE):
            last = at + SLICE > len(text)
            own = self._numbers(text[at : at + SLICE].lower())
            own = np.concatenate([tail, own, [_BLANK]] if last else [tail, own]).astype(np.int32)
            own = own[np.concatenate([[True], (own[1:] != _BLANK) | (own[:-1] != _BLANK)])]
            yield own
            tail = own[-(self.letters - 1) :]

    def grams(self, own: np.ndarray) -> np.ndarray:
        """One number an n-gram, in which the numbers of its letters can be found."""
        if len(own) < self.letters:
            return np.empty(0, np.int64)
        key = np.zeros(len(own) - self.letters + 1, np.int64)
        for i in range(self.letters):
            key = (key << 20) | own[i : len(own) - self.letters + 1 + i]
        return key

    def gram_vectors(self, keys: np.ndarray) -> np.ndarray:
        out = None
        for i in range(self.letters):
            own = self._rotated[i][(keys >> (20 * (self.letters - 1 - i))) & 0xFFFFF]
            out = own if out is None else out * own
        return out

    def vectors(self, texts: list[str]) -> np.ndarray:
        """The bundle of each text, not scaled."""
        out = np.zeros((len(texts), self.dimensions), np.float32)
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for i, text in enumerate(texts):
            for own in self.slices(text):
                held.append((i, self.grams(own)))
                size += len(own)
                if size >= SLICE:
                    self._bundle(out, held)
                    held, size = [], 0
        self._bundle(out, held)
        return out

    def _bundle(self, out: np.ndarray, held: list[tuple[int, np.ndarray]]) -> None:
        rows = sorted({i for i, _ in held})
        place = {i: k for k, i in enumerate(rows)}
        keys, column = np.unique(np.concatenate([g for _, g in held] or [np.empty(0, np.int64)]), return_inverse=True)
        if not len(keys):
            return
        row = np.repeat([place[i] for i, _ in held], [len(g) for _, g in held])
        for low in range(0, len(keys), 8192):
            part = min(8192, len(keys) - low)
            mine = (column >= low) & (column < low + part)
            counts = np.bincount(row[mine] * part + column[mine] - low, minlength=len(rows) * part).reshape(len(rows), part)
            out[rows] += counts.astype(np.float32) @ self.gram_vectors(keys[low : low + part]).astype(np.float32)


@dataclass
class Profiles:
    """Languages in order, and their prototypes scaled to length 1 (a row each)."""

    languages: list[str]
    prototypes: np.ndarray
    letters: int = LETTERS


def _scaled(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(length > 0, length, 1.0)


def _parts(batch: pa.RecordBatch, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def fit(documents: DataFrame, training: Column, text_column: str = "text", lang_column: str = "lang", dimensions: int = DIMENSIONS, letters: int = LETTERS) -> Profiles:
    """Prototypes from the rows where ``training`` holds and neither text nor language is null.

    What comes back is one vector a language.  Without training rows there are no languages.
    """
    rows = documents.where(training & F.col(text_column).isNotNull() & F.col(lang_column).isNotNull())
    rows = rows.select(F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(dimensions, letters), {}
        for batch in batches:
            for part in _parts(batch):
                vectors = _scaled(encoder.vectors(part.column(0).to_pylist()))
                names = np.array(part.column(1).to_pylist(), object)
                for name in set(names.tolist()):
                    sums[name] = sums.get(name, 0.0) + vectors[names == name].sum(axis=0, dtype=np.float64)
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total], pa.list_(pa.float64()))], names=["lang", "total"])

    sums = rows.mapInArrow(run, "lang string, total array<double>").select("lang", F.posexplode("total").alias("i", "x"))
    # Sums of whole numbers do not depend on the order of the tasks.
    exact = F.sum(F.round(F.col("x") * (1 << 20)).cast("decimal(38,0)"))
    sums = sums.groupBy("lang", "i").agg(exact.cast("double").alias("x"))
    found = sums.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("total"))  # DIMENSIONS values
    found = sorted((r["lang"], r["total"]) for r in found.collect())  # one row a language
    prototypes = np.array([t for _, t in found], np.float64).reshape(len(found), dimensions)
    return Profiles([name for name, _ in found], _scaled(prototypes).astype(np.float32), letters)


def identify(documents: DataFrame, profiles: Profiles, keep: list[str], text_column: str = "text") -> DataFrame:
    """The columns in ``keep``, ``lang_pred`` and ``score`` (the cosine, no less than 0) of each row.

    Null texts, texts without a letter and, if no language was learned, all texts are ``und``
    with the score 0.  Of equal cosines the first language in order counts.  One scan,
    no shuffle; other columns are not read.
    """
    inputs = documents.select(F.col(text_column).cast("string").alias("_text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(profiles.prototypes.shape[1], profiles.letters)
        names = np.array([*profiles.languages, UNDETERMINED], object)
        for batch in batches:
            for part in _parts(batch):
                vectors = _scaled(encoder.vectors([t or "" for t in part.column(0).to_pylist()]))
                cosines = vectors @ profiles.prototypes.T if profiles.languages else np.zeros((part.num_rows, 1))
                best = cosines.argmax(axis=1)
                score = np.clip(cosines[np.arange(len(best)), best].astype(np.float64), 0.0, 1.0)
                empty = ~vectors.any(axis=1) | (not profiles.languages)
                found = [pa.array(np.where(empty, UNDETERMINED, names[best]).tolist(), pa.string()), pa.array(np.where(empty, 0.0, score))]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *found], names=[*part.schema.names[1:], "lang_pred", "score"])

    schema = ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(inputs.schema[1:])] + ["lang_pred string", "score double"])
    return inputs.mapInArrow(run, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")


def held_out(id_column: str = "doc_id") -> Column:
    """The third of the rows that nothing is learned from, by a checksum of the id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))
