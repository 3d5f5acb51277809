"""Byte-level BPE encoding over a trie of distinct words, and decoding.

The pieces of a text between split points of the tokenizer ("words") repeat, and
their beginnings repeat even more.  The distinct words of a block of texts that are
not yet known are put into a trie.  A depth-first walk gives each node the last token
of the encoding of its path.  That token is the one vocabulary entry ending here
whose pair with the last token of the rest of the path is one that merging leaves
alone; so a shared prefix is worked out once.  The encoding of a word is read off by
walking back from its node.

Texts go through in Arrow batches; there is no shuffle, and a task keeps a bounded
table of known words.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import json
import math
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KNOWN_WORDS = 1_000_000  # of each table of a worker; some 200 bytes each
KNOWN_BYTES = 96 << 20
KNOWN_PAIRS = 1_000_000

# Characters with the White_Space property.
_SPACE = "\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


class TrieEncoder:
    """Encodes words given in the tokenizer's byte alphabet."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> None:
        self.vocabulary = vocabulary
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.whole: dict[str, bool] = {}
        self.stable: dict[tuple[str, str], bool] = {}
        self.edges: dict[tuple[str, bool], list[tuple[str, float]]] = {}
        born: dict[str, int] = {}
        for rank, (a, b) in enumerate(merges):
            born.setdefault(a + b, rank)
        # Merges then apply in the order of their ranks, so a boundary can be judged from the tokens beside it.
        self.ordered = all(born.get(a, -1) < r and born.get(b, -1) < r for r, (a, b) in enumerate(merges))
        self.born, self.parts = born, {a + b: (a, b) for a, b in reversed(merges)}
        # Vocabulary entries by their letters from the last to the first.
        self.suffixes: dict = {}
        for token in vocabulary:
            node = self.suffixes
            for letter in reversed(token):
                node = node.setdefault(letter, {})
            node[""] = token

    def _merge(self, text: str) -> list[str]:
        """Plain merging of a short string, lowest rank first, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            rank, i = min((self.ranks.get(p, len(self.ranks)), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == len(self.ranks):
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _edge(self, token: str, right: bool) -> list[tuple[str, float]]:
        """What stands at the token's left or right end while it is merged: (part, rank at which it is taken up)."""
        known = self.edges.get((token, right))
        if known is None:
            known, part, until = [], token, math.inf
            while True:
                known.append((part, until))
                if part not in self.parts:
                    break
                until, part = self.born[part], self.parts[part][right]
            self.edges[token, right] = known = known[::-1]
        return known

    def _alone(self, before: str, token: str) -> bool:
        """No merge joins the two across their boundary, at any stage of theirs."""
        if not self.ordered:
            return self._merge(before + token) == [before, token]
        left, right = self._edge(before, True), self._edge(token, False)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            rank = self.ranks.get((x, y))
            # Of equal ranks the leftmost merge comes first: the one inside `before`, but not the one inside `token`.
            if rank is not None and rank < x_until and rank <= y_until:
                return False
            if x_until is math.inf and y_until is math.inf:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def _whole(self, token: str) -> bool:
        """Merging makes the token from its letters."""
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self._merge(token) == [token]
        return known

    def encode(self, words: Iterable[str]) -> dict[str, list[int]]:
        """The trie is the sorted list: its walk visits the nodes depth first, and what two
        neighbours share is the path that stays."""
        if len(self.stable) > KNOWN_PAIRS:
            self.stable.clear()
        out: dict[str, list[int]] = {}
        path, last = "", []  # last token of each prefix of the path
        for word in sorted(words):
            shared = 0
            for a, b in zip(path, word):
                if a != b:
                    break
                shared += 1
            del last[shared:]
            for end in range(shared, len(word)):
                last.append(self._last_token(word, end, last))
            out[word] = self._read_back(last)
            path = word
        return out

    def _last_token(self, word: str, end: int, last: list[str]) -> str:
        """The one entry that ends the encoding of ``word[: end + 1]``; longer ones are tried first."""
        fitting, node, i = [], self.suffixes, end
        while i >= 0:
            node = node.get(word[i])
            if node is None:
                break
            if "" in node:
                fitting.append((i, node[""]))
            i -= 1
        stable = self.stable
        while fitting:
            i, token = fitting.pop()
            if not i:
                if self._whole(token):
                    return token
                continue
            pair = (last[i - 1], token)
            known = stable.get(pair)
            if known is None:
                known = stable[pair] = self._whole(token) and self._alone(*pair)
            if known:
                return token
        raise ValueError(f"{word[end]!r} is not in the vocabulary")

    def _read_back(self, last: list[str]) -> list[int]:
        ids, depth = [], len(last)
        while depth:
            token = last[depth - 1]
            ids.append(self.vocabulary[token])
            depth -= len(token)
        return ids[::-1]


def _alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level tokenizers, back to bytes."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Whole texts to ids as little-endian unsigned 32-bit integers, and back."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in parts["model"]["merges"]]
        self.split = Tokenizer.from_file(path).pre_tokenizer
        self.trie = TrieEncoder(parts["model"]["vocab"], merges)
        added = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.added = {t: np.uint32(i).tobytes() for t, i in added.items()}
        self.added_at = re.compile("(" + "|".join(sorted(map(re.escape, added), key=len, reverse=True)) + ")") if added else None
        letters = _alphabet()
        size = max([*parts["model"]["vocab"].values(), *added.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in parts["model"]["vocab"].items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in added.items():
            self.bytes_of[i] = token.encode("utf-8")
        gc.freeze()  # the tables above stay; the collector need not walk them again and again
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, chunks: set[str]) -> None:
        """Encodes new chunks; a chunk is split into words by the tokenizer's own rule."""
        split, known = self.split.pre_tokenize_str, self.words
        if len(known) > KNOWN_WORDS:
            known.clear()
        cut = {c: [w for w, _ in split(c)] for c in chunks}
        new = {w for own in cut.values() for w in own}.difference(known)
        for word, ids in self.trie.encode(new).items():
            known[word] = np.array(ids, np.uint32).tobytes()
        for chunk, own in cut.items():
            found = self.known[chunk] = b"".join(map(known.__getitem__, own))
            self.held += len(chunk) + len(found)

    def encode(self, texts: list[str]) -> list[bytes]:
        """A chunk is white space and what follows up to the next white space: no word crosses its ends."""
        if len(self.known) > KNOWN_WORDS or self.held > KNOWN_BYTES:
            self.known.clear()
            self.held = 0
        cut = []
        for text in texts:
            parts = self.added_at.split(text) if self.added_at and self.added_at.search(text) else [text]
            cut.append([p if i % 2 else _CHUNK.findall(p) for i, p in enumerate(parts)])
        new = {c for parts in cut for p in parts[::2] for c in p}.difference(self.known)
        if new:
            self._learn(new)
        known = self.known.__getitem__
        return [b"".join(self.added[p] if i % 2 else b"".join(map(known, p)) for i, p in enumerate(parts)) for parts in cut]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode_texts(documents: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", digests: bool = False) -> DataFrame:
    """Per document ``id`` and ``ids`` (binary, little-endian unsigned 32-bit integers).

    With ``digests``: ``id, n_tokens, ids_sha256, decoded_sha256`` instead, the text
    decoded from the ids.  Strings of added tokens get their ids.  A null text is an
    empty one: no ids.  Rows are returned as often as they occur.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = codec.encode([t.as_py() or "" for t in part.column(1)])
                if not digests:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])
                    continue
                texts = [hashlib.sha256(codec.decode(x).encode("utf-8")).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array(texts)],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    texts = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return texts.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "id long, ids binary")


@functools.lru_cache(maxsize=2)
def _codec(path: str) -> Codec:
    return Codec(path)


def decode_ids(encoded: DataFrame, path: str, ids_column: str = "ids", out_column: str = "text") -> DataFrame:
    """``encoded`` with ``out_column``: the text of its ids; a null stays null."""

    @F.arrow_udf("string")
    def decoded(ids: pa.Array) -> pa.Array:
        codec = _codec(path)
        return pa.array([None if x.as_py() is None else codec.decode(x.as_py()) for x in ids], pa.string())

    return encoded.withColumn(out_column, decoded(F.col(ids_column)))
