"""Secrets: fixed patterns, and strings whose sliding-window entropy is too high for prose.

A candidate is a run of key characters of ``MIN_LENGTH`` or more.  Each run is read
once with a window of ``WINDOW`` characters; the counts of the characters in the
window and the sum of ``c * log2(c)`` over them are updated by the character that
enters and the one that leaves, so a run of any length takes linear time.  A
window is compared with the mean of random strings of its length and class
(``expected_bits``) less ``MARGIN``; the windows above that are joined to a span of
kind ``entropy``, unless an allow-list entry covers the run.  A run that has no class
for its separators is judged without them; letters alone then need a part of ``SEGMENT``
letters, since words joined by separators have shorter ones.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
ENTROPY = "entropy"
WINDOW = 24
MIN_LENGTH = 20

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")

# Size of the alphabet, by class; the first class whose pattern holds the whole run counts.
CLASSES = (
    ("hex", re.compile(r"[0-9a-fA-F]*[0-9][0-9a-fA-F]*"), 16),
    ("upper", re.compile(r"[A-Z0-9]*[0-9][A-Z0-9]*"), 36),
    ("mixed", re.compile(r"(?=[^0-9]*[0-9])(?=[^a-z]*[a-z])(?=[^A-Z]*[A-Z])[A-Za-z0-9+/_=-]+"), 64),
    ("lower", re.compile(r"(?=[^0-9]*[0-9])[a-z0-9_-]+"), 36),
    ("upper letters", re.compile(r"[A-Z]+"), 26),
    ("lower letters", re.compile(r"[a-z]+"), 26),
    ("letters", re.compile(r"[A-Za-z]+"), 52),
)
SEPARATORS = "+/_=-"
_SEPARATOR = re.compile(r"[+/_=-]")
MARGIN = 0.35  # bits a character below a random string's mean
HEX_MARGIN = 0.5  # few letters spread more


@functools.lru_cache(maxsize=None)
def expected_bits(length: int, letters: int) -> float:
    """Mean entropy of ``length`` characters drawn at random from ``letters``."""
    p = 1.0 / letters
    chance = [math.comb(length, c) * p**c * (1 - p) ** (length - c) for c in range(length + 1)]
    return math.log2(length) - letters / length * sum(q * c * math.log2(c) for c, q in enumerate(chance) if c)


# Runs that look random and are public: identifiers, documented sample keys, inline checksums, names in camel case, paths.
PATH = r"/?([A-Za-z0-9_-]{1,19}/)+[A-Za-z0-9_-]{0,19}"
SEGMENT = 12  # a path holding a random mixed segment of this length is no path
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"(?i:.*(example|sample|placeholder|xxxx).*)",
    r"sha(256|384|512)-[A-Za-z0-9+/=]+",
    r"[a-z]*([A-Z][a-z]{2,}|By|Id|To|Of|In|On|Is|At|Or|If|No)+",
    PATH,
)

_PATH = re.compile(PATH)
_LOG = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def hot_windows(run: str, threshold: float, window: int = WINDOW) -> tuple[int, int] | None:
    """First start and last end of the windows whose entropy reaches ``threshold`` bits a character."""
    size = min(window, len(run))
    if not size:
        return None
    counts: dict[str, int] = {}
    total, first, last = 0.0, None, 0
    for i, entering in enumerate(run):
        if i >= size:
            leaving = run[i - size]
            c = counts[leaving]
            counts[leaving] = c - 1
            total += _LOG[c - 1] - _LOG[c]
        c = counts.get(entering, 0)
        counts[entering] = c + 1
        total += _LOG[c + 1] - _LOG[c]
        if i >= size - 1 and math.log2(size) - total / size >= threshold - 1e-9:
            first, last = (i + 1 - size if first is None else first), i + 1
    return None if first is None else (first, last)


def _class(run: str) -> tuple[str | None, int]:
    return next(((name, size) for name, pattern, size in CLASSES if pattern.fullmatch(run)), (None, 0))


def _hot(run: str) -> tuple[int, int] | None:
    name, letters = _class(run)
    places = None
    if name is None:
        places = [i for i, c in enumerate(run) if c not in SEPARATORS]
        whole, run = run, "".join(run[i] for i in places)
        name, letters = _class(run) if len(run) >= MIN_LENGTH // 2 else (None, 0)
        if name == "hex" and run.isdigit() or run.isalpha() and max(map(len, _SEPARATOR.split(whole))) < SEGMENT:
            name = None
    if name is None:
        return None
    hot = hot_windows(run, expected_bits(min(WINDOW, len(run)), letters) - (HEX_MARGIN if name == "hex" else MARGIN))
    return hot if hot is None or places is None else (places[hot[0]], places[hot[1] - 1] + 1)


def _is_path(run: str) -> bool:
    mixed = CLASSES[2][1]
    return _PATH.fullmatch(run) is not None and not any(len(s) >= SEGMENT and mixed.fullmatch(s) and _hot(s) for s in run.split("/"))


def scan(text: str, allowed: re.Pattern[str], paths: bool = False) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in code points, ends exclusive; with ``paths`` runs that are paths are no secrets."""
    found = {
        "assign": [m.span() for m in _ASSIGN.finditer(text) if m.end() - m.start(1) >= 6],
        "access": [m.span() for m in _ACCESS.finditer(text)],
        "hex": [m.span() for m in _HEX.finditer(text)],
        ENTROPY: [],
    }
    for m in _CANDIDATE.finditer(text):
        run = m[0]
        if allowed.fullmatch(run) or (paths and _is_path(run)):
            continue
        hot = _hot(run)
        if hot:
            found[ENTROPY].append((m.start() + hot[0], m.start() + hot[1]))
    return found


def find_secrets(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", allow_list: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Per document ``id`` and ``spans``: array of (kind, start, end) by start, then kind; one scan, no shuffle.

    ``allow_list`` patterns suppress entropy spans of runs that they match as a whole;
    the fixed patterns are never suppressed.  Null and empty texts have no span; rows
    are returned as often as they occur; other columns are not read.
    """
    order = {k: i for i, k in enumerate((*KINDS, ENTROPY))}
    source = "|".join(f"(?:{p})" for p in allow_list if p != PATH) or r"(?!)"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = re.compile(source, re.DOTALL)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out = []
            for text in batch.column(1):
                spans = [(k, *s) for k, own in scan(text.as_py() or "", allowed, PATH in allow_list).items() for s in own]
                spans.sort(key=lambda s: (s[1], order[s[0]], s[2]))
                out.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["id", "spans"])

    texts = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return texts.mapInArrow(run, "id long, spans array<struct<kind:string,start:long,end:long>>")
