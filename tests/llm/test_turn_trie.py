"""The trie of turns against plain loops over whole sequences, whatever the segments and shards."""

import hashlib
import random
from collections import defaultdict

import pytest

from codicil.llm import turn_trie

COLUMNS = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], (role, text)))
    return plain_nodes({c: [t[-1] for t in sorted(turns)] for c, turns in own.items()})


def plain_nodes(sequences):
    members = defaultdict(list)
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    out = []
    for p, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(sequences[c]) == len(p))
        out.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(turns, **options):
    return sorted((tuple(r) for r in turn_trie.prefix_nodes(turns, **options).collect()), key=str)


def several(seed, convs=60, longest=12):
    chance = random.Random(seed)
    rows = []
    for c in range(convs):
        rows += [(c * 7 - 30, t, chance.choice(["user", "assistant"]), chance.choice(["é", "a longer text", ""])) for t in range(chance.randint(1, longest))]
    stem = [(t, "user", f"turn {t}") for t in range(20)]
    for c in range(1000, 1030):  # copies of one conversation, and of its beginnings
        rows += [(c, *t) for t in stem[: 20 if c % 3 else c % 20 + 1]]
    return rows


@pytest.mark.parametrize(("segment", "shard"), [(1, 1), (2, 3), (5, 7), (64, 4096)])
def test_equal_to_plain_loops(spark, segment, shard):
    rows = several(segment)
    turns = turn_trie.ordered_turns(spark.createDataFrame(rows, COLUMNS))
    assert run(turn_trie.whole_conversations(turns), segment=segment, shard_paths=shard) == plain(rows)


def test_nulls_ties_repeats_and_other_columns(spark, nothing):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 0, "", "x"), (1, 0, "", "x"), (None, 1, "user", "lost"), (-7, 3, "user", None), (2, None, "user", "first")]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit("mine") for c in ("conv", "key", "size", "place", "node", "root", "n")})
    assert run(turn_trie.whole_conversations(turn_trie.ordered_turns(df))) == plain(rows)
    assert run(turn_trie.whole_conversations(turn_trie.ordered_turns(spark.createDataFrame([], COLUMNS)))) == []


def test_one_conversation_far_longer_than_a_segment(spark):
    rows = [(1, t, "user", str(t % 3)) for t in range(700)] + [(2, t, "user", str(t % 3)) for t in range(650)] + [(3, 0, "user", "0")]
    turns = turn_trie.whole_conversations(turn_trie.ordered_turns(spark.createDataFrame(rows, COLUMNS)))
    assert run(turns, segment=16) == plain(rows)


def test_conversations_left_without_turns_are_members_of_the_root(spark):
    from pyspark.sql import functions as F

    rows = [(c, t, "user", f"{c} {t}") for c in (6, 7, 10, 11) for t in range(3)]
    turns = turn_trie.ordered_turns(spark.createDataFrame(rows, COLUMNS))
    found = run(turn_trie.with_borrowed_heads(turns, lender=F.col("conv") - F.col("conv") % 5, taken=F.lit(3), most=8))
    lent = [("user", f"10 {t}") for t in range(3)]
    assert found == plain_nodes({6: [], 7: [], 10: lent, 11: lent})


def test_double_array_holds_its_paths_and_nothing_else():
    chance = random.Random(3)
    paths = sorted({tuple(chance.randint(1, 30) for _ in range(chance.randint(0, 6))) for _ in range(400)})
    trie = turn_trie.DoubleArray([list(p) for p in paths])
    for p in paths:
        assert len(list(trie.states(list(p)))) == len(p)
    known = {p[:d] for p in paths for d in range(1, len(p) + 1)}
    assert len(trie.preorder) == len(set(trie.preorder)) == len(known)
    for _ in range(300):
        p = tuple(chance.randint(1, 31) for _ in range(4))
        assert len(list(trie.states(list(p)))) == max([d for d in range(5) if p[:d] in known], default=0)
