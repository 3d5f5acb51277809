import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codicil.llm import bpe, near_text, packing, pii, secret_scan, sharding, toxicity
from codicil.llm.graph import components
from codicil.llm.shared import tokenizer
from tests.llm.conftest import ODD_TEXTS, SF
from tests.llm.helpers import grouped, text_links

WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer(name))


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(1, 120)]
    star = [(1000, i) for i in range(1001, 1200)]
    links = spark.createDataFrame(path + star + [(5, 5), (None, 3), (7, None), (2, 1)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links, "a", "b").collect()}
    assert got == {i: 1 for i in range(1, 121)} | {i: 1000 for i in range(1000, 1200)}
    assert components(links.where("false"), "a", "b").count() == 0


@pytest.mark.parametrize("width,similarity", [(3, 85), (5, 80)])
def test_near_text_equals_all_pairs(documents, texts, width, similarity):
    want = grouped(texts, text_links(texts, width, similarity))
    got = near_text.near_duplicate_classes(documents, width, similarity).collect()
    assert {r["id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got)


def test_near_text_links_chains_and_a_shared_passage(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in rng.integers(0, 10**9, 4000)]
    base, passage = words[:200], words[200:260]
    rows = []
    for i in range(60):  # each differs from the one before by one word, so the ends are far apart
        base = [*base]
        base[(i * 7) % 200] = f"new{i}"
        rows.append((i, " ".join(base)))
    for i in range(60, 120):  # the same passage in texts that are otherwise different
        own = words[300 + 50 * (i - 60) : 350 + 50 * (i - 60)]
        rows.append((i, " ".join(own + passage)))
    want = grouped(dict(rows), text_links(dict(rows), 3, 85))
    got = near_text.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert {r["id"]: r["component_id"] for r in got.collect()} == want


def test_near_text_odd_rows(odd, nothing):
    got = near_text.near_duplicate_classes(odd, 3, 85).collect()
    by_id = {r["id"]: r for r in got}
    assert len(got) == len(ODD_TEXTS)
    assert by_id[2]["component_id"] == 1 and not by_id[2]["kept"] and by_id[7]["component_id"] == 6
    assert [by_id[i]["n_shingles"] for i in (3, 4, 5)] == [0, 0, 0] and all(by_id[i]["kept"] for i in (3, 4, 5))
    assert by_id[None]["kept"] and sum(r["id"] == 10 and r["kept"] for r in got) == 2
    assert near_text.near_duplicate_classes(nothing).count() == 0


def test_packing_pieces_and_sequences(documents, texts):
    ids = {k: library(WORDS).encode(t or "", add_special_tokens=False).ids + [1] for k, t in texts.items()}
    got = packing.pack_documents(documents, tokenizer(WORDS), 1, 512).collect()
    want = {
        (k, p): (a, len(own := np.array(v[a : a + 512], "<u4")), zlib.crc32(own.tobytes()))
        for k, v in ids.items() for p, a in enumerate(range(0, len(v), 512))
    }
    assert {(r["id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 512
    assert sorted(sequences) == list(range(len(sequences)))
    assert len(sequences) <= 1.02 * -(-sum(len(v) for v in ids.values()) // 512) + 1


def test_reduction_keeps_the_optimum():
    """Small instances: the reduced packing is as short as the best one found by search."""

    def best(items, capacity):
        items, found = sorted(items, reverse=True), [len(items)]

        def place(i, bins):
            if len(bins) >= found[0]:
                return
            if i == len(items):
                found[0] = len(bins)
                return
            for room in {b for b in bins if b >= items[i]}:
                rest = list(bins)
                rest.remove(room)
                place(i + 1, rest + [room - items[i]])
            place(i + 1, bins + [capacity - items[i]])

        place(0, [])
        return found[0]

    rng = np.random.default_rng(5)
    for _ in range(150):
        capacity = int(rng.integers(8, 30))
        counts = Counter(int(x) for x in rng.integers(1, capacity + 1, rng.integers(1, 9)))
        fixed, rest = packing.reduce_by_dominance(counts, capacity)
        rest_items = [k for k, n in rest.items() for _ in range(n)]
        assert sum(n for n, _ in fixed) + best(rest_items, capacity) == best(list(counts.elements()), capacity)
        plan = fixed + packing.best_fit(rest, capacity)
        used = Counter()
        for n, held in plan:
            assert sum(k * m for k, m in held) <= capacity
            for k, m in held:
                used[k] += n * m
        assert used == counts


def test_packing_odd_rows(odd, nothing):
    got = packing.pack_documents(odd, tokenizer(WORDS), 1, 4096).collect()
    sizes = Counter(r["id"] for r in got)
    assert sizes[3] == sizes[4] == sizes[5] == 1 and sizes[10] == 2 and sizes[8] > 4 and sizes[None] == 1
    by_text = {r["id"]: r for r in got if r["piece"] == 0}
    ids = library(WORDS).encode(dict(r[:2] for r in ODD_TEXTS)[11], add_special_tokens=False).ids + [1]
    assert by_text[11]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert packing.pack_documents(nothing, tokenizer(WORDS)).count() == 0


def test_bpe_equals_the_library(documents, odd, nothing):
    exact = library(BYTES)
    frame = documents.select("doc_id", "text").unionAll(odd.select("doc_id", "text"))
    texts = {(r["doc_id"], hashlib.md5((r["text"] or "").encode()).hexdigest()): r["text"] for r in frame.collect()}
    got = bpe.decode_ids(bpe.encode_texts(frame, tokenizer(BYTES)), tokenizer(BYTES)).collect()
    for r in got:
        text = texts[(r["id"], hashlib.md5(r["text"].encode()).hexdigest())] or ""  # a wrong text has no entry
        assert np.frombuffer(r["ids"], "<u4").tolist() == exact.encode(text, add_special_tokens=False).ids
    assert len(got) == frame.count() and bpe.encode_texts(nothing, tokenizer(BYTES), digests=True).count() == 0


def test_bpe_on_random_strings(spark):
    rng = np.random.default_rng(11)
    alphabet = list("abcdehinorst  '\n\t.,09é  　 ßñ字😀\x1c\x85<|>")
    rows = [(i, "".join(rng.choice(alphabet, rng.integers(0, 60)))) for i in range(400)]
    got = bpe.encode_texts(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer(BYTES)).collect()
    exact = library(BYTES)
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == exact.encode(rows[r["id"]][1], add_special_tokens=False).ids for r in got)


def test_shards_fit_and_split_only_when_needed(documents):
    limit = 20_000
    rows = sharding.shard(documents, limit).collect()
    sizes, singles = Counter(), Counter()
    for r in rows:
        sizes[r["shard_id"]] += r["n_bytes"]
        singles[r["shard_id"]] += 1
    assert all(n <= limit or singles[k] == 1 for k, n in sizes.items())
    parents = {k[:-1] for k in sizes if k and "-" not in k}
    assert all(sum(n for k, n in sizes.items() if k.startswith(p)) > limit for p in parents)


def test_shards_of_one_hot_id(spark, odd, nothing):
    rows = [(7, "x" * 100)] * 400 + [(i, "y" * 10) for i in range(50)] + [(8, "z" * 5000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 1000).collect()
    sizes, singles = Counter(), Counter()
    for r in got:
        sizes[r["shard_id"]] += r["n_bytes"]
        singles[r["shard_id"]] += 1
    assert len(got) == len(rows) and all(n <= 1000 or singles[k] == 1 for k, n in sizes.items())
    assert sharding.shard(odd, 1000).count() == len(ODD_TEXTS) and sharding.shard(nothing, 10).count() == 0


def test_written_shards_hold_every_row(documents, tmp_path):
    sharding.write_shards(documents, str(tmp_path / "shards"), 50_000)
    back = documents.sparkSession.read.parquet(str(tmp_path / "shards"))
    assert back.select(documents.columns).exceptAll(documents).count() == 0 and back.count() == documents.count()


def test_base_spans_equal_plain_patterns(documents, odd, nothing, spark):
    tricky = [
        "a@b.c.d@e.f x_y@-.-", "a@b.co_x@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 000255.1.1.1 1.2.3", "4111 1111-1111 1111, 4111111111111111 1- 2",
        "+1 (555) 010-9999 and +12 ) and +1--9", "." * 5000 + "@", "1" * 40000, "9 " * 3000, "+1" + "." * 5000, "x@y" + ".z" * 8000, "𝒳𝒳 a@b.cd 𝒳 +49 30 1234567",
    ]
    frame = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(tricky)], "doc_id long, text string")
    frame = frame.unionAll(documents.select("doc_id", "text")).unionAll(odd.select("doc_id", "text"))
    texts = {r["doc_id"]: r["text"] or "" for r in frame.collect()}
    rows = pii.find_personal_data(frame).collect()
    assert len(rows) == frame.count()
    for r in rows:
        want = plain_personal_data(texts[r["id"]]) if r["id"] not in range(0, 12) else None
        if want is not None:
            assert {k: [tuple(s) for s in r[k]] for k in pii.KINDS} == want, texts[r["id"]][:80]
    assert pii.find_personal_data(nothing).count() == 0


def plain_personal_data(text):
    def luhn(number):
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
        return sum(v - 9 if v > 9 else v for v in twice) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    plain = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    return {k: [m.span() for m in re.finditer(p, text) if test(m)] for k, (p, test) in plain.items()}


def test_bootstrapping_finds_unseen_identifiers(spark):
    seeds = [f"please write to contact: user{i}@mail.example.com today" for i in range(40)]
    rows = [(i, t) for i, t in enumerate(seeds)] + [(100, "contact: user77[at]mail9 or version 9.12.13x"), (101, "version 1.2.3beta4 here")]
    rows += [(200 + i, f"version 1.{i}.77beta out") for i in range(30)]
    got = {r["id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [rows[40][1][s["start"] : s["end"]] for s in got[100]["context"]] == ["user77[at]mail9"]
    assert all(not r["context"] for i, r in got.items() if i != 100) and all(len(got[i]["email"]) == 1 for i in range(40))


def test_masking(spark):
    df = spark.createDataFrame([("call +1 now 1.2.3.4", [(5, 7, "phone"), (12, 19, "ip")]), ("none", []), ("overlap", [(0, 4, "a"), (2, 7, "b")])], "t string, s array<struct<start:int,end:int,kind:string>>")
    assert [r[0] for r in df.select(pii.masked(F.col("t"), F.col("s"))).collect()] == ["call [PHONE] now [IP]", "none", "[A]"]


def test_secrets_equal_plain_patterns(documents, odd, nothing, texts):
    for r in secret_scan.find_secrets(documents).collect():
        text = texts[r["id"]] or ""
        want = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) > 5]
        want += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        want += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        got = [tuple(s) for s in r["spans"] if s["kind"] != "entropy"]
        assert got == [(k, a, b) for a, _, k, b in sorted(want)]
    assert secret_scan.find_secrets(odd).count() == len(ODD_TEXTS) and secret_scan.find_secrets(nothing).count() == 0


def test_sliding_entropy_equals_windows_counted_anew():
    def entropy(window):
        return -sum(c / len(window) * np.log2(c / len(window)) for c in Counter(window).values())

    rng = np.random.default_rng(2)
    for _ in range(60):
        run = "".join(rng.choice(list("abcdef0123456789"), rng.integers(1, 80))) + "a" * int(rng.integers(0, 30))
        size = min(24, len(run))
        hot = [i for i in range(len(run) - size + 1) if entropy(run[i : i + size]) >= 3.0 - 1e-9]
        assert secret_scan.hot_windows(run, 3.0) == ((hot[0], hot[-1] + size) if hot else None)


def test_allow_list_suppresses_entropy_only(spark):
    rows = [(1, "id 3f2b8c1e-9d47-4a6b-8e21-7c5d0f9a1b3e end"), (2, "key Zx9Qw7Lp3Kv8Tn2Rb6Yc4Md1 end"), (3, "secret=Zx9Qw7Lp3Kv8Tn2example end"), (4, "plain words only thnntinreationingshlyesbe")]
    got = {r["id"]: [s["kind"] for s in r["spans"]] for r in secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: ["entropy"], 3: ["assign"], 4: []}


def test_toxicity_on_held_out_rows(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("pmod(xxhash64(doc_id, 1), 4) = 0")
    chain = toxicity.fit(documents, labels.join(held, "doc_id", "left_anti"), toxicity.label_categories())
    scored = toxicity.score(documents.join(held.select("doc_id"), "doc_id", "left_semi"), chain, keep=["doc_id"])
    table = Counter((r["toxic"], r["p_toxic"] >= 0.5) for r in scored.join(held, "doc_id").collect())
    assert table[(1, True)] >= 0.9 * (table[(1, True)] + table[(1, False)])
    assert table[(0, False)] >= 0.99 * (table[(0, True)] + table[(0, False)])


def test_chain_uses_out_of_fold_predictions():
    rng = np.random.default_rng(4)
    a = rng.random(600) < 0.5
    b = a ^ (rng.random(600) < 0.05)  # the second category follows the first
    rows = [(i % 3, [int(a[i]), int(b[i])], [[int(a[i])], []]) for i in range(600)]
    chain = toxicity.train(rows, [[10, 11], []], ["first", "second"])
    assert chain.models[1].earlier[0] > 1
    assert chain.probabilities({11})[1] > 0.7 > 0.3 > chain.probabilities({10})[1]


def test_toxicity_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 1), (2, None, 1), (None, 1, 1), (6, 0, 0), (6, 0, 0), (10, 1, 0)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(odd, labels, toxicity.label_categories())
    assert toxicity.score(odd, chain, keep=odd.columns).count() == len(ODD_TEXTS)
    empty = toxicity.fit(nothing, labels.where("false"), toxicity.label_categories())
    assert all(r["p_toxic"] < 0.01 for r in toxicity.score(odd, empty, keep=["doc_id"]).collect())
    assert toxicity.score(nothing, chain, keep=["doc_id"]).count() == 0
    assert SF
