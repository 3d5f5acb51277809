"""Operators on small tables, against rows worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codicil.operators import audit, changes, chunks, context, conversation, filters, pins, retrieval, scoring, verbatim
from codicil.operators import tasks as ops
from codicil.plans.retrieve import retrieve
from codicil.sources import readers, sinks


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# --- chunks ---------------------------------------------------------------------------------


def cut(spark, text, **sizes):
    df = spark.createDataFrame([(1, text)], "doc_id long, content string")
    return [tuple(r) for r in chunks.chunk_documents(df, **sizes).orderBy("chunk_index").select("content", "offset_start", "offset_end", "chunk_id", "total_chunks").collect()]


def test_short_text_is_one_chunk(spark):
    assert cut(spark, "a" * 1536) == [("a" * 1536, 0, 1536, "1_00000", 1)]


def test_text_without_breaks_is_cut_at_the_size(spark):
    got = cut(spark, "a" * 2000)
    assert [(s, e) for _, s, e, *_ in got] == [(0, 1536), (1386, 2000)]


def test_short_tail_joins_the_previous_chunk(spark):
    got = cut(spark, "b" * 1537)
    # 1537 - 1386 = 151 characters are below the minimum of 300.
    assert [(s, e, len(c)) for c, s, e, *_ in got] == [(0, 1537, 1536 + 1 + 151)]


def test_breaks_prefer_paragraphs_then_sentences(spark):
    text = "w " * 640 + "end. " + "x " * 60 + "\n\n" + "y " * 500
    got = cut(spark, text)
    assert text[: got[0][2]].endswith("\n\n")
    plain = "w " * 640 + "end. " + "x " * 600
    assert plain[: cut(spark, plain)[0][2]].endswith("end. ")


def test_chunks_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) + (". " if i % 37 == 0 else "") for i in range(9000))
    spans = [(s, e) for _, s, e, *_ in cut(spark, text)]
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(later[0] <= earlier[1] for earlier, later in zip(spans, spans[1:]))


def test_replace_keeps_one_state_per_document(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, content string")
    new = spark.createDataFrame([(2, "c"), (2, "d")], "doc_id long, content string")
    got = sinks.replace_chunks(old, new.select("doc_id").distinct(), new)
    assert rows(got, "doc_id", "content") == [(1, "a"), (2, "c"), (2, "d")]


# --- changes --------------------------------------------------------------------------------------


def paths_df(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def roots_df(spark, *roots):
    return spark.createDataFrame([(r,) for r in roots], "root string")


def test_roots_are_prefixes_of_folders_not_of_names(spark):
    files = paths_df(spark, "/a/x", "/ab/x", "/a", "/b/c/d")
    assert rows(changes.under_roots(files, roots_df(spark, "/a/", "/b", "/b/c")), "path") == [("/a",), ("/a/x",), ("/b/c/d",)]
    assert rows(changes.out_of_scope(files, roots_df(spark, "/a")), "path") == [("/ab/x",), ("/b/c/d",)]


def test_empty_roots_and_inventories_do_nothing(spark):
    files = paths_df(spark, "/a/x")
    none = roots_df(spark).limit(0)
    assert changes.out_of_scope(files, none).count() == 0
    assert changes.within_roots(files, none).count() == 1
    assert changes.reconcile_orphans(files, files.limit(0), "path").count() == 0


def test_diff_has_one_row_per_path(spark):
    prev = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "path string, mtime double")
    cur = spark.createDataFrame([("b", 1.0), ("c", 2.0), ("d", 1.0)], "path string, mtime double")
    assert rows(changes.snapshot_diff(prev, cur), "path", "change_type") == [
        ("a", "deleted"), ("b", "unchanged"), ("c", "modified"), ("d", "new")
    ]


def test_up_to_date_rules(spark):
    files = spark.createDataFrame([("a", 1.0, False), ("b", 2.0, False), ("c", 1.0, True), ("d", 1.0, False), ("e", 1.0, False)], "path string, mtime double, force boolean")
    index = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0), ("d", None)], "path string, mtime double")
    assert rows(changes.skip_up_to_date(files, index), "path") == [("b",), ("c",), ("e",)]


def test_path_filter_ignores_case_and_composition(spark):
    files = paths_df(spark, "/Users/Résumé/a", "/straße/b", "/other", None)
    assert rows(filters.filter_path(files, "RÉSUMÉ"), "path") == [("/Users/Résumé/a",)]
    assert rows(filters.filter_path(files, "STRASSE"), "path") == [("/straße/b",)]
    assert filters.filter_path(files, "").count() == 4


# --- retrieval ----------------------------------------------------------------------------------------


def test_vectors_with_zero_rows_score_zero(spark):
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<float>")
    v = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, None)], "id long, vector array<float>")
    assert rows(retrieval.vector_top_k(q, v, 5), "rank", "id", "score") == [(1, 1, 1.0), (2, 3, 0.707107), (3, 2, 0.0)]


def test_ties_at_the_cut_are_ranked_by_key(spark):
    q = spark.createDataFrame([(0, "apple")], "query_id long, text string")
    docs = spark.createDataFrame([(i, "apple pie") for i in range(50, 0, -1)], "id long, content string").repartition(5)
    assert [r["id"] for r in retrieval.keyword_search(q, docs, 3).orderBy("rank").collect()] == [1, 2, 3]


def test_many_query_blocks_give_the_same_ranking(spark, monkeypatch):
    from codicil.operators import scoring

    q = spark.createDataFrame([(i, f"word{i} common") for i in range(30)], "query_id long, text string")
    docs = spark.createDataFrame([(i, f"common word{i % 30} text{i}") for i in range(200)], "id long, content string")
    once = rows(retrieval.keyword_search(q, docs, 4), "query_id", "rank", "id")
    monkeypatch.setattr(scoring, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(scoring, "GROUP_QUERIES", 3)
    assert rows(retrieval.keyword_search(q, docs, 4), "query_id", "rank", "id") == once


def test_modes_are_ratios(spark):
    q = spark.createDataFrame([(0, "apple", [1.0, 0.0])], "query_id long, text string, vector array<float>")
    docs = spark.createDataFrame([(1, "apple", [0.0, 1.0]), (2, "pear", [1.0, 0.0])], "id long, content string, vector array<float>")
    assert rows(retrieval.hybrid_search(q, docs, 5, mode="fulltext"), "id", "score") == [(1, 1.0)]
    assert rows(retrieval.hybrid_search(q, docs, 5, mode="semantic"), "id", "score") == [(1, 0.0), (2, 1.0)]
    assert rows(retrieval.hybrid_search(q, docs, 5), "id", "score") == [(1, 0.5), (2, 0.5)]


def test_similar_terms_match_brute_force(spark):
    import itertools
    import random

    random.seed(3)
    words = {"".join(random.choices("abc", k=random.randint(2, 10))) for _ in range(120)}
    asked = sorted(words)[:25]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = sorted(
        (a, b, distance(a, b)) for a, b in itertools.product(asked, words)
        if distance(a, b) <= (2 if len(a) >= 8 else 1 if len(a) >= 4 else 0)
    )
    got = retrieval.similar_terms(
        spark.createDataFrame([(a,) for a in asked], "term string"), spark.createDataFrame([(w,) for w in words], "found string")
    )
    assert rows(got, "term", "found", "typos") == want


@pytest.mark.parametrize("limit", [256, 0])
def test_containment_matches_brute_force(spark, monkeypatch, limit):
    """With a limit of zero every group takes the path for oversized groups."""
    monkeypatch.setattr(verbatim, "GROUP_ROWS", limit)
    needles = [(g, n) for g in (1, 2) for n in ("ab", "bca", "abcab", "zz", "caab")]
    texts = [(g, i, t) for g in (1, 2) for i, t in enumerate(("xxabyy", "abcabc", "caabca", "none", "zzz"))]
    got = verbatim.bearers(
        spark.createDataFrame(needles, "g int, n string"), spark.createDataFrame(texts, "g int, i int, t string"), "n", "t", ["i"], ("g",), 2
    )
    assert rows(got, "g", "n", "i") == sorted((g, n, i) for g, n in needles for h, i, t in texts if g == h and n in t)


@pytest.mark.parametrize("limit", [256, 0])
def test_digit_containment(spark, monkeypatch, limit):
    monkeypatch.setattr(verbatim, "GROUP_ROWS", limit)
    needles = spark.createDataFrame([(1, "88"), (1, "19885"), (2, "7"), (3, "1")], "a int, token string")
    sources = spark.createDataFrame([(1, "1988", "p"), (1, "88001", "q"), (2, "123456789", "p")], "a int, ctx_token string, path string")
    assert rows(verbatim.digit_support(needles, sources, "a", "left_anti"), "a", "token") == [(1, "19885"), (3, "1")]
    assert rows(verbatim.digit_support(needles, sources, "a", "inner", ("path",)), "a", "token", "path") == [(1, "88", "p"), (1, "88", "q"), (2, "7", "p")]


def test_title_coverage_matches_brute_force(spark):
    from itertools import product

    titles = {"/a": "annual report final 2024.pdf", "/b": "report.pdf", "/c": "assurance maladie taiwan 20260701.pdf", "/d": "final report 2024"}
    asks = {1: "translate assurance maladie taiwan please", 2: "the annual report final", 3: "report 2024 final version"}

    def toks(t):
        found = t.lower().replace(".", " ").split()
        return found[:-1] if found[-1] == "pdf" else found

    want = sorted(
        (q, p, c) for (q, ask), (p, t) in product(asks.items(), titles.items())
        for c in [sum(w in ask.split() for w in toks(t)) / len(toks(t))] if c >= 0.75 and p != "/b"
    )
    got = pins.title_coverage(
        spark.createDataFrame(list(asks.items()), "query_id int, text string"),
        spark.createDataFrame(list(titles.items()), "path string, title string"), threshold=0.75,
    )
    assert rows(got, "query_id", "path", "coverage") == want


# --- audit ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame(
        [(1, 1, "/d/harbour_fees.md", "harbour_fees", "# Harbour fees\nSum 7350 EUR"), (1, 2, "/d/mooring_slip.md", "mooring_slip", "Paid on 3 June"),
         (1, 3, "/d/山城茶會-第6.2版-20230918.pdf", "山城茶會-第6.2版-20230918", "# 山城茶會：春茶\n座位 45 席"),
         (1, 4, "/d/Tide tables of the coast - Kelpie.pdf", "Tides", "x")],
        "answer_id int, rank int, path string, title string, content string",
    )


def test_citation_rules(spark, sources):
    text = "See harbour_fees.md, Kelpie.pdf, 山城茶會.pdf, ees.md and ghost.txt."
    got = audit.fabricated_citations(spark.createDataFrame([(1, text)], "answer_id int, text string"), sources)
    assert rows(got, "candidate") == [("ees.md",), ("ghost.txt",)]
    clean = audit.sanitize_citations(spark.createDataFrame([(1, "A ghost.txt, phantom.pdf end")], "answer_id int, text string"), sources).first()
    assert clean["text"] == "A [source non vérifiée retirée] end" and clean["n_removed"] == 2


def test_roles(spark, sources):
    lines = [
        "D'après mooring_slip.md, la somme versée atteint 7350 EUR.", "C'est le premier document du contexte.",
        "Le fichier s'intitule 山城茶會：春茶.", "⚠️ Fiabilité : 1", "On compte deux quais.", "Le troisième quai mesure 900.",
    ]
    found = audit.sentence_roles(spark.createDataFrame([(1, i, s) for i, s in enumerate(lines)], "answer_id int, sentence_no int, sentence string"), sources)
    assert [r[1] for r in rows(found, "sentence_no", "role")] == ["citation", "habillage", "echo_metadata", "notice", "affirmation", "affirmation"]
    flags = audit.attribute_digits(found, sources)
    assert rows(flags, "sentence_no", "probable_source") == [(0, "harbour_fees.md")]


def test_grounding(spark, sources):
    lines = ["La redevance du port est de 7 350 EUR.", "La redevance du port est de 7 450 EUR.", "La version 6.2 du 20230918 fait foi."]
    roles = audit.sentence_roles(spark.createDataFrame([(1, i, s) for i, s in enumerate(lines)], "answer_id int, sentence_no int, sentence string"), sources)
    assert [r[1] for r in rows(audit.ground_answers(roles, sources), "sentence_no", "supported")] == [True, False, True]
    summary = audit.grounding_summary(spark.createDataFrame([(1,), (2,)], "answer_id int"), audit.ground_answers(roles, sources))
    assert rows(summary, "answer_id", "checked", "unsupported", "grounding_score") == [(1, 3, 1, 0.0), (2, 0, 0, 1.0)]


def test_embedding_rules(spark):
    roles = spark.createDataFrame([(1, 0, "citation", ["/a"], "trois mois selon a")], "answer_id int, sentence_no int, role string, cited array<string>, sentence string")
    sentence = spark.createDataFrame([(1, 0, [1.0, 0.0])], "answer_id int, sentence_no int, vector array<float>")
    near = spark.createDataFrame([(1, "/a", [0.0, 1.0]), (1, "/b.md", [1.0, 0.1])], "answer_id int, path string, vector array<float>")
    assert rows(audit.attribute_embedding(roles, sentence, near), "probable_source") == [("b.md",)]
    far = spark.createDataFrame([(1, "/a", [1.0, 0.1]), (1, "/b.md", [1.0, 0.0])], "answer_id int, path string, vector array<float>")
    assert audit.attribute_embedding(roles, sentence, far).count() == 0
    staged = spark.createDataFrame([(1, 0, "trois mois")], "answer_id int, sentence_no int, stripped string")
    assert rows(audit.stale_embedding(staged, sentence, near), "probable_source") == [("b.md",)]


def test_notices(spark):
    flags = spark.createDataFrame([(1, 0, "Phrase", "a.md", "b.md", True)], "answer_id int, sentence_no int, sentence string, attributed string, probable_source string, stale boolean")
    assert audit.attribution_notice(flags).first()["notice"] == (
        "\n\n⚠️ Fiabilité : l'extrait attribué à « a.md » (introuvable dans les documents de ce tour) semble provenir de « b.md » — vérifiez la source."
    )
    found = spark.createDataFrame([(1, "X-1")], "answer_id int, token string")
    listed = spark.createDataFrame([(1, "/a"), (1, "/b")], "answer_id int, label string")
    bearers = spark.createDataFrame([("X-1", 9)], "token string, bearers long")
    assert audit.multi_source_notice(found, listed, bearers).first()["notice"] == (
        "\n\n📎 Cette information apparaît dans au moins 9 documents (les 2 plus pertinents) :\n• /a\n• /b"
    )


# --- conversations and context -----------------------------------------------------------------------------


def test_referent_replay(spark):
    turns = [
        (1, 0, "Parlons de cet atlas des côtes de Bretagne", "/a", None), (1, 2, "Combien de cartes montre-t-il ?", None, "/noise"),
        (1, 4, "Le règlement intérieur de la grande société cliente", None, "/b"), (1, 6, "reviens au premier document", None, None),
        (1, 8, "Et il dit quoi ?", None, None), (1, 10, "le dernier document", None, None), (2, 0, "il est où ?", None, "/z"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, text string, named_path string, fallback_path string").repartition(3)
    got = rows(conversation.referent_stack(df), "conv_id", "turn", "action", "referent", "stack_size")
    assert [(c, t, a) for c, t, a, *_ in got] == [
        (1, 0, "none"), (1, 2, "hold"), (1, 4, "none"), (1, 6, "recall"), (1, 8, "hold"), (1, 10, "recall"), (2, 0, "none")
    ]
    assert [r for *_, r, _ in got] == [None, "/a", None, "/a", "/a", "/a", None]


def test_pack_context_never_exceeds_the_budget(spark):
    ranked = spark.createDataFrame([(1, r, "x" * 800) for r in range(1, 9)], "query_id int, rank int, text string")
    kept = context.pack_context(ranked, 1000, 100).orderBy("rank").collect()
    assert [len(r["text"]) for r in kept] == [800, 800, 800, 800] and not any(r["truncated"] for r in kept[:4])
    cut_last = context.pack_context(ranked.withColumn("text", F.when(F.col("rank") == 5, F.repeat(F.lit("y"), 4000)).otherwise(F.col("text"))), 1200, 100).orderBy("rank").collect()
    assert [r["rank"] for r in cut_last] == [1, 2, 3, 4, 5] and len(cut_last[-1]["text"]) == (1200 - 900 - 50) * 4 + 3


def test_blank_contents_are_never_duplicates(spark):
    ranked = spark.createDataFrame([(1, 1, "/a", "same"), (1, 2, "/b", " same "), (1, 3, "/c", " "), (1, 4, "/d", "")], "query_id int, rank int, path string, content string")
    assert rows(context.dedup_by_content(ranked), "path") == [("/a",), ("/c",), ("/d",)]


def test_eta_edges(spark):
    schema = "status string, file_path string, started_at timestamp, completed_at timestamp"
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    left = spark.createDataFrame([(".pdf", 10)], "extension string, n long")
    idle = spark.createDataFrame([], schema)
    assert ops.throughput_eta(idle, left, now).first()["eta_seconds"] is None
    done = spark.sql("SELECT 'completed' status, '/a.pdf' file_path, timestamp'2024-01-01 11:55:00' started_at, timestamp'2024-01-01 11:55:30' completed_at")
    got = ops.throughput_eta(done, left, now).first()
    assert (got["eta_seconds"], got["confidence"], got["recent_completed"]) == (300, "low", 1)
    assert ops.throughput_eta(done, left.limit(0), now).first()["eta_seconds"] == 0


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("un été\r\nfin".encode())
    (tmp_path / "b.md").write_bytes("latin é".encode("latin-1"))
    (tmp_path / "c.md").write_bytes("seize é".encode("utf-16"))
    (tmp_path / "d.json").write_text('{"a": {"b": [1, {"c": 2}]}}')
    (tmp_path / "e.json").write_text("{broken")
    texts = {r["path"].rsplit("/")[-1]: r for r in readers.read_text_files(spark, str(tmp_path)).collect()}
    assert (texts["a.txt"]["text"], texts["a.txt"]["word_count"], texts["a.txt"]["line_count"]) == ("un été\nfin", 3, 2)
    assert (texts["b.md"]["encoding"], texts["b.md"]["text"]) == ("latin-1", "latin é")
    assert (texts["c.md"]["encoding"], texts["c.md"]["text"]) == ("utf-16", "seize é")
    docs = {r["path"].rsplit("/")[-1]: r for r in readers.read_json_docs(spark, str(tmp_path)).collect()}
    assert docs["d.json"]["keys_count"] == 3 and docs["e.json"]["error"].startswith("Invalid JSON")
    assert {r["extension"] for r in readers.file_inventory(spark, str(tmp_path)).collect()} == {".txt", ".md", ".json"}
    assert readers.read_vectors(spark, str(tmp_path / "none"), "id long, vector array<float>").count() == 0


def test_publication(spark, tmp_path):
    table = sinks.Publication(spark, str(tmp_path), "published")
    with pytest.raises(ValueError):
        table.rollback()
    table.build(spark.range(3), "v1")
    table.swap()
    with pytest.raises(ValueError):
        table.build(spark.range(0), "v2", check=lambda df: df.count() > 0)
    assert table.read().count() == 3
    table.build(spark.range(5), "v3")
    table.swap()
    assert spark.table("published").count() == 5
    table.rollback()
    assert spark.table("published").count() == 3 and table.previous == "v3"


def test_embeddings(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, "gamma"), (4, "")], "id long, t string")
    vectors = {r["id"]: np.array(r["vector"]) for r in retrieval.embed_hashed(docs, "t", size=64).collect()}
    assert vectors[1] @ vectors[2] == pytest.approx(1.0) and vectors[4] @ vectors[4] == 0
    own = retrieval.embed_with(docs, "t", lambda: lambda texts: [[float(len(t))] for t in texts])
    assert rows(own.where("vector IS NOT NULL"), "id") == [(1,), (2,), (3,)]


def test_retrieval_end_to_end(spark):
    docs = spark.createDataFrame(
        [("/d/contrat.md", "contrat", "Le contrat de bail mentionne REF-2024x et un loyer."), ("/d/copie.md", "copie", "Le contrat de bail mentionne REF-2024x et un loyer."),
         ("/d/note.md", "note", "Une note sur les fournitures de bureau."), ("/d/facture.md", "facture", "La facture du fournisseur.")],
        "path string, title string, content string",
    )
    asked = spark.createDataFrame([(1, "Où apparaît REF-2024x ?"), (2, "ouvre facture")], "query_id int, text string")
    got = rows(retrieve(asked, docs), "query_id", "position", "path", "pinned")
    assert [(q, path, pin) for q, _, path, pin in got if q == 2][0] == (2, "/d/facture.md", True)
    first = [path for q, _, path, pin in got if q == 1]
    assert first == ["/d/contrat.md"]  # the copy has the same content and is dropped


def test_sql_names(spark):
    from codicil.functions.registry import register_all

    register_all(spark)
    assert spark.sql("SELECT fold('Été') f").first()["f"] == "ete"
    assert spark.sql(f"SELECT size(chunk_pieces('{'a' * 2000}')) n").first()["n"] == 2
    assert spark.sql(f"SELECT count(*) n FROM chunk_text('{'a' * 2000}')").first()["n"] == 2


def test_search_folds_both_sides_alike_and_answers_blank_queries(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["ΟΔΟΣ Αθηνών", "İzmir limanı", "plain text", None])], "id long, content string")
    asked = spark.createDataFrame([(1, "ΟΔΟΣ"), (2, "İzmir"), (3, " ?! "), (4, None)], "query_id long, text string")
    got = {(r["query_id"], r["rank"], r["id"]) for r in retrieval.keyword_search(asked, docs, 2).collect()}
    assert got == {(1, 1, 0), (2, 1, 1), (3, 1, 0), (3, 2, 1), (4, 1, 0), (4, 2, 1)}


def test_a_task_passes_on_no_more_than_the_limit(spark, monkeypatch):
    monkeypatch.setattr(scoring, "CELLS", 40 * 256)
    monkeypatch.setattr(scoring._Best, "KEPT", 50)
    docs = spark.range(3000).selectExpr("id", "concat('word ', id % 7) as content").repartition(3)
    asked = spark.createDataFrame([(1, "word"), (2, "word 3"), (3, "5")], "query_id long, text string")
    scored = scoring.lexical_scores(asked, docs, "id", "content", limit=4)
    assert scored.count() <= 3 * 4 * 3
    best = {(r["query_id"], r["id"]) for r in retrieval.keyword_search(asked, docs, 4).collect()}
    assert best == {(1, i) for i in range(4)} | {(2, i) for i in (3, 10, 17, 24)} | {(3, i) for i in (5, 12, 19, 26)}


def test_one_row_of_each_key_wins(spark):
    batch = spark.createDataFrame([(1, "a", 5), (1, "b", 5), (1, "c", 4), (2, "d", 1), (2, "d", 1)], "id int, content string, version int")
    target = spark.createDataFrame([(1, "old", 0), (3, "kept", 0)], "id int, content string, version int")
    got = {r["id"]: r["content"] for r in sinks.upsert_documents(target, batch, version="version").collect()}
    assert set(got) == {1, 2, 3} and got[1] in ("a", "b") and got[2] == "d" and got[3] == "kept"
    assert sinks.upsert_documents(target, batch, version="version").count() == 3
