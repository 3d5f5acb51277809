"""Column functions on hand-made rows, mostly with text the driver tables lack."""

import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from codicil.functions import answers, paths, queries, text, turns
from codicil.functions import unicode as uc

T = "t"


@pytest.mark.parametrize(
    "raw,tag",
    [("fr-FR", "fr"), ("fra", "fr"), ("zh_TW", "zh"), ("chi_tra", "zh"), ("EN", "en"), ("xx", "xx"), ("", "unknown"),
     ("fra+eng", "unknown"), ("fra+fr", "fr"), ("klingon", "unknown"), (None, "unknown"), ("yue", "zh")],
)
def test_language_tag(value, raw, tag):
    assert value(text.language_tag(F.col(T)), t=raw) == tag


@pytest.mark.parametrize("raw,want", [(None, None), ("  ", None), ("FRA", "fr"), ("klingon", "klingon"), ("unknown", "unknown")])
def test_language_filter_value(value, raw, want):
    assert value(text.language_filter_value(F.col(T)), t=raw) == want


def test_normalize_text(value):
    assert value(text.normalize_text(F.col(T)), t="\r\n a  b\r\rc\n\n\n\nd  ") == "a b\n\nc\n\nd"


def test_glue_line_and_columns(value):
    glue = text.glue_cjk(F.col(T))
    assert value(glue, t="承 擔\t責 any 任") == "承擔責 any 任"
    assert value(glue, t="前\n天\n 地 \n玄\n黃 色\nend") == "前天地玄\n黃色\nend"
    assert value(glue, t="天\n地\nsentence") == "天\n地\nsentence"
    once = value(glue, t="天\n地\n玄\n黃\nx y")
    assert value(glue, t=once) == once == "天地玄黃\nx y"


def test_scripts(value):
    ratio = text.script_ratio(F.col(T), ["LATIN"])
    assert value(ratio["ratio"], t="ab12Жш") == 0.5 and value(ratio["letters"], t="ab12Жш") == 4
    assert value(ratio["ratio"], t="123 !") == 0.0
    assert value(text.missing_script(F.col(T), ["CJK"]), t="only latin") is True
    assert value(text.missing_script(F.col(T), ["CJK"]), t="one 字") is False
    assert value(text.is_garbled(F.col(T), ["en"]), t="Ж" * 60 + "a" * 160) is True
    assert value(text.is_garbled(F.col(T), ["en"]), t="Ж" * 40 + "a" * 150) is False
    assert value(text.is_garbled(F.col(T), []), t="Ж" * 500) is False


def test_sentences(value):
    assert value(text.sentences(F.col(T)), t="甲乙。丙丁！Pi is 3.14. Next… end\n• item\n\n") == [
        "甲乙。", "丙丁！", "Pi is 3.14.", "Next…", "end", "• item"
    ]


def test_identity_ignores_composition(value):
    a, b = "/docs/résumé.pdf", unicodedata.normalize("NFD", "/docs/résumé.pdf")
    ids = {value(paths.doc_id(F.col(T)), t=x) for x in (a, b)}
    assert ids == {hashlib.sha256(a.encode()).hexdigest()}


@pytest.mark.parametrize(
    "path,stem,ext,parent",
    [("/a/b/c.tar.GZ", "c.tar", ".gz", "/a/b"), ("/a/.bashrc", ".bashrc", "", "/a"), ("/x", "x", "", "/"), ("/a/n.", "n.", "", "/a")],
)
def test_path_parts(value, path, stem, ext, parent):
    got = value(paths.path_parts(F.col(T)), t=path)
    assert (got["title"], got["file_type"], got["parent"]) == (stem, ext, parent)


def test_routes(value):
    def route(path, mb):
        return tuple(value(paths.route(F.col(T), F.lit(mb)), t=path))

    assert route("/a.json", 1.0) == ("json", None)
    assert route("/a.md", 1.0) == ("plaintext", None)
    assert route("/a.html", 1.0) == ("code", None)
    assert route("/a.doc", 1.0)[1].startswith("Legacy Office format (.doc)")
    assert route("/a.zzz", 1.0) == (None, "Unsupported file type: .zzz")
    assert route("/a.json", 60.0)[1].startswith("File too large: 60.0 MB")


@pytest.mark.parametrize(
    "path,keep",
    [("/r/rebuild/a.md", True), ("/r/venv/a.md", False), ("/r/pkg.egg-info/a.txt", False), ("/r/.git/a.md", False),
     ("/r/.hidden.md", False), ("/r/a.py", False), ("/r/x/a.PDF", True)],
)
def test_scannable(value, path, keep):
    assert value(paths.is_scannable(F.col(T)), t=path) is keep


def test_digit_tokens(value):
    digits = answers.digit_tokens(F.col(T))
    assert value(digits, t="2 400 or 1.200, 8,5 and points 1, 2 et 3 in 1988") == ["2400", "1200", "85", "1", "2", "3", "1988"]


def test_quantity_and_checkable(value):
    assert value(answers.has_quantity(F.col(T)), t="trois mois") is True
    assert value(answers.has_quantity(F.col(T)), t="三個月") is True
    assert value(answers.has_quantity(F.col(T)), t="un mois") is False
    assert value(answers.is_checkable(F.col(T)), t="試用期為三個月") is True
    assert value(answers.is_checkable(F.col(T)), t="Voici 3.") is False
    assert value(answers.is_checkable(F.col(T)), t="⚠️ Fiabilité : 1 détail chiffré") is False


def test_structured_tokens(value):
    found = value(queries.structured_tokens(F.col(T), 2), t='Où est "le contrat" de a.b@acme.tw, REF-2024x, 粒 米 女 et 20240131 字 ?')
    assert found == ["a.b@acme.tw,", "le contrat", "粒米女", "2024x", "20240131"]


def test_apostrophes_are_quotes_unless_guarded(value):
    phrase = "l'état d'urgence"
    assert value(queries.structured_tokens(F.col(T)), t=phrase) == ["état d"]
    assert value(queries.structured_tokens(F.col(T), 1, True), t=phrase) == []


def test_terms(value):
    assert value(queries.salient_terms(F.col(T)), t="Quelle est la date de l'échéance 2024 ?") == ["date", "échéance", "2024"]
    assert value(queries.anchor_terms(F.col(T)), t="事假 扣薪 rule") == ["事假", "扣薪", "rule", "假扣"]
    assert set(value(queries.anchor_terms(F.col(T)), t="事假扣薪")) >= {"事假", "假扣", "扣薪"}


def test_query_rewrites(value):
    reduced = queries.reduce_meta_question(F.col(T))
    assert value(reduced, t="Quels sont les documents qui parlent d'enseignants ?")["subject"] == "enseignants"
    assert value(reduced, t="哪些文件提到玻璃？")["subject"] == "玻璃"
    assert value(reduced, t="有沒有關於 假期 的文件？")["subject"] == "假期"
    miss = value(reduced, t="Which colour is it?")
    assert (miss["matched"], miss["near_miss"], miss["subject"]) == (False, True, "Which colour is it?")
    assert value(queries.expanded_query(F.col(T)), t="Où est mon CV ?") == "cv curriculum vitae resume résumé"
    assert value(queries.should_expand(F.col(T)), t="one two three four five") is False
    assert value(queries.should_expand(F.col(T)), t="one two three four five pdf") is True


@pytest.mark.parametrize(
    "message,intent",
    [("Qui suis-je ?", "identity_user"), ("Qui es-tu ?", "identity_self"), ("Quel jour sommes-nous ?", "temporal"),
     ("Quelle est la date du contrat ?", "none"), ("Quelle est la date ?", "temporal"), ("Quels dossiers lis-tu ?", "index_scope"),
     ("What is Zed?", "identity_self")],
)
def test_config_intent(value, message, intent):
    assert value(turns.config_intent(F.col(T), "zed"), t=message) == intent


@pytest.mark.parametrize(
    "message,small",
    [("Bonjour !", True), ("Bonjour Zed !", True), ("Bonjour, quels sont les horaires du bac ?", False), ("merci", True),
     ("茶會報名規則", False), ("?!", True), ("ok parfait", True)],
)
def test_small_talk(value, message, small):
    assert value(turns.is_small_talk(F.col(T)), t=message) is small


@pytest.mark.parametrize(
    "message,kind",
    [("Combien de cartes montre-t-il ?", "followup"), ("Y a-t-il un relevé détaillé sur les marées du golfe de cette saison ?", "new"),
     ("reviens au premier document", "ordinal_first"), ("le dernier", "ordinal_last"), ("它的座位數", "followup"),
     ("第一個文件", "ordinal_first"), ("La carte des phares de la côte", "new"), ("", "new")],
)
def test_classify_turn(value, message, kind):
    assert value(turns.classify_turn(F.col(T)), t=message) == kind


def test_strip_notices_is_idempotent(value):
    raw = "ℹ️ Réponse générale — pas issue de vos documents.\n\nYes.\n\n⚠️ Avertissement : x\n\n⚠️ Fiabilité : y"
    clean = value(turns.strip_notices(F.col(T)), t=raw)
    assert clean == "Yes." == value(turns.strip_notices(F.col(T)), t=clean)


def test_casefold_and_fold(value):
    assert value(uc.nfc_casefold(F.col(T)), t="Straße") == "strasse"
    assert value(uc.fold(F.col(T)), t="Élan") == "elan"


def test_excerpt(value):
    body = "x" * 300 + "Needle" + "y" * 300
    got = value(text.excerpt_around(F.col(T), F.lit("needle")), t=body)
    assert got == "…" + "x" * 200 + "Needle" + "y" * 200 + "…"
    assert value(text.excerpt_around(F.col(T), F.lit("none")), t=body) == body[:400]


def test_dates(value):
    assert value(text.normalise_date(F.col(T)), t="D:20240131235959+01") == "2024-01-31T23:59:59"
    assert value(text.normalise_date(F.col(T)), t="20240131") == "2024-01-31"
    assert value(text.normalise_date(F.col(T)), t="2024") == "2024"


def test_latin_share_is_the_fast_form(value):
    assert value(text.latin_share(F.col(T)), t="abЖ") == pytest.approx(1 / 3)


def test_letters_are_counted_by_replacing_them(spark):
    """A translation looks every character up in a table, twelve times a text (F13, F27)."""
    from codicil.catalog.tables import LETTERS, letter_vector

    assert "translate" not in str(letter_vector("text"))
    text = "ÉTÉ Été ee Tt 漢字 é ı İ"
    found = spark.createDataFrame([(text,), ("",), (None,)], "text string").select(letter_vector("text").alias("v")).collect()
    assert found[0]["v"][:2] == [3.0, 4.0] and found[1]["v"] == [0.0] * len(LETTERS) and found[2]["v"] == [None] * len(LETTERS)
