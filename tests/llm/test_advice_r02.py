"""Personal data: seeds and instances that contexts had left out."""

import string

from codicil.llm import pii


def test_seeds_without_digits_with_blanks_and_behind_any_separator(spark):
    def card(i):
        head = f"411111111111{i:03d}"
        return next(f"{n[:4]} {n[4:8]} {n[8:12]} {n[12:]}" for n in (f"{head}{c}" for c in "0123456789") if pii_luhn(n))

    def pii_luhn(number):
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
        return sum(v - 9 if v > 9 else v for v in twice) % 10 == 0

    names = [a + "ane" for a in string.ascii_lowercase[:12]]
    texts = [f"mail:\t{n}.doe@example.com and so on" for n in names] + ["we have mail:\nanna[at]host.example and so on"]
    texts += [f"ring tel +1 (974) 555-34{i:02d} after six" for i in range(12)] + ["ring tel 0974 (12) 555-99 after six"]
    texts += [f"card no {card(i)} ok" for i in range(12)] + ["card no 4111 1111 xxxx 111a ok"]
    texts += [f"user={n}@key.example.org;" for n in names] + ['user="jane(at)key", then']
    texts += [f"seen in {w} often" for w in names]
    got = {r["id"]: r for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = {i: [texts[i][s["start"] : s["end"]] for s in r["context"]] for i, r in got.items() if r["context"]}
    assert found == {12: ["anna[at]host.example"], 25: ["0974 (12) 555-99"], 38: ["4111 1111 xxxx 111a"], 51: ["jane(at)key"]}


def test_context_spans_far_into_a_text(spark):
    rows = [(i, f"mail: {c}@example.com end") for i, c in enumerate(string.ascii_lowercase)]
    rows.append((100, "𝒳 wörd: \n" * 1500 + "x=mail:  <anna[at]host>. " + "tail " * 900))
    got = {r["id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [rows[-1][1][s["start"] : s["end"]] for s in got[100]["context"]] == ["anna[at]host"]


def run(spark, texts):
    rows = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r["id"]: [texts[r["id"]][s["start"] : s["end"]] for s in r["context"]] for r in rows if r["context"]}


def test_trusted_instances_lead_to_patterns_without_base_spans(spark):
    odd = [f"{a}{b}une[at]host" for a in string.ascii_lowercase for b in "rst"][:20]
    texts = [f"mail: {a}{b}ane@example.com end" for a in string.ascii_lowercase for b in "xyz"]
    texts += [f"mail: {n} end" for n in odd] + [f"fax: {n} end" for n in odd] + ["fax: never(at)seen end", "tape: only(at)here end"]
    found = run(spark, texts)
    assert found == {i: [t.split()[1]] for i, t in enumerate(texts) if i >= 78 and not t.startswith("tape")}


def test_numbers_behind_stop_words_stay(spark):
    texts = [f"see the user{i}x@mail.example page and the report in the {1900 + i}s of the 19{i:02d}x models" for i in range(40)]
    texts += [f"the house on the hill and the road in the {1900 + i}s" for i in range(40)]
    texts += [f"in the {i} cases and the {i}th of the plans" for i in range(40)]
    assert run(spark, texts) == {}


def test_two_words_make_a_pattern_where_the_nearer_alone_does_not(spark):
    texts = [f"reach us at {a}une@example.com today" for a in string.ascii_lowercase] + ["reach us at night(at)example today"]
    texts += [f"look at {w} and at b{i}c today" for i, w in enumerate(["houses", "trees", "ships"] * 12)]
    assert run(spark, texts) == {26: ["night(at)example"]}


def test_an_instance_may_have_any_number_of_tokens(spark):
    texts = ["call: +49 " + " ".join(f"{(i * 7 + k) % 10}" for k in range(9)) + " ok" for i in range(12)]
    long = "+49" + " 1" * 120
    assert run(spark, [*texts, f"call: {long} ok"]) == {12: [long]}


def test_time_grows_with_the_text_and_not_with_its_square(spark):
    import time

    names = [f"{a}{b}ane" for a in string.ascii_lowercase for b in "xy"]

    def seconds(hits):
        words = [f"{names[i % 6]}[at]host" if i % 4 == 0 else f"{names[i % 52]}@example.com" for i in range(hits)]
        text = " or ".join(f"mail: {w}" for w in words)
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        spent = []
        for _ in range(2):
            began = time.time()
            found = pii.find_personal_data(df).first()
            spent.append(time.time() - began)
        assert len(text) >= 20 * hits and len(found["email"]) == hits * 3 // 4 and len(found["context"]) == hits // 4
        return min(spent)

    assert seconds(16_000) < 4 * seconds(4_000)
