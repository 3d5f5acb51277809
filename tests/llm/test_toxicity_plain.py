"""The classifier chain against plain loops: scores of whole texts, and weights at the optimum of their penalised loss."""

import math
import random
import re

import numpy as np
import xxhash

from codicil.llm import toxicity
from tests.llm.conftest import SF


def plain_features(text):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    counts = {}
    for word in words:
        for name in [f"={word}"] + [f"^{word[:n]}" for n in (3, 4, 5, 6) if len(word) >= n]:
            counts[name] = counts.get(name, 0) + 1
    out = set()
    for name, n in counts.items():
        base = (xxhash.xxh64_intdigest(name) >> 4) * 8
        out.add(base)
        if n > 1:
            levels = {1: True, 2: n >= 4, 3: n * 100 >= len(words), 4: n * 30 >= len(words)}
            out |= {base + i for i, reached in levels.items() if reached}
    return out


def plain_chain(chain, present):
    out = []
    for model in chain.models:
        z = model.intercept + sum(w for f, w in model.weights.items() if f in present) + sum(w * p for w, p in zip(model.earlier, out, strict=True))
        out.append(1 / (1 + math.exp(-max(-40, min(40, z)))))
    return out


def test_scores_of_whole_texts(spark, documents, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    chain = toxicity.fit(documents, labels, toxicity.label_categories())
    assert all(m.weights for m in chain.models) and len(chain.models[1].earlier) == 1
    for frame in (documents, odd):
        rows = toxicity.score(frame, chain, keep=["doc_id", "text"]).collect()
        assert len(rows) == frame.count()
        for r in rows:
            want = plain_chain(chain, plain_features(r["text"]))
            assert abs(r["p_low_quality"] - want[0]) < 1e-9 and abs(r["p_toxic"] - want[1]) < 1e-9


def test_weights_are_at_the_optimum_and_earlier_probabilities_are_out_of_fold():
    draw = random.Random(5)
    rows = []
    for i in range(240):
        first, x = draw.random() < 0.5, [j for j in range(6) if draw.random() < 0.4]
        second = (2 in x) != (draw.random() < 0.15)
        rows.append((i % 3, [int(first and 0 in x or draw.random() < 0.2), int(second)], [x, x]))
    chosen, penalty = [list(range(10, 16)), list(range(20, 26))], 0.01
    chain = toxicity.train(rows, chosen, ["a", "b"], penalty=penalty, steps=4000)
    x = np.array([[1.0 if j in r[2][0] else 0.0 for j in range(6)] for r in rows])
    fold = np.array([r[0] for r in rows])
    y = np.array([r[1] for r in rows], float)

    def gradient(model, columns, answers, names):
        w = np.array([model.weights.get(f, 0.0) for f in names] + model.earlier)
        p = 1 / (1 + np.exp(-(columns @ w + model.intercept)))
        return w, columns.T @ (p - answers) / len(answers), (p - answers).mean()

    w, g, intercept = gradient(chain.models[0], x, y[:, 0], chosen[0])
    assert abs(intercept) < 1e-4 and all(abs(a) <= penalty + 1e-4 if not b else abs(a + penalty * np.sign(b)) < 1e-4 for a, b in zip(g, w, strict=True))
    earlier = np.empty(len(rows))
    for f in range(3):  # the first category's probabilities come from rows of other folds
        part = [r for r in rows if r[0] != f]
        model = toxicity.train(part, [chosen[0]], ["a"], penalty=penalty, steps=4000).models[0]
        own = np.array([model.weights.get(c, 0.0) for c in chosen[0]])
        earlier[fold == f] = 1 / (1 + np.exp(-(x[fold == f] @ own + model.intercept)))
    w, g, intercept = gradient(chain.models[1], np.column_stack([x, earlier]), y[:, 1], chosen[1])
    assert abs(intercept) < 1e-3 and all(abs(a) <= penalty + 1e-3 if not b else abs(a + penalty * np.sign(b)) < 1e-3 for a, b in zip(g, w, strict=True))
