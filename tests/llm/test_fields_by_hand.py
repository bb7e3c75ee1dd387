"""Language and toxicity predictions against features, marginals and sums written out in plain Python."""

import math
import random
from itertools import product

import pytest

pytest.importorskip("pointloom.llm")

from pointloom.llm import langid, toxicity  # noqa: E402

ALL = (1 << 64) - 1
M = 0x9E3779B97F4A7C15
STEMS = {"aa": ["kilo", "mora", "tipa", "wero"], "bb": ["schul", "grun", "pfla", "zwis"], "cc": ["queu", "beaux", "oise", "trei"]}


def spread(h):
    h = ((h ^ (h >> 31)) * 0xD6E8FEB86659FD93) & ALL
    return h ^ (h >> 29)


def keys(word):
    """Keys of the features of a word: itself, openings of 2 to 6, endings of 1 to 4, letter trigrams with borders."""
    kind = lambda n: n * 0x2545F4914F6CDD1D & ALL
    h, whole = 0, 0
    for c in map(ord, word):
        whole = spread(((whole + c) * M) & ALL)
    out = [spread((whole + kind(1) + kind(2)) & ALL)]
    for i, c in enumerate(map(ord, word[:6])):
        h = ((h + c) * M) & ALL
        if i:
            out.append(spread((h + kind(10 + i)) & ALL))
    h = 0
    for i, c in enumerate(map(ord, word[::-1][:4])):
        h = ((h + c) * M) & ALL
        out.append(spread((h + kind(20 + i)) & ALL))
    e = [1, *map(ord, word), 2]
    return out + [spread((((((a * M + b) * M) + c) * M) + kind(3)) & ALL) for a, b, c in zip(e, e[1:], e[2:])]


def words(text):
    out, now = [], ""
    for c in (text or "") + " ":
        if c.isalpha():
            now += c
        elif now:
            out.append(now.lower())
            now = ""
    return out


def marginals(model, ws):
    """Probability of each label at each word, by the sum over all labellings."""
    place = {int(k): i for i, k in enumerate(model.keys)}
    k = len(model.labels)
    scores = []
    for w in ws:
        at = [place[x] for x in keys(w) if x in place] + [len(model.keys) + i for i, (_, v) in enumerate(sorted(model.lexicons.items())) if w in v]
        scores.append([sum(model.weights[i, c] for i in at) / math.sqrt(max(1, len(at))) + model.bias[c] for c in range(k)])
    total, p = 0.0, [[0.0] * k for _ in ws]
    for y in product(range(k), repeat=len(ws)):
        v = math.exp(model.start[y[0]] + sum(scores[i][c] for i, c in enumerate(y)) + sum(model.transitions[a, b] for a, b in zip(y, y[1:])))
        total += v
        for i, c in enumerate(y):
            p[i][c] += v
    return [[v / total for v in row] for row in p]


def say(rng, stems, n):
    return " ".join(rng.choice(stems) + rng.choice(["a", "en", "ion", "o", ""]) for _ in range(n))


def test_language_by_hand(spark):
    rng = random.Random(3)
    schema = "doc_id long, text string, lang string"
    rows = [(i if i % 5 else None, say(rng, STEMS[v], 30), v) for i, v in enumerate(["aa", "bb", "cc"] * 30)]
    model = langid.train(spark.createDataFrame(rows + rows[:20], schema))
    assert sorted(model.labels) == ["aa", "bb", "cc"]
    texts = [say(rng, STEMS[v], rng.randrange(1, 4)) + " " + say(rng, STEMS[u], rng.randrange(0, 3)) for v in STEMS for u in STEMS for _ in range(3)] + ["x", "Éa tipa", "unknown words", "kilo", None, "", "12 -"]
    df = spark.createDataFrame([(None if i % 4 == 0 else 7, t, "zz") for i, t in enumerate([*texts, *texts])], schema)  # null and repeated keys, repeated rows
    got = langid.predict(df, model).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        ws = words(r.text)
        if not ws:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        p = marginals(model, ws)
        mean = [sum(row[c] for row in p) / len(ws) for c in range(3)]
        assert abs(max(mean) - r.score) < 1e-4 and abs(mean[model.labels.index(r.lang_pred)] - max(mean)) < 1e-4


def test_toxicity_by_hand(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(120):
        w = say(rng, STEMS["aa"], 30).split()
        if i % 3 == 0:
            w[rng.randrange(30)] = "vile" + rng.choice(["a", "en", "ion"])
            w[rng.randrange(30)] = "vileness"
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    docs = spark.createDataFrame([*rows, (None, "kilo vileness"), rows[0]], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([*labels, (None, 1), labels[0]], "doc_id long, toxic int"))
    texts = ["kilo vileness mora", "kilo mora tipa", "Vilea, wero! kilo", "vileness vileion", "tipa", "", None, "1 2"]
    got = toxicity.score(spark.createDataFrame([(None if i == 2 else 5, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).collect()
    assert [r.text for r in got] == texts
    for r in got:
        ws = words(r.text)
        p = [row[1] for row in marginals(model.field, ws)] if ws else []
        a, b, c = model.curve
        worst = min(max(max(p), 1e-6), 1 - 1e-6) if p else None
        x, y = (math.log(worst / (1 - worst)), math.log1p(sum(v for v in p if v >= 0.05))) if p else (-12.0, 0.0)
        exp = 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * x + c * y))))
        assert abs(exp - r.score) < 2e-3 and r.predicted == int(r.score >= 0.5)
        hot = [i for i, v in enumerate(p) if v >= 0.5]
        assert [r.text[s.begin : s.end].lower() for s in r.spans] == [ws[i] for i in hot] and all(abs(s.p - p[i]) < 1e-4 for s, i in zip(r.spans, hot))
    assert got[0].predicted == 1 and got[1].predicted == 0
