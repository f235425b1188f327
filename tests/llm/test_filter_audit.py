import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa

from plumbline.llm import filter_audit


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
    }


def brute(rows, labels):
    found = []
    for i, text, part in rows:
        f = fails(text or "")
        f["E"] = any(j is not None and i is not None and j < i and (t or "") == (text or "") for j, t, _ in rows)
        found.append((part or "", {k for k, v in f.items() if v}, any(d == i and q == 1 for d, q, _ in labels), any(d == i and x == 1 for d, _, x in labels)))
    out = []
    for part in {p for p, *_ in found}:
        own, shapley = [x for x in found if x[0] == part], {f: 0 for f in "ABCDE"}
        made = []
        for order in permutations("ABCDE"):
            alive = own
            for step, f in enumerate(order, 1):
                gone = [x for x in alive if f in x[1]]
                left = [x for x in alive if f not in x[1]]
                shapley[f] += len(gone)
                early = set(order[: step - 1])
                made.append((part, "".join(order), step, len(left), len(gone), sum(f in x[1] and bool(x[1] & early) for x in own), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone), f))
                alive = left
        out += [(*m[:-1], shapley[m[-1]]) for m in made]
    return sorted(out)


def corpus(rng):
    vocab = ["low", "High", "é", "UPPER", "日本", "a", "b#", "50%", "x" * 70, *[f"w{i}" for i in range(150)]]
    rows = [(i, " ".join(rng.choices(vocab, weights=[3, 1, 1, rng.choice([0, 9]), 1, 1, rng.choice([0, 0, 1]), 0, 1, *[rng.choice([0, 1])] * 150], k=rng.choice([0, 3, 49, 50, 51, 120]))), rng.choice(["s1", "s2", "", None])) for i in range(120)]
    rows += [(rng.randint(0, 300), rows[rng.randrange(9)][1], rng.choice(["s1", "s3"])) for _ in range(40)]
    rows += [(500, None, "s1"), (499, "", None), (501, " \t", "s2"), (None, rows[0][1], "s1"), (None, "once", "s1"), rows[5], rows[5], (502, "a b c " * 40000, "s1"), (503, "y" * 2_500_000 + " z" * 60, "s1")]
    return rows


def test_equals_brute_force(spark):
    rng = random.Random(6)
    rows = corpus(rng)
    labels = [(rng.choice([*range(130), 500, None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(160)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, mask int, digest string").repartition(6)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in filter_audit.audit(df, marks).collect())
    assert got == brute(rows, labels)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "x", "s")], "doc_id long, text string, source string")
    assert filter_audit.audit(one, labels).count() == 600


def test_words_of_one_hash_are_told_apart(monkeypatch):
    real = filter_audit.words

    def coarse(data, starts):
        w = real(data, starts)
        w.hash = w.hash % np.uint64(3)
        return w

    monkeypatch.setattr(filter_audit, "words", coarse)
    rng = random.Random(7)
    texts = [" ".join(rng.choices(["aa", "ab", "b", "ccc", "é"], k=rng.randint(0, 30))) for _ in range(60)]
    (first, data, starts), = filter_audit.runs(pa.array(texts))
    n, distinct = filter_audit.distinct_words(data, starts)
    assert first == 0 and n.tolist() == [len(t.split()) for t in texts] and distinct.tolist() == [len(set(t.split())) for t in texts]
