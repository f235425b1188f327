import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import kneser_ney


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


class Plain:
    """The same model with dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        self.raw = Counter(t for x in texts for t in tokens(x))
        counts = Counter()
        for x in texts:
            row = ["<b>"] * (order - 1) + tokens(x)
            counts.update(tuple(row[i : i + order]) for i in range(len(row) - order + 1))
        self.count = {order: counts}
        for k in range(order - 1, 0, -1):
            self.count[k] = Counter(g[1:] for g in self.count[k + 1])
        self.d, self.total, self.followers = {}, {}, {}
        for k, c in self.count.items():
            self.d[k] = (0.0, *kneser_ney.discounts_of([sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]))
            self.total[k], self.followers[k] = Counter(), defaultdict(lambda: [0, 0, 0, 0])
            for g, v in c.items():
                self.total[k][g[:-1]] += v
                self.followers[k][g[:-1]][min(v, 3)] += 1

    def p(self, gram):
        k = len(gram)
        lower = self.p(gram[1:]) if k > 1 else 1 / (len(self.raw) + 1)
        total = self.total[k][gram[:-1]]
        if not total:
            return lower
        own = self.count[k].get(gram, 0)
        rest = sum(d * n for d, n in zip(self.d[k], self.followers[k][gram[:-1]]))
        return (max(0, own - self.d[k][min(own, 3)]) + rest * lower) / total

    def score(self, text):
        row = ["<b>"] * (self.order - 1) + tokens(text)
        return sum(math.log10(self.p(tuple(row[i : i + self.order]))) for i in range(len(row) - self.order + 1))


def corpus(rng):
    vocab = ["the", "The", "of", "a", "é", "日本", "x1", "zebra", "Ünder", "b" * 40] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(vocab, weights=[9] * 10 + [1] * 60, k=rng.choice([0, 1, 2, 5, 30, 80])))) for i in range(150)]
    return rows + [(200, None), (201, ""), (202, " \n\t"), (203, "the of " * 30000), (204, "the of " * 3), rows[7], (None, "the zebra")]


@pytest.mark.parametrize("order", [2, 3])
def test_equals_a_plain_model(spark, order):
    rows = corpus(random.Random(3))
    df = spark.createDataFrame([(d, t, i, "x") for i, (d, t) in enumerate(rows)], "doc_id long, text string, n_tokens int, shard string").repartition(5)
    train = [r for i, r in enumerate(rows) if i % 4]
    model = kneser_ney.train(spark, df.where("n_tokens % 4 <> 0"), order=order)
    plain = Plain([t for _, t in train], order)
    out = kneser_ney.score(spark, df.withColumnRenamed("n_tokens", "row"), model)
    assert set(out.columns) == {"doc_id", "row", "shard", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"}
    got = {r.row: r for r in out.collect()}
    assert len(got) == len(rows)
    n, v = sum(plain.raw.values()), len(plain.raw)
    for i, (_, text) in enumerate(rows):
        t = tokens(text)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(x in plain.raw for x in t), n)
        assert math.isclose(r.base_score, sum(math.log10((plain.raw[x] + 1) / (n + v + 1)) for x in t), rel_tol=1e-9)
        assert math.isclose(r.score, plain.score(text), rel_tol=1e-9)
        assert math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens), rel_tol=1e-9)


def test_probabilities_add_up_to_one(spark):
    rows = corpus(random.Random(4))
    model = kneser_ney.train(spark, spark.createDataFrame(rows, "doc_id long, text string"), order=3)
    vocab = sorted({t for _, x in rows for t in tokens(x) if t})
    import pyarrow as pa

    every = {}
    for _, hashes, starts in kneser_ney.tokens(pa.array([*vocab, "never seen"])):
        every = dict(zip([*vocab, "?"], hashes[starts], strict=True))
    outcomes = np.array([*every.values(), kneser_ney.END], np.uint64)
    for head in (("the", "of"), ("zebra", "?"), ("?", "the"), ("é", "x1")):
        grams = np.stack([np.full(len(outcomes), every[h], np.uint64) for h in head] + [outcomes], 1)
        p, _ = model.probabilities(grams)
        words = len(vocab) - len({v for v in vocab if v.lower() in vocab and v != v.lower()})
        kept = {tuple(g): x for g, x in zip(grams.tolist(), p)}
        assert len(kept) <= words + 2 and math.isclose(sum(kept.values()), 1.0, rel_tol=1e-9)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = kneser_ney.train(spark, none)
    assert kneser_ney.score(spark, none, model).count() == 0
    r = kneser_ney.score(spark, spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score) == (3, 0, 0, 0.0)
    with pytest.raises(ValueError):
        kneser_ney.train(spark, none, order=1)


def test_discounts_stay_inside_their_counts():
    for n in ([0, 0, 0, 0], [5, 0, 0, 0], [10, 5, 3, 2], [1, 90, 90, 900], [0, 3, 3, 3]):
        assert all(0 < d < k for k, d in zip((1, 2, 3), kneser_ney.discounts_of(n)))


def test_blocks_are_short():
    """Sorted hashes and counts of mostly one take fewer bytes than they have, and come back as they went."""
    rng = np.random.default_rng(3)
    words = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    for order, most in ((1, 8), (2, 9)):
        grams = np.unique(words[rng.integers(0, len(words), (25_000, order))], axis=0)
        packed = kneser_ney._pack(grams, {"count": np.ones(len(grams), np.int64)})
        back, fields = kneser_ney._unpack(packed)
        assert sorted(map(tuple, back.tolist())) == sorted(map(tuple, grams.tolist())) and fields["count"].tolist() == [1] * len(grams)
        assert len(packed) < most * len(grams)
    assert kneser_ney._unpack(kneser_ney._pack(np.zeros((0, 2), np.uint64), {}))[0].shape == (0, 2)
