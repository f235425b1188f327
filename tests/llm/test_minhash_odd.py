import random
import re

import numpy as np

from plumbline.llm import minhash_odd as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)], len({find(i) for i in range(len(rows))})


def corpus(rng, families=12, size=14):
    vocab = [f"w{i}" for i in range(400)] + ["Été", "ßx", "日本"]
    rows, k = [], 0
    for f in range(families):
        base = rng.choices(vocab, k=rng.randint(60, 260))
        for _ in range(size):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 9])):  # similarities all around the threshold
                own[rng.randrange(len(own))] = rng.choice(vocab)
            rows.append((k, rng.choice([" ", "\n", "  "]).join(own)))
            k += 1
    rows += [(k + i, t) for i, t in enumerate([None, "", " \t", "a b", "A  b", "a b c", "x" * 5000, "the " * 4000, "THE " * 3999])]
    rows += [(None, rows[0][1]), (None, "alone and without an id here"), rows[3], rows[3]]
    rng.shuffle(rows)
    return rows


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", 5)
    monkeypatch.setattr(M, "CHUNK_BYTES", 3000)
    rows = corpus(random.Random(11))
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, row int, component int").repartition(4)
    got = M.components(spark, df).collect()
    want, n = brute(rows)
    assert sorted([(r.id, r.n_shingles, r.component_id) for r in got], key=str) == sorted(want, key=str)
    assert sum(r.stays for r in got) == n
    assert all(r.doc.doc_id == r.id and (r.id == r.component_id or r.id is None) for r in got if r.stays)
    kept = M.dedup(spark, df)
    assert kept.columns == df.columns and kept.count() == n
    assert M.components(spark, df.limit(0)).count() == 0


def test_sketches_estimate_high_similarity():
    rng = np.random.default_rng(2)
    errors = []
    for j in (0.7, 0.85, 0.95):
        for _ in range(60):
            n = 600
            both = int(2 * n * j / (1 + j))
            pool = M._mix(rng.integers(0, 1 << 63, 2 * n - both, np.uint64))
            a, b = np.sort(pool[:n]), np.sort(pool[n - both :])
            bands, odd = M.sketch(np.concatenate([a, b]), np.array([n, n]))
            bits = int(np.bitwise_count((odd[0] ^ odd[1]).view(np.uint64)).sum())
            size = 64 * M.SKETCH_WORDS
            errors.append(1 + size / (4 * M.SAMPLES) * np.log(1 - 2 * bits / size) - j)
            if j >= 0.85:
                assert bits <= M.most_differing_bits(0.85 - M.SLACK) and (bands[0] == bands[1]).any()
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05
