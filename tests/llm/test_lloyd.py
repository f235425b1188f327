import hashlib
import math
import random

from plumbline.llm import lloyd


def brute(rows, k, rounds):
    kept = []
    for n, (i, v) in enumerate(rows):
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * x) for x in v], n))
    sha = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest()
    centroids = [x for _, x, _ in sorted((r for r in kept if r[0] is not None), key=lambda r: (sha(r[0]), r[1]))[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        held = [[] for _ in centroids]
        for _, x, _ in kept:
            held[near(x)[1]].append(x)
        centroids = [[sum(c) // len(h) for c in zip(*h)] if h else old for h, old in zip(held, centroids)]
    found = [(i, *near(x)) for i, x, _ in kept]
    total = [sum(d for _, d, c in found if c == k) for k in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, total[c], sum(total), digest[c]) for i, d, c in found), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(5)
    vec = lambda s: [rng.gauss(s, 1) for _ in range(64)]
    rows = [(i, vec(i % 7)) for i in range(200)]
    rows += [(300, None), (301, []), (302, vec(0)[:63]), (303, [*vec(0), 1.0]), (304, [None, *vec(0)[1:]]), (305, [float("nan"), *vec(0)[1:]]), (306, [*vec(0)[1:], float("inf")])]
    rows += [(307, [0.0] * 64), (307, [0.0] * 64), (308, [-0.001] * 64), rows[3], (None, vec(2)), (309, [1 / 256] * 64), (310, [2.0**18] * 64)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, s0 string").repartition(3)
    got = sorted((tuple(r) for r in lloyd.lloyd(spark, df, k=12, rounds=3).collect()), key=str)
    assert got == brute(rows, 12, 3)
    floats = spark.createDataFrame([(i, v) for i, v in rows[:30]], "vec_id long, embedding array<float>")
    as_floats = [(r.vec_id, list(r.embedding)) for r in floats.collect()]
    got = sorted((tuple(r) for r in lloyd.lloyd(spark, floats).collect()), key=str)
    assert got == brute(as_floats, 40, 5) and len(got) == 30


def test_no_vector_is_kept(spark):
    for rows in ([], [(1, None)], [(2, [1.0] * 3)], [(3, [1e300] * 64)]):
        assert lloyd.lloyd(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == 0
