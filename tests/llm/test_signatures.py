import random

import numpy as np
import pyarrow as pa

from plumbline.llm import fuzzy_lines


def test_least_hashes_of_all_shingles():
    rng = random.Random(3)
    lines = ["".join(rng.choices("ab c é日𝄞", k=rng.choice([0, 1, 4, 5, 6, 9, 40, 300]))) for _ in range(200)] + ["ab" * 4000, "x" * 900, "", "".join(chr(rng.randint(0x4E00, 0x9F00)) for _ in range(5000))]
    got = fuzzy_lines.signatures(pa.array(lines)).to_pylist()
    known = {}
    for line, s in zip(lines, got):
        # Each hash stands for one shingle: a line alone tells which.
        shingles = sorted({line[i : i + 7] for i in range(len(line) - 6)})
        for x in shingles[:50]:
            if x not in known:
                known[x] = fuzzy_lines.signatures(pa.array([x])).to_pylist()[0][0] & 0xFFFFFFFF
        every = [fuzzy_lines.signatures(pa.array([x])).to_pylist()[0][0] & 0xFFFFFFFF for x in shingles[50:]] + [known[x] for x in shingles[:50]]
        assert [h & 0xFFFFFFFF for h in s] == sorted(set(every))[: fuzzy_lines.LEAST]
    assert len(set(known.values())) == len(known)


def test_similarities_are_those_of_sets():
    rng = np.random.default_rng(3)
    sides = [[], []]
    for _ in range(400):
        pool = rng.integers(0, 2**32, 45, dtype=np.uint64)
        for side in sides:
            side.append(np.unique(rng.choice(pool, rng.integers(0, 26)))[: fuzzy_lines.LEAST])
    want = []
    for x, y in zip(*sides):
        least = sorted({*x.tolist(), *y.tolist()})[: fuzzy_lines.LEAST]
        want.append(sum(h in x and h in y for h in least) / max(len(least), 1))
    a, b = (pa.array([x.astype(np.uint32).view(np.int32).tolist() for x in side], pa.list_(pa.int32())) for side in sides)
    assert fuzzy_lines.similarities(a, b).to_pylist() == want
    assert fuzzy_lines.similarities(a[7:90], b[7:90]).to_pylist() == want[7:90]
    assert fuzzy_lines.similarities(a[:0], b[:0]).to_pylist() == []


def _batches(columns, size):
    import itertools

    table = pa.table(columns)
    return itertools.chain(*[table.slice(k, size).to_batches() for k in range(0, table.num_rows, size)])


def test_chance_pairs_stay_in_their_bucket(monkeypatch):
    """Lines that share a band and little else are no pairs, whatever the bucket's size; like ones are found or their members are told."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(fuzzy_lines, "CHUNK", 500)
    monkeypatch.setattr(fuzzy_lines, "BLOCK", 16)
    signs = [np.unique(np.append(rng.integers(0, 1 << 32, 17), [5, 6, 7])).astype(np.uint32) for _ in range(1300)]
    for i in range(0, 1300, 26):  # like the one before it by 19 of 20 hashes
        signs[i + 1] = np.append(signs[i][:-1], rng.integers(0, 1 << 32, 1).astype(np.uint32))
    s = pa.array([x.view(np.int32).tolist() for x in signs], pa.list_(pa.int32()))
    k = fuzzy_lines.sketches(s)
    for key in (np.zeros(1300, np.int64), np.arange(1300) // 52, np.arange(1300)):
        rows = {"key": key, "node": np.arange(1300), **{c: k[i] for i, c in enumerate(fuzzy_lines.SKETCH)}}
        out = pa.Table.from_batches(fuzzy_lines._met(_batches(rows, 130))).to_pylist()
        pairs, more = {(r["a"], r["b"]) for r in out if r["key"] is None}, {r["a"] for r in out if r["key"] is not None}
        true = {(i, i + 1) for i in range(0, 1300, 26) if key[i] == key[i + 1]}
        assert true <= pairs | {p for p in true if {*p} <= more} and len(pairs) < len(true) + 200  # of about 11,000 that meet in blocks
        blocks = {"key": key, "i": np.zeros(1300, np.int64), "j": np.zeros(1300, np.int64), "block": np.zeros(1300, np.int64), "node": np.arange(1300), "component": np.arange(1300)}
        every = blocks | {c: k[i] for i, c in enumerate(fuzzy_lines.SKETCH)} | {"places": np.full(1300, 50), **{c: np.zeros(1300, np.int64) for c in fuzzy_lines.FULL[1:]}}
        met = {(r["a"], r["b"]) for r in pa.Table.from_batches(fuzzy_lines._every(_batches(every, 130), 0.8)).to_pylist()}
        assert true <= met and len(met) < len(true) + 20_000  # of 844,350 pairs in one bucket


def test_bitmaps_drop_no_similar_pair():
    rng = random.Random(8)
    lines, dropped = [], 0
    for _ in range(300):
        a = [rng.choice(["ka", "lo", "mit", "run", "sol"]) + rng.choice("abc") for _ in range(rng.randint(2, 60))]
        b = list(a)
        for _ in range(rng.choice([0, 1, 1, 2, 5, 20])):
            b[rng.randrange(len(b))] = rng.choice(["ka", "lo", "mit"]) + rng.choice("abc")
        lines += [" ".join(a), " ".join(b)]
    full = pa.Table.from_batches(fuzzy_lines._full(_batches({"node": np.arange(600), "norm": lines}, 100)))
    bits = np.stack([full.column(c).to_numpy().view(np.uint64) for c in fuzzy_lines.FULL[1:]], 1)
    places = full.column("places").to_numpy()
    for i in range(0, 600, 2):
        x, y = fuzzy_lines.shingle_set(lines[i]), fuzzy_lines.shingle_set(lines[i + 1])
        may = np.bitwise_count(bits[i] ^ bits[i + 1]).sum() <= fuzzy_lines._most(0.8, places[i] + places[i + 1])
        assert may or len(x & y) < 0.8 * len(x | y)
        dropped += not may
    assert dropped > 20
