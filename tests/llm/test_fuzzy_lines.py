import random

from plumbline.llm import fuzzy_lines


def norm(line):
    for c in "\t\n\x0b\x0c\r":
        line = line.replace(c, " ")
    return " ".join(x for x in line.split(" ") if x).lower()


def shingles(line):
    return {line[i : i + 5] for i in range(max(1, len(line) - 4))}


def brute(rows, min_chars=1):
    """Numbers of the lines that go, of each row."""
    places, sets = [], []
    for r, (d, t) in enumerate(rows):
        for no, line in enumerate((t or "").split("\n")):
            if len(norm(line)) >= min_chars:
                places.append((d is None, d if d is not None else 0, r, no))
                sets.append(shingles(norm(line)))
    root = list(range(len(places)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(places)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, p in enumerate(places):
        least[find(i)] = min(p, least.get(find(i), p))
    gone = [[] for _ in rows]
    for i, p in enumerate(places):
        if least[find(i)] != p:
            gone[p[2]].append(p[3])
    return gone


def corpus(rng):
    vocab = ["".join(rng.choices(["ka", "lo", "mit", "é", "run", "sol"], k=rng.randint(1, 4))) for _ in range(120)]
    families = [[rng.choice(vocab) for _ in range(rng.randint(10, 45))] for _ in range(30)]
    rows = []
    for d in range(120):
        lines = []
        for _ in range(rng.randint(1, 6)):
            own = list(rng.choice(families)) if rng.random() < 0.6 else [rng.choice(vocab) for _ in range(rng.randint(1, 40))]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            lines.append(" ".join(own))
        rows.append((d, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "A" * 300), (204, "a" * 290 + "\nshort"), (205, "x y " * 5000), (206, "x y " * 4900), (207, "日本語 テキスト です ね 日本語 テキスト"), (208, "日本語  テキスト です ね 日本語 テキスト ")]
    rows += [rows[0], (None, rows[1][1])]
    return rows


def test_links_match_brute_force(spark):
    rows = corpus(random.Random(8))
    df = spark.createDataFrame([(d, t, i, "x") for i, (d, t) in enumerate(rows)], "doc_id long, text string, row int, line string").coalesce(1)
    want = brute(rows)
    got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.removed) for r in fuzzy_lines.line_report(spark, df).collect()), key=lambda r: str(r[0]))
    full = sorted(((d, len((t or "").split("\n")), g) for (d, t), g in zip(rows, want)), key=lambda r: str(r[0]))
    found = expected = 0
    for (d, n, k, gone), (e, m, all_gone) in zip(got, full, strict=True):
        assert (d, n, k) == (e, m, len(gone)) and set(gone) <= set(all_gone)
        found, expected = found + k, expected + len(all_gone)
    assert found >= 0.99 * expected > 100
    out = fuzzy_lines.dedup_lines(spark, df)
    assert out.columns == df.columns
    texts = {(r.doc_id, r.row): r.text for r in out.collect()}
    by_row = {(rows[i][0], i): i for i in range(len(rows))}
    assert set(texts) <= set(by_row)
    for k, i in by_row.items():
        lines = (rows[i][1] or "").split("\n")
        if len(want[i]) < len(lines):
            kept = texts[k]
            if rows[i][1] is None:
                assert kept is None
            else:  # in order, with all that must stay
                kept, at = kept.split("\n"), 0
                for x in (x for n, x in enumerate(lines) if n not in want[i]):
                    at = kept.index(x, at) + 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert fuzzy_lines.line_report(spark, df).count() == 0
    assert fuzzy_lines.dedup_lines(spark, df).count() == 0


def test_lines_without_spaces_and_short_lines(spark):
    """Pairs that differ where they begin, or anywhere, and have few word starts or none."""
    rng = random.Random(31)
    cjk = lambda n: "".join(chr(rng.randint(0x4E00, 0x9F00)) for _ in range(n))
    code = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789/._-=", k=n))
    words = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz" + " " * 5, k=n)).strip() + "z"
    pairs = []
    for make in (cjk, code, words):
        for n in [12, 14, 18, 25, 35] * 4 + [60, 90, 130, 200] * 5:
            a = make(n)
            at = rng.randrange(len(a)) if n >= 60 else rng.choice([0, len(a)])
            pairs.append((a, a[:at] + rng.choice("qjx") + a[at:]))
    for _ in range(20):
        tail = code(45)
        pairs.append((f"http://{tail}", f"https://{tail}"))
    pairs = [p for p in pairs if min(map(len, map(norm, p))) >= 10 and norm(p[0]) != norm(p[1])]
    pairs = [(a, b) for a, b in pairs if len(shingles(norm(a)) & shingles(norm(b))) >= 0.8 * len(shingles(norm(a)) | shingles(norm(b)))]
    rows = [(i, x) for i, x in enumerate(x for p in pairs for x in p)]
    want = sum(map(len, brute(rows)))
    assert want >= len(pairs) > 120
    got = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    assert sum(r.n_removed for r in fuzzy_lines.line_report(spark, got).collect()) >= 0.98 * want


def similar(a, b):
    x, y = shingles(norm(a)), shingles(norm(b))
    return norm(a) != norm(b) and len(x & y) >= 0.8 * len(x | y)


def kinds(rng):
    """Pairs of similar lines, 40 of each kind."""
    words = lambda alphabet, n, low=2, high=9: " ".join("".join(rng.choices(alphabet, k=rng.randint(low, high))) for _ in range(n))
    latin, cyrillic, poor, rich = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшыэюя", "abcdefghjklmopquvwxyz", "nrti"
    cjk = lambda n: "".join(chr(rng.randint(0x4E00, 0x9F00)) for _ in range(n))

    def tail(base, more):
        """``base`` and as much of ``more`` as leaves them similar."""
        out = base
        for c in " " + more:
            if not similar(base, out + c) and norm(base) != norm(out + c):
                break
            out += c
        return base, out

    def edited(base, glyphs):
        out = list(base)
        for _ in range(200):
            old, at = list(out), rng.randrange(len(out))
            out[at : at + rng.choice([0, 1])] = rng.choice([[], [rng.choice(glyphs)]])
            if not similar(base, "".join(out)) and norm(base) != norm("".join(out)):
                return base, "".join(old)
        return base, "".join(out)

    made = {
        "script and a tail of another": lambda: tail(words(cyrillic, rng.randint(10, 60)), words(latin, 40)),
        "latin and a cyrillic tail": lambda: tail(words(latin, rng.randint(10, 60)), words(cyrillic, 40)),
        "poor in letters and a rich tail": lambda: tail(words(poor, rng.randint(10, 60)), words(rich, 40)),
        "rich in letters and a poor tail": lambda: tail(words(rich, rng.randint(10, 60)), words(poor, 40)),
        "words and a tail of single letters": lambda: tail(words(latin, rng.randint(15, 60)), words(latin, 90, 1, 1)),
        "long words and a tail of short ones": lambda: tail(words(latin, rng.randint(10, 40), 8, 14), words(latin, 60, 2, 4)),
        "spaceless and a tail of words": lambda: tail(cjk(rng.randint(60, 200)), words(latin, 40)),
        "words and a spaceless tail": lambda: tail(words(latin, rng.randint(15, 60)), cjk(90)),
        "edits": lambda: edited(words(latin, rng.randint(15, 90)), latin),
        "edits in cyrillic": lambda: edited(words(cyrillic, rng.randint(15, 90)), cyrillic),
        "edits without spaces": lambda: edited(cjk(rng.randint(60, 300)), cjk(9)),
        "code": lambda: edited("".join(rng.choices("abcdef0123456789/._-=;", k=rng.randint(60, 200))), "xyz9"),
        "short": lambda: tail("".join(rng.choices(latin + "   ", k=rng.randint(9, 30))).strip() + "q", "zz"),
    }
    out = {}
    for kind, make in made.items():
        out[kind] = []
        while len(out[kind]) < 40:
            a, b = make()
            if similar(a, b):
                out[kind].append((a, b))
    return out


def test_recall_by_kind_of_line(spark):
    found = kinds(random.Random(41))
    rows, of = [], []
    for kind, pairs in found.items():
        for a, b in pairs:
            rows += [(len(rows), a), (len(rows) + 1, b)]
            of.append(kind)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(4)
    gone = {r.doc_id: r.n_removed for r in fuzzy_lines.line_report(spark, df).collect()}
    got = {kind: 0 for kind in found}
    for i, kind in enumerate(of):
        got[kind] += gone[2 * i] + gone[2 * i + 1]
    print({k: n / 40 for k, n in got.items()})
    assert all(n >= 38 for n in got.values()), got


def test_short_repeats_go(spark):
    rows = [(1, "ok\nno\n1234\nshorter"), (2, "OK \n\n\t\n12345\n shorter"), (3, "no\nshorten\n日本")]
    out = {r.doc_id: r.removed for r in fuzzy_lines.line_report(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert out == {1: [], 2: [0, 4], 3: [0]}


def test_shuffled_where_there_are_many(spark, monkeypatch):
    rows = corpus(random.Random(9))[:60]
    monkeypatch.setattr(fuzzy_lines, "MOST_BROADCAST", 0)
    got = {r.doc_id: r.removed for r in fuzzy_lines.line_report(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)).collect()}
    assert got == {d: gone for (d, _), gone in zip(rows, brute(rows))} and sum(map(len, got.values())) > 20


def test_no_pair_of_a_large_bucket_goes_by(spark):
    rows = [(key, 1000 * key + i, (1000 * key + i) // 3, size) for key, size in ((1, 600), (2, 9)) for i in range(size)]
    mixed = spark.createDataFrame(rows, "key long, node long, component long, size long")
    want = {(a, b) for k, a, c, _ in rows for m, b, d, _ in rows if k == m and a < b and c != d}
    got = [tuple(r) for r in fuzzy_lines.FuzzyLines._every_pair(mixed).collect()]
    assert len(got) == len(want) and set(got) == want


def test_passes_and_small_blocks_change_nothing(spark, monkeypatch):
    rows = corpus(random.Random(12))[:60]
    for name, n in (("PASS_BANDS", 64), ("BLOCK", 4), ("CHUNK", 32), ("TOGETHER", 50)):
        monkeypatch.setattr(fuzzy_lines, name, n)
    got = {r.doc_id: r.removed for r in fuzzy_lines.line_report(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)).collect()}
    assert got == {d: gone for (d, _), gone in zip(rows, brute(rows))} and sum(map(len, got.values())) > 20
