import random
import re
from collections import Counter, defaultdict

from plumbline.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _norm(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ").lower()


def brute(rows, min_docs, share, keep_share):
    texts, hosts = [r[1] or "" for r in rows], [r[2] or "" for r in rows]
    docs = defaultdict(set)
    for t, h in zip(texts, hosts):
        docs[h].add(t)
    lines = defaultdict(set)
    for t, h in zip(texts, hosts):
        for x in t.split("\n"):
            if WORD.search(x):
                lines[h, _norm(x)].add(t)
    out = []
    for t, h in zip(texts, hosts):
        w = WORD.findall(t)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(windows)
        repeat = len({i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)})
        held = [x for x in t.split("\n") if WORD.search(x)]
        limit = max(min_docs, int(len(docs[h]) * share))
        total = sum(map(len, held))
        left = sum(len(x) for x in held if len(lines[h, _norm(x)]) <= limit)
        failed = len(w) < 50 or 100 * repeat > 50 * len(w)
        clean = "\n".join(x for x in t.split("\n") if not WORD.search(x) or len(lines[h, _norm(x)]) <= limit)
        out.append((len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(held) - len(set(held)), repeat, failed, not failed and left >= keep_share * total, clean))
    return out


def test_matches_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    vocab = [rng.choice("abcdefgh") * rng.randint(1, 4) + rng.choice(["", ".", "é", "#*"]) for _ in range(40)]
    boiler = ["Home  |  About  us", "home | about us ", " ".join(rng.choices(vocab, k=45))]
    rows = []
    for i in range(160):
        parts = [" ".join(rng.choices(vocab, k=rng.randint(1, 25))) for _ in range(rng.randint(1, 8))]
        for b in boiler:
            if rng.random() < 0.5:
                parts.insert(rng.randint(0, len(parts)), b)
        rows.append((i, "\n".join(parts), rng.choice(["a", "a", "b", None])))
    rows += rows[:5] + [(200, None, "a"), (201, "", None), (202, "\n \n", "b"), (None, "same " * 30000, "a"), (203, "x y z " * 10 + boiler[2] + "\n" + "q", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for bits in (20, 5):  # with 5, texts of over 32 words are compared in full
        monkeypatch.setattr(quality, "POSITION_BITS", bits)
        got = quality.judge(spark, df, ["doc_id", "text"], min_docs=8, share=0.05, keep_share=0.3).collect()
        want = brute(rows, 8, 0.05, 0.3)
        as_rows = sorted(((r.doc.doc_id, r.doc.text, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got), key=str)
        assert as_rows == sorted(((a[0], a[1], *b[:-1]) for a, b in zip(rows, want)), key=str)
    out = quality.clean(spark, df, min_docs=8, share=0.05, keep_share=0.3)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(((a[0], b[-1]) for a, b in zip(rows, want) if b[-2]), key=str)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c " * 20, "h", "x", 5, 6)], "doc_id long, text string, source string, h string, row int, n_words int")
    assert quality.clean(spark, df, min_words=3).collect() == []
    ok = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)), "h", "x", 5, 6)], df.schema)
    assert quality.clean(spark, ok).collect() == ok.collect()
    assert quality.judge(spark, df.limit(0), ["doc_id"]).count() == 0
