import random

from tests.llm.test_minhash_odd import brute as near_brute
from tests.llm.test_quality import brute as quality_brute

import corpus_pipeline
from plumbline.llm import quality


def _docs(spark):
    rng = random.Random(21)
    vocab = ["".join(rng.choices(["ka", "lo", "mit", "é", "run", "sol", "ter"], k=rng.randint(1, 4))) for _ in range(3000)]
    rows = []
    for i in range(60):
        lines = [" ".join(rng.choices(vocab, k=rng.randint(15, 40))) for _ in range(4)]
        rows.append((i, "\n".join(lines), "en", f"src{i % 3}", 0))
    near = [x.split() for x in rows[5][1].split("\n")]
    for k in range(3):  # every line changed so much that lines differ but documents are near
        own = [list(x) for x in near]
        for x in own:
            x[rng.randrange(len(x))] = f"new{k}"
        rows.append((100 + k, " \n".join(" ".join(x) for x in own), "en", "src0", 0))
    rows += [(200, rows[7][1], "en", "src1", 0), (201, None, None, None, None), (202, "too short", "en", "src1", 9), (203, "same " * 400, "de", None, 0), (None, rows[8][1] + "\nand one more line of its own, long enough", "fr", "src2", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2), rows


def test_stages(spark):
    docs, rows = _docs(spark)
    kept = corpus_pipeline.quality_rules(spark, docs, "")
    assert kept.columns == docs.columns
    want = quality_brute([(r[0], r[1], r[3]) for r in rows], 20, 0.02, 0.3)
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in kept.collect()), key=str) == sorted(((a[0], b[-1], len(b[-1])) for a, b in zip(rows, want) if b[-2]), key=str)
    lines = corpus_pipeline.line_dedup(spark, kept, "")
    assert lines.columns == docs.columns and {r.doc_id for r in lines.collect()} >= set(range(60)) and 200 not in {r.doc_id for r in lines.collect()}
    near = corpus_pipeline.near_dedup(spark, docs, "")
    assert near.columns == docs.columns
    _, n = near_brute([(r[0], r[1]) for r in rows], 80)
    assert near.count() == n
    packed = corpus_pipeline.packing(spark, near, "")
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in near.collect()}


def test_run(spark, tmp_path):
    docs, rows = _docs(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in got}
    assert set(range(60)) <= ids and not ids & {200, 201, 202, 203}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "packing"]


def test_large_group_of_near_copies_leaves_one(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnoprstu", k=rng.randint(3, 9)))
    base = [[word() for _ in range(25)] for _ in range(8)]
    rows = [(i, "\n".join(" ".join(word() for _ in range(25)) for _ in range(4)) + "\nhome about contact imprint", "en", "src", 0) for i in range(70)]
    for k in range(30):  # one word of one line changed: more copies than the limit of 20
        own = [list(x) for x in base]
        own[k % 8][rng.randrange(25)] = f"new{k}"
        rows.append((1000 + k, "\n".join(" ".join(x) for x in own), "en", "src", 0))
    rows.append((2000, rows[-1][1], "en", "src", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2)
    assert not {r.doc_id for r in quality.clean(spark, docs).collect()} & {r[0] for r in rows[70:]}
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stage = corpus_pipeline.quality_rules(spark, docs, "").collect()
    assert sum("home about" in r.text for r in stage) == 1
    assert any(r.text in {x[1] for x in rows[70:]} for r in stage)  # one of the group whole
    ids = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert ids >= set(range(70)) and len(ids - set(range(70))) == 1
