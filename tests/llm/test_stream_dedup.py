import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import stream_dedup

TEXTS = ["A b", "a B", "", None, "É", "é", "x" * 100_000, "X" * 100_000, "c", "c", "c"]


def _write(spark, rows, path, mode="append"):
    spark.createDataFrame(rows, "doc_id long, text string, digest int").coalesce(1).write.mode(mode).parquet(path)


def _expected(rows):
    def norm(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")

    groups = {}
    for d, t, _ in rows:
        groups.setdefault(norm(t), []).append(d)
    key = lambda d: (d is not None, d or 0)
    out = []
    for d, t, _ in rows:
        own = groups[norm(t)]
        out.append((d, max(own, key=key), len(own)))
    return sorted(out, key=str), len(groups)


@pytest.mark.parametrize("digest", [stream_dedup.sha256, lambda t: F.substring(F.sha2(t, 256), 1, 1)])
def test_matches_brute_force_over_several_batches(spark, tmp_path, digest):
    rng = random.Random(3)
    path, rows = str(tmp_path / "docs"), []
    run = None
    for part in range(3):
        own = [(part * 100 + i if rng.random() < 0.9 else None, rng.choice(TEXTS), 1) for i in range(30)]
        own += own[:2]  # repeated rows
        rows += own
        _write(spark, own, path)
        run = run or stream_dedup.StreamDedup(spark, path, digest=digest, max_files=1)
        run.run()
        run.batch = spark.read.parquet(path).select(F.coalesce("doc_id", F.lit(stream_dedup.NO_ID)).alias("doc_id"), stream_dedup.normalised(F.col("text")).alias("text"))
        got = run.result().collect()
        want, n = _expected(rows)
        assert sorted([(r.doc_id, r.keep_id, r.group_size) for r in got], key=str) == want
        assert sum(r.kept for r in got) == n
        assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_what_comes_after_a_run_waits_for_the_next(spark, tmp_path):
    path = str(tmp_path / "docs")
    clash = lambda t: F.substring(F.sha2(t, 256), 1, 0)
    _write(spark, [(1, "a", 0), (2, "b", 0), (3, "A", 0)], path)
    run = stream_dedup.StreamDedup(spark, path, digest=clash)
    run.run()
    _write(spark, [(4, "b", 0), (5, "c", 0)], path)
    shown = lambda: sorted((r.doc_id, r.keep_id, r.group_size) for r in run.result().collect())
    assert shown() == [(1, 3, 2), (2, 2, 1), (3, 3, 2)]
    run.run()
    assert shown() == [(1, 3, 2), (2, 4, 2), (3, 3, 2), (4, 4, 2), (5, 5, 1)]
    at = run.state().first().locator
    assert at.rpartition("#")[2] == "0" and at.rpartition("#")[0].endswith(".parquet")


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    _write(spark, [], path)
    run = stream_dedup.StreamDedup(spark, path)
    run.run()
    assert run.result().count() == 0
