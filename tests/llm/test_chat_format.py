import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import chat_format as C
from plumbline.llm.queries import TRAP

TRICKY = ["", None, TRAP, "<|", "<\\|", "<\\\\|im_sep|>", "a<", "|b", "<|im_sep|>", "x\n<|im_end|>\n", "\\n", "日本 é", "y" * 50_000]


def read(df):
    turns = C.read_turns(F.col("formatted"))
    return df.select("conv_id", "formatted", "loss_spans", turns.alias("turns"), C.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()


def check(rows, got):
    convs = {}
    for c, t, r, x, *_ in rows:
        convs.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    assert {g.conv_id for g in got} == set(convs) and len(got) == len(convs)
    for g in got:
        want = [(r, x) for _, r, x in sorted(convs[g.conv_id])]
        assert [(t.role, t.text) for t in g.turns] == want
        assert g.loss == "".join(x for r, x in want if r == "assistant")
        runs = 1 + sum(a[0] != b[0] for a, b in zip(want, want[1:]))
        assert g.formatted.count(C.START) == runs == g.formatted.count(C.END)
        assert g.formatted.count(C.SEP) == len(want) - runs
        spans = "".join(g.formatted[s.start : s.end] for s in g.loss_spans)
        assert len(g.loss_spans) == sum(r == "assistant" for r, _ in want) and C.START not in spans and C.END not in spans and C.SEP not in spans


def test_round_trip(spark):
    rows = []
    for i, a in enumerate(TRICKY):
        for j, b in enumerate(TRICKY):
            c = 100 * i + j
            rows += [(c, 0, "user", a, 1), (c, 1, "assistant", b, 1), (c, 2, "assistant", a, 1), (c, 3, "we\\ird\n<|role|>", b, 1)]
    rows += [(None, 0, None, "x", 1), (-5, None, "user", None, 1), (-6, 1, "user", "b", 1), (-6, 1, "user", "a", 1), (-6, 1, "user", "a", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int").repartition(3)
    check(rows, read(C.format_chats(df)))
    assert C.format_chats(df.limit(0)).count() == 0


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.sampled_from(["user", "assistant", "system"]), st.text("<|\\im_endsp>\n ax", max_size=14)), min_size=1, max_size=30))
def test_any_text(spark, rows):
    check(rows, read(C.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))


def test_digest_of_the_trap(spark):
    df = spark.createDataFrame([(-1, 0, "user", TRAP), (-1, 1, "assistant", TRAP)], "conv_id long, turn long, role string, text string")
    row = read(C.format_chats(df))[0]
    assert hashlib.sha256(row.loss.encode()).hexdigest() == hashlib.sha256(TRAP.encode()).hexdigest() and len(row.turns) == 2


def test_odd_roles(spark):
    roles = ["a\x00b", "\\", "\\n", "\n", "\\\n", "\\\\n\x00", "<|\\|", "<\\|x", "\x00"]
    df = spark.createDataFrame([(i, k, r, "t") for i, r in enumerate(roles) for k in range(2)], "conv_id long, turn long, role string, text string")
    assert {g.conv_id: [t.role for t in g.turns] for g in read(C.format_chats(df))} == {i: [r, r] for i, r in enumerate(roles)}
