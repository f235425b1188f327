import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import best_fit, bfd_pack
from plumbline.llm.queries import BYTE_BPE_PATTERN, TOKENIZERS
from plumbline.llm.tokens import WordEncoder, rank_encoding, text_encoder

WORD_BPE = f"{TOKENIZERS}/word_bpe_49k.json"
BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
TEXTS = [None, "", "one", "Two words", "two words", "two words", "Ünï códe 日本語 \x1c\x85x y", "a " * 300, "<|endoftext|> it's", "\n\t \r", "é ́x", "x" * 500]


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(WORD_BPE)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_words_give_the_ids_of_the_text(encoder, text):
    whole = encoder.model.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode([text.encode()])[0], "<u4").tolist() == whole


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=12))
def test_plan_is_gapless_and_best_fit(histogram):
    slots, n = best_fit.plan(histogram, 32)
    used, taken = defaultdict(list), Counter()
    for length, count in histogram.items():
        own = slots[slots[:, 0] == length]
        for rank in range(count):
            s = own[np.searchsorted(own[:, 1], rank, "right") - 1]
            k = rank - s[1]
            used[s[3] + k // s[2]].append((s[4] + k % s[2] * length, length))
            taken[length] += 1
    assert taken == Counter(histogram) and set(used) == set(range(n))
    for segments in used.values():
        end = 0
        for offset, length in sorted(segments):
            assert offset == end
            end += length
        assert end <= 32
    one_by_one = bfd_pack.best_fit_decreasing([x for x, c in histogram.items() for _ in range(c)], 32)
    assert n == len(one_by_one)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_segment_tree_finds_the_least_room(lengths):
    rows: list[list[int]] = []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        rooms = [(50 - sum(lengths[i] for i in r), n) for n, r in enumerate(rows)]
        fit = [x for x in rooms if x[0] >= lengths[k]]
        if fit:
            rows[min(fit)[1]].append(k)
        else:
            rows.append([k])
    found = bfd_pack.best_fit_decreasing(lengths, 50)
    assert sorted(x for r in found for x in r) == list(range(len(lengths)))
    assert len(found) == len(rows)
    assert sorted(sum(lengths[i] for i in r) for r in found) == sorted(sum(lengths[i] for i in r) for r in rows)


def _docs(spark, texts):
    rows = [(i if i else None, t, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3)


def test_best_fit_keeps_every_token(spark, encoder):
    texts = TEXTS * 3
    out = best_fit.pack(spark, _docs(spark, texts), WORD_BPE, seq_len=64).collect()
    want = Counter()
    for i, t in enumerate(texts):
        ids = np.array([*encoder.model.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 64)):
            own = ids[at : at + 64]
            want[(i if i else None, k, at, len(own), zlib.crc32(own.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    rows = defaultdict(list)
    for r in out:
        rows[r.sequence_id].append((r.offset, r.length))
    for segments in rows.values():
        end = 0
        for offset, length in sorted(segments):
            assert offset == end
            end += length
        assert end <= 64


def test_matrices_round_trip(spark):
    texts, model = TEXTS * 2, rank_encoding(BYTE_BPE, BYTE_BPE_PATTERN)
    out = bfd_pack.pack(_docs(spark, texts), BYTE_BPE, BYTE_BPE_PATTERN, seq_len=64, shard_bytes=2000).collect()
    got = defaultdict(dict)
    for r in out:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 64 and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1]
        assert bfd_pack.positions(r.cu_seqlens).tolist() == [x for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]) for x in range(b - a)]
        for d, p, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:]):
            got[d][p] = ids[a:b].tolist()
    assert {r.shard for r in out} != {0}
    for i, t in enumerate(texts):
        whole = [x for p in sorted(got[i or None]) for x in got[i or None][p]]
        assert whole == [*model.encode_ordinary(t or ""), 50256]


def test_empty_table(spark):
    none = _docs(spark, ["x"]).limit(0)
    assert best_fit.pack(spark, none, WORD_BPE).count() == 0
    assert bfd_pack.pack(none, BYTE_BPE, BYTE_BPE_PATTERN).count() == 0


def test_few_sequences():
    rng = random.Random(1)
    histogram = Counter(rng.randint(1, 4096) for _ in range(20000))
    slots, n = best_fit.plan(histogram, 4096)
    bound = -(-sum(k * v for k, v in histogram.items()) // 4096)
    assert bound <= n <= 1.01 * bound and len(slots) < 50_000


ODD = ["a", "b", "K", "J", "É", "×", "÷", "œ", "̌", "́", "̇", "I", "İ", "'s", "'T", "1", "٣", "日", "Ж", ",", ".", "..", ", ", " ", "\n", "\x1c", "\x85", "\xa0", "<|endoftext|>", "<|EndOfText|>", "<|", "\x00", "ᄀ", "ᅡ", "Ǆ", "ll", "$$"]


def test_odd_texts_have_the_ids_of_the_tokenizer(encoder):
    rng = random.Random(6)
    texts = ["".join(rng.choices(ODD, k=rng.randint(0, 40))) for _ in range(3000)]
    for text, ids in zip(texts, encoder.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.model.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_are_encoded_whole():
    file = f"{TOKENIZERS}/byte_bpe_50k.json"
    with pytest.raises(ValueError, match="word by word"):
        WordEncoder(file)
    model = text_encoder(file)
    for text in (t for t in TEXTS if t):
        assert np.frombuffer(model.encode([text.encode()])[0], "<u4").tolist() == model.model.encode(text, add_special_tokens=False).ids


def test_long_white_space():
    rng, model = random.Random(2), rank_encoding(BYTE_BPE, BYTE_BPE_PATTERN)
    for _ in range(40):
        space = rng.choice([" ", "\n", " \n", "\t", "　 ", " \xa0"])
        text = rng.choice(["", "ab c", "日's", "1"]) + (space * 12000)[: rng.randint(9990, 12000)] + rng.choice(["x", "", "é", "\x1c", "1 y"])
        text *= rng.randint(1, 2)
        assert bfd_pack.encode(model, text).tolist() == model.encode_to_numpy(text).tolist()
    assert len(bfd_pack.encode(model, " " * 5_000_000 + "a")) > 1
