import itertools
import math

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import unigram
from plumbline.llm.queries import TOKENIZERS

FILE = f"{TOKENIZERS}/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def data():
    with open(FILE, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def codec(data):
    return unigram.Codec(unigram.Model.load(data))


@pytest.fixture(scope="module")
def judge(data):
    """The same pieces and scores in the library's own unigram search (field 3 of field 2 is the kind of model)."""
    return sentencepiece.SentencePieceProcessor(model_proto=data + b"\x12\x02\x18\x01")


def ids(codec, text):
    return np.frombuffer(codec.encode(text.encode()), "<i4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=25), st.text("abe thion  \n▁é日", max_size=60)))
def test_agrees_with_the_library(codec, judge, text):
    assert ids(codec, text) == judge.encode(text)
    assert codec.decode(codec.encode(text.encode())).decode() == text.replace("▁", " ")


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text("ab", min_size=1, max_size=3), st.integers(-9, -1), min_size=1, max_size=8), st.text("abc", min_size=1, max_size=7))
def test_best_of_all_paths(keys, text):
    """Against every way to cut the text."""
    names = [*keys, "<unk>"]
    trie = unigram.DoubleArray({k.encode(): i for i, k in enumerate(keys)})
    scores = np.array([*map(float, keys.values()), 0.0])
    low = min(keys.values()) - unigram.UNKNOWN_COST
    own = unigram.Codec(unigram.Model(trie.base, trie.check, trie.value, scores, [], [-1] * 256, len(keys), low, False, True, True))

    def worth(cut):
        return sum(keys[x] if x in keys else low if len(x) == 1 else -math.inf for x in cut)

    cuts = []
    for marks in itertools.product([0, 1], repeat=len(text) - 1):
        at = [0, *[i + 1 for i, m in enumerate(marks) if m], len(text)]
        cuts.append([text[a:b] for a, b in itertools.pairwise(at)])
    found = [names[i] for i in own.best_path(text.encode())]
    got = sum(low if x == "<unk>" else keys[x] for x in found)
    assert got == max(map(worth, cuts))
    for i in range(len(text)):
        assert [e for e, _ in trie.prefixes(text.encode(), i)] == [e for e in range(i + 1, len(text) + 1) if text[i:e] in keys]


def test_documents(spark, codec):
    texts = [None, "", " ", "the the", "the the", "ü▁ 日", "x" * 3000, "a b " * 5000]
    docs = spark.createDataFrame([(i or None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = unigram.encode_documents(spark, docs, FILE).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id or 0] or ""
        assert r.ids == ids(codec, text) and r.n_ids == len(r.ids)
        assert r.round_trip == ("▁" not in text)
    assert unigram.encode_documents(spark, docs.limit(0), FILE).count() == 0
