import random
import re

import pyarrow as pa

from plumbline.llm import words as w


def test_words_in_pieces_of_any_size(monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(w, "PIECE", 64)
    monkeypatch.setattr(w, "_UP", w._powers(w._STEP))
    monkeypatch.setattr(w, "_DOWN", w._powers(w._BACK))
    seen = {}
    for _ in range(200):
        texts = ["".join(rng.choices("aB é\t\n日x", k=rng.choice([0, 0, 1, 3, 10, 200]))) for _ in range(rng.randint(1, 8))]
        monkeypatch.setattr(w, "RUN", rng.choice([1, 50, 1000]))
        out = [[] for _ in texts]
        for first, data, starts in w.runs(pa.array(texts)):
            found = w.words(data, starts)
            for b, e, h, t in zip(found.begin, found.end, found.hash, found.text):
                word = data[b:e].tobytes()
                out[first + t].append(word)
                assert seen.setdefault(word, h) == h
        assert out == [[x.encode() for x in re.findall(r"[^\x20\x09-\x0d]+", t)] for t in texts]
    assert len(set(seen.values())) == len(seen)


def test_slices_and_empty_columns():
    column = pa.array(["a b", "", "cD", "e"])[1:3]
    ((first, data, starts),) = w.runs(column)
    assert first == 0 and data.tobytes() == b"cD" and starts.tolist() == [0, 0]
    assert w.words(data, starts, lower=True).hash.tolist() == w.words(*next(iter(w.runs(pa.array(["Cd"]))))[1:], lower=True).hash.tolist()
    assert not list(w.runs(pa.array([], pa.string())))
    (only,) = w.runs(pa.array(["", ""]))
    assert len(w.words(*only[1:]).hash) == 0
