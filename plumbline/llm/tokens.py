"""Token ids of whole texts inside Arrow tasks."""

from __future__ import annotations

import base64
import functools
import json
import os
import re

import numpy as np
import pyarrow as pa

#: Entries of a worker's cache of words; beyond it the cache starts anew. About 200 bytes an entry.
CACHE_WORDS = 700_000
#: Longer words are encoded each time.
CACHE_WORD_BYTES = 64
#: Texts are looked up together up to this many bytes.
CHUNK_BYTES = 1 << 20


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


#: A run of lower-case ASCII and of Latin-1 letters up to white space or ASCII punctuation (but the apostrophe, which may bind
#: letters to it); a run of such punctuation up to white space; what else there is up to white space.
WORDS = re.compile(rb"[a-z\x80-\x96\x98-\xb6\xb8-\xbf\xc3]++(?![^\s!-&(-/:-@\[-`{-~])|[!-&(-/:-@\[-`{-~]++(?!\S)|\S+")
PLAIN = re.compile(rb"[a-z\x80-\x96\x98-\xb6\xb8-\xbf\xc3]+")
#: Combining marks (their first bytes) may bind to the letter before them, and special tokens are found before letters lose their case.
CASED = (b"\xcc", b"\xcd", b"<|")


def by_words(spec: dict) -> bool:
    """True for a tokenizer file whose ids of a text are those of its words: text is composed and lower-cased,
    white space only separates, letters stand apart from all else, and a mark ends each word."""
    parts = (spec.get("normalizer") or {}).get("normalizers") or []
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    model = spec.get("model") or {}
    return (
        [p["type"] for p in parts] == ["NFC", "Replace", "Lowercase"]
        and (parts[1]["pattern"], parts[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [p["type"] for p in split] == ["Split", "ByteLevel"]
        and split[0]["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
        and (split[0]["behavior"], split[0]["invert"]) == ("Removed", True)
        and not split[1]["add_prefix_space"]
        and not split[1]["use_regex"]
        and model.get("type") == "BPE"
        and model.get("end_of_word_suffix") == "</w>"
        and all(not t["normalized"] and t["content"].startswith("<|") for t in spec.get("added_tokens") or [])
    )


class TextEncoder:
    """Ids of any tokenizer, text by text."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(file)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit numbers."""
        return [np.array(self.model.encode_batch_fast([t.decode()], add_special_tokens=False)[0].ids, "<u4").tobytes() for t in texts]


class WordEncoder(TextEncoder):
    """Ids of a tokenizer that works ``by_words``.

    The ids of a text are those of its words, one after another, so words are encoded once and found again
    in a bounded cache. A word ends at ASCII white space, or where letters meet punctuation; whatever
    else the tokenizer takes for white space stays inside and is handled by it. ASCII letters lose their
    case first, unless the text has combining marks or might hold a special token. New runs of plain letters
    are already composed and single words to the tokenizer, so many at a time skip its first steps, and
    are told apart by the tokens that end a word.
    """

    def __init__(self, file: str):
        super().__init__(file)
        from tokenizers import Tokenizer

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        if not by_words(spec):
            raise ValueError(f"{file} does not work word by word")
        spec["normalizer"] = None
        spec["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
        self.runs = Tokenizer.from_str(json.dumps(spec))
        self.cache: dict[bytes, bytes] = {}
        vocab = self.model.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words that the cache lacks; words too long for it are returned only."""
        plain, other, big = [], [], {}
        for w in new:
            (plain if len(w) <= CACHE_WORD_BYTES and PLAIN.fullmatch(w) else other).append(w)
        for at in range(0, len(plain), 8192):
            part = plain[at : at + 8192]
            ids = np.array(self.runs.encode_batch_fast([b" ".join(part).decode().lower()], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * (np.nonzero(self.ends[ids])[0] + 1)).tolist()
            raw = ids.tobytes()
            self.cache.update(zip(part, [raw[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)], strict=True))
        for at in range(0, len(other), 4096):
            part = other[at : at + 4096]
            got = self.model.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            for w, e in zip(part, got, strict=True):
                (self.cache if len(w) <= CACHE_WORD_BYTES else big)[w] = np.array(e.ids, "<u4").tobytes()
        return big

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        words = [WORDS.findall(t if any(c in t for c in CASED) else t.lower()) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        big = self._learn(list(set().union(*words).difference(self.cache)))
        get = (self.cache | big if big else self.cache).__getitem__
        return [b"".join(map(get, own)) for own in words]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out, run, size = [], [], 0
        for t in texts:
            run.append(t)
            size += len(t)
            if size >= CHUNK_BYTES:
                out += self._encode(run)
                run, size = [], 0
        return out + self._encode(run) if run else out


@functools.lru_cache(maxsize=1)
def text_encoder(file: str) -> TextEncoder:
    """One encoder for all tasks of a worker process."""
    with open(file, encoding="utf-8") as f:
        return WordEncoder(file) if by_words(json.load(f)) else TextEncoder(file)


def rank_encoding(file: str, pattern: str):
    """A tiktoken encoding from a rank file; special tokens' strings are ordinary text."""
    import tiktoken

    with open(file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
