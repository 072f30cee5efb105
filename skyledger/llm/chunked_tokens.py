"""Token ids from the tokenizers library, a pre-token at a time.

A byte-pair vocabulary merges within pre-tokens only, so a text's ids are those of its pre-tokens,
one after the other. Workers split texts as the vocabulary's file says, remember the ids of
pre-tokens that they met lately, and give the new ones to the library's model. Texts with
characters beyond the Latin blocks are cut at those spaces that no token can cross; their chunks,
or whole texts where a space is not safe to cut at, pass through the library's own normalizer and
splitter. Either way the ids are the library's.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

#: A space before white space or at the end is part of a longer run, where the byte-level pattern may look further.
UNSAFE = re.compile(r" (?:\s|\Z)")
#: From here on are combining marks, and what is a letter may hang on the Unicode version.
BEYOND_LATIN = re.compile("[ɐ-\U0010ffff]")
#: The letters, numbers and spaces before that, and the two vocabularies' patterns over them.
L, N, S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
ENDINGS = "'(?:s|t|re|ve|m|ll|d)"
PATTERNS = {
    "byte": f" ?[{L}]+|{ENDINGS}| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+",
    "word": f"[{L}]+|{ENDINGS}|[{N}]|[^{S}{L}{N}]+",
}
MARK = "!"


class Recent(dict):
    """A memory of bounded size: when it is full, it starts anew and takes over what is asked for
    again from the one before."""

    def __init__(self, keep: int):
        super().__init__()
        self.keep, self.older = keep, {}

    def lacking(self, wanted: set) -> set:
        """The keys that have to be learnt; the others are present from now on."""
        missing = wanted.difference(self)
        if len(self) + len(missing) > self.keep:
            self.older = dict(self)
            self.clear()
            missing = wanted
        if self.older:
            older = self.older
            again = {k: older[k] for k in missing.intersection(older)}
            self.update(again)
            missing = missing.difference(again)
        return missing


class ChunkEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    ``kind`` is ``"byte"`` for a byte-level vocabulary whose tokens carry their leading space, or
    ``"word"`` for one that lower-cases, drops white space and marks word ends. Strings of special
    tokens are ordinary text. ``keep`` bounds the pre-tokens remembered.
    """

    def __init__(self, path: str, kind: str, keep: int = 400_000, longest: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if kind not in PATTERNS:
            raise ValueError(f"unknown kind of vocabulary: {kind}")
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.kind, self.longest = kind, longest
        self.merger = self._merger()
        self.split = re.compile(PATTERNS[kind]).findall
        self.known = Recent(keep)

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _merger(self):
        """The library's model alone. It takes pre-tokens, their bytes already spelled as the
        vocabulary's characters, with a mark between each two; and so normalizing and splitting
        are not paid for again."""
        from tokenizers import Tokenizer

        bare = json.loads(self.library.to_str()) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        others = [b for b in range(256) if b not in plain]
        self.spelling = {b: chr(256 + k) for k, b in enumerate(others)} | {0xFF: f" {MARK} "}
        model = Tokenizer.from_str(json.dumps(bare))
        self.mark = model.encode(MARK).ids[0]
        return model

    def _group(self, tokens: list[str]) -> str:
        """Pre-tokens in the vocabulary's characters, a mark after each."""
        plain = f"\n{MARK}\n".join(tokens)
        if plain.isascii() and plain.replace("\n", "").isprintable() and plain.count("\n") == 2 * len(tokens) - 2:
            return f"{plain}\n{MARK}".replace(" ", self.spelling[32])
        # no byte of UTF-8 is 255
        data = b"\xff".join([t.encode() for t in tokens]) + b"\xff"
        return data.decode("latin-1").translate(self.spelling)

    def _merged(self, tokens: list[str]) -> list[bytes]:
        """The ids of pre-tokens, none of which has the mark."""
        out: list[bytes] = []
        for found in self.merger.encode_batch_fast([self._group(tokens[k : k + 512]) for k in range(0, len(tokens), 512)], add_special_tokens=False):
            ids = np.array(found.ids, dtype="<u4")
            ends, data = (4 * np.flatnonzero(ids == self.mark)).tolist(), ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *[e + 4 for e in ends[:-1]]], ends, strict=True)]
        return out

    def pre_tokens(self, text: str) -> list[str | bytes]:
        """The pre-tokens of a text; bytes where the library shall normalize and split."""
        if not BEYOND_LATIN.search(text):
            return self.split(text.lower() if self.kind == "word" else text)
        if self.kind == "word":
            chunks = text.replace("\n", " ").split(" ")
        elif UNSAFE.search(text):
            return [text.encode()]
        else:
            first, *rest = text.split(" ")
            chunks = [first, *[" " + c for c in rest]]
        out: list[str | bytes] = []
        for c in chunks:
            if BEYOND_LATIN.search(c):
                out.append(c.encode())
            else:
                out += self.split(c.lower() if self.kind == "word" else c)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [self.pre_tokens(t) for t in texts]
        known = self.known
        new = known.lacking(set(chain.from_iterable(parts)))
        plain = sorted((t for t in new if isinstance(t, str) and MARK not in t), key=str.isascii)
        known.update(zip(plain, self._merged(plain), strict=True))
        others = list(new.difference(plain))
        known.update(zip(others, self.whole([t if isinstance(t, str) else t.decode() for t in others]), strict=True))
        get = known.__getitem__
        out = [b"".join(map(get, p)) for p in parts]
        for t in new:
            if len(t) > self.longest:
                del known[t]
        return out


@lru_cache(maxsize=1)
def worker_encoder(path: str, kind: str) -> ChunkEncoder:
    """The encoder of this Python process. Workers serve many tasks, and pre-tokens that one task met
    are known to the next; a new worker starts with none, and the ids are the same."""
    return ChunkEncoder(path, kind)
