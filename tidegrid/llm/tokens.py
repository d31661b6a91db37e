"""Token ids of a byte-level BPE vocabulary over Arrow batches, with offsets and decoding."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

#: Folder of the public vocabulary files; every function here takes another.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"

#: The code points with the Unicode property White_Space.
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# A chunk is white space and what follows up to the next white space. The tokenizer's pattern never matches across the end of a chunk: white space stands only at the start of its matches, and its look-ahead from white space ends at the next other character, in the same chunk.
_CHUNK = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
_ASCII_CHUNK = re.compile("[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
# The tokenizer's pattern, for text in ASCII.
_ASCII_WORD = re.compile("'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")

#: Chunks and words up to this length are kept, and up to so many of each; beyond that the store starts anew. A worker's stores stay under about 150 MB.
KEPT_CHARS, KEPT = 48, 300_000


class Encoder:
    """encode() gives what the tokenizers library gives for the whole text, special tokens' names being ordinary text.

    Texts are cut into chunks, which the library encodes once each: most chunks come back often. Each kept chunk is its ids as bytes (int32), so a text's ids are one join. That holds for byte-level vocabularies that cut texts by the usual pattern and change nothing before or after; with any other vocabulary the library gets whole texts.
    """

    def __init__(self, folder: str = TOKENIZERS, name: str = BYTE_BPE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(f"{folder}/{name}")
        with open(f"{folder}/{name}", encoding="utf-8") as f:
            parts = json.load(f)
        cut = parts.get("pre_tokenizer") or {}
        model = parts["model"]
        added = [t for t in parts.get("added_tokens", []) if not t.get("special")]
        self.by_chunks = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and parts.get("normalizer") is None and model.get("type", "BPE") == "BPE" and not (model.get("end_of_word_suffix") or model.get("continuing_subword_prefix") or model.get("dropout")) and not added
        self.tokenizer.encode_special_tokens = True
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=np.int32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        plain = [c for c in missing if c.isascii()]
        other = [c for c in missing if not c.isascii()]
        split = [_ASCII_WORD.findall(c) for c in plain]
        if len(self.words) > KEPT:
            self.words.clear()
        new = list(set(chain.from_iterable(split)).difference(self.words))
        self.words.update(zip(new, self._library(new)))
        found = dict(zip(plain, [b"".join(map(self.words.__getitem__, s)) for s in split]))
        found.update(zip(other, self._library(other)))
        for w in new:
            if len(w) > KEPT_CHARS:
                del self.words[w]
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """int32 ids as bytes of each text; none for empty and null texts."""
        if not self.by_chunks:
            return [b if t else b"" for t, b in zip(texts, self._library([t or "" for t in texts]))]
        cut = [(_ASCII_CHUNK if t.isascii() else _CHUNK).findall(t) if t else [] for t in texts]
        if len(self.chunks) > KEPT:
            self.chunks.clear()
        known = self.chunks
        missing = list(set(chain.from_iterable(cut)).difference(known))
        known.update(self._learn(missing))
        found = [b"".join(map(known.__getitem__, c)) for c in cut]
        for c in missing:
            if len(c) > KEPT_CHARS:
                del known[c]
        return found

    def count(self, texts: list[str | None]) -> np.ndarray:
        return np.fromiter((len(b) // 4 for b in self.encode(texts)), dtype=np.int64, count=len(texts))


@lru_cache(maxsize=4)
def encoder(folder: str = TOKENIZERS, name: str = BYTE_BPE) -> Encoder:
    """The encoder of this Python worker, loaded once."""
    return Encoder(folder, name)


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 characters stand for themselves, the other bytes, in order, for the code points from 256 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=4)
def token_bytes(folder: str = TOKENIZERS, name: str = BYTE_BPE) -> list[bytes]:
    """The bytes of each token id, by the byte table read backwards."""
    with open(f"{folder}/{name}", encoding="utf-8") as f:
        model = json.load(f)
    back = {c: b for b, c in enumerate(byte_characters())}
    out = [b""] * (max([*model["model"]["vocab"].values(), *(t["id"] for t in model.get("added_tokens", []))]) + 1)
    for token, i in model["model"]["vocab"].items():
        out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    for t in model.get("added_tokens", []):
        out[t["id"]] = t["content"].encode()
    return out


@lru_cache(maxsize=4)
def token_lengths(folder: str = TOKENIZERS, name: str = BYTE_BPE) -> np.ndarray:
    return np.array([len(b) for b in token_bytes(folder, name)], dtype=np.int64)


def decode(ids, folder: str = TOKENIZERS, name: str = BYTE_BPE) -> str:
    """The text of ids. Bytes that several tokens share in one character come together again; a character that ids cut in two, at either end, becomes U+FFFD. Unknown ids raise IndexError."""
    table = token_bytes(folder, name)
    return b"".join(table[i] for i in ids).decode("utf-8", errors="replace")


def byte_offsets(ids: np.ndarray, folder: str = TOKENIZERS, name: str = BYTE_BPE) -> np.ndarray:
    """Offset in UTF-8 bytes at which each token starts, and the end as the last entry: the tokens' bytes follow each other without gaps."""
    return np.concatenate([[0], np.cumsum(token_lengths(folder, name)[ids])])


def char_offsets(text: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For byte offsets into the UTF-8 of text: the character each one lies in, and whether it is that character's first byte."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    lead = np.concatenate([(raw & 0xC0) != 0x80, [True]])
    number = np.cumsum(lead) - 1
    return number[starts], lead[starts]
