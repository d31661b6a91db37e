"""Oversized texts cut into overlapping pieces at natural boundaries, by recursive bisection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import tokens
from tidegrid.llm.encode import spread

LIMIT, OVERLAP = 4096, 128
#: Tokens of its own from which a stretch can be bisected: any more hold a border between characters.
LEAST = 8
#: Kinds of boundary, weakest first: inside a character (never cut), between characters, after a comma, semicolon or brace without white space, at white space, after a sentence or statement, after a line, after a blank line.
KINDS = ("none", "character", "mark", "space", "sentence", "line", "paragraph")
_SCHEMA = "doc_id long, piece_no int, n_pieces int, start_char long, end_char long, n_tokens int, overlap_tokens int, cut string, text string"


def strengths(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Index into KINDS of the boundary before each token start; raw is the UTF-8 text. The start and the end of the text count as paragraphs."""
    padded = np.concatenate([np.full(4, 10, np.uint8), raw, np.full(1, 10, np.uint8)])
    at = starts + 4
    after, b1, b2, b3, b4 = (padded[at - k] for k in (0, 1, 2, 3, 4))
    space = lambda x: (x == 32) | ((x >= 9) & (x <= 13))
    out = np.where((after & 0xC0) == 0x80, 0, 1)
    free = out > 0
    out[free & np.isin(b1, np.frombuffer(b",;{}", np.uint8))] = 2
    out[free & (space(after) | space(b1))] = 3
    ends = np.isin(b1, np.frombuffer(b".!?;}", np.uint8)) & space(after)
    # The UTF-8 ends of the ideographic full stop and of the full-width ! and ?.
    ends |= (b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x82) | (b3 == 0xEF) & (b2 == 0xBC) & ((b1 == 0x81) | (b1 == 0x9F))
    out[free & ends] = 4
    line = (b1 == 10) | ((b1 == 13) & (after != 10))
    out[free & line] = 5
    blank = (b1 == 10) & ((b2 == 10) | (b2 == 13) & (b3 == 10)) | (b1 == 13) & (b2 == 13)
    out[free & line & blank] = 6
    return out


def cuts(strength: np.ndarray, limit: int, overlap: int, small: set[tuple[int, int]] = frozenset()) -> list[tuple[int, int, int]]:
    """(from, to, own) of each piece in tokens: own is where what it does not share with the piece before begins, and from lies overlap tokens earlier, or as few more as a cut character needs.

    A stretch that is still too long with its overlap, or is in small, is cut at the strongest boundary within a quarter of its length from its middle, the nearest of equals.
    """
    n = len(strength) - 1

    def begin(a: int) -> int:
        if a == 0:
            return 0
        a = max(0, a - overlap)
        while strength[a] == 0:
            a -= 1
        return a

    done, todo = [], [(0, n)]
    while todo:
        a, b = todo.pop()
        start = begin(a)
        if b - start <= limit and (a, b) not in small:
            done.append((start, b, a))
            continue
        mid, reach = (a + b) // 2, max(1, (b - a) // 4)
        window = np.arange(max(a + 1, mid - reach), min(b - 1, mid + reach) + 1)
        best = strength[window]
        window = window[best == best.max()]
        cut = int(window[np.argmin(np.abs(window - mid))])
        todo += [(cut, b), (a, cut)]
    return done


def split_text(text: str, e: tokens.Encoder, ids: np.ndarray, limit: int, overlap: int, folder: str, name: str) -> list[dict]:
    """The pieces of one text; each also has at most limit tokens when it is encoded by itself, for which a stretch is bisected once more where needed. A stretch of up to LEAST tokens needs it never: with its overlap it is well under any limit that split_documents takes."""
    starts = tokens.byte_offsets(ids, folder, name)
    raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    strength = strengths(raw, starts)
    char, _ = tokens.char_offsets(text, starts)
    small: set[tuple[int, int]] = set()
    while True:
        spans = cuts(strength, limit, overlap, small)
        parts = [text[char[s] : char[t]] for s, t, _ in spans]
        over = [(own, t) for (s, t, own), n in zip(spans, e.count(parts)) if n > limit and t - own > LEAST]
        if not over:
            break
        small.update(over)
    return [
        {"piece_no": i, "n_pieces": len(spans), "start_char": int(char[s]), "end_char": int(char[t]), "n_tokens": t - s, "overlap_tokens": own - s, "cut": KINDS[strength[t]] if t < len(ids) else "end", "text": p}
        for i, ((s, t, own), p) in enumerate(zip(spans, parts))
    ]


def split_documents(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, folder: str = tokens.TOKENIZERS, name: str = tokens.BYTE_BPE) -> DataFrame:
    """The pieces of every document of more than limit tokens: (doc_id, piece_no from 0, n_pieces, start_char, end_char, n_tokens, overlap_tokens, cut, text).

    A piece has at most limit tokens of its document's encoding and, encoded by itself, of its own. It begins with the last overlap tokens of the piece before it (up to three more where these begin inside a character) and ends at the boundary `cut`, one of KINDS or `end`. Without their overlaps the pieces follow each other without a gap. Documents of up to limit tokens, empty and null texts give no row; repeated rows give their pieces as often.

    A token has at least one byte, so a text of up to limit bytes needs no encoding; only longer ones are sent to Python, each to one task and one after the other.
    """
    if overlap < 0 or overlap + 4 > (limit - overlap) // 4:
        raise ValueError("overlap must be under about a fifth of limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = tokens.encoder(folder, name)
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.frombuffer(e.encode([text])[0], dtype=np.int32)
                if len(ids) > limit:
                    rows = split_text(text, e, ids, limit, overlap, folder, name)
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc, **r} for r in rows], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("n_tokens", pa.int32()), ("overlap_tokens", pa.int32()), ("cut", pa.string()), ("text", pa.string())])
    long = documents.select("doc_id", "text").where(F.octet_length("text") > limit)
    return spread(long).mapInArrow(run, _SCHEMA)
