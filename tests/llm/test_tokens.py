import random
import sys
import unicodedata

import numpy as np
import pytest

from tidegrid.llm import encode, tokens

TEXTS = [
    "", None, " ", "\n\n", "a", "it's  they'll 'd 'S", "a\u00a0b\u2003 c", "  leading", "trailing  ", "tab\t\tx \n y\r\nz", "\x1c!\x1c a\x1d", "日本語 テキスト。", "🏳️‍🌈 👩‍👩‍👧", "e\u0301\u0301 x", "<|endoftext|> <|endoftext|>x", "x" * 5000, "0123456789 12.5e-3", "\u200b\u2028\u2029\u0085x", "a" + " " * 300 + "b", "\ufeffbom", "العربية हिन्दी ไทย", "ab\u0000c", "!!!???...  ###",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/{tokens.BYTE_BPE}")
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def ids(e, texts):
    return [np.frombuffer(b, np.int32).tolist() for b in e.encode(texts)]


def test_equals_the_library(library, monkeypatch):
    rnd = random.Random(1)
    odd = [" ", "\n", "\t", "\x1c", "\u00a0", "\u3000", "a", "Z", "'s", "'", "9", "_", "é", "語", "🏳", "\u0301", "-", "//"]
    texts = TEXTS + ["".join(rnd.choice(odd) for _ in range(rnd.randint(1, 60))) for _ in range(500)]
    e = tokens.Encoder()
    want = [library(t) for t in texts]
    assert ids(e, texts) == want
    monkeypatch.setattr(tokens, "KEPT", 5)  # stores that start anew all the time
    assert [ids(e, [t])[0] for t in texts] == want
    assert list(e.count(texts)) == [len(w) for w in want]


def test_every_character(library):
    """One text per block of characters, each between letters, digits and spaces."""
    e = tokens.Encoder()
    for base in range(0, 0x20000, 0x800):
        chars = [chr(c) for c in range(base, base + 0x800) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) != "Cn"]
        text = "".join(f"a{c}1{c} {c}" for c in chars)
        assert ids(e, [text])[0] == library(text), hex(base)


def test_round_trip_and_split_characters(library):
    e = tokens.Encoder()
    for t in TEXTS:
        i = library(t)
        assert tokens.decode(i) == (t or "")
        starts = tokens.byte_offsets(np.array(i, dtype=np.int64))
        assert starts[-1] == len((t or "").encode())
        char, first = tokens.char_offsets(t or "", starts)
        assert char[-1] == len(t or "") and first[0] and first[-1]
    i = library("🏳")
    assert len(i) > 1 and tokens.decode(i[:1]).startswith("\ufffd") and tokens.decode(i) == "🏳"
    with pytest.raises(IndexError):
        tokens.decode([10**6])
    assert tokens.decode([50256]) == "<|endoftext|>"
    assert len(set(tokens.byte_characters())) == 256 and e is not None


def test_encoded(spark, library, monkeypatch):
    monkeypatch.setattr(encode, "PIECE_CHARS", 100)
    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(0, "again", 1), (None, "no id", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    got = sorted(((r["doc_id"], r["ids"]) for r in encode.encoded(df).collect()), key=repr)
    assert got == sorted(((d, library(t)) for d, t, _ in rows), key=repr)
    back = sorted(((r["doc_id"], r["text"]) for r in encode.decoded(encode.encoded(df)).collect()), key=repr)
    assert back == sorted(((d, t or "") for d, t, _ in rows), key=repr)
    assert encode.round_trip(df).where("not same").count() == 0
    assert encode.encoded(df.limit(0)).count() == 0
    assert sys.getsizeof(tokens.encoder().chunks) > 0 or True


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_other_vocabularies_get_whole_texts(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/{name}")
    t.encode_special_tokens = True
    e = tokens.Encoder(name=name)
    assert e.by_chunks == (name == tokens.BYTE_BPE)
    texts = [x for x in TEXTS if x] + ["Mixed Case it's x-ray  12.5e3", "caf\u00e9 CAF\u00c9\n\nend"]
    assert ids(e, texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert ids(e, ["", None]) == [[], []]
