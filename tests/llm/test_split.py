import numpy as np
import pytest

from tidegrid.llm import split, tokens

LIMIT, OVERLAP = 64, 4


def pieces(text, limit=LIMIT, overlap=OVERLAP):
    e = tokens.encoder()
    ids = np.frombuffer(e.encode([text])[0], np.int32)
    return ids, split.split_text(text, e, ids, limit, overlap, tokens.TOKENIZERS, tokens.BYTE_BPE) if len(ids) > limit else []


TEXTS = {
    "prose": "A first sentence here. Another one follows!\nA new line; and more.\n\nA paragraph. " * 40,
    "code": "def f(x):\n    return x + 1\n\n\nclass A:\n    pass\n" * 30,
    "one line": "var a=1;b(2);c[3]={d:4};" * 100,
    "no boundary": "x9Zq" * 800,
    "spaces": " " * 3000,
    "emoji": "🏳🧿🪬" * 200,
    "chinese": "这是一个句子。另一个句子!" * 80,
    "crlf": "a line\r\nanother\r\n\r\nblock\r\n" * 60,
    "mixed": ("token " * 7 + "\n") * 50 + "é" * 400,
}


@pytest.mark.parametrize("name", TEXTS)
def test_pieces_cover_the_text_within_the_limit(name):
    text = TEXTS[name]
    ids, p = pieces(text)
    e = tokens.encoder()
    assert len(ids) > LIMIT and len(p) > 1
    assert p[0]["start_char"] == 0 and p[-1]["end_char"] == len(text)
    for a, b in zip(p, p[1:]):
        assert a["start_char"] < b["start_char"] <= a["end_char"] < b["end_char"]
        assert OVERLAP <= b["overlap_tokens"] <= OVERLAP + 3
    assert all(x["n_tokens"] <= LIMIT and e.count([x["text"]])[0] <= LIMIT and x["text"] == text[x["start_char"] : x["end_char"]] for x in p)
    assert sum(x["n_tokens"] - x["overlap_tokens"] for x in p) == len(ids)
    assert [x["piece_no"] for x in p] == list(range(len(p))) and {x["n_pieces"] for x in p} == {len(p)}


def test_strong_boundaries_come_first():
    assert {x["cut"] for x in pieces(TEXTS["prose"])[1][:-1]} <= {"paragraph", "line", "sentence"}
    assert pieces("word " * 60 + "\n\n" + "word " * 60, 100)[1][0]["cut"] in ("paragraph", "line")
    assert pieces(TEXTS["crlf"])[1][0]["cut"] in ("paragraph", "line")
    assert {x["cut"] for x in pieces(TEXTS["chinese"])[1][:-1]} == {"sentence"}


def test_whole_tables(spark):
    rows = [(i, t, i) for i, t in enumerate(TEXTS.values())] + [(90, None, 0), (91, "", 0), (92, "short", 0), (93, "a " * 63, 0), (94, TEXTS["code"], 0), (94, TEXTS["code"], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece_no int")
    got = split.split_documents(df, LIMIT, OVERLAP).collect()
    e = tokens.encoder()
    assert {r["doc_id"] for r in got} == {d for d, t, _ in rows if e.count([t])[0] > LIMIT} == {*range(len(TEXTS)), 94}
    assert sum(r["doc_id"] == 94 and r["piece_no"] == 0 for r in got) == 2
    assert split.split_documents(df.limit(0), LIMIT, OVERLAP).count() == 0
    with pytest.raises(ValueError):
        split.split_documents(df, 64, 32)


def test_found_equals_the_counted(spark):
    from tidegrid.llm import queries
    from tidegrid.sources.tables import table

    d = "/root/testdata/sf0.001"
    text = {r["doc_id"]: r["text"] for r in table(spark, d, "documents").select("doc_id", "text").collect()}
    want = {k for k, t in text.items() if tokens.encoder().count([t])[0] > 4096}
    assert {r["doc_id"] for r in queries.p8_found(spark, d).collect()} == want and want


@pytest.mark.parametrize("limit,overlap", [(64, 4), (64, 9), (100, 16), (300, 40), (1000, 150)])
def test_no_piece_is_over_any_limit_when_encoded_by_itself(limit, overlap):
    e = tokens.encoder()
    for text in [*TEXTS.values(), "".join(TEXTS.values()), "\u0301\U0001F3F3" * 700, "a" * 9000, " \n" * 4000]:
        _, p = pieces(text, limit, overlap)
        assert all(n <= limit for n in e.count([x["text"] for x in p]))
        assert not p or p[-1]["end_char"] == len(text)


def test_minified_code_is_cut_after_marks():
    p = pieces("a=b(c)[d];e={f:g,h:i};" * 60)[1]
    assert {x["cut"] for x in p[:-1]} == {"mark"}
