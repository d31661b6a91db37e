"""Encoding of a whole corpus with a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import tokens

#: Characters of text that are encoded at once, about; a longer text is one piece of its own.
PIECE_CHARS = 4_000_000


def spread(documents: DataFrame) -> DataFrame:
    """documents over enough tasks: a scan of few row groups is dealt out by a hash of its rows' text id, else left as it is."""
    cores = documents.sparkSession.sparkContext.defaultParallelism
    # Only the plan is looked at, nothing runs.
    return documents if documents.rdd.getNumPartitions() >= cores else documents.repartition(4 * cores, "doc_id")


def pieces(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, list]]:
    """(first row, texts) of runs of rows of a batch of bounded length."""
    texts, first, size, run = batch.column(column).to_pylist(), 0, 0, []
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if run and size + n > PIECE_CHARS:
            yield first, run
            first, size, run = i, 0, []
        run.append(t)
        size += n
    if run:
        yield first, run


def encoded(documents: DataFrame, folder: str = tokens.TOKENIZERS, name: str = tokens.BYTE_BPE) -> DataFrame:
    """(doc_id, ids) of each document: ids is a list of integers, empty for an empty and for a null text.

    No special token is added, and names of special tokens inside a text are ordinary text. Repeated rows come out as often as they come in; a null doc_id stays null; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = tokens.encoder(folder, name)
        for batch in batches:
            for first, texts in pieces(batch):
                found = e.encode(texts)
                ends = np.concatenate([[0], np.cumsum([len(b) // 4 for b in found])]).astype(np.int32)
                flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(found))])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), ids], ["doc_id", "ids"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, ids array<int>")


def counted(documents: DataFrame, keep: list[str], folder: str = tokens.TOKENIZERS, name: str = tokens.BYTE_BPE) -> DataFrame:
    """The columns keep and n_tokens of each document; 0 for empty and null texts."""
    fields = [documents.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = tokens.encoder(folder, name)
        for batch in batches:
            for first, texts in pieces(batch):
                own = [batch.column(c).slice(first, len(texts)) for c in keep]
                yield pa.RecordBatch.from_arrays([*own, pa.array(e.count(texts))], [*keep, "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens long"
    return spread(documents.select(*dict.fromkeys([*keep, "doc_id", "text"]))).mapInArrow(run, schema)


def decoded(ids: DataFrame, folder: str = tokens.TOKENIZERS, name: str = tokens.BYTE_BPE) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); a null list gives a null text, an empty one an empty text. Characters that the list cuts in two become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else tokens.decode(x, folder, name) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(documents: DataFrame, folder: str = tokens.TOKENIZERS, name: str = tokens.BYTE_BPE) -> DataFrame:
    """(doc_id, n_tokens, n_chars, same): whether decoding gives each document's text back; null and empty texts give 0, 0, true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = tokens.encoder(folder, name)
        for batch in batches:
            for first, texts in pieces(batch):
                n, chars, same = [], [], []
                for t, b in zip(texts, e.encode(texts)):
                    n.append(len(b) // 4)
                    chars.append(len(t or ""))
                    same.append(tokens.decode(np.frombuffer(b, np.int32), folder, name) == (t or ""))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array(n, pa.int64()), pa.array(chars, pa.int64()), pa.array(same)], ["doc_id", "n_tokens", "n_chars", "same"])

    return spread(documents.select("doc_id", F.col("text"))).mapInArrow(run, "doc_id long, n_tokens long, n_chars long, same boolean")
