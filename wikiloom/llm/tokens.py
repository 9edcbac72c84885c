"""Token counts (operator 4): whole-token shortcut in front of the merges of a public tokenizer."""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikiloom.llm.common import bounded
from wikiloom.llm.textgrid import Grid, Known, prefix, slabs, span_hashes


@cache
def library(path: str, plain: bool = False):
    """plain: special strings in texts are text like other."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = plain
    return out


def specials(path: str) -> list[str]:
    return [t.content for t in library(path).get_added_tokens_decoder().values()]


def _byte_of() -> dict[str, int]:
    """The characters by which byte-level vocabularies write the 256 bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def whole_tokens(path: str) -> list[str]:
    """The vocabulary strings proved to encode alone as exactly their own token; run once, on the driver."""
    tok, byte_of, end = library(path), _byte_of(), "</w>"
    texts, ids = [], []
    for piece, i in tok.get_vocab(with_added_tokens=False).items():
        if piece.endswith(end):
            try:
                texts.append(bytes(byte_of[c] for c in piece.removesuffix(end)).decode())
                ids.append(i)
            except (KeyError, UnicodeDecodeError):
                continue
    got = tok.encode_batch_fast(texts, add_special_tokens=False)
    return sorted(t for t, i, e in zip(texts, ids, got, strict=True) if t and e.ids == [i])


class Counter:
    """Counts tokens of whole texts as the library would, pre-token by pre-token."""

    def __init__(self, path: str, whole: list[str]):
        self.tok, self.special = library(path), specials(path)
        self.whole, self.rest = Known(19, np.int8), Known(21, np.int32)
        grid = Grid(whole, fold=True)
        h, doc, start, end = self._spans(grid)
        alone = (start == np.concatenate([[0], grid.ends[:-1] + 1])[doc]) & (end == grid.ends[doc])
        alone &= ~grid.doubtful()[doc]
        self.whole.put(h[alone], np.ones(alone.sum(), np.int8))

    @staticmethod
    def _spans(grid: Grid):
        start, end = grid.word_level()
        return span_hashes(prefix(grid.cp), start, end), np.searchsorted(grid.ends, start), start, end

    def counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for a, b in slabs(texts):
            out[a:b] = self._slab([t if t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t) for t in texts[a:b]], texts[a:b])
        return out

    def _slab(self, texts: list[str], raw: list[str]) -> np.ndarray:
        grid = Grid(texts, fold=True)
        h, doc, start, end = self._spans(grid)
        n, known = self.whole.look(h)
        n = n.astype(np.int64)
        left = np.flatnonzero(~known)
        if len(left):
            value, known = self.rest.look(h[left])
            n[left] = value
            left = left[~known]
        if len(left):
            new, first, back = np.unique(h[left], return_index=True, return_inverse=True)
            words = [grid.joined[start[i] : end[i]] for i in left[first]]
            sizes = np.fromiter((len(e) for e in self.tok.encode_batch_fast(words, add_special_tokens=False)), np.int64, len(words))
            self.rest.put(new, sizes)
            n[left] = sizes[back]
        out = np.bincount(doc, weights=n, minlength=len(texts)).astype(np.int64)
        # special strings and characters that Unicode versions class differently: the library reads the whole text
        odd = grid.doubtful()
        for i, t in enumerate(raw):
            if odd[i] or any(s in t for s in self.special):
                out[i] = len(self.tok.encode(t, add_special_tokens=False))
        return out


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per document: the id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Counts are those of the tokenizers library for the word-level BPE file at `path`, over the whole text, without
    begin, end or padding. Null text counts as empty: 0 bytes, 0 tokens. A null id is kept. Repeated rows give repeated
    results; an empty table gives none; further columns of docs, whatever their names, are ignored. Map-only: no shuffle.
    """
    whole = whole_tokens(path)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, whole)
        for batch in bounded(batches):
            n = counter.counts([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    bare = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n"))
    out = bare.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
