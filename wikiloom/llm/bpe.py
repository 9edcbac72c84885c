"""BPE encoding and decoding (operator 13): cached pre-tokens, and tree concatenation of long texts.

Whole texts are laid end to end (Grid) and cut into pre-tokens; ids of pre-tokens seen before are copied, new ones go to
the library. A long text is halved until its leaves are short; Spark deals the leaves out, so that one text's halves are
encoded by many tasks. Leaves are joined in a tree: a window around the join is encoded again and grows until its first
token is one of the left side and its last token one of the right side, at the same places. That is exact: BPE merges the
pair of least rank, leftmost first, so the merges of two neighbouring tokens don't depend on what stands beyond them, and a
sequence is the encoding of its text if and only if each two neighbours are the encoding of theirs. All neighbours left of
the window, in it, and right of it are such.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikiloom.llm.common import bounded
from wikiloom.llm.textgrid import Grid, Known, prefix, slabs, span_hashes
from wikiloom.llm.tokens import library, specials

#: Ids of remembered pre-tokens that a worker holds before it starts afresh.
POOL_IDS = 4_000_000
#: Code points of a leaf at most; longer texts are halved until their leaves are that short.
LEAF = 32_768
#: Bytes on each side of a join that the first window holds about.
WINDOW = 64
#: Bytes from which on a place in a run, or behind a cut, can't be within a contraction (three characters).
CLEAR = 12
END = "</w>"


class Pool:
    """Ids of stretches of text by their hash: those seen before are copied, new ones are encoded."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]):
        self.encode, self.known = encode, Known(21, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.size, self.words = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    @staticmethod
    def _room(a: np.ndarray, need: int) -> np.ndarray:
        return a if need <= len(a) else np.concatenate([a, np.zeros(max(need - len(a), len(a)), a.dtype)])

    def _learn(self, h: np.ndarray, texts: list[str]) -> np.ndarray:
        found = self.encode(texts)
        size = np.fromiter(map(len, found), np.int64, len(found))
        need, words = self.used + int(size.sum()), self.words + len(found)
        self.ids = self._room(self.ids, need)
        self.at, self.size = self._room(self.at, words), self._room(self.size, words)
        self.ids[self.used : need] = np.fromiter((i for x in found for i in x), np.uint32, need - self.used)
        number = np.arange(self.words, words)
        self.at[number], self.size[number] = self.used + np.cumsum(size) - size, size
        self.known.put(h, number)
        self.used, self.words = need, words
        return number

    def look(self, h: np.ndarray, text: Callable[[int], str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the stretches with these hashes, one after the other, and each stretch's number of ids; text(i): the i-th."""
        if self.used > POOL_IDS:
            self.known.clear()
            self.used = self.words = 0
        number, known = self.known.look(h)
        left = np.flatnonzero(~known)
        if len(left):
            new, first, back = np.unique(h[left], return_index=True, return_inverse=True)
            number[left] = self._learn(new, [text(i) for i in left[first]])[back]
        size = self.size[number]
        stop = np.cumsum(size)
        return self.ids[np.repeat(self.at[number] - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)], size


class Encoder:
    """Token ids of whole texts, pre-token by pre-token. words: for a vocabulary with word ends, else byte-level BPE.

    plain: special strings are text like other. Such strings otherwise, and characters that versions of Unicode class
    differently, send the whole text to the library.
    """

    def __init__(self, path: str, words: bool = False, plain: bool = False):
        self.tok, self.words = library(path, plain), words
        self.special = [] if plain else specials(path)
        self.pool = Pool(lambda texts: [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)])

    def grid(self, texts: list[str]) -> tuple[Grid, np.ndarray, np.ndarray]:
        if self.words:
            texts = [t if t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t) for t in texts]
        grid = Grid(texts, fold=self.words)
        return (grid, *(grid.word_level() if self.words else grid.byte_level()))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for a, b in slabs(texts):
            yield from self._slab(texts[a:b])

    def _slab(self, texts: list[str]) -> Iterator[np.ndarray]:
        grid, start, end = self.grid(texts)
        ids, size = self.pool.look(span_hashes(prefix(grid.cp), start, end), lambda i: grid.joined[start[i] : end[i]])
        bounds = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(start, np.concatenate([[0], grid.ends]))]
        odd = grid.doubtful()
        for i, t in enumerate(texts):
            if odd[i] or any(s in t for s in self.special):
                yield np.array(self.tok.encode(t, add_special_tokens=False).ids, np.uint32)
            else:
                yield ids[bounds[i] : bounds[i + 1]]


# tree concatenation


@dataclass
class Part:
    """A normalised text in UTF-8 with its encoding: ids, where each token starts, where its pre-token starts (in bytes)."""

    raw: bytes
    ids: np.ndarray
    start: np.ndarray
    word: np.ndarray


@cache
def _inner(path: str) -> tuple:
    """The library on normalised text, without added tokens; the same without word ends; each id's bytes; which ids end a word."""
    from tokenizers import Tokenizer

    said = json.loads(library(path).to_str()) | {"normalizer": None, "added_tokens": [], "post_processor": None}
    closed = Tokenizer.from_str(json.dumps(said))
    said["model"]["end_of_word_suffix"] = None
    pieces = {i: s for s, i in library(path).get_vocab(with_added_tokens=False).items()}
    top = max(pieces) + 1
    ends = np.array([pieces.get(i, "").endswith(END) for i in range(top)])
    sizes = np.array([len(pieces.get(i, "").removesuffix(END)) for i in range(top)], np.int64)
    return closed, Tokenizer.from_str(json.dumps(said)), sizes, ends


def _placed(path: str, raw: bytes, ids: np.ndarray, words: np.ndarray) -> Part:
    """words: where the pre-tokens start, one for each token that ends a word."""
    _, _, sizes, ends = _inner(path)
    size, last = sizes[ids], ends[ids]
    number = np.cumsum(last) - last
    word = words[number]
    before = np.cumsum(size) - size
    first = np.flatnonzero(np.concatenate([[True], last[:-1]])) if len(ids) else np.zeros(0, np.int64)
    return Part(raw, ids, word + before - (before[first][number] if len(ids) else before), word)


def _bytes_before(text: str) -> np.ndarray:
    """For each code point of the text, and its end, the bytes before it."""
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF))]).astype(np.int64)


def _by_library(path: str, text: str, open_end: bool = False) -> Part:
    """The encoding of a normalised text; open_end: its last pre-token goes on beyond it."""
    closed, inside, _, ends = _inner(path)
    got = closed.encode(text, add_special_tokens=False)
    ids = np.array(got.ids, np.int64)
    first = np.flatnonzero(np.concatenate([[True], ends[ids[:-1]]])) if len(ids) else np.zeros(0, np.int64)
    places = np.array([got.offsets[k][0] for k in first], np.int64)
    if open_end and len(ids):
        ids = np.concatenate([ids[: first[-1]], np.array(inside.encode(text[places[-1] :], add_special_tokens=False).ids, np.int64)])
    return _placed(path, text.encode(), ids, _bytes_before(text)[places])


def leaf(encoder: Encoder, path: str, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A leaf in normalised form, its ids, and where its pre-tokens start (in bytes)."""
    grid, start, end = encoder.grid([text])
    if grid.doubtful()[0]:
        part = _by_library(path, encoder.tok.normalizer.normalize_str(text))
        return part.raw, part.ids, part.word[part.start == part.word]
    ids, _ = encoder.pool.look(span_hashes(prefix(grid.cp), start, end), lambda i: grid.joined[start[i] : end[i]])
    low = grid.cp[:-1].tobytes().decode("utf-32-le")
    return low.encode(), ids.astype(np.int64), _bytes_before(low)[start]


def halves(text: str, most: int) -> list[str]:
    """The text halved until no piece is longer than `most`. Cuts stand before characters that normalisation leaves apart
    from what is before them; a stretch without such a character stays whole."""
    out, todo = [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        middle = (a + b) // 2
        if b - a > most:
            while middle < b and (unicodedata.category(text[middle])[0] == "M" or unicodedata.category(text[middle]) == "Cn" or 0x1160 <= ord(text[middle]) <= 0x11FF):
                middle += 1
            if middle < b:
                todo += [(middle, b), (a, middle)]
                continue
        out.append(text[a:b])
    return out


def _clean(path: str, part: Part, ends_too: bool) -> np.ndarray:
    """Tokens that start (ends_too: end) between characters, at an edge of their pre-token or clear of its beginning."""
    _, _, sizes, ends = _inner(path)
    at = part.start + sizes[part.ids] if ends_too else part.start
    raw = np.frombuffer(part.raw + b"\0", np.uint8)
    edge = ends[part.ids] if ends_too else part.start == part.word
    return (raw[at] & 0xC0 != 0x80) & (edge | (part.start - part.word >= CLEAR))


def joined(path: str, left: Part, right: Part, window: int = WINDOW) -> Part:
    """The encoding of both texts together, by windows that grow until both sides agree."""
    _, _, sizes, ends = _inner(path)
    starts = np.flatnonzero(_clean(path, left, False))
    stops = np.flatnonzero(_clean(path, right, True) & (right.start >= CLEAR))
    places = right.start[stops] + sizes[right.ids[stops]]
    while True:
        i = np.searchsorted(left.start[starts], len(left.raw) - max(window, CLEAR), "right") - 1
        j = np.searchsorted(places, window)
        k, m = starts[i] if i >= 0 else -1, stops[j] if j < len(stops) else -1
        p, q = left.start[k] if k >= 0 else 0, places[j] if m >= 0 else len(right.raw)
        middle = _by_library(path, (left.raw[p:] + right.raw[:q]).decode(), m >= 0 and not ends[right.ids[m]])
        ids = middle.ids
        if (k < 0 or (len(ids) and ids[0] == left.ids[k])) and (m < 0 or (len(ids) and ids[-1] == right.ids[m])):
            break
        window *= 2
    k, m = max(k, 0), (len(right.ids) if m < 0 else m + 1)
    shift = len(left.raw)
    return Part(
        left.raw + right.raw, np.concatenate([left.ids[:k], ids, right.ids[m:]]),
        np.concatenate([left.start[:k], middle.start + p, right.start[m:] + shift]), np.concatenate([left.word[:k], middle.word + p, right.word[m:] + shift]),
    )


def tree(path: str, parts: list[Part], window: int = WINDOW) -> np.ndarray:
    """The ids of the texts of all parts together; neighbours are joined, then neighbours of these, and so on."""
    while len(parts) > 1:
        parts = [joined(path, *parts[i : i + 2], window) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0].ids


# on Spark


def _decoder(path: str) -> Callable[[np.ndarray], str]:
    pieces = {i: s for s, i in library(path).get_vocab(with_added_tokens=True).items()}
    return lambda ids: " ".join([pieces[i] for i in ids.tolist()])


def _rows(id_column: pa.Array, ids: list[np.ndarray], decode: Callable[[np.ndarray], str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [id_column, pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([decode(x) for x in ids], pa.string())],
        ["id", "n_tokens", "ids", "decoded"],
    )


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF, window: int = WINDOW) -> DataFrame:
    """One row per document: the id, n_tokens, ids (binary: unsigned 32-bit, little-endian) and decoded (what the library decodes).

    Ids are those of the tokenizers library for the word-level BPE file at `path`, over whole texts, without added tokens.
    Texts of over `leaf_chars` code points without special strings are encoded by tree concatenation: their leaves are
    shuffled by (row, leaf) and met again by row, so memory is bounded by one text. Others are map-only. Null text counts as empty:
    no tokens, decoded ''. A null id is kept. Repeated rows give repeated results; an empty table gives none; further columns
    of docs, whatever their names, are ignored.
    """
    special = specials(path)
    kind = docs.schema[id_col].dataType.simpleString()
    bare = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    long = F.char_length("t") > leaf_chars
    for s in special:
        long = long & ~F.contains("t", F.lit(s))
    result = f"id {kind}, n_tokens long, ids binary, decoded string"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decode = Encoder(path, words=True), _decoder(path)
        for batch in bounded(batches):
            yield _rows(batch.column(0), list(encoder.encode(batch.column(1).to_pylist())), decode)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            for i, t in enumerate(batch.column(1).to_pylist()):
                texts = halves(t, leaf_chars)
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(pa.array([i] * n, pa.int64())) for c in (0, 2)), pa.array(range(n), pa.int32()), pa.array([n] * n, pa.int32()), pa.array(texts)], ["id", "row", "part", "parts", "t"]
                )

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, words=True)
        for batch in bounded(batches, 4):
            raw, ids, words = zip(*(leaf(encoder, path, t) for t in batch.column(4).to_pylist()), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(raw, pa.binary()), *(pa.array([x.astype("<u4").tobytes() for x in y], pa.binary()) for y in (ids, words))], ["id", "row", "part", "parts", "raw", "ids", "words"]
            )

    def meet(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        if rows.num_rows != rows.column("parts")[0].as_py():
            raise RuntimeError("leaves of a text are lost: its row number changed between two runs of a task")
        parts = [_placed(path, r, *(np.frombuffer(x, "<u4").astype(np.int64) for x in (i, w))) for r, i, w in zip(*(rows.column(c).to_pylist() for c in ("raw", "ids", "words")), strict=True)]
        return pa.Table.from_batches([_rows(rows.column("id").combine_chunks()[:1], [tree(path, parts, window)], _decoder(path))])

    short = bare.filter(~long).mapInArrow(whole, result)
    apart = bare.filter(long).withColumn("row", F.monotonically_increasing_id()).mapInArrow(cut, f"id {kind}, row long, part int, parts int, t string")
    done = apart.repartition("row", "part").mapInArrow(leaves, f"id {kind}, row long, part int, parts int, raw binary, ids binary, words binary")
    return short.unionByName(done.groupBy("row").applyInArrow(meet, result)).withColumnRenamed("id", id_col)
