"""Inverting documents: Arrow kernels that sort the tokens of many documents at once.

Built-in functions make the tokens, or for words of letters, the usual case, ``Letters`` finds them with the JVM's own
table of letters; only whole arrays are handled. A part of a batch has at most ``MOST_TOKENS`` tokens, or one document,
so a task's memory does not follow the number of its documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.analysis import MOST_BYTES
from ..functions.scoring import NORM_VALUES

#: Tokens that are sorted at a time, if not of one document.
MOST_TOKENS = 1 << 20
#: Documents of a block: few, so that blocks weigh about the same where a frequent term is dealt out.
BLOCK_DOCS = 32


def _ends(begins: np.ndarray, size: int) -> pa.Array:
    return pa.array(np.append(begins, size), pa.int32())


_table: list[bytes] = []


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``MOST_TOKENS`` tokens (some four bytes of a text count as one), or one row."""
    lists = batch.schema.get_field_index("tokens") >= 0
    sizes = pc.list_value_length(batch["tokens"]) if lists else pc.divide(pc.binary_length(batch["text"]), 4)
    upto = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + MOST_TOKENS, "right")))
        yield batch.slice(at, end - at)
        at = end


@dataclass(frozen=True)
class Letters:
    """Words of letters, in lower case or not, and norms by the usual law: 1 / sqrt(len) times ``boost``, or 0 for None."""

    packed: bytes
    lowered: bool
    boost: float | None

    @staticmethod
    def of(jvm, lowered: bool, boost: float | None) -> Letters:
        """``jvm`` says, once, which characters are letters, so that words are those of its regular expressions."""
        if not _table:
            every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
            is_letter = np.zeros(0x110000, bool)
            is_letter[_characters(jvm.java.util.regex.Pattern.compile(r"\P{L}+").matcher(every).replaceAll(""))] = True
            _table.append(zlib.compress(np.packbits(is_letter).tobytes()))
        return Letters(_table[0], lowered, boost)

    @cached_property
    def is_letter(self) -> np.ndarray:
        return np.unpackbits(np.frombuffer(zlib.decompress(self.packed), np.uint8)).astype(bool)

    def found(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts, and how many each text has. Bytes that are not UTF-8 are no letters."""
        texts = pc.fill_null(texts.cast(pa.binary()), b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset :][: len(texts) + 1]
        data = texts.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if texts.buffers()[2] else b""
        offsets = offsets - offsets[0]
        raw = np.frombuffer(data, np.uint8)
        if not data.isascii():
            try:
                chars = _characters(data.decode())
            except UnicodeDecodeError:
                return self.found(pa.array([t.decode("utf-8", "replace").encode() for t in texts.to_pylist()], pa.binary()))
            letter = np.repeat(self.is_letter[chars], 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000))
        else:
            letter = self.is_letter[raw]
        begins = letter.copy()
        begins[1:] &= ~letter[:-1]
        cuts = offsets[:-1][np.diff(offsets) > 0]
        begins[cuts] = letter[cuts]
        at = np.flatnonzero(begins)
        kept = np.flatnonzero(letter)
        terms = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(np.append(np.searchsorted(kept, at), len(kept)).astype(np.int32)), pa.py_buffer(raw[kept])])
        return terms, np.diff(np.searchsorted(at, offsets))

    def changed(self, terms: pa.Array) -> pa.Array:
        return pa.array([t[:MOST_BYTES].lower() if self.lowered else t[:MOST_BYTES] for t in terms.to_pylist()], pa.string())

    def norms(self, lens: np.ndarray) -> pa.Array:
        x = 1.0 / np.sqrt(np.maximum(lens, 1)) * (self.boost or 0.0)
        code = np.maximum(np.searchsorted(NORM_VALUES, x, "right") - 1, 1)
        return pa.array(np.where(x > 0, np.array(NORM_VALUES)[code], 0.0))


def _characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Tokens:
    """The tokens of some rows, in order of rows and positions: ``code`` (place in ``terms``, which are sorted), ``row``, ``pos``."""

    def __init__(self, rows: pa.RecordBatch, letters: Letters | None = None):
        if letters is None:
            lists = rows["tokens"]
            self.lens = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            terms, pos = lists.flatten().flatten()
            met, self.pos = terms.dictionary_encode(), pos.to_numpy()
            known, at = met.dictionary, met.indices.to_numpy()
        else:
            terms, self.lens = letters.found(rows["text"])
            raw = terms.dictionary_encode()
            met = letters.changed(raw.dictionary).dictionary_encode()
            known, at = met.dictionary, met.indices.to_numpy()[raw.indices.to_numpy()]
            begins = np.cumsum(self.lens) - self.lens
            self.pos = np.arange(len(at)) - np.repeat(begins, self.lens)
        order = pc.sort_indices(known).to_numpy()
        self.terms = known.take(pa.array(order))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.code = rank[at]
        self.row = np.repeat(np.arange(rows.num_rows), self.lens)
        self.size = len(self.code)
        if ((self.pos[1:] < self.pos[:-1]) & (self.row[1:] == self.row[:-1])).any():
            self._take(np.lexsort((self.pos, self.row)))

    def _take(self, at: np.ndarray) -> None:
        self.code, self.row, self.pos = self.code[at], self.row[at], self.pos[at]

    def sort(self, *by: np.ndarray) -> np.ndarray:
        """Sort by keys, the first foremost, and tokens as they are in a key; where each posting, a term in a row, begins."""
        key = np.zeros(self.size, np.int64)
        for k in by:
            key = key * (int(k.max(initial=0)) + 1) + k
        # The place of a token is the last digit of its key, so that plain numbers are sorted.
        self._take(np.sort(key * max(self.size, 1) + np.arange(self.size)) % max(self.size, 1))
        return np.flatnonzero(changes(self.code) | changes(self.row))

    def positions(self, begins: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(_ends(begins, self.size), pa.array(self.pos, pa.int32()))


def changes(xs: np.ndarray) -> np.ndarray:
    """Where an array begins or differs from what is before."""
    out = np.ones(len(xs), bool)
    out[1:] = xs[1:] != xs[:-1]
    return out


def _blocks(rows: pa.RecordBatch, letters: Letters | None = None) -> pa.RecordBatch:
    """``term, df, cf, first, entries, lens``: the postings of each term in blocks of ``BLOCK_DOCS``, and one row without a term for lengths."""
    t = Tokens(rows, letters)
    begins = t.sort(t.code)
    code, doc = t.code[begins], pa.array(t.row[begins])
    runs = np.flatnonzero(changes(code))
    nth = np.arange(len(code)) - np.repeat(runs, np.diff(np.append(runs, len(code))))
    at = np.flatnonzero(nth % BLOCK_DOCS == 0)
    norm = rows["norm"] if letters is None else letters.norms(t.lens)
    entries = pa.StructArray.from_arrays([rows["doc_id"].take(doc), norm.take(doc), t.positions(begins)], ["doc_id", "norm", "positions"])
    has = pa.array(np.flatnonzero(t.lens))
    lens = pa.StructArray.from_arrays([rows["doc_id"].take(has), pa.array(t.lens, pa.int64()).take(has), norm.take(has)], ["doc_id", "len", "norm"])
    none, first = [None], begins[at] if len(at) else begins
    terms = pa.concat_arrays([t.terms.take(pa.array(code[at])), pa.array(none, t.terms.type)])
    df = pa.array([*np.diff(np.append(at, len(code))), None], pa.int64())
    cf = pa.array([*np.diff(np.append(first, t.size)), None], pa.int64())
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, [len(code), len(code)]), pa.int32()), entries)
    of_lens = pa.ListArray.from_arrays(pa.array(np.append(np.zeros(len(at) + 1), len(has)), pa.int32()), lens)
    leads = pa.concat_arrays([rows["doc_id"].take(doc.take(pa.array(at))), pa.array(none, rows["doc_id"].type)])
    return pa.RecordBatch.from_arrays([terms, df, cf, leads, lists, of_lens], ["term", "df", "cf", "first", "entries", "lens"])


def _vectors(rows: pa.RecordBatch, letters: Letters | None = None) -> pa.RecordBatch:
    """``doc_id, terms``: the terms of each row that has some, with their frequencies and positions, in order of terms."""
    t = Tokens(rows, letters)
    begins = t.sort(t.row, t.code)
    has = np.flatnonzero(t.lens)
    many = pa.array(np.diff(np.append(begins, t.size)), pa.int64())
    each = pa.StructArray.from_arrays([t.terms.take(pa.array(t.code[begins])), many, t.positions(begins)], ["term", "freq", "positions"])
    lists = pa.ListArray.from_arrays(_ends(np.searchsorted(t.row[begins], has), len(begins)), each)
    return pa.RecordBatch.from_arrays([rows["doc_id"].take(pa.array(has)), lists], ["doc_id", "terms"])


def mapped(f: Callable[..., pa.RecordBatch], letters: Letters | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: rows have ``doc_id`` and a ``text``, whose words are letters, or ``tokens`` and a ``norm``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                yield f(part, letters)

    return work


def blocks(letters: Letters | None = None):
    return mapped(_blocks, letters)


def vectors(letters: Letters | None = None):
    return mapped(_vectors, letters)
