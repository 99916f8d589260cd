"""Token counts by compiled finite-state tokenizers.

Byte-level BPE is run as two deterministic transducers. The first reads character classes and marks where
pre-tokens begin; its transitions carry the marks, of which one may lie a character back. Texts are laid
end to end and cut into chunks; each chunk's map from entry state to exit state is found for all chunks
and states at once, the maps compose by a parallel prefix scan, and a second pass with known entry states
reads off the marks. The second transducer reads the bytes of every pre-token, whatever its length: a transition carries the
change in the number of tokens that the byte makes. Its states are made deterministic as they are met: a state is what the future can
depend on, the ends of the text so far that begin some token, each with the last token before it and the tokens
after it. Prefixes that agree in these are one state, and a transition is compiled once. Pre-tokens seen
lately are kept with their counts, up to a bound on their number.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL, LIMIT = "byte_bpe_50k.json", 512
#: Characters in a chunk, characters worked on at once, and pre-tokens remembered.
CHUNK, BLOCK, REMEMBERED = 1024, 1 << 21, 800_000
#: States that a machine keeps before it begins anew; the rank of no merge.
MOST_STATES, NEVER = 300_000, 1 << 60
SEAM = "\ud800"  # stands between texts; no text can hold it

LETTER, NUMBER, BLANK, WHITE, QUOTE, OTHER, END = range(7)
MARKED = "strevmld"  # letters that can follow an apostrophe in a suffix; classes 7 and up
START, LETTERS, NUMBERS, OTHERS, APOS, APOS_R, APOS_V, APOS_L, SUFFIX, ONE_BLANK, ONE_WHITE, BLANKS, WHITES = range(13)
HERE, BACK = 1, 2  # marks: a pre-token begins at this character, one began at the character before


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = LETTER if kind == "L" else NUMBER
    for c in (9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[c] = WHITE
    table[ord(" ")], table[ord("'")], table[ord(SEAM)] = BLANK, QUOTE, END
    for i, c in enumerate(MARKED):
        table[ord(c)] = 7 + i
    return table


@lru_cache(maxsize=1)
def pretoken_machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks for ``class * states + state``, of the pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``."""
    letter = lambda c: c == LETTER or c >= 7
    starts = lambda c: LETTERS if letter(c) else {NUMBER: NUMBERS, BLANK: ONE_BLANK, WHITE: ONE_WHITE, QUOTE: APOS, OTHER: OTHERS, END: START}[c]
    white = lambda c: c in (BLANK, WHITE)
    after_blank = lambda c: LETTERS if letter(c) else NUMBERS if c == NUMBER else OTHERS

    def step(q: int, c: int) -> tuple[int, int]:
        name = MARKED[c - 7] if c >= 7 else ""
        if q in (APOS_R, APOS_V, APOS_L) and c != END:
            if name == {APOS_R: "e", APOS_V: "e", APOS_L: "l"}[q]:
                return SUFFIX, 0
            return (LETTERS, BACK) if letter(c) else (starts(c), BACK | HERE)
        if c == END:
            return START, HERE | (BACK if q in (APOS_R, APOS_V, APOS_L) else 0)
        if q == LETTERS and letter(c) or q == NUMBERS and c == NUMBER or q == OTHERS and c in (OTHER, QUOTE):
            return q, 0
        if q == APOS:
            if name and name in "stmd":
                return SUFFIX, 0
            if name and name in "rvl":
                return {"r": APOS_R, "v": APOS_V, "l": APOS_L}[name], 0
            if c in (OTHER, QUOTE):
                return OTHERS, 0
        if q in (ONE_BLANK, ONE_WHITE, BLANKS, WHITES) and white(c):
            return (BLANKS if c == BLANK else WHITES), 0
        if q == ONE_BLANK:
            return after_blank(c), 0
        if q == BLANKS:
            return after_blank(c), BACK
        if q == WHITES:
            return starts(c), BACK | HERE
        return starts(c), HERE

    moves = [step(q, c) for c in range(7 + len(MARKED)) for q in range(13)]
    return np.array([m[0] for m in moves], np.uint8), np.array([m[1] for m in moves], np.uint8)


def chunk_entries(classes: np.ndarray, entry: int = START) -> np.ndarray:
    """The entry state of each chunk (row of ``classes``), by a prefix scan over the chunks' state maps."""
    go, _ = pretoken_machine()
    n, states = len(classes), 13
    maps = np.tile(np.arange(states, dtype=np.intp), (n, 1))
    rows = classes.astype(np.intp) * states
    for j in range(classes.shape[1]):
        maps = go[maps + rows[:, j, None]].astype(np.intp)
    d = 1
    while d < n:  # after a round, row i maps the entry of chunk i - 2d + 1 to the exit of chunk i
        maps[d:] = np.take_along_axis(maps[d:], maps[:-d].copy(), 1)
        d *= 2
    return np.concatenate([[entry], maps[:-1, entry]]).astype(np.intp)


def pretoken_starts(codes: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin; a seam is a pre-token of its own."""
    go, marks = pretoken_machine()
    n = len(codes)
    padded = np.full(-(-n // CHUNK) * CHUNK, END, np.uint8)
    padded[:n] = char_classes()[codes]
    classes = padded.reshape(-1, CHUNK)
    state, rows = chunk_entries(classes), classes.T.astype(np.intp) * 13
    out = np.empty(classes.T.shape, np.uint8)
    for j in range(CHUNK):
        at = rows[j] + state
        out[j] = marks[at]
        state = go[at].astype(np.intp)
    flat = out.T.reshape(-1)[:n]
    here = (flat & HERE).astype(bool)
    here[: n - 1] |= (flat[1:] & BACK).astype(bool)
    here[:1] = True
    return np.flatnonzero(here)


class ByteMachine:
    """The transducer over the bytes of a pre-token, compiled as it is used.

    ``go`` maps ``state * 256 + byte`` to ``next state * 1024 + 512 + change in the number of tokens``.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        raw = lambda s: bytes(byte_of[c] for c in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if all(c in byte_of for c in t)}
        self.rank = {(vocab[raw(a)], vocab[raw(b)]): i for i, (a, b) in enumerate(pairs)}
        self.made = [vocab[raw(a + b)] for a, b in pairs]
        self.byte_ids = [vocab[bytes([b])] for b in range(256)]
        self.tokens = vocab
        if max(map(len, vocab)) > 500:
            raise ValueError("changes of the number of tokens have ten bits")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.begun = {t[:n] for t in vocab for n in range(len(t))}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self._start()

    def _start(self) -> None:
        """The state before any byte: the empty end, after no token."""
        first = ((b"", b"", 0),)
        self.states, self.ends, self.go = {first: 0}, [first], {}

    def compile(self, state: int, byte: int) -> int:
        """The transition from ``state``. One token can end the longer text: that which may follow the last token before it."""
        ends = [(end + bytes([byte]), last, after) for end, last, after in self.ends[state]]
        for end, last, after in ends:
            if end in self.tokens and self.follows(last, end):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        change = 1 - after  # ``after`` tokens follow the place where this one begins
        kept = (*[(e, t, n + change) for e, t, n in ends if e in self.begun], (b"", end, 0))
        found = self.states.setdefault(kept, len(self.ends))
        if found == len(self.ends):
            self.ends.append(kept)
        move = self.go[state << 8 | byte] = found << 10 | (change + 512)
        return move

    def merged(self, word: bytes) -> list[int]:
        """The ids of a string's tokens, by merging the leftmost pair of lowest rank again and again."""
        rank, made = self.rank.get, self.made
        ids = [self.byte_ids[b] for b in word]
        ranks = [rank(p, NEVER) for p in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), NEVER)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), NEVER)
        return ids

    def follows(self, a: bytes, b: bytes) -> bool:
        """Whether token ``b`` can come after ``a``: the pair of them stays as it is."""
        key = (a, b)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > REMEMBERED:
                self.fits.clear()
            known = self.fits[key] = len(self.merged(a + b)) == (2 if a else 1) and self.merged(a + b)[-1] == self.tokens[b]
        return known

    def count(self, word: bytes) -> int:
        """Tokens of ``word``: the sum of its transitions."""
        if len(self.ends) > MOST_STATES:
            self._start()
        go, state, n = self.go.get, 0, 0
        for byte in word:
            move = go(state << 8 | byte)
            if move is None:
                move = self.compile(state, byte)
            state = move >> 10
            n += (move & 1023) - 512
        return n


class Remembered(dict):
    """Counts of pre-tokens, worked out when first asked for."""

    def __init__(self, machine: ByteMachine):
        super().__init__({SEAM: 0})
        self.machine = machine

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
            self[SEAM] = 0
        n = self.machine.count(word.encode("utf-8"))
        if len(word) <= 64:
            self[word] = n
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> Remembered:
    return Remembered(ByteMachine(path))


def parts_of(text: str) -> list[str]:
    """``text`` in parts of about a block, cut only before a blank that follows no white space: a pre-token begins there."""
    out, at = [], 0
    while len(text) - at > BLOCK:
        cut_at = text.rfind(" ", at + 1, at + BLOCK)
        while cut_at > at and text[cut_at - 1].isspace():
            cut_at = text.rfind(" ", at + 1, cut_at)
        if cut_at <= at:
            break
        out.append(text[at:cut_at])
        at = cut_at
    return [*out, text[at:]]


def count_tokens(texts: list[str | None], path: str) -> list[int]:
    """The number of tokens of each text."""
    memo = counter(path)
    totals = np.zeros(len(texts), np.int64)
    queue: list[tuple[int, str]] = []

    def work() -> None:
        if not queue:
            return
        whole = SEAM.join([*(t for _, t in queue), ""])
        starts = pretoken_starts(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32))
        cuts = [*starts.tolist(), len(whole)]
        counts = np.fromiter(map(memo.__getitem__, [whole[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]), np.int64, len(starts))
        ends = np.cumsum([len(t) + 1 for _, t in queue])
        sums = np.concatenate([[0], np.cumsum(counts)])
        np.add.at(totals, [i for i, _ in queue], np.diff(np.concatenate([[0], sums[np.searchsorted(starts, ends)]])))
        queue.clear()

    held = 0
    for i, text in enumerate(texts):
        pieces = [text or ""]
        for special in memo.machine.special:  # the library takes their strings for one token each
            pieces = [x for p in pieces for x in p.split(special)]
        totals[i] += len(pieces) - 1
        for piece in pieces:
            for part in parts_of(piece):
                queue.append((i, part))
                held += len(part) + 1
                if held >= BLOCK:
                    work()
                    held = 0
    work()
    return totals.tolist()


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``path`` names the tokenizer's file on every machine. A null text is empty and has no tokens; an empty
    table gives an empty result; repeated rows are counted alike; a null doc_id is carried along. Strings of
    special tokens count as one token. Long texts are worked on in parts. Other columns play no part.
    """
    import pyarrow as pa

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            n_bytes = pa.compute.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, pa.array(count_tokens(texts.to_pylist(), path), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
