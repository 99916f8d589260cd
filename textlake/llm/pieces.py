"""SentencePiece encoding and decoding with N-best segmentations.

A text's segmentations are the paths of a lattice whose edges are pieces; a path's score is the sum of its
pieces' scores in the model. Forward Viterbi scores give the best path to every place, so a backward A-star
search that uses them as its heuristic, which is exact, yields paths in order of their scores.

No piece of the vocabulary goes on past the end of a word (that is checked), so the lattice of a text is a
chain of the lattices of its words: ``n`` best segmentations of the text come from the ``n - 1`` words that
lose least by their second best, and only those are searched past their best.

A BPE model's scores are the ranks of its merges, and its encoding is what the merges lead to, which is
mostly not the best path. Ids are therefore the library's own, word by word, as no merge goes on past
the end of a word; the lattice gives the N-best list.
"""

from __future__ import annotations

import heapq
import itertools
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL, NBEST = "piece_bpe_32k.model", 4
SPACE_MARK = "▁"
#: Words that a worker remembers; and bytes of ids of the last one past which it forgets all.
REMEMBERED = 400_000
#: Words that are segmented together, and characters that each may have.
AT_ONCE = 8192, 24
#: A word is a run of space marks and what follows up to the next one or the line's end, or a run of line ends.
WORD = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}\\n]+|{SPACE_MARK}+|\\n+")


INF = float("inf")


class Remembered(dict):
    """Numbers of words, whose best segmentations are worked out when first asked for.

    A last character that no piece joins to the one before it, such as a comma, is segmented on its own.
    """

    def __init__(self, model: Pieces):
        super().__init__()
        self.model, self.spanned = model, {p[i : i + 2] for p in model.scores for i in range(len(p) - 1)}
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.scores, self.gaps, self.begins, self.sizes, self.ids, self.raw = array("d"), array("d"), array("q"), array("q"), array("i"), []
        self.nbest: dict[tuple[str, int], list] = {}

    def full(self) -> bool:
        """Whether to forget before the next text: numbers hold as long as a text is worked on."""
        return len(self) > REMEMBERED or len(self.ids) > 16 * REMEMBERED

    def ids_of(self, number: int) -> array:
        return self.ids[self.begins[number] : self.begins[number] + self.sizes[number]]

    def __missing__(self, word: str) -> int:
        if len(word) > 1 and word[-2:] not in self.spanned:
            head, last = self[word[:-1]], self[word[-1]]
            ids, raw = (self.ids_of(head) + self.ids_of(last)).tobytes(), self.raw[head] + self.raw[last]
            score, gap = self.scores[head] + self.scores[last], min(self.gaps[head], self.gaps[last])
        else:
            found, score, gap = self.model.best_of(word)
            ids = array("i", found).tobytes()
            raw = b"".join([self.model.raw[i] for i in found])
        return self.add(word, ids, raw, score, gap)

    def learn(self, words: Iterable[str]) -> None:
        """Work out words that are not known yet, many at once where they are short and of known characters."""
        spanned, new = self.spanned, set()
        for w in words:
            if w not in self:
                new.add(w[:-1] if len(w) > 1 and w[-2:] not in spanned else w)
        at_once = sorted(w for w in new if w not in self and len(w) <= AT_ONCE[1])
        for k in range(0, len(at_once), AT_ONCE[0]):
            for word, ids, score, gap in self.model.best_of_many(at_once[k : k + AT_ONCE[0]]):
                self.add(word, ids.tobytes(), b"".join([self.model.raw[i] for i in ids.tolist()]), score, gap)

    def add(self, word: str, ids: bytes, raw: bytes, score: float, gap: float) -> int:
        number = self[word] = len(self.raw)
        self.scores.append(score)
        self.gaps.append(gap)
        self.begins.append(len(self.ids))
        self.sizes.append(len(ids) // 4)
        self.ids.frombytes(ids)
        self.raw.append(raw)
        return number


class Merged(dict):
    """Numbers of words (UTF-8, with spaces): the ids that the library's encoder gives them, what those are worth, and the lattice's best score and gap."""

    def __init__(self, model: Pieces):
        super().__init__()
        self.model, self.before = model, len(model.encoder.encode("\n"))
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.begins, self.sizes, self.ids, self.exact = array("q"), array("q"), array("i"), array("b")
        self.worth, self.scores, self.gaps = array("d"), array("d"), array("d")
        self.nbest: dict[tuple[str, int], list] = {}

    def full(self) -> bool:
        return len(self) > REMEMBERED or len(self.ids) > 16 * REMEMBERED or len(self.nbest) > REMEMBERED // 16

    def learn(self, words: Iterable[bytes]) -> None:
        """Encode words that are not known yet. A last character that no piece joins to the one before it is encoded on its own."""
        spanned, ends, new = self.model.best.spanned, {}, set()
        for w in words:
            if w not in self:
                text = w.decode("utf-8")
                if len(text) > 1 and text[-2:].replace(" ", SPACE_MARK) not in spanned:
                    ends[w] = head, last = text[:-1].encode(), text[-1].encode()
                    new.update((head, last))
                else:
                    new.add(w)
        raw, worth, found = self.model.raw, self.model.worth, {}
        new = [w for w in new if w not in self]
        shown = [w.decode("utf-8").replace(" ", SPACE_MARK) for w in new]
        short = [w for w in shown if len(w) <= AT_ONCE[1]]
        for k in range(0, len(short), AT_ONCE[0]):
            found.update((w, (score, gap)) for w, _, score, gap in self.model.best_of_many(short[k : k + AT_ONCE[0]]))
        # Each word after a line end, so that the library puts no mark before it.
        for word, show, ids in zip(new, shown, self.model.encoder.encode([b"\n" + w for w in new], num_threads=1), strict=True):
            ids = ids[self.before :]
            best = found.get(show) or self.model.best_of(show)[1:]
            self.add(word, array("i", ids), sum([worth[i] for i in ids]), b"".join([raw[i] for i in ids]) == word, *best)
        for word, (head, last) in ends.items():
            if word not in self:
                i, j = self[head], self[last]
                self.add(word, self.ids_of(i) + self.ids_of(j), self.worth[i] + self.worth[j], self.exact[i] and self.exact[j], self.scores[i] + self.scores[j], min(self.gaps[i], self.gaps[j]))

    def ids_of(self, number: int) -> array:
        return self.ids[self.begins[number] : self.begins[number] + self.sizes[number]]

    def add(self, word: bytes, ids: array, worth: float, exact: bool, score: float, gap: float) -> None:
        self[word] = len(self.sizes)
        self.begins.append(len(self.ids))
        self.sizes.append(len(ids))
        self.ids.extend(ids)
        self.worth.append(worth)
        self.exact.append(bool(exact))
        self.scores.append(score)
        self.gaps.append(gap)


class Pieces:
    """The vocabulary of a model file, its lattice and its decoder."""

    def __init__(self, path: str):
        import sentencepiece

        model = self.encoder = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        ids = range(len(self.pieces))
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in ids if model.is_byte(i)}
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}|\\n", self.pieces[i]) for i in plain):
            raise ValueError("a piece goes on past the end of a word")
        self.scores = {self.pieces[i]: model.get_score(i) for i in plain}
        self.ids = {self.pieces[i]: i for i in plain}
        self.unknown = min(s for s in self.scores.values() if s > -1e8) - 10.0  # a character that is no piece, as its bytes
        self.longest = max(map(len, self.scores))
        self.trie: dict[str, list] = {}  # a node: character -> [id of the piece that ends here or -1, its score, next node]
        for i in plain:
            node = self.trie
            for c in self.pieces[i]:
                entry = node.setdefault(c, [-1, 0.0, {}])
                node = entry[2]
            entry[:2] = i, model.get_score(i)
        byte_of = {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.raw = [byte_of.get(i, self.pieces[i].replace(SPACE_MARK, " ").encode("utf-8")) for i in ids]
        #: What a piece adds to a score; of a character's bytes the first has the character's.
        self.worth = [(self.unknown if byte_of[i][0] & 0xC0 != 0x80 else 0.0) if i in byte_of else self.scores.get(self.pieces[i], 0.0) for i in ids]
        self.best, self.merged = Remembered(self), Merged(self)

    def forward(self, word: str) -> tuple[list[float], list[list[tuple[int, float]]]]:
        """The best score to each place, and the edges that end there as (begin, score)."""
        n = len(word)
        best, into = [-INF] * (n + 1), [[] for _ in range(n + 1)]
        best[0] = 0.0
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                s = self.scores.get(word[i:j], self.unknown if j == i + 1 else None)
                if s is not None:
                    into[j].append((i, s))
                    best[j] = max(best[j], best[i] + s)
        return best, into

    def nbest(self, word: str, n: int) -> list[tuple[tuple[int, ...], float]]:
        """The ``n`` best segmentations of a word, as ids and score, by A-star from the end.

        Ties go to the path whose last pieces are longer, so reruns agree.
        """
        best, into = self.forward(word)
        turn = itertools.count()
        heap = [(-best[-1], 0, next(turn), len(word), 0.0, ())]
        found: list[tuple[tuple[int, ...], float]] = []
        while heap and len(found) < n:
            _, _, _, at, score, path = heapq.heappop(heap)
            if at == 0:
                cuts = (*path[::-1], len(word)) if path else (0,)
                found.append((tuple(x for a, b in zip(cuts, cuts[1:], strict=False) for x in self.ids_of(word[a:b])), score))
                continue
            for i, s in into[at]:
                heapq.heappush(heap, (-(best[i] + s + score), i, next(turn), i, score + s, (*path, i)))
        return found

    def ids_of(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [i] if i is not None else [self.byte_ids[b] for b in piece.encode("utf-8")]

    def best_of(self, word: str) -> tuple[tuple[int, ...], float, float]:
        """Ids and score of the best segmentation of a word, and what its second best loses (inf: there is none)."""
        n, trie, unknown, low = len(word), self.trie, self.unknown, -INF
        first, again, back = [low] * (n + 1), [low] * (n + 1), [0] * (n + 1)
        used = [-1] * (n + 1)
        first[0] = 0.0
        for i in range(n):
            f, g, node, j = first[i], again[i], trie, i
            for c in word[i : i + self.longest]:
                j += 1
                entry = node.get(c)
                if entry is None:
                    if j == i + 1:  # a character that is no piece
                        entry = [-1, unknown, {}]
                    else:
                        break
                piece, s, node = entry
                if piece < 0:
                    if j > i + 1:
                        continue
                    s = unknown
                x = f + s
                if x > first[j]:
                    y = g + s
                    again[j] = first[j] if first[j] > y else y
                    first[j], back[j], used[j] = x, i, piece
                elif x > again[j]:
                    again[j] = x
                if not node:
                    break
        found, at = [], n
        while at:
            i = back[at]
            found.append((used[at],) if used[at] >= 0 else self.ids_of(word[i:at]))
            at = i
        return tuple(x for ids in reversed(found) for x in ids), first[n], first[n] - again[n]

    def _compile(self) -> None:
        """The trie as arrays: a table of moves, by hashes of node and character, and for each node its piece and score."""
        self.letters = {c: k + 1 for k, c in enumerate(sorted({c for p in self.scores for c in p}))}
        moves, ids, scores, queue = [], [-1], [-INF], [(self.trie, 0)]
        for node, number in queue:
            for c, (piece, score, below) in node.items():
                moves.append((number * (len(self.letters) + 1) + self.letters[c], len(ids)))
                queue.append((below, len(ids)))
                ids.append(piece)
                scores.append(score if piece >= 0 else -INF)
        self.node_ids, self.node_scores = np.array(ids, np.int32), np.array(scores)
        keys, to = np.array(moves, np.int64).T
        size = 4 << len(keys).bit_length()
        self.move_keys, self.move_to, self.probes, slot = np.full(size, -1, np.int64), np.zeros(size, np.int32), 0, self._slots(keys, size)
        while len(keys):  # linear probing, a step for all keys at a time
            self.probes += 1
            free = self.move_keys[slot] < 0
            self.move_keys[slot[free]] = keys[free]
            won = free & (self.move_keys[slot] == keys)
            self.move_to[slot[won]] = to[won]
            keys, to, slot = keys[~won], to[~won], (slot[~won] + 1) & (size - 1)
        table = np.zeros(0x110000, np.int64)
        table[[ord(c) for c in self.letters]] = list(self.letters.values())
        self.letter_of = table

    @staticmethod
    def _slots(keys: np.ndarray, size: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (size - 1)

    def _moved(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The nodes that follow, 0 where none does."""
        keys = nodes * (len(self.letters) + 1) + letters
        slot = self._slots(keys, len(self.move_keys))
        out = np.where(self.move_keys[slot] == keys, self.move_to[slot], 0)
        open_ = np.flatnonzero((out == 0) & (self.move_keys[slot] >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.move_keys) - 1)
            met = self.move_keys[slot[open_]]
            hit = met == keys[open_]
            out[open_[hit]] = self.move_to[slot[open_[hit]]]
            open_ = open_[~hit & (met >= 0)]
        return out

    def best_of_many(self, words: list[str]) -> Iterator[tuple[str, np.ndarray, float, float]]:
        """``best_of`` for many words at once (ids as 32-bit numbers), leaving out those with a character that is no piece."""
        if not hasattr(self, "letter_of"):
            self._compile()
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        m, longest = len(words), int(sizes.max(initial=0))
        flat = self.letter_of[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        letters = np.zeros((longest + 1, m), np.int64)  # place by word, so that a step reads one row
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        letters[place, np.repeat(np.arange(m), sizes)] = flat
        first, again = np.full((longest + 1, m), -INF), np.full((longest + 1, m), -INF)
        back, used = np.zeros((longest + 1, m), np.int64), np.full((longest + 1, m), -1, np.int32)
        first[0] = 0.0
        for i in range(longest):
            live, nodes = np.flatnonzero((sizes > i) & (first[i] > -INF)), 0
            for j in range(i + 1, min(longest, i + self.longest) + 1):
                nodes = self._moved(nodes if j > i + 1 else np.zeros(len(live), np.int64), letters[j - 1, live])
                on = nodes > 0
                live, nodes = live[on], nodes[on].astype(np.int64)
                if not len(live):
                    break
                ends = self.node_ids[nodes] >= 0
                w, node = live[ends], nodes[ends]
                s = self.node_scores[node]
                x, y, was = first[i, w] + s, again[i, w] + s, first[j, w]
                better = x > was
                again[j, w] = np.where(better, np.maximum(was, y), np.maximum(again[j, w], x))
                w, node, x = w[better], node[better], x[better]
                first[j, w], back[j, w], used[j, w] = x, i, self.node_ids[node]
        at, column = sizes.copy(), np.arange(m)
        good = first[at, column] > -INF
        scores, gaps = first[at, column], first[at, column] - np.where(good, again[at, column], 0)
        path = []
        while at.any():
            path.append(np.where((at > 0) & good, used[at, column], -1))
            at = np.where(good, back[at, column], 0)
        steps = np.array(path[::-1], np.int32).reshape(len(path), m).T
        for k in np.flatnonzero(good).tolist():
            yield words[k], steps[k][steps[k] >= 0], float(scores[k]), float(gaps[k])

    def normalise(self, text: str) -> str:
        """Spaces as marks, with one put before the text; an empty text stays empty."""
        return SPACE_MARK + text.replace(" ", SPACE_MARK) if text else ""

    def _known(self, text: str) -> tuple[list[str], np.ndarray]:
        """The words of a text and their numbers."""
        if self.best.full():
            self.best.forget()
        words = WORD.findall(self.normalise(text))
        return words, np.fromiter(map(self.best.__getitem__, words), np.int64, len(words))

    def encode(self, text: str) -> list[int]:
        """The ids of the best segmentation."""
        _, known = self._known(text)
        return self._gathered(known)[0].tolist()

    def _gathered(self, known: np.ndarray, of: Remembered | Merged | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered words end to end, and how many each has."""
        of = self.best if of is None else of
        sizes = np.frombuffer(of.sizes, np.int64)[known]
        moved = np.repeat(np.frombuffer(of.begins, np.int64)[known] - (np.cumsum(sizes) - sizes), sizes)
        return np.frombuffer(of.ids, np.int32)[moved + np.arange(len(moved))], sizes

    def _ways(self, words: list[str] | _Picked, known: np.ndarray, n: int, of: Remembered | Merged | None = None) -> tuple[float, list[tuple[float, dict[int, tuple[int, ...]]]]]:
        """The best score, and of the ``n`` best segmentations what each loses to it and its ids where they differ, by word."""
        if not len(known):
            return 0.0, [(0.0, {})]
        of = self.best if of is None else of
        scores, gaps = np.frombuffer(of.scores)[known], np.frombuffer(of.gaps)[known]
        most = min(n - 1, len(gaps))
        limit = np.partition(gaps, most - 1)[most - 1] if most else -INF
        weak = sorted((g, i) for i, g in ((i, gaps[i]) for i in np.flatnonzero((gaps <= limit) & (gaps < INF)).tolist()))[:most]
        ways: list[tuple[float, dict[int, tuple[int, ...]]]] = [(0.0, {})]
        for _, i in weak:
            key = (words[i], n)
            if key not in of.nbest:
                of.nbest[key] = self.nbest(*key)
            lost = [(float(scores[i]) - s, ids) for ids, s in of.nbest[key]]
            ways = heapq.nsmallest(n, ((w + d, {**c, i: ids} if k else c) for w, c in ways for k, (d, ids) in enumerate(lost)), key=lambda x: x[0])
        return float(scores.sum()), ways

    def encode_nbest(self, text: str, n: int = NBEST) -> list[tuple[list[int], float]]:
        """The ``n`` best segmentations of a text as ids and scores, best first; fewer if there are fewer."""
        words, known = self._known(text)
        total, ways = self._ways(words, known, n)
        best = [self.best.ids_of(k).tolist() for k in known.tolist()]
        return [([x for i, k in enumerate(best) for x in changed.get(i, k)], total - w) for w, changed in ways]

    def encode_many(self, texts: list[bytes], n: int = NBEST) -> tuple[np.ndarray, np.ndarray, list[list[float]], list[bool]]:
        """Ids of the best segmentations of UTF-8 texts end to end and their ends; the scores of the ``n`` best; whether the ids decode to the text."""
        split = _Split(texts)
        if not split.words:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64), [[0.0] for _ in texts], [True for _ in texts]
        if self.best.full():
            self.best.forget()
        words = [w.decode("utf-8").replace(" ", SPACE_MARK) for w in split.words]
        self.best.learn(words)
        numbers = np.fromiter(map(self.best.__getitem__, words), np.int64, len(words))
        exact = np.fromiter((self.best.raw[k] == w for k, w in zip(numbers.tolist(), split.words, strict=True)), bool, len(words))
        ids, ends, trips = self._joined(split, numbers, exact, self.best)
        return ids, ends, self._scores(split, words, numbers, n, self.best), trips

    def merge_many(self, texts: list[bytes], n: int = NBEST) -> tuple[np.ndarray, np.ndarray, list[float], list[list[float]], list[bool]]:
        """The library's ids of UTF-8 texts end to end, their ends and scores; the scores of the ``n`` best segmentations; whether the ids decode to the text."""
        split, merged = _Split(texts), self.merged
        if not split.words:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64), [0.0] * len(texts), [[0.0] for _ in texts], [True] * len(texts)
        if merged.full():
            merged.forget()
        merged.learn(split.words)
        numbers = np.fromiter(map(merged.__getitem__, split.words), np.int64, len(split.words))
        ids, ends, trips = self._joined(split, numbers, np.frombuffer(merged.exact, bool)[numbers], merged)
        worth = np.frombuffer(merged.worth)[numbers][split.index]
        own = [float(worth[i:j].sum()) for i, j in split.spans]
        return ids, ends, own, self._scores(split, split.words, numbers, n, merged), trips

    def _joined(self, split: _Split, numbers: np.ndarray, exact: np.ndarray, of: Remembered | Merged) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        ids, sizes = self._gathered(numbers[split.index], of)
        upto, good = np.concatenate([[0], np.cumsum(sizes)]), exact[split.index]
        trips = [bool(good[i:j].all()) or self.decode(ids[upto[i] : upto[j]].tolist()) == body[1:].decode("utf-8") for (i, j), body in zip(split.spans, split.bodies, strict=True)]
        return ids, upto[[j for _, j in split.spans]], trips

    def _scores(self, split: _Split, words: list[str] | list[bytes], numbers: np.ndarray, n: int, of: Remembered | Merged) -> list[list[float]]:
        known, out = numbers[split.index], []
        for i, j in split.spans:
            total, ways = self._ways(_Picked(words, split.index[i:j]), known[i:j], n, of)
            out.append([total - w for w, _ in ways])
        return out

    @staticmethod
    def _shown(raw: bytes) -> str:
        text = raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, runs of bytes read as UTF-8, marks as spaces, without the first one."""
        raw = self.raw
        return self._shown(b"".join([raw[i] for i in ids]))


class _Split:
    """UTF-8 texts with a space before each (``bodies``), their distinct ``words``, the ``index`` of each word there, and the words' ``spans`` by text.

    Words are found on bytes, and each distinct one is looked up once.
    """

    def __init__(self, texts: list[bytes]):
        import pyarrow as pa

        self.bodies = [b" " + t.replace(SPACE_MARK.encode(), b" ") if t else b"" for t in texts]
        data = b"".join(self.bodies)
        ends = np.cumsum([len(b) for b in self.bodies], dtype=np.int64)
        letters = np.frombuffer(data, np.uint8)
        space, line = letters == 32, letters == 10
        first = np.empty(len(letters), bool)
        first[1:] = (space[1:] & ~space[:-1]) | (line[1:] != line[:-1])
        starts = np.concatenate([np.zeros(1, np.int64), ends])
        first[starts[starts < len(letters)]] = True
        at = np.flatnonzero(first)
        cuts = pa.py_buffer(np.append(at, len(letters)).astype(np.int64).tobytes())
        encoded = pa.Array.from_buffers(pa.large_binary(), len(at), [None, cuts, pa.py_buffer(data)]).dictionary_encode()
        self.words, self.index = encoded.dictionary.to_pylist(), encoded.indices.to_numpy()
        bounds = np.searchsorted(at, starts).tolist()
        self.spans = list(zip(bounds[:-1], bounds[1:], strict=True))


class _Picked:
    """The words of a text, by their places in a list of distinct ones."""

    def __init__(self, words: list[str] | list[bytes], index: np.ndarray):
        self.words, self.index = words, index

    def __getitem__(self, i: int) -> str:
        w = self.words[self.index[i]]
        return w if isinstance(w, str) else w.decode("utf-8").replace(" ", SPACE_MARK)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", nbest: int = NBEST) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, ids, score, nbest_scores, round_trip``.

    ``ids`` are those of the library's encoder and ``score`` is the sum of their scores; ``nbest_scores`` the scores of the ``nbest`` best ones of the
    whole text; ``round_trip`` says whether the ids decode to the text (a mark that the text itself holds
    decodes to a space, and then counts as one). A null text is empty, and an empty text has no ids, score 0
    and one segmentation. Very long texts are encoded whole. Repeated rows are encoded alike; a null doc_id is carried along; an empty table
    gives an empty result; other columns play no part.
    """
    import pyarrow as pa

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for at in range(0, len(batch), 256):  # ids of a few hundred texts at a time
                part = batch.slice(at, 256)
                flat, ends, own, found, trips = model.merge_many(part.column("text").cast(pa.binary()).to_pylist(), nbest)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
                scores = pa.array([[round(s, 6) for s in f] for f in found], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array([round(x, 6) for x in own]), scores, pa.array(trips)], ["doc_id", "ids", "score", "nbest_scores", "round_trip"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, ids array<int>, score double, nbest_scores array<double>, round_trip boolean")


def decode_documents(encoded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, text`` from rows of ids; null ids decode to an empty text."""
    import pyarrow as pa

    rows = encoded.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([model.decode(x) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
