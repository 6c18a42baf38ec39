"""N-best segmentation into SentencePiece pieces, and decoding.

The piece lattice of a text has an edge for each piece of the vocabulary that occurs in it (blanks written as U+2581,
one put in front); a character that is no piece gets an edge of its own at ``least score - 10`` and is spelled in byte
pieces. Scores are those of the model file (pieces that it marks as never merged count as the lowest rank). The score
of a segmentation is the sum over its edges.

The forward Viterbi scores of all positions are exact, so the backward A-star search from the end, ordered by what is
lost against the best, gives complete segmentations in order of score. Along the best pieces nothing more is lost, so
each step of the search runs on to the beginning of the word, and of all branches on the way only as many are held as
segmentations are still wanted: time and memory follow the length of a word, however many segmentations tie. No piece
spans two words, so the lattice of a text is a chain of word lattices; words of more than ``LONG`` characters (texts
without blanks) are cut further between any two characters that stand together in no piece. Viterbi runs once for each
distinct word of a worker, for all new words of a chunk together in numpy (words still over ``WIDE`` one by one), and
gives the gap between its best and second-best segmentation. The N best of a text can only differ from its best in the
N - 1 words of smallest gap; A-star runs on those words and a sort merges their alternatives.

Ties: the shorter last piece is taken in the best segmentation, and the best comes first. Null text gives null ids and zero pieces; empty text
gives an empty list. ``decode`` gives back the text byte for byte (except that U+2581 in a text becomes a blank).
Rows are kept one for one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, chunks
from .token_counts import MARK, model, pre_tokens

NEVER, UNKNOWN = -1e8, 10.0
MULT, SPREAD = U(0x9DDFEA08EB382D69), U(0xC4CEB9FE1A85EC53)
#: Characters from which a word is cut where no piece crosses, and from which Viterbi runs on it alone.
LONG, WIDE = 24, 256
#: Stands before a part of a word that is not its beginning; no text in UTF-8 has it.
INNER = "\ud800"


def written(word: str) -> str:
    """A word, or a later part of one, as the pieces spell it."""
    return (word[1:] if word[:1] == INNER else MARK + word).replace(" ", MARK)


class Lattice:
    """The vocabulary of a model as a hash table of pieces, and the best segmentations of words seen so far."""

    def __init__(self, path: str, limit: int = 300_000, room: int = 6_000_000):
        sp = model(path)
        every = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in every}
        score = {i: sp.get_score(i) for i in every}
        low = min((s for s in score.values() if s > NEVER), default=0.0)
        self.score = {i: s if s > NEVER else low for i, s in score.items()}
        self.unknown = low - UNKNOWN
        self.byte = {b: sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.low_bytes = np.array([self.byte[b] for b in range(128)], np.int32)
        self.name = {i: p for p, i in self.ids.items()}
        self.back = {i: b for b, i in self.byte.items()}
        self.longest = max(map(len, self.ids))
        pieces = list(self.ids)
        self.pairs = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        keys = self.keys(pieces)
        bits = 20
        while True:  # slots for open addressing are not needed if a table this sparse has no more than four in a slot
            slot = (keys * SPREAD >> U(64 - bits)).astype(np.int64)
            rank = np.zeros(len(keys), np.int64)
            order = np.argsort(slot, kind="stable")
            s = slot[order]
            first = np.r_[0, np.flatnonzero(s[1:] != s[:-1]) + 1]
            rank[order] = np.arange(len(s)) - np.repeat(first, np.diff(np.r_[first, len(s)]))
            if rank.max() < 4:
                break
            bits += 1
        self.bits, self.ways = bits, int(rank.max()) + 1
        self.slots = np.zeros((self.ways, 1 << bits), np.uint64)
        self.slot_id = np.zeros((self.ways, 1 << bits), np.int32)
        self.slots[rank, slot] = keys
        self.slot_id[rank, slot] = [self.ids[p] for p in pieces]
        self.taken = np.zeros(1 << bits, bool)
        self.taken[slot] = True
        self.scores = np.full(sp.get_piece_size(), self.unknown)
        for i, s in self.score.items():
            self.scores[i] = s
        spelled = [bytes([self.back[i]]) if i in self.back else self.name.get(i, "").replace(MARK, " ").encode() for i in range(sp.get_piece_size())]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_n = np.array(list(map(len, spelled)), np.int64)
        self.spelled_at = np.cumsum(self.spelled_n) - self.spelled_n
        self.limit, self.room = limit, room  # words and characters that the cache holds
        self.forget()

    def forget(self) -> None:
        """Empties the cache: words by number, and what is known of each number."""
        self.number: dict[str, int] = {}
        self.few: dict[tuple[int, int], list] = {}
        self.characters = self.few_ids = 0
        self.total, self.gap = np.zeros(0), np.zeros(0)
        self.many, self.at, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    @staticmethod
    def keys(words: list[str]) -> np.ndarray:
        out = np.zeros(len(words), np.uint64)
        for k, p in enumerate(words):
            h = 0
            for c in p:
                h = (h * int(MULT) + ord(c) + 1) & (2**64 - 1)
            out[k] = h
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ids of pieces by key; 0 for none. Most keys end at a small table of the slots that are taken."""
        flat, out = keys.ravel(), np.zeros(keys.size, np.int32)
        slot = (flat * SPREAD >> U(64 - self.bits)).astype(np.int64)
        hit = np.flatnonzero(self.taken[slot])
        slot, flat, ids = slot[hit], flat[hit], np.zeros(len(hit), np.int32)
        for way in range(self.ways):
            np.copyto(ids, self.slot_id[way][slot], where=self.slots[way][slot] == flat)
        out[hit] = ids
        return out.reshape(keys.shape)

    def learn(self, words: list[str]) -> None:
        """Viterbi for new words, all words of a length at once: score, gap to the second best, ids."""
        by: dict[int, list[str]] = {}
        for w in words:
            by.setdefault(len(w) - 1 if w[:1] == INNER else len(w) + 1, []).append(w)
        got = []
        for n, group in by.items():
            self.characters += n * len(group)
            step = 1 + 200_000 // n if n <= WIDE else 1
            for at in range(0, len(group), step):
                part = group[at : at + step]
                self.number.update(zip(part, range(len(self.number), len(self.number) + len(part)), strict=True))
                got.append(self.viterbi(list(map(written, part)), n) if n <= WIDE else self.alone(written(part[0])))
        total, gap, many, flat = (np.concatenate(x) for x in zip(*got, strict=True))
        self.total, self.gap, self.many, self.flat = np.r_[self.total, total], np.r_[self.gap, gap], np.r_[self.many, many], np.r_[self.flat, flat]
        self.at = np.cumsum(self.many) - self.many

    def viterbi(self, words: list[str], n: int) -> tuple[np.ndarray, ...]:
        m = len(words)
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(m, n).T.astype(np.uint64) + U(1)
        alpha, second = np.full((n + 1, m), -np.inf), np.full((n + 1, m), np.inf)
        alpha[0] = 0.0
        last, piece = np.zeros((n + 1, m), np.int32), np.zeros((n + 1, m), np.int32)
        keys, every = np.zeros((0, m), np.uint64), np.arange(m)
        for v in range(1, n + 1):
            k = min(v, self.longest)
            grown = np.empty((k, m), np.uint64)  # keys of the last 1, 2, ... characters
            grown[0] = code[v - 1]
            np.multiply(keys[: k - 1], MULT, out=grown[1:])
            grown[1:] += code[v - 1]
            keys, ids = grown, self.find(grown)
            s = self.scores[ids]
            s += alpha[v - k : v][::-1]
            s[1:][ids[1:] == 0] = -np.inf
            size = s.argmax(0)  # of equal ones the shortest
            alpha[v] = s[size, every]
            s[size, every] = -np.inf
            second[v] = alpha[v] - s.max(0)
            last[v], piece[v] = size + 1, ids[size, every]
        gap, place = np.full(m, np.inf), np.full(m, n)
        rows = np.arange(m)
        out = []
        while (place > 0).any():
            on = place > 0
            gap = np.where(on, np.minimum(gap, second[place, rows]), gap)
            out.append((piece[place, rows], place.copy(), on))
            place = np.where(on, place - last[place, rows], place)
        ids = np.stack([o[0] for o in out[::-1]], 1) if out else np.zeros((m, 0), np.int32)
        ons = np.stack([o[2] for o in out[::-1]], 1) if out else np.zeros((m, 0), bool)
        ends = np.stack([o[1] for o in out[::-1]], 1) if out else None
        if (ids == 0).any():  # characters of one byte
            code = np.where(ons, code.T[np.arange(m)[:, None], np.maximum(ends - 1, 0)].astype(np.int64) - 1, 0)
            ids = np.where(ons & (ids == 0) & (code < 128), self.low_bytes[np.minimum(code, 127)], ids)
        counts, flat = ons.sum(1), ids[ons]
        odd = np.flatnonzero((ons & (ids == 0)).any(1))
        if len(odd):
            at = np.cumsum(counts) - counts
            parts = np.split(flat, at[1:])
            for k in odd:
                own = zip(parts[k], ends[k][ons[k]], strict=True)
                parts[k] = np.array([x for i, e in own for x in ([i] if i else map(self.byte.__getitem__, words[k][e - 1].encode()))], np.int32)
            counts, flat = np.array(list(map(len, parts))), np.concatenate(parts)
        return alpha[n], gap, counts, flat

    def edges(self, word: str, v: int) -> list[tuple[int, int, float]]:
        """Pieces that end at v: start, id (0: unknown character), score; shortest first."""
        out = []
        for u in range(v - 1, max(-1, v - 1 - self.longest), -1):
            i = self.ids.get(word[u:v], 0)
            if i or u == v - 1:
                out.append((u, i, self.score[i] if i else self.unknown))
        return out

    def forward(self, word: str) -> tuple[list[float], list[float], list[int], list[int]]:
        """Viterbi for one word: best score up to each position, its lead over the runner-up, length and id of its last piece."""
        alpha, lead, size, piece = [0.0], [np.inf], [0], [0]
        for v in range(1, len(word) + 1):
            top = runner = -np.inf
            for u, i, s in self.edges(word, v):
                s += alpha[u]
                if s > top:
                    top, runner, at, found = s, top, u, i
                elif s > runner:
                    runner = s
            alpha.append(top)
            lead.append(top - runner)
            size.append(v - at)
            piece.append(found)
        return alpha, lead, size, piece

    def own_ids(self, word: str, u: int, v: int, i: int) -> tuple[int, ...]:
        return (i,) if i else tuple(self.byte[b] for b in word[u:v].encode())

    def alone(self, word: str) -> tuple[np.ndarray, ...]:
        """What ``viterbi`` gives, for one long word."""
        alpha, lead, size, piece = self.forward(word)
        v, gap, parts = len(word), np.inf, []
        while v:
            gap = min(gap, lead[v])
            parts.append(self.own_ids(word, v - size[v], v, piece[v]))
            v -= size[v]
        ids = np.array([i for p in parts[::-1] for i in p], np.int32)
        return np.array([alpha[-1]]), np.array([gap]), np.array([len(ids)]), ids

    def search(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a word: backward A-star with the forward Viterbi scores as exact heuristics."""
        alpha, _, size, _ = self.forward(word)
        agenda, found, k = [(0.0, 0, len(word), 0.0, None)], [], 1  # lost, order, position, score behind, (piece, parent)
        while agenda and len(found) < n:
            lost, _, v, behind, chain = agenda.pop(0)
            while v:
                for u, i, s in self.edges(word, v):
                    if v - u == size[v]:
                        onward = u, behind + s, ((u, v, i), chain)
                        continue
                    entry = (lost + alpha[v] - (alpha[u] + s), k, u, behind + s, ((u, v, i), chain))
                    k += 1
                    if len(agenda) < n - len(found) - 1 or agenda and entry < agenda[-1]:
                        bisect.insort(agenda, entry)
                        del agenda[n - len(found) - 1 :]
                v, behind, chain = onward
            ids = []
            while chain:
                (u, v, i), chain = chain
                ids += self.own_ids(word, u, v, i)
            found.append((behind, tuple(ids)))
        return found

    def alternatives(self, number: int, word: str, n: int):
        if (number, n) not in self.few:
            own = self.search(written(word), n)
            self.few_ids += sum(len(ids) for _, ids in own)
            if len(self.few) >= self.limit // 6 or self.few_ids > self.room // 4:
                self.few.clear()
                self.few_ids = sum(len(ids) for _, ids in own)
            self.few[number, n] = own
        return self.few[number, n]

    def parts(self, text: str) -> list[str]:
        """Pre-tokens, long ones cut wherever no piece crosses."""
        words = pre_tokens(text)
        if max(map(len, words)) <= LONG:
            return words
        out = []
        for w in words:
            if len(w) <= LONG:
                out.append(w)
                continue
            spelled = w.replace(" ", MARK)
            cuts = [k for k in range(1, len(w)) if spelled[k - 1 : k + 1] not in self.pairs]
            ends = [*cuts, len(w)]
            out.append(w[: ends[0]])
            out += [INNER + w[a:b] for a, b in zip(cuts, ends[1:], strict=True)]
        return out

    def encode(self, texts: list[str | None], n: int):
        """Ids of the best segmentations one after the other, where each text's begin and end, and for each text its n
        best: score and the words that change, as (first id, last id, new ids) within the text's best."""
        split = [self.parts(t) if t else [] for t in texts]
        every = [w for s in split for w in s]
        numbers = list(map(self.number.get, every))
        if None in numbers:
            new = {w for w, k in zip(every, numbers, strict=True) if k is None}
            if len(self.number) + len(new) > self.limit or self.characters + sum(map(len, new)) > self.room:
                self.forget()
                new = set(every)
            self.learn(list(new))
            numbers = list(map(self.number.__getitem__, every))
        numbers = np.array(numbers, np.int64)
        many = self.many[numbers]
        ends = np.cumsum(many)
        flat = self.flat[np.arange(int(many.sum())) + np.repeat(self.at[numbers] - ends + many, many)]
        words_at = np.cumsum([0, *map(len, split)])
        upto = np.r_[0, ends][words_at]
        gaps, totals = self.gap[numbers], self.total[numbers]
        ways = []
        for k, words in enumerate(split):
            a, b = words_at[k], words_at[k + 1]
            own = gaps[a:b]
            few = np.sort(np.argpartition(own, n - 2)[: n - 1]) if n - 1 < len(own) and n > 1 else np.arange(len(own) if n > 1 else 0)
            found = [(float(totals[a:b].sum()), ())]
            for f in few:
                first = int(ends[a + f] - many[a + f] - upto[k])
                options = self.alternatives(int(numbers[a + f]), words[f], n)
                found = sorted(((s - (options[0][0] - o), (*c, (first, first + int(many[a + f]), ids)) if j else c) for s, c in found for j, (o, ids) in enumerate(options)), key=lambda x: -x[0])[:n]
            ways.append(found)
        return flat, upto, ways

    @staticmethod
    def changed(best: np.ndarray, changes) -> np.ndarray:
        parts, at = [], 0
        for first, last, ids in changes:
            parts += [best[at:first], np.array(ids, np.int32)]
            at = last
        return np.concatenate([*parts, best[at:]]) if parts else best

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of a run of pieces, with the blank that stands before each text, and where each piece ends."""
        n = self.spelled_n[ids]
        ends = np.cumsum(n)
        return self.spelled[np.arange(int(n.sum())) + np.repeat(self.spelled_at[ids] - ends + n, n)], ends

    def decode(self, ids) -> str:
        return self.spell(np.asarray(ids, np.int64))[0].tobytes().decode("utf-8", "replace")[1:]


@lru_cache(1)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def segment(docs: DataFrame, path: str, n: int = 4, every: bool = False, digests: bool = True) -> DataFrame:
    """doc_id, ids (best segmentation), n_pieces, scores (of the n best, best first), round_trip (decoding the best gives
    the text); digests: sha256 of each of the n best (ids as little-endian 32-bit integers); every: all n best lists of ids."""

    def run(batches):
        lat = lattice(path)
        for chunk in chunks(batches, limit=1 << 20):
            texts = chunk.column("text").to_pylist()
            flat, upto, ways = lat.encode(texts, n)
            spelled, ends = lat.spell(flat)
            bytes_at = np.r_[0, ends][upto]
            scores, same, marks, lists = [], [], [], []
            for k, t in enumerate(texts):
                best = flat[upto[k] : upto[k + 1]]
                scores.append(None if t is None else [w[0] for w in ways[k]])
                same.append(None if t is None else spelled[bytes_at[k] : bytes_at[k + 1]].tobytes()[1:] == t.replace(MARK, " ").encode())
                own = [lat.changed(best, c) for _, c in ways[k]] if t is not None and (digests or every) else None
                marks.append([hashlib.sha256(o.astype("<i4", copy=False)).hexdigest() for o in own] if digests and own is not None else None)
                lists.append([o.tolist() for o in own] if every and own is not None else None)
            counts = np.diff(upto)
            best = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32), mask=np.array([*(t is None for t in texts), False])), pa.array(flat.astype(np.int32)))
            columns = [chunk.column("doc_id"), best, pa.array(counts.astype(np.int64)), pa.array(scores, pa.list_(pa.float64())), pa.array(same, pa.bool_())]
            columns += [pa.array(marks, pa.list_(pa.string()))] * digests + [pa.array(lists, pa.list_(pa.list_(pa.int32())))] * every
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "ids", "n_pieces", "scores", "round_trip"] + ["digests"] * digests + ["nbest"] * every
    schema = "doc_id long, ids array<int>, n_pieces long, scores array<double>, round_trip boolean" + ", digests array<string>" * digests + ", nbest array<array<int>>" * every
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids."""

    def run(batches):
        for b in batches:
            texts = [None if i is None else lattice(path).decode(i) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")
