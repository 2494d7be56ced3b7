"""Encoding with a SentencePiece vocabulary by streaming Viterbi, and decoding.

The best segmentation maximises the sum of the piece scores. Text arrives in portions;
an automaton of all pieces reports where one ends, and each such end offers a path to
its boundary. A later piece can begin only within the length of the longest piece before
the end of what has come, so only those boundaries are open. When the back pointers of
all open boundaries lead to one boundary, no later text can change what lies before it:
the ids up to there are committed and dropped.

Models built by merging pairs hold merge ranks as scores, whose sum would prefer many
early pieces to one late piece. For them a piece scores -(PIECE_COST + ln(rank + 2)), the
ranks in the order of the ids, so that fewer pieces win and earlier merges break ties.
The ids are those of the best path under these scores; the merging program's own ids,
which follow the order of merges, differ in part (the README says how much). Either
decodes to the text.

Where no piece holds the space mark after another symbol, the boundary before a mark
that follows another symbol is always such a point. Whole texts are cut there, and
the ids of the parts are remembered, as words recur. Short parts of one length that are
new are segmented together, boundary by boundary over arrays.

Symbols without a piece become their UTF-8 bytes where the vocabulary has byte
pieces, else the unknown id. Of equal scores the path with the longer last piece
wins. Null and empty texts have no ids. Decoding gives the text back but for a mark
(U+2581) in the text itself, which becomes a space, as a space is coded by it, and
for unknown ids. Repeated rows are coded each; other columns pass through, a column
of the name ``ids`` is replaced.
"""

import sys
from math import log
from types import ModuleType

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

MARK = "▁"
CACHE_PARTS, CACHE_CHARS = 1 << 17, 1 << 21
#: Parts of one length are encoded together, up to this length and number, from this number on.
LONGEST_TOGETHER, TOGETHER, LEAST_TOGETHER = 40, 1 << 10, 128
#: Texts are taken up by portions of so many characters; their parts are held at once.
PORTION = 1 << 20
#: A long text comes in portions of so many longest pieces.
STEP = 16
#: How far a symbol without a piece lies below the worst piece.
UNKNOWN_PENALTY = 10.0
PIECE_COST = 5.0
#: Scores below this mark pieces that merge after all others.
BARRED = -1e8
STATE, NEVER = "logloom_worker_pieces", float("-inf")


def ranked(scores: list[float]) -> bool:
    """Whether the scores are merge ranks: each but the barred ones is minus its place."""
    kept = [(n, s) for n, s in enumerate(scores) if s > BARRED]
    return len(scores) > 1 and all(s == -n for n, s in kept)


class Trie:
    """The pieces as arrays: a child is found by its parent's number and a symbol.

    Node 0 is none, node 1 the root; ``score`` is minus infinity where no piece ends.
    """

    def __init__(self, scores: dict[str, float], ids: dict[str, int]):
        prefixes = sorted({p[:n] for p in scores for n in range(1, len(p) + 1)}, key=len)
        number = {"": 1} | {p: n for n, p in enumerate(prefixes, 2)}
        keys = np.array([number[p[:-1]] << 21 | ord(p[-1]) for p in prefixes], np.int64)
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], order.astype(np.int32) + 2
        self.score = np.array([NEVER, NEVER] + [scores.get(p, NEVER) for p in prefixes])
        self.piece = np.array([-1, -1] + [ids.get(p, -1) for p in prefixes], np.int32)

    def children(self, nodes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Each node's child by its symbol, or 0."""
        out = np.zeros(nodes.shape, np.int32)
        alive = nodes > 0
        keys = nodes[alive].astype(np.int64) << 21 | symbols[alive]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        out[alive] = np.where(self.keys[at] == keys, self.nodes[at], 0)
        return out

    def best_paths(self, texts: list[str]) -> list[bytes | None]:
        """The ids of texts of one length, boundary by boundary for all of them at once.

        None for a text that has a symbol without a piece.
        """
        count, length = len(texts), len(texts[0])
        symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        symbols = symbols.reshape(count, length).astype(np.int64)
        node, found = np.ones((count, length), np.int32), []
        for depth in range(length):
            node = self.children(node[:, :length - depth], symbols[:, depth:])
            if not node.any():
                break
            found.append(node)
        if not found:
            return [None] * count
        values = [self.score[n] for n in found]
        score = np.full((count, length + 1), NEVER)
        score[:, 0] = 0
        taken = np.ones((count, length + 1), np.int64)
        for end in range(1, length + 1):
            reach = min(end, len(found))  # the longest comes first, so it wins ties
            options = np.stack([score[:, end - n] + values[n - 1][:, end - n]
                                for n in range(reach, 0, -1)])
            best = options.argmax(0)
            score[:, end] = options[best, np.arange(count)]
            taken[:, end] = reach - best
        known = (values[0] > NEVER).all(1)
        ids = np.zeros((count, length), "<i4")
        at, first = np.where(known, length, 0), np.full(count, length)
        pieces = np.zeros((len(found), count, length), np.int32)
        for n, nodes in enumerate(found):
            pieces[n, :, :length - n] = self.piece[nodes]
        while len(rows := np.flatnonzero(at)):
            size = taken[rows, at[rows]]
            at[rows] -= size
            first[rows] -= 1
            ids[rows, first[rows]] = pieces[size - 1, rows, at[rows]]
        data, width = ids.tobytes(), 4 * length
        return [data[r * width + 4 * f:(r + 1) * width] if k else None
                for r, (f, k) in enumerate(zip(first.tolist(), known.tolist(), strict=True))]


class Vocabulary:
    """Pieces of a model file with their ids and scores."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        scores, ids, coded = {}, {}, {}
        for i, name in enumerate(names):
            if model.is_byte(i):
                coded[int(name[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                scores[name], ids[name] = model.get_score(i), i
        if ranked(list(scores.values())):
            scores = {name: -(PIECE_COST + log(rank + 2)) for rank, name in enumerate(scores)}
        self._take(names, scores, ids, coded, model.unk_id())

    @classmethod
    def of(cls, scores: dict[str, float], unknown: int = 0) -> "Vocabulary":
        """A vocabulary without byte pieces; ids follow the order, after the unknown id."""
        self = cls.__new__(cls)
        ids = {p: i for i, p in enumerate(scores, unknown + 1)}
        self._take(["⁇"] * (unknown + 1) + list(scores), scores, ids, {}, unknown)
        return self

    def _take(self, names, scores, ids, coded, unknown):
        self.ids, self.bytes, self.unknown = ids, coded, unknown
        self.data = [n.encode() for n in names]
        for byte, i in coded.items():
            self.data[i] = bytes([byte])
        self.scores = scores
        self.longest = max(map(len, self.scores))
        self.floor = min(self.scores.values()) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.trie = Trie(scores, ids)
        self.cuts = all(MARK not in p.lstrip(MARK) for p in self.scores)

    def code(self, piece: str) -> list[int]:
        if piece in self.scores:
            return [self.ids[piece]]
        data = piece.encode("utf-8", "replace")
        if all(b in self.bytes for b in data):
            return [self.bytes[b] for b in data]
        return [self.unknown]


class StreamingViterbi:
    """Feed text in any portions; ids come out as soon as they are certain."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text = ""  # not yet committed; boundary b lies before text[b]
        self.score, self.back = [0.0], [0]
        self.next_try = 2 * vocabulary.longest

    def feed(self, portion: str) -> list[int]:
        self._extend(portion)
        if len(self.text) < self.next_try:
            return []
        ids = self._take(self._certain())
        self.next_try = len(self.text) + 2 * self.v.longest
        return ids

    def finish(self) -> list[int]:
        return self._take(len(self.text))

    def _extend(self, portion: str) -> None:
        """Find the best path to each boundary of the portion, from left to right.

        The longest piece that ends at a boundary comes first, so it wins ties.
        """
        score, back, floor = self.score, self.back, self.v.floor
        at = len(self.text)
        text = self.text = self.text + portion
        for last, (length, value) in self.v.automaton.iter(text, max(0, at - self.v.longest + 1)):
            if last < at and last + 1 < len(score):
                continue  # a boundary of an earlier portion
            while len(score) <= last + 1:
                back.append(len(score) - 1)
                score.append(score[-1] + floor)
            value += score[last + 1 - length]
            if value > score[last + 1]:
                score[last + 1], back[last + 1] = value, last + 1 - length
        while len(score) <= len(text):
            back.append(len(score) - 1)
            score.append(score[-1] + floor)

    def _certain(self) -> int:
        """The boundary where the paths of all open boundaries meet.

        From the highest on, each is replaced by its predecessor until one is left.
        """
        end = len(self.text)
        alive = set(range(max(0, end - self.v.longest + 1), end + 1))
        while len(alive) > 1:
            highest = max(alive)
            alive.remove(highest)
            alive.add(self.back[highest])
        return alive.pop()

    def _take(self, end: int) -> list[int]:
        """Commit the best path to ``end``; what follows counts from there."""
        text, back, known, path, at = self.text, self.back, self.v.ids, [], end
        while at:
            before = back[at]
            piece = text[before:at]
            one = known.get(piece)
            path += [one] if one is not None else reversed(self.v.code(piece))
            at = before
        path.reverse()
        base = self.score[end]
        self.text = text[end:]
        self.score = [s - base for s in self.score[end:]]
        self.back = [b - end for b in back[end:]]
        self.back[0] = 0
        return path


class Encoder:
    """Whole texts to ids; parts between certain boundaries are encoded once."""

    def __init__(self, vocabulary: Vocabulary, cached: int = CACHE_PARTS):
        self.v, self.cached = vocabulary, cached
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _stream(self, text: str) -> bytes:
        viterbi, ids, step = StreamingViterbi(self.v), [], STEP * self.v.longest
        for i in range(0, len(text), step):
            ids += viterbi.feed(text[i:i + step])
        return np.array(ids + viterbi.finish(), "<i4").tobytes()

    def _keys(self, text: str) -> list[str]:
        """The parts of a text; one that begins with a single mark goes without it."""
        parts = text.replace(MARK, " ").split(" ")
        if "" not in parts:
            return parts
        out, marks = [], 1
        for part in parts:
            if part:  # otherwise the next mark follows at once and may join this one
                out.append(part if marks == 1 else MARK * marks + part)
                marks = 1
            else:
                marks += 1
        if marks > 1:
            out.append(MARK * (marks - 1))
        return out

    def _learn(self, keys: set[str]) -> None:
        """Encode parts that are not known yet, those of one length together."""
        new = keys - self.known.keys()
        self.held += sum(map(len, new))
        if len(self.known) + len(new) > self.cached or self.held > CACHE_CHARS:
            self.known.clear()
            new, self.held = keys, sum(map(len, keys))
        known, groups = self.known, {}
        for key in new:
            text = key if key[0] == MARK else MARK + key
            groups.setdefault(len(text), []).append((key, text))
        for length, group in groups.items():
            for at in range(0, len(group), TOGETHER):
                some = group[at:at + TOGETHER]
                codes = (self.v.trie.best_paths([t for _, t in some])
                         if length <= LONGEST_TOGETHER and len(some) >= LEAST_TOGETHER
                         else [None] * len(some))
                for (key, text), code in zip(some, codes, strict=True):
                    known[key] = self._stream(text) if code is None else code

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        if not self.v.cuts:
            return [np.frombuffer(self._stream(MARK + t.replace(" ", MARK)) if t else b"", "<i4")
                    for t in texts]
        parts = [self._keys(t) if t else [] for t in texts]
        self._learn(set().union(*parts))
        known = self.known
        out = [np.frombuffer(b"".join([known[k] for k in keys]), "<i4") for keys in parts]
        if self.held > CACHE_CHARS:  # very long parts are not remembered
            known.clear()
            self.held = 0
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        """The text of ``ids``; bytes that are not UTF-8 become replacement marks."""
        text = b"".join([self.v.data[i] for i in ids]).decode("utf-8", "replace")
        return text[1:].replace(MARK, " ")


def worker_encoder(path: str, cached: int = CACHE_PARTS) -> Encoder:
    """One encoder per Python worker, kept between tasks (see ``vocabulary.encoder``)."""
    state = sys.modules.setdefault(STATE, ModuleType(STATE))
    if getattr(state, "path", None) != path:
        state.path, state.encoder = path, Encoder(Vocabulary(path))
    state.encoder.cached = cached
    return state.encoder


def encode(docs: DataFrame, vocabulary: str, cached: int = CACHE_PARTS) -> DataFrame:
    """Rows of ``docs`` without their text, with ``ids`` (array of int).

    ``cached`` bounds the parts that a worker remembers: a million take about 200 MB.
    """
    kept = [c for c in docs.columns if c not in ("text", "ids")]
    schema = StructType([docs.schema[c] for c in kept]).add("ids", ArrayType(IntegerType()))

    def run(batches):
        coder = worker_encoder(vocabulary, cached)
        for batch in batches:
            first, texts, held = 0, [], 0
            for last, text in enumerate(batch["text"], 1):
                texts.append(text.as_py())
                held += len(texts[-1])
                if held < PORTION and last < len(batch):
                    continue
                coded = coder.encode_all(texts)
                ids = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *map(len, coded)]), pa.int32()),
                    pa.array(np.concatenate([*coded, np.empty(0, "<i4")]), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c].slice(first, last - first) for c in kept), ids], [*kept, "ids"])
                first, texts, held = last, [], 0

    return docs.select(*kept, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary: str) -> DataFrame:
    """Rows with ``ids`` given back their ``text``; null ids and unknown numbers give nothing.

    SQL functions look the pieces up, so that no second Python worker runs beside the
    one that encodes. Bytes that are not UTF-8 become replacement marks.
    """
    pieces = F.split(F.lit(",".join(p.hex() for p in Vocabulary(vocabulary).data)), ",")
    coded = F.unhex(F.array_join(F.transform("ids", lambda i: F.get(pieces, i)), ""))
    text = F.make_valid_utf8(F.coalesce(coded.cast("string"), F.lit("")))
    text = F.replace(F.substr(text, F.lit(2)), F.lit(MARK), F.lit(" "))
    return rows.select(*[c for c in rows.columns if c != "text"], text.alias("text"))
