"""Token counts that follow edits, from a segment tree over each document's pre-tokens.

A leaf holds some consecutive pre-tokens (a word with the white space before it);
every node the characters and tokens below it. An edit (at, removed, inserted) goes
down by the character sums. The leaves it touches are cut into pre-tokens again from
the start of the word before the edit to the end of the word after it, as only these
can change; only words that are new there are encoded, and the sums above the leaf
are updated. Words that cannot be cut in the middle by the tokenizer's rules are the
runs between ASCII white space.

Edits of a document apply in the order of ``seq`` to the text as it then is; ``at``
and ``removed`` are cut to the text. Null texts count as empty; null edit fields mean
0 or nothing inserted. Edits of unknown or null ids have no effect; rows that repeat a
doc_id get the same edits; repeated edit rows apply again. Documents without edits
keep their count. No rows give no rows; other columns pass through.
"""

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from logloom.llm.vocabulary import encoder

LEAF = 32
PRE_TOKEN = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
WHITE = " \t\n\x0b\x0c\r"
EDITS = "array<struct<seq:bigint,at:bigint,removed:bigint,inserted:string>>"


class CountTree:
    """Characters and tokens of a text, by leaves of ``leaf`` pre-tokens."""

    def __init__(self, text: str, count, leaf: int = LEAF):
        """``count`` gives the tokens of each of a list of pre-tokens."""
        self.count, self.leaf, self.encoded = count, leaf, 0
        pieces = PRE_TOKEN.findall(text)
        tokens = self._counted(pieces)
        self.leaves = [pieces[i:i + leaf] for i in range(0, len(pieces), leaf)] or [[]]
        self.counts = [tokens[i:i + leaf] for i in range(0, len(pieces), leaf)] or [[]]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i in range(len(self.leaves)):
            self._set(i)
        for node in range(self.width - 1, 0, -1):
            self._sum(node)

    def _counted(self, pieces: list[str]) -> list[int]:
        self.encoded += len(pieces)
        return self.count(pieces)

    def _set(self, leaf: int) -> None:
        self.chars[self.width + leaf] = sum(map(len, self.leaves[leaf]))
        self.tokens[self.width + leaf] = sum(self.counts[leaf])

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _up(self, first: int, last: int) -> None:
        low, high = (self.width + first) // 2, (self.width + last) // 2
        while low:
            for node in range(low, high + 1):
                self._sum(node)
            low, high = low // 2, high // 2

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` and the offset in it."""
        node = 1
        while node < self.width:
            node *= 2
            if at >= self.chars[node] and self.chars[node + 1]:
                at -= self.chars[node]
                node += 1
        return node - self.width, at

    def _place(self, at: int) -> tuple[int, int, int]:
        """Leaf, pre-token and offset in it of character ``at``."""
        leaf, at = self.find(at)
        pieces = self.leaves[leaf]
        for i, piece in enumerate(pieces):
            if at < len(piece):
                return leaf, i, at
            at -= len(piece)
        return leaf, len(pieces), at

    def edit(self, at: int, removed: int, inserted: str) -> None:
        at = min(max(at, 0), self.chars[1])
        removed = min(max(removed, 0), self.chars[1] - at)
        # one character before and after, so that both neighbouring words are in
        first, i, head = self._place(max(at - 1, 0))
        head += min(at, 1)
        last, j, tail = self._place(min(at + removed, max(self.chars[1] - 1, 0)))
        tail += at + removed - min(at + removed, max(self.chars[1] - 1, 0))
        before = self.leaves[first][i][:head] if i < len(self.leaves[first]) else ""
        after = self.leaves[last][j][tail:] if j < len(self.leaves[last]) else ""
        rest, rest_counts = self.leaves[last][j + 1:], self.counts[last][j + 1:]
        text = before + inserted + after
        # a piece that ends in white space, or is it, joins the word that follows
        while text and text[-1] in WHITE:
            if rest:
                text += rest.pop(0)
                rest_counts.pop(0)
            elif last + 1 < len(self.leaves):
                last += 1
                rest, rest_counts = list(self.leaves[last]), list(self.counts[last])
            else:
                break
        kept = slice(0, i)
        pieces = PRE_TOKEN.findall(text)
        self.leaves[first] = self.leaves[first][kept] + pieces + (rest if first == last else [])
        self.counts[first] = (self.counts[first][kept] + self._counted(pieces)
                              + (rest_counts if first == last else []))
        for leaf in range(first + 1, last + 1):
            self.leaves[leaf], self.counts[leaf] = [], []
        if last > first:
            self.leaves[last], self.counts[last] = rest, rest_counts
        for leaf in range(first, last + 1):
            self._set(leaf)
        self._up(first, last)

    @property
    def text(self) -> str:
        return "".join(p for pieces in self.leaves for p in pieces)

    @property
    def total(self) -> int:
        return self.tokens[1]


def counter(vocabulary: str):
    """Tokens of pre-tokens, by the worker's encoder."""
    coder = encoder(vocabulary)

    def count(pieces):
        # every piece has one word, but for white space alone at the end of a text
        found = [len(ids) // 4 for ids in coder.parts(coder.split("".join(pieces)))]
        return found + [0] * (len(pieces) - len(found))

    return count


def counted(docs: DataFrame, edits: DataFrame, vocabulary: str) -> DataFrame:
    """``docs`` without text, with tokens_before, tokens_after, chars_after, words_encoded.

    ``edits``: doc_id, seq, at, removed, inserted. A document's edits depend on each
    other, so they meet in one row; they are a part of its own history, as its text is.
    ``words_encoded`` counts the pre-tokens that the edits made anew.
    """
    added = ["tokens_before", "tokens_after", "chars_after", "words_encoded"]
    kept = [c for c in docs.columns if c not in ("text", *added)]
    schema = StructType([docs.schema[c] for c in kept])
    for name in added:
        schema = schema.add(name, LongType())
    gathered = edits.groupBy(F.col("doc_id").alias("_id")).agg(F.array_sort(F.collect_list(
        F.struct("seq", "at", "removed", "inserted"))).cast(EDITS).alias("_edits"))
    # the caller's columns travel as one, whatever their names
    rows = docs.select(F.struct(*kept).alias("_row"), "doc_id",
                       F.coalesce("text", F.lit("")).alias("text")).join(
        gathered, F.col("doc_id") == F.col("_id"), "left").drop("_id", "doc_id")

    def run(batches):
        count = counter(vocabulary)
        for batch in batches:
            found = []
            for text, changes in zip(batch["text"], batch["_edits"], strict=True):
                tree = CountTree(text.as_py(), count)
                before, tree.encoded = tree.total, 0
                for change in changes.as_py() or ():
                    tree.edit(change["at"] or 0, change["removed"] or 0,
                              change["inserted"] or "")
                found.append((before, tree.total, tree.chars[1], tree.encoded))
            columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] or [
                pa.array([], pa.int64())] * len(added)
            yield pa.RecordBatch.from_arrays([*batch["_row"].flatten(), *columns],
                                             [*kept, *added])

    return rows.mapInArrow(run, schema)
