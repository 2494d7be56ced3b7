"""Token ids of whole texts with a tokenizer whose tokens never span white space."""

import os
import re
import sys
from array import array
from types import ModuleType
from unicodedata import normalize

import numpy as np

CACHE_WORDS = 340_000
CACHE_BYTES = 1 << 23
JOINED = 256
STATE = "logloom_worker_words"
#: Latin letters in UTF-8, A-Z lower-cased; words of them and ASCII signs but the apostrophe
#: (as in "'s"); the runs of such a word.
LETTER = rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])"
LETTERS = re.compile(LETTER + rb"+")
PLAIN = re.compile(rb"(?:[!-&(-@\[-`{-~]|" + LETTER + rb")+")
RUN = re.compile(LETTER + rb"+|[0-9]|[^a-z0-9\xc3]+")
#: Texts of ASCII signs, Latin letters and white space, which lower-case sign by sign and need
#: no composing; the tokenizer's runs of such a text in lower case (two bytes from \x80: a letter).
SIMPLE = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
RUNS = re.compile(rb"[a-z\x80-\xff]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[!-/:-@\[-`{-~]+")


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


def stays_letter(character: str) -> bool:
    """Whether it ends in a letter or digit when composed and lower-cased.

    Some letters end in a mark then, which joins a stop that follows.
    """
    return character.isalnum() and (
        character.isascii() or normalize("NFC", character.lower())[-1].isalnum())


class Store(dict):
    """Ids of words; a run that is looked up by its key and missing is learned."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, run: bytes) -> bytes:
        return self.learn(run)


class WordEncoder:
    """Encodes the words of a text once each; ids are little-endian unsigned 32-bit.

    For tokenizers that compose (NFC) and lower-case the text, drop white space, cut
    it into runs of letters, single digits and runs of other signs, and end each run
    with a token marked ``</w>``. Words are the runs between ASCII white space; plain
    texts are cut into the tokenizer's own runs, of which there are fewer. When the
    cache holds half of what it may, it is put by and a new one begins, which takes
    from it what comes again: words that recur often stay known.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known = Store(self._learn_run)
        self.before: dict[bytes, bytes] = {}
        self.characters = byte_characters()
        self.held = 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _put_by(self) -> None:
        # what grew beyond its size, as by one very long text, is not put by
        self.before = dict(self.known) if len(self.known) <= CACHE_WORDS // 2 else {}
        self.known.clear()

    def _learn_run(self, run: bytes) -> bytes:
        ids = self.before.get(run)
        if ids is None:
            shown = run.decode() if run.isascii() else \
                run.decode("latin-1").translate(self.characters)
            ids = array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()
        self.held += len(run)
        if len(self.known) >= CACHE_WORDS // 2 or self.held > CACHE_BYTES // 2:
            self._put_by()
            self.held = len(run)
        self.known[run] = ids
        return ids

    def _learn(self, new: set[bytes]) -> None:
        known = self.known
        self.held += sum(map(len, new))
        if len(known) + len(new) > CACHE_WORDS // 2 or self.held > CACHE_BYTES // 2:
            self._put_by()
            self.held = sum(map(len, new))
        again = {w for w in new if w in self.before}
        known.update(zip(again, map(self.before.__getitem__, again)))
        new -= again
        stopped, letters, rest, model = [], [], [], self.tokenizer.model
        # runs are coded one by one: those of digits and signs recur
        cut = [(w, RUN.findall(w)) for w in new if not w.isalpha() and not LETTERS.fullmatch(w)
               and PLAIN.fullmatch(w) and b"<|" not in w]
        new.difference_update([w for w, _ in cut])
        runs = {r for _, parts in cut for r in parts if r not in known and r not in new}
        self.held += sum(map(len, runs))
        new |= runs
        for word in new:
            # a run of letters goes straight to the model
            if word.isalpha() and word.islower():  # of bytes: a-z only
                known[word] = array("I", [t.id for t in model.tokenize(word.decode())]).tobytes()
                continue
            text = word.decode("utf-8", "replace")
            if LETTERS.fullmatch(word):
                shown = text.lower().encode().decode("latin-1").translate(self.characters)
                known[word] = array("I", [t.id for t in model.tokenize(shown)]).tobytes()
                continue
            # a stop after a letter or digit is a run of its own
            if len(text) > 1 and text[-1] in ".," and stays_letter(text[-2]):
                stopped.append(word)
                word, text = word[:-1], text[:-1]
                if word in known:
                    continue
            (letters if text.isalpha() else rest).append((word, text))
        if stopped:
            rest += [(b".", "."), (b",", ",")]
        for at in range(0, len(letters), JOINED):
            some = letters[at:at + JOINED]
            ids = np.array(self._ids([" ".join(t for _, t in some)])[0], "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):  # a letter that falls apart when lower-cased
                rest += some
                continue
            data, start = ids.tobytes(), 0
            for (word, _), end in zip(some, (ends * 4).tolist(), strict=True):
                known[word] = data[start:end]
                start = end
        for (word, _), ids in zip(rest, self._ids([t for _, t in rest]), strict=True):
            known[word] = array("I", ids).tobytes()
        for word in stopped:
            known[word] = known[word[:-1]] + known[word[-1:]]
        for word, parts in cut:
            known[word] = b"".join([known[r] for r in parts])

    def split(self, text: str | None) -> list[bytes]:
        """The words of a text, in forms that recur more often but have the same ids.

        A-Z are lower-cased here, but not where a special token's text or a
        combining mark (U+0300 to U+037F) could make a difference.
        """
        data = (text or "").encode("utf-8", "replace")
        if not (b"<|" in data or b"\xcc" in data or b"\xcd" in data):
            data = data.lower()
        return data.split()

    def parts(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word."""
        found = list(map(self.known.get, words))
        gaps = [n for n, ids in enumerate(found) if ids is None]
        if gaps:
            self._learn({words[n] for n in gaps})
            for n in gaps:
                found[n] = self.known[words[n]]
        return found

    def runs(self, text: str | None) -> list[bytes] | None:
        """The tokenizer's runs of a text where they are plain to see; they recur more
        often than words, which differ by the stops beside them."""
        if text and "<|" not in text and SIMPLE.fullmatch(text):
            return RUNS.findall(text.lower().encode())
        return None

    def encode(self, text: str | None) -> bytes:
        runs = self.runs(text)
        return b"".join(self.parts(self.split(text)) if runs is None
                        else map(self.known.__getitem__, runs))


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker, kept between tasks.

    Functions of this package travel to the workers by value, so their globals end
    with the task; what is to outlive it hangs on a module entry of the worker.
    """
    state = sys.modules.setdefault(STATE, ModuleType(STATE))
    if getattr(state, "path", None) != path:
        state.path, state.encoder = path, WordEncoder(path)
    return state.encoder
