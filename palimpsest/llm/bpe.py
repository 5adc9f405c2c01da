"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens. It accepts exactly the token sequences that the
merges produce, and for each word there is one path whose arc labels spell it.
It begins with one state and an arc for each base symbol, and each merge (u, v)
-> w, in order of rank, adds one gadget: a state reached by w that takes over
the arcs of v's state, an arc w beside every arc u, and the loss of arc v in
u's state. Written out, the arcs number the square of the vocabulary, so the
automaton is kept as its gadgets: for each state the state it took its arcs
from, for each arc the arc it stands beside, and the lost arcs with their rank.
A transition is looked up by going back through the gadgets, and lands in a
table that further lookups read.

The labels of the arcs are compiled into a second table, by character: a state
is the longest beginning of a label that a word's read part ends with, and
lists the labels that end there. A word is read once, one transition a
character. At each place at most one token ends on a path from the start, namely
the listed label for which the state at its own beginning has an arc; so there
is nothing to search and nothing to go back to. The tokens are then read off
from the last one back. Decoding emits arc labels.

Texts are normalised and split into words as the tokenizer file says, whole
where they have no special tokens and no characters beyond ``PLAIN``, else piece
by piece between white space, which no token crosses. The tokens of words are
kept in bounded tables.

Cases: a null text counts as empty; an empty text has no tokens, and its
digests are those of the empty string; very long texts and words go the same
way; special tokens in a text have their own ids; repeated rows repeat; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

PIECES = 150_000
ARCS = 150_000
TRANSITIONS = 150_000
#: White space as the file's patterns mean it; the controls that Python's split takes for it; the split pattern.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ONLY_PYTHON_SPACE = re.compile("[\x1c-\x1f]")
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same in lower-cased ASCII.
ASCII_WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
#: Beyond this code point the tokenizer's own normaliser and splitter cut a piece into words, as Unicode versions differ.
PLAIN = re.compile("[\x00-\u02ff]*")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}


class Automaton:
    """A tokenization automaton in the form of its merge gadgets."""

    def __init__(self, vocabulary: dict[str, int], merges: Iterable[tuple[str, str]], end: str = "</w>"):
        self.ids, self.end = vocabulary, end
        self.labels = {i: s for s, i in vocabulary.items()}
        size = max(self.labels, default=-1) + 1
        self.born, self.row, self.column = [-1] * size, [-1] * size, [-1] * size
        self.lost: dict[tuple[int, int], int] = {}
        self.lost_labels: set[int] = set()
        for rank, (u, v) in enumerate(merges):
            self._gadget(rank, vocabulary[u], vocabulary[v], vocabulary[u + v])
        self._arcs: dict[int, bool] = {}
        self._compile(end)

    def _compile(self, end: str) -> None:
        """The table by character: for each state its transitions, the state it falls back to, and the labels that end there, long ones first."""
        self.rows, self.back, inner, last = [{}], [0], [()], [()]
        for label, i in self.ids.items():
            symbol = len(label.removesuffix(end)) == 1
            if i in self.lost_labels or not symbol and self.born[i] < 0:
                continue
            state, text = 0, label.removesuffix(end)
            for character in text:
                state = self.rows[state].setdefault(character, len(self.rows))
                if state == len(self.rows):
                    self.rows.append({})
                    self.back.append(0)
                    inner.append(())
                    last.append(())
            (last if label.endswith(end) else inner)[state] = ((len(text), i),)
        queue = list(self.rows[0].values())
        for state in queue:  # states by length, so that those fallen back to are whole
            back = self.back[state]
            inner[state] += inner[back]
            last[state] += last[back]
            for character, then in self.rows[state].items():
                self.back[then] = self._reached(back, character)
                queue.append(then)
        self.inner, self.last, self._known = inner, last, len(self.rows)
        self.sizes = {i: len(label.removesuffix(end)) for label, i in self.ids.items()}

    def _reached(self, state: int, character: str) -> int:
        while state and character not in self.rows[state]:
            state = self.back[state]
        return self.rows[state].get(character, 0)

    def _transition(self, state: int, character: str) -> int:
        """A transition that isn't in the table yet."""
        then = self._reached(state, character)
        if self._known < TRANSITIONS:
            self._known += 1
            self.rows[state][character] = then
        return then

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        if self.born[w] >= 0 or w in self.lost_labels:
            raise ValueError("two merges make one label")
        if {u, v} & self.lost_labels or not self._look_up(u, v):  # no state has the arcs to be joined
            self.lost_labels.add(w)
            return
        self.born[w], self.row[w], self.column[w] = rank, v, u
        self.lost[u, v] = rank

    def has_arc(self, state: int, label: int) -> bool:
        """Whether the state reached by token ``state`` has an arc ``label``."""
        key = state << 32 | label
        known = self._arcs.get(key)
        if known is None:
            if len(self._arcs) >= ARCS:
                self._arcs.clear()
            known = self._arcs[key] = self._look_up(state, label)
        return known

    def _look_up(self, p: int, x: int) -> bool:
        lost, born = self.lost, self.born
        before = len(born) + 1  # gadgets of a rank below this one count
        while True:
            if lost.get((p, x), before) < before:
                return False
            a, b = born[p], born[x]
            if a < 0 and b < 0:
                return True
            if b >= a:  # the arc came beside another one, after the gadget's own loss
                before, x = b + 1, self.column[x]
            else:  # the state took its arcs before the gadget's own loss
                before, p = a, self.row[p]

    def encode_word(self, word: str) -> list[int]:
        """The labels' ids on the path that spells a word of byte symbols, its last one marked as the end."""
        rows, inner, arcs, has_arc = self.rows, self.inner, self._arcs, self.has_arc
        ends, state, final = [], 0, len(word) - 1  # by place, the token that ends after it, or -1
        for at in range(final):
            then = rows[state].get(word[at])
            state = self._transition(state, word[at]) if then is None else then
            ended = -1
            for size, label in inner[state]:
                if size > at:
                    ended = label
                    break
                before = ends[at - size]
                if before >= 0:
                    known = arcs.get(before << 32 | label)
                    if known or known is None and has_arc(before, label):
                        ended = label
                        break
            ends.append(ended)
        then = rows[state].get(word[final])
        state = self._transition(state, word[final]) if then is None else then
        for size, label in self.last[state]:
            if size > final or (ends[final - size] >= 0 and has_arc(ends[final - size], label)):
                path, at = [label], final - size
                while at >= 0:
                    path.append(ends[at])
                    at -= self.sizes[ends[at]]
                path.reverse()
                return path
        raise ValueError(f"no path spells {word!r}")


class _Kept(dict):
    """A bounded table that works out what it lacks. When it is full, what is asked for again is taken over from the full one."""

    def __init__(self, make, most: int, longest: int = 40):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Tokenizer:
    """Normalising, splitting, encoding and decoding as a tokenizer file says."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        before, splits = (spec[part] or {} for part in ("normalizer", "pre_tokenizer"))
        kinds = [x["type"] for x in before.get("normalizers", ())], [x["type"] for x in splits.get("pretokenizers", ())]
        pattern = splits["pretokenizers"][0].get("pattern", {}).get("Regex") if kinds[1] else None
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or pattern != WORDS or model["type"] != "BPE":
            raise ValueError("a tokenizer file of another kind")
        if any(t.get(flag) for t in spec["added_tokens"] for flag in ("lstrip", "rstrip", "single_word", "normalized")) or any(re.search(r"\s", t["content"]) for t in spec["added_tokens"]):
            raise ValueError("added tokens of another kind")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # a character that all added tokens have; without one every piece is searched
        self._mark = next((c for c in next(iter(self.special), "") if all(c in t for t in self.special)), "")
        self.automaton = Automaton(model["vocab"], (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]), model["end_of_word_suffix"])
        self.labels = self.automaton.labels | {i: s for s, i in self.special.items()}
        # the library's normaliser and splitter alone, without its own copy of the merges
        self._content, self._library = json.dumps(spec | {"added_tokens": [], "post_processor": None, "model": {"type": "BPE", "vocab": {}, "merges": []}}), None
        self._words = regex.compile(WORDS.replace(r"\s", SPACE))
        self._space = re.compile(f"[{SPACE}]+")
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else re.compile("(?!)")
        self._symbols = byte_symbols()
        self._names = {i: str(i) for i in self.labels}
        self._of_word = _Kept(self._written_word, PIECES)
        self._of_piece = _Kept(self._written_piece, PIECES // 10)

    def _split(self, piece: str) -> list[str]:
        """The words of a piece without white space or special tokens, in byte symbols, where Unicode versions may differ."""
        if self._library is None:
            from tokenizers import Tokenizer as Library

            self._library = Library.from_str(self._content)
        return [w for w, _ in self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(piece))]

    def _in_symbols(self, word: str) -> str:
        return "".join(map(self._symbols.__getitem__, word.encode()))

    def _pieces(self, text: str) -> list[str]:
        return self._space.sub("\n", text).strip("\n").split("\n") if ONLY_PYTHON_SPACE.search(text) else text.split()

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text."""
        written = self.written(text)[0]
        return list(map(int, written.split(" "))) if written else []

    def decode(self, ids: Iterable[int]) -> str:
        """The labels of the arcs with these ids; the file names no decoder, so a space joins them."""
        return " ".join(map(self.labels.__getitem__, ids))

    def _joined(self, ids: list[int]) -> tuple[str, str]:
        """Ids in decimal and their labels, joined by spaces."""
        return " ".join(map(self._names.__getitem__, ids)), self.decode(ids)

    def _written_word(self, word: str) -> tuple[str, str]:
        return self._joined(self.automaton.encode_word(word if word.isascii() and word.isprintable() else self._in_symbols(word)))

    def _plain_words(self, text: str) -> list[str]:
        """The words of a text without special tokens or characters beyond ``PLAIN``."""
        return ASCII_WORDS.findall(text.lower()) if text.isascii() else self._words.findall(unicodedata.normalize("NFC", text).lower())

    def _written_piece(self, piece: str) -> tuple[str, str]:
        """Of a piece as it stands in a text."""
        found = []
        for i, part in enumerate(self._special.split(piece) if self._mark in piece else (piece,)):
            if i % 2:
                found.append(self._joined([self.special[part]]))
            elif PLAIN.fullmatch(part):
                found += map(self._of_word.__getitem__, self._plain_words(part))
            else:
                found += [self._joined(self.automaton.encode_word(w)) for w in self._split(part)]
        return self._together(found)

    @staticmethod
    def _together(found: Iterable[tuple[str, str]]) -> tuple[str, str]:
        found = list(found)
        return " ".join([f[0] for f in found if f[0]]), " ".join([f[1] for f in found if f[0]])

    def written(self, text: str | None) -> tuple[str, str]:
        """The ids of a text in decimal and the decoded text, both joined by a space."""
        text = text or ""
        if self._mark not in text and (text.isascii() or PLAIN.fullmatch(text)):
            # all at once, as nothing here depends on what stands around a character
            return self._together(map(self._of_word.__getitem__, self._plain_words(text)))
        return self._together(map(self._of_piece.__getitem__, filter(None, self._pieces(text))))


_loaded: dict[str, Tokenizer] = {}


def load(content: str) -> Tokenizer:
    """The tokenizer of a file's content, compiled once a process."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = Tokenizer(content)
    return _loaded[key]


def _shared(docs: DataFrame, path: str) -> Broadcast[str]:
    """The file's content, read by the driver; a vocabulary's size doesn't grow with the data."""
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: the number of tokens and the SHA-256 of its ids and of the decoded text."""
    content = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(content.value)
        for batch in batches:
            n, ids, decoded = [], [], []
            for text in batch.column("text"):
                a, b = tokenizer.written(text.as_py())
                n.append(a.count(" ") + 1 if a else 0)
                ids.append(hashlib.sha256(a.encode()).hexdigest())
                decoded.append(hashlib.sha256(b.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Each document's token ids, as the last stage of a pipeline writes them."""
    content = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(content.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # some texts are very long
                part = batch.slice(at, 256)
                ids = [np.fromstring(tokenizer.written(text.as_py())[0], np.int32, sep=" ") for text in part.column("text")]
                sizes = np.array([len(x) for x in ids], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array(sizes), lists], names=["doc_id", "source", "n_tokens", "ids"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "source", "text").mapInArrow(run, "doc_id long, source string, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The decoded text of each row of (doc_id, ids); null ids decode to the empty string."""
    content = _shared(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(content.value)
        for batch in batches:
            texts = [tokenizer.decode(x.as_py() or []) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
