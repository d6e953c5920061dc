"""BPE encoding and decoding with a tokenization automaton.

Merges are compiled, in rank order, by successive merge gadgets. The automaton
starts with one state and an arc to itself for each byte. Each token's arcs lead
to one state. The gadget of a merge (a, b)

* splits the target state p of a: a now leads to a copy of p without its arc b;
* adds an arc ab, beside a, to every state that has a, leading to the target
  that b had before.

The automaton then accepts exactly the token sequences that BPE gives. It is
kept as a transition table: a row for each state, a column for each class of
arcs that the same states have, a bit for "has the arc", and the row that each
token leads to. The driver compiles it once and broadcasts it (some 20 MB for
50,000 merges, whatever the input).

Encoding reads a word once from left to right. Each prefix of a word has one
accepted sequence, so one state: tokens that end at a byte are told by one
Aho-Corasick automaton over the arcs' labels, and the one that the table lets
follow the state at its start gives the state at its end. Nothing is tried and
taken back. Decoding emits the bytes that label the arcs.

Words are split by the vocabulary's pattern. Its letters, numbers and spaces are
those of the library that the vocabulary is for: code points on which Unicode
tables of different age differ are asked of it (``class_exceptions``).

Null texts encode as empty ones; strings of special tokens inside a text become
those tokens, as is the default of the tokenizers library. Very long words take
time in proportion to their length. Only the id and the text are read, so other
columns can't clash. Repeated rows give repeated rows; an empty table gives an
empty result.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import map_rows, text_of

#: Fixed value: the split pattern of byte-level BPE vocabularies of this kind.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a task remembers at a time.
MEMO_WORDS = 150_000

def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies, by their rule."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return {chr(b if b in plain else next(spare)): b for b in sorted(range(256), key=lambda b: (b in plain, b))}


class MergeAutomaton:
    """Deterministic automaton over tokens, built by one gadget a merge: rows are states, columns classes of arcs."""

    def __init__(self, alphabet: list[tuple[bytes, int]], merges: list[tuple[bytes, bytes, int]]):
        """alphabet: (byte string, id). merges: (left, right, id of the product) by rank."""
        self.ids: dict[bytes, int] = dict(alphabet)
        self.bits = np.zeros((64, 8), np.uint8)
        self.bits[0, 0] = 1
        #: The row that a token leads to and the column of its arcs; row 0 is the start. Tokens that share a row or a column are counted.
        self.row, self.column = dict.fromkeys(self.ids.values(), 0), dict.fromkeys(self.ids.values(), 0)
        self._in_row, self._in_column = [len(self.ids) + 1], [len(self.ids)]
        for left, right, product in merges:
            self._gadget(left, right, product)
        self.bits = np.ascontiguousarray(self.bits[: len(self._in_row), : -(-len(self._in_column) // 8)])
        self._scan = None

    def has(self, row: int, column: int) -> int:
        return self.bits[row, column >> 3] >> (column & 7) & 1

    def _room(self, rows: int, columns: int) -> None:
        have = self.bits.shape
        if rows > have[0] or columns > 8 * have[1]:
            wide = np.zeros((have[0] * (1 + (rows > have[0])), have[1] * (1 + (columns > 8 * have[1]))), np.uint8)
            wide[: have[0], : have[1]] = self.bits
            self.bits = wide

    def _own_row(self, token: int) -> int:
        """A state that only this token leads to."""
        old = self.row[token]
        if self._in_row[old] > 1:
            new = len(self._in_row)
            self._room(new + 1, 0)
            self.bits[new] = self.bits[old]
            self._in_row[old] -= 1
            self._in_row.append(1)
            self.row[token] = new
        return self.row[token]

    def _own_column(self, token: int) -> int:
        """A column for the arcs of this token alone."""
        old = self.column[token]
        if self._in_column[old] > 1:
            new = len(self._in_column)
            self._room(0, new + 1)
            self.bits[:, new >> 3] |= (self.bits[:, old >> 3] >> (old & 7) & 1) << (new & 7)
            self._in_column[old] -= 1
            self._in_column.append(1)
            self.column[token] = new
        return self.column[token]

    def _gadget(self, left: bytes, right: bytes, product: int) -> None:
        if left + right in self.ids:
            raise ValueError("two merges give the same token")
        a, b = self.ids.get(left), self.ids.get(right)
        if a is None or b is None or not self.has(self.row[a], self.column[b]):
            return  # no path has a then b: this merge never applies
        self.row[product] = self.row[b]
        self._in_row[self.row[b]] += 1
        row, column = self._own_row(a), self._own_column(b)
        self.bits[row, column >> 3] &= 255 - (1 << (column & 7))
        self.column[product] = self.column[a]
        self._in_column[self.column[a]] += 1
        self.ids[left + right] = product

    def __getstate__(self):
        return self.__dict__ | {"_scan": None}

    def _labels(self):
        """The automaton over labels, and the table's rows as bytes."""
        found = ahocorasick.Automaton()
        for label, i in self.ids.items():
            found.add_word(label.decode("latin-1"), (i, len(label), self.row[i], self.column[i] >> 3, self.column[i] & 7))
        found.make_automaton()
        return found, [r.tobytes() for r in self.bits]

    def encode(self, word: bytes) -> list[int]:
        """The one accepted token sequence that spells the word."""
        if self._scan is None:
            self._scan = self._labels()
        labels, table = self._scan
        states, came = [table[0]] + [b""] * len(word), [(0, 0)] * (len(word) + 1)
        for last, (token, size, row, byte, bit) in labels.iter(word.decode("latin-1")):
            start = last + 1 - size
            if states[start][byte] >> bit & 1:
                states[last + 1], came[last + 1] = table[row], (token, start)
        out, at = [], len(word)
        while at:
            token, at = came[at]
            out.append(token)
        return out[::-1]


#: Stand-ins by class for code points that the split pattern's own tables class otherwise.
_STAND_INS = {"letter": "é", "number": "1", "space": "\xa0", "other": "!"}


def class_exceptions(tokenizer) -> dict[int, str]:
    """Code points whose class in the library (letter, number, space or other) isn't that of the regex package's tables.

    Only those are asked about on which the regex package and Python's own
    (older) tables differ, and all that count as spaces.
    """
    kinds, names, found = {"L": 1, "N": 2}, ("other", "letter", "number", "space"), {}
    pieces = lambda t: len(tokenizer.pre_tokenizer.pre_tokenize_str(t))
    for base in range(0, 0x110000, 4096):
        if 0xD800 <= base < 0xE000:
            continue
        text, own = "".join(map(chr, range(base, base + 4096))), np.zeros(4096, np.int8)
        for k, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
            for m in regex.finditer(pattern, text):
                own[m.start() : m.end()] = k
        older = np.fromiter((kinds.get(unicodedata.category(c)[0], 0) for c in text), np.int8, 4096)
        for i in np.flatnonzero(own != older):
            c = text[i]
            kind = "letter" if pieces("a" + c) == 1 else "number" if pieces("1" + c) == 1 else "other" if pieces("!" + c) == 1 else "space"
            if kind != names[own[i]]:
                found[base + int(i)] = kind
    return found


class Splitter:
    """Words of the split pattern, with other classes for the exceptions."""

    def __init__(self, exceptions: dict[int, str]):
        self.pattern = regex.compile(SPLIT)
        self.stand_ins = {p: _STAND_INS[kind] for p, kind in exceptions.items()}
        ends = sorted(exceptions)
        starts = [p for p in ends if p - 1 not in exceptions]
        ends = [p for p in ends if p + 1 not in exceptions]
        self.odd = re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(starts, ends)) + "]") if starts else None

    def __call__(self, text: str) -> list[str]:
        if self.odd is None or text.isascii() or not self.odd.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.stand_ins))]


class Memo(dict):
    """Packed ids of words, forgotten all at once when full."""

    def __init__(self, automaton: MergeAutomaton, most: int = MEMO_WORDS):
        self.automaton, self.most = automaton, most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = self.automaton.encode(word.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            self[word] = packed
        return packed


class Codec:
    """Vocabulary file of the tokenizers library, byte-level BPE, compiled."""

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        spec = json.loads(text)
        letters = byte_letters()
        vocab = {w: i for w, i in spec["model"]["vocab"].items()}
        raw = {w: bytes(letters[c] for c in w) for w in vocab if all(c in letters for c in w)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.automaton = MergeAutomaton(
            [(bytes([b]), vocab[c]) for c, b in letters.items() if c in vocab],
            [(raw[a], raw[b], vocab[a + b]) for a, b in pairs],
        )
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.labels = {i: raw.get(w, w.encode()) for w, i in vocab.items()} | {i: w.encode() for w, i in self.special.items()}
        self.exceptions = class_exceptions(Tokenizer.from_str(text))
        self._ready()

    def _ready(self) -> None:
        self.split = Splitter(self.exceptions)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.memo = Memo(self.automaton)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in ("automaton", "special", "labels", "exceptions")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get = self.memo.__getitem__
        if self.marks is None or not self.marks.search(text):
            return b"".join(map(get, self.split(text)))
        out = []
        for part in self.marks.split(text):
            if part in self.special:
                out.append(struct.pack("<I", self.special[part]))
            else:
                out += map(get, self.split(part))
        return b"".join(out)

    def decode_packed(self, packed: bytes) -> str:
        return b"".join(map(self.labels.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec_of(text: str) -> Codec:
    """The driver compiles a vocabulary once."""
    if text not in _CODECS:
        _CODECS.clear()
        _CODECS[text] = Codec(text)
    return _CODECS[text]


def encode_decode(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens and the text decoded from ids.

    ``vocabulary`` is the file's path, read and compiled by the driver.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        compiled = spark.sparkContext.broadcast(codec_of(f.read()))

    def make():
        codec = compiled.value

        def work(cols):
            packed = [codec.encode_packed(t or "") for t in cols["text"]]
            return {"doc_id": cols["doc_id"], "ids": packed, "n_tokens": [len(p) // 4 for p in packed], "decoded": [codec.decode_packed(p) for p in packed]}

        return work

    return map_rows(text_of(docs, id_col, text_col), make, "doc_id long, ids binary, n_tokens long, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))
