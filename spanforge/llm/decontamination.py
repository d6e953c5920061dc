"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to lower-case (A-Z) words; any other ASCII character than
letters and digits separates words. A window is ``words`` consecutive words of
an item; an item of fewer words, but not none, is one window. All windows make
one automaton: a text is scanned once, and hits are mapped back to words and to
character offsets of the original text.

The automaton reads a word as two digits of its number among the benchmark's
words, in a base of about the square root of their count: so it has at most
2 x ``words`` states a word of the benchmark, whatever the words' length (1.3 KB a word
of ten-word windows), and no state with many ways on. Beyond BLOCK_WORDS the
benchmark is scanned in blocks, one after the other.

Null, empty and wordless texts have no words and no hits. Items without words
match nothing; repeated items count each by its id. Windows of an item with a
null id count as hits, but such an item is in no list of items. Repeated rows give repeated
rows; an empty table, or an empty benchmark, gives rows without hits. Texts of
any length are scanned in whole. Only the id and the text are read, so other
columns can't clash.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import repeat

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import checkpoint, column_of, map_rows, text_of

#: Benchmark words that one automaton takes (some 250 MB); a larger benchmark is scanned in blocks of this size.
BLOCK_WORDS = 250_000

_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b > 127 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")
_HITS = "array<struct<first:int,last:int>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


class Windows:
    """The automaton of all windows over words' digits; "\\0\\0" stands for words that the benchmark hasn't."""

    def __init__(self, items: list[tuple[str | None, str | None]], words: int):
        split = [(item, words_of(text)) for item, text in items]
        found = sorted({w for _, ws in split for w in ws})
        base = math.isqrt(len(found)) + 1
        #: First and second digits are different letters, so matches begin at words alone.
        self.digits = {w: chr(1 + i // base) + chr(1 + base + i % base) for i, w in enumerate(found)}
        windows: dict[str, tuple[int, set[str]]] = {}
        for item, ws in split:
            line = "".join(map(self.digits.__getitem__, ws))
            for i in range(max(1, len(ws) - words + 1) if ws else 0):
                part = line[2 * i : 2 * (i + words)]
                windows.setdefault(part, (len(part) // 2, set()))[1].update([] if item is None else [item])
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        #: By the automaton's values, each window's words and items.
        self.known: list[tuple[int, list[str]]] = []
        for part, (n, ids) in windows.items():
            self.automaton.add_word(part, len(self.known))
            self.known.append((n, sorted(ids)))
        if self.known:
            self.automaton.make_automaton()

    def hits(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(last word, window) of each occurrence."""
        if self.known and words:
            for end, window in self.automaton.iter("".join(map(self.digits.get, words, repeat("\0\0")))):
                yield end // 2, window


_LAST: list = [None, None]


def sender(items: DataFrame, words: int) -> Callable[[], Windows]:
    """The automaton of a block's items: they are broadcast, and it is built once a Python worker, which holds one at a time."""
    shipped, name = items.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in items.collect()]), uuid.uuid4().hex

    def windows() -> Windows:
        if _LAST[0] != name:
            _LAST[:] = [None, None]
            _LAST[:] = [name, Windows(shipped.value, words)]
        return _LAST[1]

    return windows


def _merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def spans_of(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Character offsets in the original text, end excluded, of runs of words."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.translate(_NORMAL))]
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [{"start": int(chars[at[a][0]]), "end": int(chars[at[b][1]])} for a, b in runs]


def _scan(state: DataFrame, items: DataFrame, words: int, final: bool) -> DataFrame:
    """Add one block's hits and items to what the blocks before have found; the final block gives spans in place of texts."""
    sent = sender(items, words)

    def make():
        windows = sent()
        known = windows.known

        def one(text, runs, ids):
            w, found, seen = words_of(text), [(r["first"], r["last"]) for r in runs], set()
            for last, k in windows.hits(w):
                found.append((last - known[k][0] + 1, last))
                seen.add(k)
            if not seen:
                return len(w), runs, ids
            return len(w), [{"first": a, "last": b} for a, b in _merge(found)], sorted({*ids, *(i for k in seen for i in known[k][1])})

        def work(cols):
            rows = [one(*x) for x in zip(cols["text"], cols["runs"], cols["items"])]
            out = {"doc_id": cols["doc_id"], "n_words": [r[0] for r in rows], "items": [r[2] for r in rows]}
            if not final:
                return out | {"text": cols["text"], "runs": [r[1] for r in rows]}
            runs = [[(x["first"], x["last"]) for x in r[1]] for r in rows]
            return out | {"n_hit": [sum(b - a + 1 for a, b in r) for r in runs], "spans": [spans_of(t, r) if r else [] for t, r in zip(cols["text"], runs)]}

        return work

    return map_rows(state, make, "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>" if final else f"doc_id long, text string, n_words long, runs {_HITS}, items array<string>")


def scan(docs: DataFrame, benchmark: DataFrame, *, words: int = 10, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, items (ids, sorted as strings) and spans of the original text.

    The benchmark's words are counted first. Up to ``block_words`` it is one
    broadcast automaton; beyond, blocks of that size scan in turn, without a
    shuffle. What a block has found is written before the next is sent, so a
    task holds one automaton, whatever the benchmark's size.
    """
    blocks = _blocks(benchmark, block_words)
    state = text_of(docs, id_col, text_col).withColumns({"n_words": F.lit(0).cast("long"), "runs": F.expr(f"CAST(array() AS {_HITS})"), "items": F.expr("CAST(array() AS array<string>)")})
    for i, items in enumerate(blocks, 1):
        state = _scan(state, items, words, i == len(blocks))
        if i < len(blocks):
            state = checkpoint(state)
    return state


def _blocks(benchmark: DataFrame, block_words: int) -> list[DataFrame]:
    """The benchmark in parts of about ``block_words``, by its counted words."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    count = items.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")))).first()[0] or 0
    n = max(1, -(-count // block_words))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) for b in range(n)]


def clean(docs: DataFrame, benchmark: DataFrame, *, words: int = 10, block_words: int = BLOCK_WORDS, text_col: str = "text") -> DataFrame:
    """The documents that hold no window, dropped where they are, without a join; each block's rest is written before the next block."""
    blocks = _blocks(benchmark, block_words)
    for i, items in enumerate(blocks, 1):
        docs = docs.where(column_of(docs.sparkSession, _clean_of(sender(items, words)), "boolean", F.col(text_col).cast("string")))
        if i < len(blocks):
            docs = checkpoint(docs)
    return docs


def _clean_of(sent: Callable[[], Windows]):
    def make():
        windows = sent()
        return lambda texts: [next(windows.hits(words_of(t)), None) is None for t in texts]

    return make


def digests(scanned: DataFrame) -> DataFrame:
    return scanned.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
