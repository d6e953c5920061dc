"""Token counts of SentencePiece BPE models by whole-token shortcut.

Offline, on the driver, each vocabulary string is merged by itself; those that
come out as one token are the whole tokens. Also proved there, from the
vocabulary, is a split of texts into pre-tokens that no merge can cross: no
vocabulary string holds a pair of neighbouring characters that the split may
separate. Tasks count pre-tokens that are whole tokens directly and merge only
the rest.

Null texts count as empty ones (0 tokens); strings of control tokens inside a
text are ordinary text, as is the library's default. Of merges with equal scores
the leftmost goes first, as in the library. Texts of any length are counted in whole. Repeated
rows give repeated rows; an empty table gives an empty result. Only the id and the
text are read, so other columns can't clash.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import map_rows, text_of

#: SentencePiece's mark for a space; a fixed value.
SPACE = "▁"
#: Pre-tokens whose counts a task remembers at a time.
MEMO_WORDS = 300_000
#: Splits from fine to coarse, with the pairs of classes that each may separate:
#: S space mark, P ASCII punctuation, D ASCII digit, L line ends and tabs, W the rest.
_P, _W = r"!-/:-@\[-`{-~", rf"[^{SPACE}\x00-/:-@\[-`{{-~0-9]"
SPLITS = [
    (rf"{SPACE}*[{_P}]*{_W}+|{SPACE}*[{_P}]+|{SPACE}+|[0-9]|[\x00-\x20]|\x7f", {"WS", "WP", "WD", "WL", "PS", "PD", "PL", "SD", "SL", "DS", "DP", "DD", "DL", "DW", "LS", "LP", "LD", "LL", "LW"}),
    (rf"{SPACE}*[^{SPACE}\x00-\x20]+|{SPACE}+|[\x00-\x20]", {"WS", "PS", "DS", "WL", "PL", "DL", "SL", "LS", "LP", "LD", "LL", "LW"}),
    (rf"{SPACE}*[^{SPACE}]+|{SPACE}+", {"WS", "PS", "DS", "LS"}),
    (r"(?s).+", set()),
]


def kind(c: str) -> str:
    if c == SPACE:
        return "S"
    if c <= " " or c == "\x7f":
        return "L"
    if "0" <= c <= "9":
        return "D"
    return "P" if c < "\x7f" and not c.isalpha() else "W"


@dataclass
class Vocabulary:
    rank: dict[str, float]  #: strings that merges may make, the best lowest
    single: set[str]  #: characters with a token of their own
    whole: set[str]  #: strings proved to encode alone as one token
    split: str
    prefix: str


def merged(word: str, rank: dict[str, float]) -> list[str]:
    """BPE: the best-ranked pair first, the leftmost among equals."""
    parts, none = list(word), float("inf")
    get = rank.get
    if len(parts) > 200:
        return _merged_long(parts, rank)
    ranks = [get(a + b, none) for a, b in zip(parts, parts[1:])]
    while ranks:
        best = min(ranks)
        if best == none:
            break
        i = ranks.index(best)
        parts[i] += parts.pop(i + 1)
        ranks.pop(i)
        if i < len(ranks):
            ranks[i] = get(parts[i] + parts[i + 1], none)
        if i:
            ranks[i - 1] = get(parts[i - 1] + parts[i], none)
    return parts


def _merged_long(parts: list[str], rank: dict[str, float]) -> list[str]:
    """As merged(), with a queue of pairs: n log n for words of any length."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [(r, i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank.get(a + b)) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, made = heapq.heappop(queue)
        j = after[i]
        if not parts[i] or j >= n or parts[i] + parts[j] != made:
            continue
        parts[i], parts[j] = made, ""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := rank.get(parts[a] + parts[b])) is not None:
                heapq.heappush(queue, (r, a, parts[a] + parts[b]))
    return [p for p in parts if p]


def load(model: str) -> Vocabulary:
    """Read a model file and prove its whole tokens and its split."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(model, "rb") as f:
        proto.ParseFromString(f.read())
    norm, kinds = proto.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
    plain = norm.name == "identity" and not norm.remove_extra_whitespaces and not proto.trainer_spec.treat_whitespace_as_suffix
    if proto.trainer_spec.model_type != proto.trainer_spec.BPE or not plain or not proto.trainer_spec.byte_fallback:
        raise ValueError("only BPE models with byte fallback and without normalization are supported")
    if any(p.type not in (kinds.NORMAL, kinds.BYTE, kinds.CONTROL, kinds.UNKNOWN) for p in proto.pieces):
        raise ValueError("user-defined and unused pieces aren't supported")
    rank = {p.piece: -p.score for p in proto.pieces if p.type == kinds.NORMAL and len(p.piece) > 1}
    single = {p.piece for p in proto.pieces if p.type == kinds.NORMAL and len(p.piece) == 1}
    joined = {kind(a) + kind(b) for p in rank for a, b in zip(p, p[1:])}
    split = next(pattern for pattern, cuts in SPLITS if not cuts & joined)
    return Vocabulary(rank, single, single | {p for p in rank if merged(p, rank) == [p]}, split, SPACE if norm.add_dummy_prefix else "")


class Counter(dict):
    """Counts of pre-tokens: whole tokens at once, others by merging, remembered for a while."""

    def __init__(self, vocabulary: Vocabulary, most: int = MEMO_WORDS):
        super().__init__(dict.fromkeys(vocabulary.whole, 1))
        self.vocabulary, self.most = vocabulary, most + len(vocabulary.whole)

    def __missing__(self, word: str) -> int:
        v = self.vocabulary
        if len(self) >= self.most:
            self.clear()
            self.update(dict.fromkeys(v.whole, 1))
        n = sum(1 if p in v.rank or p in v.single else len(p.encode()) for p in merged(word, v.rank))
        if len(word) <= 64:
            self[word] = n
        return n


def count(docs: DataFrame, model: str, *, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_bytes (UTF-8), n_tokens, n_pretokens, over_limit (n_tokens > limit).

    ``model`` is the file's path, read by the driver; the proved vocabulary
    (some MB, whatever the input) goes to tasks as a broadcast variable.
    Repeated rows give repeated rows; an empty table gives an empty result.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(load(model))

    def make():
        vocabulary = shipped.value
        get, split, prefix = Counter(vocabulary).__getitem__, regex.compile(vocabulary.split).findall, vocabulary.prefix

        def work(cols):
            n_tokens, n_words = [], []
            for text in cols["text"]:
                words = split(prefix + text.replace(" ", SPACE)) if text else []
                n_words.append(len(words))
                n_tokens.append(sum(map(get, words)))
            return {"doc_id": cols["doc_id"], "n_bytes": cols["n_bytes"], "n_tokens": n_tokens, "n_pretokens": n_words}

        return work

    counted = map_rows(text_of(docs, id_col, text_col).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")), make, "doc_id long, n_bytes long, n_tokens long, n_pretokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
