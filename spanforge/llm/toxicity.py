"""Toxicity scores by a weighted finite-state pattern grammar.

A lexicon transducer (a trie over letters) writes a symbol for each word:
insult, threat, target, negation, report or other; sentence ends, pauses
(commas, colons), quotation marks and line ends have symbols too. Insult stems
(whole words, or beginnings that an ending follows) and their weights are
learned from labelled rows; the other classes are small word lists. Three
transducers rewrite the symbols and are composed into one table when a task
starts:

* negation: an insult or threat up to ``REACH`` symbols after a negation, in one
  clause, becomes a negated one;
* reported speech: after a report word, over pauses, up to the sentence's end,
  what matched becomes reported; a quotation that opens there is reported to its
  closing mark;
* target: an insult or threat up to ``REACH`` symbols after a target becomes an
  aimed one.

An acceptor weighs the matched symbols of each clause (between pauses or ends)
and a document adds its clauses up. Weights are fitted to the labelled rows by
logistic regression: those of affirmed matches are not negative, those of
negated and reported ones have the sign that the rows give them.

Null and empty texts match no clause and get the score of a text without
matches. Texts of any length are read in whole. Repeated rows get equal scores;
an empty table gives an empty result, and without labelled rows of both kinds
all scores fall on the side of the kind there is (0 if none). Ids that repeat
among labels count once, as toxic if any of their rows is. Only the id and the
text are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections import Counter
from math import exp, log, log1p

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import column_of, map_rows, text_of

#: Bounds of the training sample: rows of label 1 and of label 0, characters a row.
TOXIC_ROWS, CLEAN_ROWS = 2_000, 9_000
LONGEST_ROW = 20_000
#: Words whose symbols a task remembers at a time.
MEMO_WORDS = 100_000
REACH = 4
#: A stem counts as an insult from so many labelled toxic texts, such a log-odds ratio and such a G statistic on.
STEM_ROWS, STEM_ODDS, STEM_G = 5, 2.0, 20.0
#: Letters of the beginnings of words that are looked at.
STEM_LETTERS = (4, 9)

THREATS = "kill hurt destroy stab shoot strangle töten umbringen tuer frapper matar golpear".split()
TARGETS = "you your youre yourself u he she they them these those people du dich dir ihr euch tu toi vous te ti usted ustedes".split()
NEGATIONS = "not never no nobody isnt arent nicht kein keine nie ne pas jamais nunca jamás".split()
REPORTS = "said says say told wrote writes called calls reported quoted alleged sagte schrieb dit écrit dijo escribió".split()

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, END, PAUSE, QUOTE, BREAK = range(10)
#: Symbols that the composed transducer may write for a match.
MATCHES = ("insult", "threat", "aimed_insult", "aimed_threat", "negated", "reported")
AFFIRMED = MATCHES[:4]

_LETTERS = re.compile(r"[^\W\d_]+")
_PARTS = re.compile(r"(?P<word>[^\W\d_]+)|(?P<end>[.!?;]+)|(?P<pause>[,:]+)|(?P<quote>[\"“”„«»])")
_MARKS = {"end": (END, 0.0), "pause": (PAUSE, 0.0), "quote": (QUOTE, 0.0)}


class Transducer:
    """Deterministic, total: ``step(state, symbol)`` gives the next state and the symbol written."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def compose(self, after: Transducer) -> Transducer:
        """First this one, then ``after`` on what it wrote."""

        def step(state, symbol):
            left, written = self.step(state[0], symbol)
            right, out = after.step(state[1], written)
            return (left, right), out

        return Transducer((self.start, after.start), step)

    def table(self, symbols) -> tuple[list[dict], int]:
        """Reachable states as rows ``{symbol: (next row, written)}``; the start is row 0."""
        at, rows, todo = {self.start: 0}, [], [self.start]
        while todo:
            state = todo.pop(0)
            row = {}
            for s in symbols:
                nxt, out = self.step(state, s)
                if nxt not in at:
                    at[nxt] = len(at)
                    todo.append(nxt)
                row[s] = (at[nxt], out)
            rows.append(row)
        return rows, 0


def _within_reach(trigger: int, rewrite: dict, ends: tuple[int, ...]) -> Transducer:
    """Rewrites symbols that come up to REACH symbols after the trigger, with none of ``ends`` between."""

    def step(left, symbol):
        if symbol in ends:
            return 0, symbol
        if symbol == trigger:
            return REACH, symbol
        return max(0, left - 1), rewrite.get(symbol, symbol) if left else symbol

    return Transducer(0, step)


def _reported() -> Transducer:
    """States: plain, after a report word, inside a quotation that opened there."""

    def step(state, symbol):
        if symbol == BREAK or symbol == END and state < 2:
            return 0, symbol
        if symbol == QUOTE:
            return (0, 2, 1)[state], symbol
        if symbol == REPORT and state == 0:
            return 1, symbol
        return state, "reported" if state and symbol in (INSULT, THREAT, "negated") else symbol

    return Transducer(0, step)


def _named() -> Transducer:
    """What is still plain is named for the acceptor."""
    return Transducer(0, lambda state, s: (0, {INSULT: "insult", THREAT: "threat"}.get(s, s)))


def grammar() -> list[dict]:
    negation = _within_reach(NEGATION, {INSULT: "negated", THREAT: "negated"}, (PAUSE, END, QUOTE, BREAK))
    target = _within_reach(TARGET, {INSULT: "aimed_insult", THREAT: "aimed_threat"}, (END, BREAK))
    return negation.compose(_reported()).compose(target).compose(_named()).table(range(10))[0]


class Lexicon(dict):
    """Symbols and weights of white-space separated tokens, by a trie over letters; remembered for a while.

    A stem "idiot$" is a whole word, "lowei+" a beginning that more letters follow.
    """

    def __init__(self, stems: dict[str, float]):
        self.trie: dict = {}
        words = [(w + "$", symbol, 3.0) for symbol, group in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in group]
        for word, symbol, weight in [*words, *((s, INSULT, w) for s, w in stems.items())]:
            node = self.trie
            for c in word:
                last, node = node, node.setdefault(c, {})
            last[word[-1]] = (symbol, weight)

    def symbol(self, word: str) -> tuple[int, float]:
        node, best = self.trie, (OTHER, 0.0)
        for c in word:
            best = node.get("+", best)
            node = node.get(c)
            if node is None:
                return best
        return node.get("$", best)

    def __missing__(self, token: str) -> tuple[tuple[int, float], ...]:
        if len(self) >= MEMO_WORDS:
            self.clear()
        low = token.lower().replace("'", "").replace("’", "")
        out = [self.symbol(m.group()) if m.lastgroup == "word" else _MARKS[m.lastgroup] for m in _PARTS.finditer(low)]
        found = tuple(out)
        if len(token) <= 64:
            self[token] = found
        return found


class Hot(dict):
    """Whether a token holds an insult or a threat."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def __missing__(self, token: str) -> bool:
        if len(self) >= MEMO_WORDS:
            self.clear()
        found = any(s in (INSULT, THREAT) for s, _ in self.lexicon.__missing__(token))
        if len(token) <= 64:
            self[token] = found
        return found


class Matcher:
    def __init__(self, stems: dict[str, float]):
        self.lexicon, self.rows = Lexicon(stems), grammar()
        self.hot = Hot(self.lexicon)

    def clauses(self, text: str | None) -> Counter:
        """For each kind of match the weights of the clauses that have it, the heaviest match of each clause."""
        found: Counter = Counter()
        tokens = (text or "").split()
        if not any(map(self.hot.__getitem__, tokens)):
            return found
        state, clause, rows = 0, {}, self.rows
        for line in text.split("\n"):
            for token in line.split():
                for symbol, weight in self.lexicon[token]:
                    state, out = rows[state][symbol]
                    if out == END or out == PAUSE:
                        found.update(clause)
                        clause = {}
                    elif isinstance(out, str):
                        clause[out] = max(weight, clause.get(out, 0.0))
            state = rows[state][BREAK][0]
            found.update(clause)
            clause = {}
        return found


def features(clauses: Counter) -> list[float]:
    return [1.0, *(log1p(clauses[k]) for k in MATCHES), log1p(sum(clauses[k] for k in AFFIRMED))]


def score_of(clauses: Counter, weights: list[float]) -> float:
    x = sum(a * b for a, b in zip(features(clauses), weights))
    return 1 / (1 + exp(-max(-30.0, min(30.0, x))))


def training_sample(docs: DataFrame, labels: DataFrame, *, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, longest: int = LONGEST_ROW) -> list[tuple[str, int]]:
    """At most so many labelled texts of each label, none above ``longest`` characters, chosen by a hash of the id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    marked = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(1 << 30)
    most = {0: clean_rows, 1: toxic_rows}
    share = {k: min(1.0, 1.2 * n / max(1, counts.get(k, 0))) for k, n in most.items()}
    drawn = marked.withColumn("draw", draw).where(F.col("draw") < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))  # bounded, whatever the input
    texts = text_of(docs).where(F.col("text").isNotNull() & (F.length("text") <= longest))
    # One text an id, so that what is collected is bounded by the ids drawn.
    got = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic", "draw").agg(F.min("text").alias("text")).collect()
    kept: dict[int, list] = {0: [], 1: []}
    for r in sorted(got, key=lambda r: (r["draw"], r["doc_id"])):
        if len(kept[r["toxic"]]) < most[r["toxic"]]:
            kept[r["toxic"]].append(r["text"])
    return [(t, y) for y in (0, 1) for t in kept[y]]


def learn_stems(sample: list[tuple[str, int]]) -> dict[str, float]:
    """Stems that mark toxic texts, with log-odds: "word$" or "beginning+".

    Taken in order of their G statistic; of stems of which one begins the other
    only the first is kept.
    """
    counts = (Counter(), Counter())
    totals = [sum(1 for _, y in sample if y == k) for k in (0, 1)]
    for text, y in sample:
        seen = set()
        for w in set(_LETTERS.findall(text.lower())):
            if len(w) > 2:
                seen.add(w + "$")
                seen.update(w[:n] + "+" for n in range(STEM_LETTERS[0], min(len(w) - 1, STEM_LETTERS[1]) + 1))
        counts[y].update(seen)

    def g(a: int, b: int) -> float:
        """Of a of the toxic and b of the clean texts, against one rate for both."""
        p = (a + b) / sum(totals)
        bits = ((a, totals[1] * p), (b, totals[0] * p), (totals[1] - a, totals[1] * (1 - p)), (totals[0] - b, totals[0] * (1 - p)))
        return 2 * sum(n * log(n / e) for n, e in bits if n and e)

    found = []
    for s, a in counts[1].items():
        b = counts[0][s]
        odds = log((a + 0.5) / (totals[1] + 1)) - log((b + 0.5) / (totals[0] + 1))
        if a >= STEM_ROWS and odds >= STEM_ODDS and (score := g(a, b)) >= STEM_G:
            found.append((-score, not s.endswith("$"), s, odds))
    kept: dict[str, float] = {}
    begun: set[str] = set()
    for _, _, s, odds in sorted(found):
        bare = s[:-1]
        if bare in begun or any(bare[:n] + "+" in kept for n in range(1, len(bare))):
            continue
        kept[s] = odds
        begun.update(bare[:n] for n in range(STEM_LETTERS[0], len(bare) + (s[-1] == "+")))
    return kept


def fit(sample: list[tuple[str, int]], *, ridge: float = 0.02, rounds: int = 100) -> tuple[dict[str, float], list[float]]:
    """Stems and weights (bias, MATCHES, all affirmed): Newton steps with a ridge, kept at bounds where they are met."""
    stems = learn_stems(sample)
    if len({y for _, y in sample}) < 2:
        return stems, [-4.0 if not sample or sample[0][1] == 0 else 4.0, *[0.0] * len(MATCHES), 3.0]
    matcher = Matcher(stems)
    x = np.array([features(matcher.clauses(t)) for t, _ in sample])
    y = np.array([float(v) for _, v in sample])
    penalty = np.diag([1e-6, *[ridge] * (len(MATCHES) + 1)]) * len(y) / 100
    bounded = np.array([False, *(k in AFFIRMED for k in MATCHES), True])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty @ w
        free = ~(bounded & (w <= 0) & (slope > 0))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w))
        step = np.zeros_like(w)
        step[free] = np.clip(np.linalg.solve(h[np.ix_(free, free)], slope[free]), -3, 3)
        after = np.where(bounded, np.maximum(w - step, 0.0), w - step)
        if abs(after - w).max() < 1e-8:
            break
        w = after
    return stems, [float(v) for v in w]


def predict(docs: DataFrame, stems: dict[str, float], weights: list[float], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, score, clauses (weights of the matched ones, by kind)."""
    shipped = docs.sparkSession.sparkContext.broadcast((stems, weights))

    def make():
        stems, weights = shipped.value
        matcher = Matcher(stems)

        def work(cols):
            found = [matcher.clauses(t) for t in cols["text"]]
            return {"doc_id": cols["doc_id"], "score": [score_of(c, weights) for c in found], "clauses": [dict(c) for c in found]}

        return work

    return map_rows(text_of(docs, id_col, text_col), make, "doc_id long, score double, clauses map<string,double>")


def score_column(spark: SparkSession, text: Column, stems: dict[str, float], weights: list[float]) -> Column:
    """The score as a column, so that rows can be kept or dropped where they are, without a join."""
    shipped = spark.sparkContext.broadcast((stems, weights))

    def make():
        stems, weights = shipped.value
        matcher = Matcher(stems)
        return lambda texts: [score_of(matcher.clauses(t), weights) for t in texts]

    return column_of(spark, make, "double", text.cast("string"))
