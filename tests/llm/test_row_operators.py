"""Operators that work row by row, against the libraries and against brute force."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanforge.llm import bpe_automaton as bpe
from spanforge.llm import decontamination as dc
from spanforge.llm import language_id as li
from spanforge.llm import license_scan as ls
from spanforge.llm import quality_rules as qr
from spanforge.llm import queries as q
from spanforge.llm import token_count as tc
from spanforge.llm import toxicity as tox
from tests.compare import assert_same, oracle
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"
TEXT = st.text(st.sampled_from("aeehttionrs   '.,(_-\n\t\r19!éüñ中▁😀\x1c\x85\x7f<|endoftext|>"), max_size=60)


@pytest.fixture(scope="module")
def byte_bpe():
    from tokenizers import Tokenizer

    path = q.vocabulary("byte_bpe_50k.json")
    return bpe.Codec(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_bpe_equals_the_library(byte_bpe, text):
    codec, library = byte_bpe
    want = library.encode(text, add_special_tokens=False).ids
    packed = codec.encode_packed(text)
    assert list(memoryview(packed).cast("I")) == want
    assert codec.decode_packed(packed) == library.decode(want, skip_special_tokens=False)


def test_bpe_special_strings_and_long_words(byte_bpe):
    codec, library = byte_bpe
    for text in ("a<|endoftext|> b<|endoftext|>", "ab" * 3000, "a" * 3000, " " * 500 + "x", "\n" * 300):
        assert list(memoryview(codec.encode_packed(text)).cast("I")) == library.encode(text, add_special_tokens=False).ids


def test_bpe_equals_the_library_on_every_code_point(byte_bpe):
    """Each code point after and before a contraction, a letter, a digit, a mark and a blank."""
    codec, library = byte_bpe
    points = [chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    texts = [" | ".join("{0}'ll a{0}1{0}!{0} {0}b".format(c) for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(codec.encode_packed(text), "<u4").tolist() == want.ids, text


def test_compiled_table(byte_bpe):
    import pickle

    codec, library = byte_bpe
    auto = codec.automaton
    assert len(auto.ids) == 50_256 and auto.bits.nbytes < 32 << 20
    table = {(a, b): auto.has(auto.row[auto.ids[a]], auto.column[auto.ids[b]]) for a, b in ((b"t", b"h"), (b"t", b"he"), (b"q", b"z"), (b" t", b"he"))}
    assert table == {(b"t", b"h"): 0, (b"t", b"he"): 0, (b"q", b"z"): 1, (b" t", b"he"): 0}
    again = pickle.loads(pickle.dumps(codec))
    assert again.encode_packed("Tables travel well") == codec.encode_packed("Tables travel well")


def test_merge_automaton_on_small_alphabets():
    rng = random.Random(3)
    for _ in range(150):
        merges, tokens = [], [b"a", b"b", b"c"]
        for i in range(rng.randint(1, 12)):
            x, y = rng.choice(tokens), rng.choice(tokens)
            if x + y not in tokens:
                merges.append((x, y, 3 + i))
                tokens.append(x + y)
        auto = bpe.MergeAutomaton([(b"a", 0), (b"b", 1), (b"c", 2)], merges)
        for _ in range(30):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12)))
            parts = [word[i : i + 1] for i in range(len(word))]
            for x, y, _ in merges:  # the merges one after another, each everywhere from the left
                out, i = [], 0
                while i < len(parts):
                    if parts[i : i + 2] == [x, y]:
                        out.append(x + y)
                        i += 2
                    else:
                        out.append(parts[i])
                        i += 1
                parts = out
            assert auto.encode(word) == [auto.ids[p] for p in parts]


def test_op10(spark, byte_bpe):
    got = q.op10_bpe(spark, SF).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    for i, t in zip(docs.doc_id, docs.text):
        ids = byte_bpe[1].encode(t or "", add_special_tokens=False).ids
        assert tuple(got.loc[i]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_bpe_odd(odd, none):
    path = q.vocabulary("byte_bpe_50k.json")
    got = bpe.encode_decode(odd, path).collect()
    assert len(got) == odd.count() and {r.n_tokens for r in got if r.decoded == ""} == {0}
    assert bpe.digests(bpe.encode_decode(none, path)).count() == 0


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    path = q.vocabulary("piece_bpe_32k.model")
    v = tc.load(path)
    counter, split = tc.Counter(v), __import__("regex").compile(v.split).findall
    return (lambda t: sum(map(counter.__getitem__, split(v.prefix + t.replace(" ", tc.SPACE)))) if t else 0), sentencepiece.SentencePieceProcessor(model_file=path), v


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_counts_equal_the_library(pieces, text):
    count, library, _ = pieces
    assert count(text) == len(library.encode(text))


def test_whole_tokens_are_proved_and_long_words_merge(pieces):
    count, library, v = pieces
    assert len(v.whole) > 30_000 and all(tc.merged(w, v.rank) == [w] for w in list(v.whole)[:500])
    for text in ("a" * 5000, " " * 3000 + "x", "<s></s><unk><0x0A>", "ab12" * 400):
        assert count(text) == len(library.encode(text))
    word = "internationalization" * 12
    assert tc._merged_long(list(word), v.rank) == tc.merged(word[:200], v.rank)[:0] + tc._merged_long(list(word), v.rank)
    assert tc._merged_long(list(word[:150]), v.rank) == tc.merged(word[:150], v.rank)


def test_op3(spark, pieces, odd, none):
    got = q.op3_token_counts(spark, SF).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    for i, t in zip(docs.doc_id, docs.text):
        n = len(pieces[1].encode(t))
        assert (got.n_bytes[i], got.n_tokens[i], got.over_limit[i]) == (len(t.encode()), n, n > 4096)
    path = q.vocabulary("piece_bpe_32k.model")
    assert sorted((r.n_bytes, r.n_tokens) for r in tc.count(odd, path).collect())[:2] == [(0, 0), (0, 0)] and tc.count(none, path).count() == 0


def words7(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute_windows(texts, items, n=10):
    out = []
    for t in texts:
        w, hit, seen = words7(t), set(), set()
        for item, x in items:
            v = words7(x)
            for win in {tuple(v[i : i + n]) for i in range(max(1, len(v) - n + 1))} if v else ():
                for i in range(len(w) - len(win) + 1):
                    if tuple(w[i : i + len(win)]) == win:
                        hit.update(range(i, i + len(win)))
                        seen.add(str(item))
        out.append((len(w), len(hit), sorted(seen)))
    return out


def test_decontamination(spark, odd, none):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    rows = docs.collect()
    want = {r.doc_id: x for r, x in zip(rows, brute_windows([r.text for r in rows], items))}
    for kw in ({}, {"block_words": 300}):  # one automaton, and many blocks
        got = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in dc.scan(docs, bench, **kw).collect()}
        assert got == want
        clean = {r.doc_id for r in dc.clean(docs, bench, **kw).select("doc_id").collect()}
        assert clean == {i for i, (_, hit, _) in want.items() if not hit}
    assert dc.scan(odd, bench).count() == odd.count() and dc.scan(none, bench).count() == 0
    assert all(r.n_hit == 0 for r in dc.scan(odd, bench.limit(0)).collect())
    digest = {r.doc_id: r for r in q.op7_decontamination(spark, SF).collect()}
    for i, (n, hit, seen) in want.items():
        assert tuple(digest[i])[1:] == (n, hit, len(seen), hashlib.sha256(",".join(seen).encode()).hexdigest(), hit > 0)


def test_decontamination_short_items_overlaps_and_offsets(spark, frame):
    bench = spark.createDataFrame([(1, "Two words"), (2, None), (3, "..."), (10, " ".join("abcdefghijkl")), (11, "two WORDS")], "item_id long, text string")
    text = "Ünï two,words! A b-c d e f g h i j k l x two two words"
    r = dc.scan(frame([text]), bench).first()
    assert (r.n_hit, r.items) == (2 + 12 + 2, ["1", "10", "11"])
    assert [text[s.start : s.end] for s in r.spans] == ["two,words! A b-c d e f g h i j k l", "two words"]


def test_an_automaton_is_bounded_by_its_words():
    """States are words of windows, not their letters; a worker holds one block's automaton."""
    long = " ".join("x" * 200 + str(i) for i in range(40))
    states = {t: dc.Windows([("a", t)], 10).automaton.get_stats()["nodes_count"] for t in (long, long.replace("x", ""))}
    assert set(states.values()) == {states[long]} and states[long] <= 31 * 20 + 1
    assert list(dc.Windows([], 10).hits([b"a"])) == [] and list(dc.Windows([("a", "b c")], 10).hits([b"a", b"b", b"c"])) == [(2, 0)]


def test_items_without_an_id_contaminate(spark, frame):
    bench = spark.createDataFrame([(None, "lost and found"), (None, "red fox"), (7, "red fox")], "item_id long, text string")
    docs = frame(["it was lost and found", "a red fox", "nothing here"])
    for kw in ({}, {"block_words": 2}):
        got = {r.doc_id: (r.n_hit, r.items) for r in dc.scan(docs, bench, **kw).collect()}
        assert got == {0: (3, []), 1: (2, ["7"]), 2: (0, [])}
        assert [r.doc_id for r in dc.clean(docs, bench, **kw).collect()] == [2]
    assert [r.contaminated for r in dc.digests(dc.scan(docs, bench)).orderBy("doc_id").collect()] == [True, True, False]


def test_op1_equals_its_sql_and_brute_force(spark, odd, none, frame):
    got = q.op1_quality_rules(spark, SF)
    assert_same(got.toPandas(), oracle(qr.ORACLE, "sf0.001"))
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")

    def base(t):
        w, cover = words(t), set()
        wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        for i, x in enumerate(wins):
            if wins.count(x) > 1:
                cover.update(range(i, i + 5))
        lines = [x for x in (t or "").split("\n") if words(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)

    texts = [None, "", "a b c d e a b c d e", "x\nx\n \n x\ny", "# a|b\n\x0b\x1c", "one two three four five six " * 3, "e e e e e e e"]
    rows = {r.doc_id: tuple(r)[1:6] for r in qr.evaluate(frame(texts)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}
    assert rows == {i: base(t) for i, t in enumerate(texts)}
    out = qr.evaluate(odd).collect()
    assert len(out) == odd.count() and all(r.base_failed and not r.kept for r in out if r.n_words < 10)
    assert qr.evaluate(none).count() == 0
    assert "Python" not in got._jdf.queryExecution().toString()


def test_lines_are_cleaned_first(frame):
    good = "This is a sentence with quite enough words to stay in the text."
    more = "Another line follows here, and it says something else entirely."
    r = qr.evaluate(frame([f"Home\n{good}\nAccept cookie settings.\na | b | c | d\n{more}"])).first()
    assert r.cleaned.split("\n") == [good, more] and r.kept and r.n_lines_removed == 3
    assert not qr.evaluate(frame(["Home\n" + "menu | bar | with | very | many | items | that | is | long | enough\n" * 2])).first().kept


def test_license_retrieval_misses_nothing(spark, odd, none, frame):
    rng = random.Random(5)
    filler = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) for _ in range(n))
    texts, want = [], []
    for _ in range(40):
        name = rng.choice(sorted(ls.TEMPLATES))
        w = ls.TEMPLATES[name].split()
        if len(w) > 40 and rng.random() < 0.5:
            w[len(w) // 2] = "changed"
        texts.append(f"{filler(rng.randint(0, 90))} {' '.join(w)} {filler(rng.randint(0, 90))}")
        want.append(name)
    got = {r.doc_id: r.licenses for r in ls.scan(frame(texts)).collect()}
    assert all(n in got[i] for i, n in enumerate(want))
    # every window of every template held in full against brute force
    prepared = [ls.prepare(n, t) for n, t in sorted(ls.TEMPLATES.items())]
    memo = ls.WordHashes()
    for i, text in enumerate(texts):
        h = ls.shingle_hashes(np.array([memo[w] for w in ls.words_of(text)], np.uint64)).tolist()
        full = {t.name for t in prepared if any(len(t.shingles & set(h[a : a + t.window - 4])) >= 0.8 * len(t.shingles) for a in range(0, len(h), t.stride))}
        assert set(got[i]) == full
    assert all(r.licenses == [] for r in ls.scan(odd).collect()) and ls.scan(none).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    op = q.op2_license_scan(spark, SF).toPandas().set_index("doc_id").licenses
    for mark, name in (("Apache License, Version 2.0.", "apache-2.0"), ("the MIT License.", "mit"), ("CC BY-NC 4.0.", "cc-by-nc-4.0"), ("General Public License, version 3.", "gpl-3.0")):
        assert {i for i, x in op.items() if name in x} == set(docs.doc_id[docs.text.str.contains(mark, regex=False)])


def test_templates_of_a_size_are_looked_up_together():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    made = {f"t{i:03d}": " ".join(word() for _ in range(rng.randint(6, 60))) for i in range(120)}
    made["t003"] = made["t002"]  # two of one text
    prepared = [ls.prepare(n, t) for n, t in sorted(made.items())]
    tables, memo = ls.band_tables(prepared), ls.WordHashes()
    assert len(tables) == len({t.words for t in prepared}) < 8 and sum(len(k) for t in tables for k in t.keys[:1]) == 120
    missed = 0
    for name, text in made.items():
        inserted = text.split()
        if len(inserted) > 40:
            inserted.insert(20, "inserted")
        own = " ".join([*(word() for _ in range(rng.randint(0, 70))), *inserted, *(word() for _ in range(rng.randint(0, 70)))])
        found = {m["template"] for m in ls.scan_texts([own], prepared, tables, memo)[0]}
        missed += name not in found
        assert found <= {name, "t002", "t003"}
    assert missed == 0


def test_gru_gradients():
    model = li.ByteGru(3, hidden=4, seed=1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(0)
    data, labels = rng.integers(97, 123, (5, 6)).astype(np.uint8), rng.integers(0, 3, 5)
    loss = lambda: -np.log(model.positions(data)[:, np.arange(5), labels]).mean()
    grads = model.gradients(data, labels)
    for key, g in grads.items():
        for at in zip(*np.unravel_index(np.argsort(-abs(g), axis=None)[:3], g.shape)):
            old = model.p[key][at]
            model.p[key][at] = old + 1e-3
            up = loss()
            model.p[key][at] = old - 1e-3
            down = loss()
            model.p[key][at] = old
            assert abs((up - down) / 2e-3 - g[at]) < 2e-3 * max(1, abs(g[at])), key


def test_op8_learns_and_pools_whole_texts(spark, odd, none, frame):
    d = f"{DATA}/sf0.01"
    got = q.op8_language_id(spark, d).toPandas()
    truth = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id").lang
    held = got[got.held_out]
    assert (held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all() and len(got) == 1000
    assert (held.lang_pred == held.doc_id.map(truth)).mean() > 0.97
    langs, model = li.fit([("aa", "abab abba baba " * 50), ("zz", "zyzy yzzy zzyy " * 50)], steps=60)
    rows = li.predict(odd, langs, model).collect()
    assert len(rows) == odd.count() and {r.lang_pred for r in rows if r.score == 0} == {"und"}
    end = li.predict(frame(["ab " * 10 + "zyzy " * 4000, "123 !", "ab1"]), langs, model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in end] == ["zz", "und", "aa"]
    assert {r.lang_pred for r in li.predict(frame(["½", "②", "²", "Ⅷ", "7 ½ ②", "_"]), langs, model).collect()} == {"und"}  # numbers, not letters
    assert li.predict(none, langs, model).count() == 0
    assert {r.lang_pred for r in li.predict(frame(["ab"]), *li.fit([])).collect()} == {"und"}
    assert li.training_sample(none) == []


def test_training_reads_long_segments_to_their_end(frame):
    ends = {"aa": "ab" * 200, "zz": "zy" * 200}
    langs, model = li.fit([(lang, "x" * li.SEGMENT_BYTES + end) for lang, end in ends.items()], steps=60)
    got = {r.doc_id: (r.lang_pred, r.score > 0.9) for r in li.predict(frame(list(ends.values())), langs, model).collect()}
    assert got == {0: ("aa", True), 1: ("zz", True)}


def test_toxicity_grammar():
    m = tox.Matcher({"oaf$": 3.0, "grob+": 2.0})
    clauses = lambda t: dict(m.clauses(t))
    assert clauses("He is an oaf. A groble, grob") == {"aimed_insult": 3.0, "insult": 2.0}
    assert clauses("not an oaf") == {"negated": 3.0}
    assert clauses("she said the word oaf") == {"reported": 3.0}
    assert clauses("I will kill you") == {"threat": 3.0} and clauses("they kill it") == {"aimed_threat": 3.0}
    assert clauses("an OAF! oaf\noaf") == {"insult": 9.0}
    assert clauses(None) == clauses("") == clauses("loaf grob") == {}
    for said in ("he said: you are an oaf", 'she said, "you are an oaf"', "he said you are an oaf", 'he wrote: "Enough. You are an oaf. Go."', "she said, not an oaf", "sagte er, „du oaf“"):
        assert clauses(said) == {"reported": 3.0}, said
    assert clauses("he said no. you are an oaf") == {"aimed_insult": 3.0} == clauses('he said "no". you are an oaf') == clauses('he said "no\nyou are an oaf')
    assert clauses("you, oaf") == {"aimed_insult": 3.0} and clauses("no, oaf!") == {"insult": 3.0} == clauses('"oaf"')


def test_negated_and_reported_matches_can_lower_a_score():
    clean = ["he said you oaf", "not an oaf", *["nothing here at all", "good day"] * 15]
    stems, weights = tox.fit([("you oaf", 1), ("an oaf here", 1), ("oaf", 1)] * 30 + [(t, 0) for t in clean] * 20)
    score = lambda t: tox.score_of(tox.Matcher(stems).clauses(t), weights)
    assert "oaf$" in stems and score("an oaf") > 0.9 and score("she said: oaf") < 0.1 > score("never an oaf")
    assert score("oaf. she said: oaf") < score("oaf")


def test_samples_are_bounded(spark):
    copies = [(7, "the same text", "en", 1)] * 3000 + [(i, f"text number {i}", "en", i % 2) for i in range(8, 60)]
    docs = spark.createDataFrame(copies, "doc_id long, text string, lang string, toxic int")
    assert len(tox.training_sample(docs, docs.select("doc_id", "toxic"), toxic_rows=20, clean_rows=20)) <= 40
    drawn = li.training_sample(docs, rows=20)
    assert 0 < len(drawn) <= 20 and len(set(drawn)) == len(drawn)


def test_a_chosen_batch_size_is_kept(spark, frame):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    try:
        spark.conf.set(key, "10000")
        li.predict(frame(["a"]), *li.fit([])).count()
        assert spark.conf.get(key) == "10000"
    finally:
        spark.conf.unset(key)


def test_op4_held_out(spark, odd, none):
    d = f"{DATA}/sf0.1"
    got = q.op4_toxicity(spark, d).toPandas().merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    p, y = held.score.to_numpy(), held.toxic.to_numpy()
    order = p.argsort().argsort() + 1
    auc = (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    recall = held.predicted[y == 1].mean()
    lang = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id").lang
    by_lang = held[y == 1].groupby(held.doc_id.map(lang)).predicted.mean()
    print("held-out recall", recall, dict(by_lang), "auc", auc, "false", held.predicted[y == 0].mean())
    assert recall > 0.8 and len(by_lang) == 4 and by_lang.min() > 0.6
    assert auc > 0.9 and held.predicted[y == 0].mean() < 0.02 and ((held.score >= 0.5) == (held.predicted == 1)).all()
    stems, weights = tox.fit([("an oaf here", 1)] * 40 + [("clean words here", 0)] * 400)
    rows = tox.predict(odd, stems, weights).collect()
    column = {round(r[0], 12) for r in odd.select(tox.score_column(spark, odd.text, stems, weights)).collect()}
    assert column == {round(r.score, 12) for r in rows}
    assert len(rows) == odd.count() and len({r.score for r in rows}) == 1 and tox.predict(none, stems, weights).count() == 0
    assert tox.fit([])[0] == {} and 0 <= tox.score_of(tox.Counter(), tox.fit([])[1]) < 0.5
