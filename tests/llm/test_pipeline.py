"""The pipeline's stages on planted documents, and run() against a plain version of its last stages."""

import hashlib
import random
import re
from collections import Counter

import numpy as np

import corpus_pipeline as cp
from spanforge.llm import queries as q
from tests.conftest import DATA
from tests.llm.test_corpus_operators import brute_components


def test_stages_on_planted_documents(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bcdfglmnrst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    item, passage, base = text(30), text(110), text(150)
    plain = {i: text(90) for i in range(200)}
    planted = {
        900: f"{text(40)} oaf. {text(10)} oaf! {text(9)} oaf",
        901: base,
        902: base,
        903: base.replace(base.split()[70], "changed", 1),
        904: f"{text(40)} {passage} {text(30)}",
        905: f"{text(50)} {passage} {text(20)}",
        906: f"{text(30)} {item} {text(10)}",
    }
    docs = {**plain, **planted}
    labelled = {i: (f"{t} oaf you oaf, oaf" if i % 4 == 0 else t, int(i % 4 == 0)) for i, t in plain.items()}
    rows = [(i, labelled[i][0] if i in labelled else t, "en", None, len(t), None) for i, t in docs.items()]
    rows += [(2000, None, None, None, None, None), (2001, "", None, None, 0, None), (None, "no id", None, None, 5, None)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, y, y) for i, (_, y) in labelled.items()], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now = spark.read.parquet(f"{d}/documents.parquet")
    columns, gone, texts = now.columns, {}, {}
    for name, stage in cp.STAGES:
        before = {r.doc_id for r in now.select("doc_id").collect()}
        stage(spark, now, d).write.parquet(f"{d}/out/{name}")
        now = spark.read.parquet(f"{d}/out/{name}")
        if name != "tokens":
            assert now.columns == columns
            texts[name] = {r.doc_id: r.text for r in now.collect()}
        gone[name] = before - {r.doc_id for r in now.select("doc_id").collect()}
    assert gone == {"toxicity": {900, *(i for i in plain if i % 4 == 0)}, "near_dedup": {902, 903}, "suffix_dedup": set(), "decontamination": {906}, "tokens": set()}
    assert passage not in texts["suffix_dedup"][904] and passage not in texts["suffix_dedup"][905]
    assert texts["suffix_dedup"][901] == base and texts["suffix_dedup"][3] == plain[3]
    last = {r.doc_id: r for r in now.collect()}
    assert set(last) == set(texts["decontamination"]) and last[2000].n_tokens == last[2001].n_tokens == 0


def test_near_dedup_keeps_what_five_word_shingles_tell_apart(spark):
    base = [f"w{i}" for i in range(100)]
    changed = lambda at: " ".join("changed" if i in at else w for i, w in enumerate(base))
    rows = [(1, changed([])), (2, changed([20, 50, 80])), (3, changed([5]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in cp.drop_near_duplicates(spark, docs, "").collect()} == {1, 2}


def test_run(spark):
    from tokenizers import Tokenizer

    d = f"{DATA}/sf0.001"
    got = cp.run(spark, d).toPandas()
    docs, library = spark.read.parquet(f"{d}/documents.parquet").toPandas(), Tokenizer.from_file(q.vocabulary("byte_bpe_50k.json"))
    assert 0 < len(got) < len(docs) and got.doc_id.is_unique
    uncut = docs.set_index("doc_id").text
    whole = [i for i, n in zip(got.doc_id, got.n_tokens) if len(library.encode(uncut[i], add_special_tokens=False).ids) == n]
    assert len(whole) > 0.8 * len(got)


def plain_cut(texts, width, least_words):
    """Texts without the repeated strings of ``width`` bytes that run over so many words."""
    raws = [t.encode() for t in texts]
    times = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - width + 1):
            if times[r[i : i + width]] > 1:
                gone[i : i + width] = True
        turns = np.flatnonzero(np.diff(gone.astype(int), prepend=0, append=0))
        for a, b in zip(turns[::2], turns[1::2]):
            if len(r[a:b].split()) < least_words:
                gone[a:b] = False
        out.append(np.frombuffer(r, np.uint8)[~gone].tobytes().decode("utf-8", "ignore"))
    return out


def plain_windows(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, {tuple(words[i : i + 10]) for i in range(max(1, len(words) - 9))} if words else set()


def test_run_equals_a_plain_version_of_the_stages_after_toxicity(spark):
    from tokenizers import Tokenizer

    d = f"{DATA}/sf0.001"
    rows = cp.drop_toxic(spark, spark.read.parquet(f"{d}/documents.parquet"), d).select("doc_id", "text").collect()
    comp, _ = brute_components({r.doc_id: r.text for r in rows}, n=5)
    kept = [r for r in rows if comp[r.doc_id] == r.doc_id]
    texts = dict(zip([r.doc_id for r in kept], plain_cut([r.text for r in kept], cp.PASSAGE_BYTES, cp.PASSAGE_WORDS)))
    items = set().union(*(plain_windows(t)[1] for t in spark.read.parquet(f"{d}/benchmark.parquet").toPandas().text))
    sizes = {len(x) for x in items}

    def holds(text):
        words, _ = plain_windows(text)
        return any(tuple(words[i : i + n]) in items for n in sizes for i in range(len(words) - n + 1))

    library = Tokenizer.from_file(q.vocabulary("byte_bpe_50k.json"))
    want = {}
    for i, text in texts.items():
        if not holds(text):
            ids = library.encode(text, add_special_tokens=False).ids
            packed = np.array(ids, "<u4").tobytes()
            want[i] = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in cp.run(spark, d).collect()}
    assert got == want and 0 < len(want) < len(kept) < len(rows)
    assert any(texts[r.doc_id] != r.text for r in kept)


def test_run_on_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert cp.run(spark, d).count() == 0
