import random

import pytest
import xxhash

from spanforge.llm import queries as q
from spanforge.llm import simhash as sh
from tests.conftest import DATA
from tests.llm.test_corpus_operators import near_copies


def plain_fingerprint(text):
    """Bit by bit, over shingles as they are defined."""
    words, word = [], ""
    for ch in (text or "") + " ":
        if ch in " \t\n\v\f\r":
            words += [word] if word else []
            word = ""
        else:
            word += ch.lower() if "A" <= ch <= "Z" else ch
    parts = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    hashes = [xxhash.xxh64(" ".join(p).encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """By all pairs: the smallest id reachable."""
    ids, at = sorted(prints), {}
    for i in ids:
        at[i] = i
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and at[b] < at[a]:
                    at[a], changed = at[b], True
    return at


def check(rows, texts):
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = plain_components(prints)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{prints[i]:016x}", want[i]) for i in texts}
    return want


def test_op12_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()
    check(q.op12_simhash(spark, f"{DATA}/sf0.001").collect(), {r.doc_id: r.text for r in docs})


def test_near_groups_and_chains_equal_all_pairs(frame):
    rng = random.Random(4)
    texts = [t for _ in range(6) for t in near_copies(rng, 40, words=300, edits=3)]  # few edits of long texts: some bits differ
    texts += ["", None, " \t", "One", "one", "a b", "a b c", "A  b\nc"]
    want = check(sh.digests(sh.near_duplicates(frame(texts))).collect(), dict(enumerate(texts)))
    sizes = sorted((list(want.values()).count(c) for c in set(want.values())), reverse=True)
    assert sizes[0] > 3


def test_links_join_what_all_pairs_join(spark):
    rng = random.Random(9)
    start = [rng.getrandbits(64) for _ in range(5)]
    prints = set(start)
    for _ in range(400):  # balls and chains about the starts, and numbers with the top bit set
        x = rng.choice(sorted(prints))
        for b in rng.sample(range(64), rng.randrange(1, 4)):
            x ^= 1 << b
        prints.add(x)
    prints |= {start[0] ^ (1 << b) for b in range(64)}  # a whole ball of radius one: its centre is met by 65
    numbered = dict(enumerate(sorted(prints)))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in numbered.items()], "fp long, rep long")
    found = [(r.a, r.b) for r in sh.links(df, 2).collect()]
    assert len(found) == len(set(found)) and all(a < b and (numbered[a] ^ numbered[b]).bit_count() <= 2 for a, b in found)
    comp = {r.node: r.component for r in sh.connected(sh.links(df, 2)).collect()}
    assert {i: comp.get(i, i) for i in numbered} == plain_components(numbered)


def test_odd_rows(odd, none):
    rows = sh.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and sh.near_duplicates(none).collect() == []
    given = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    want = plain_components({i: plain_fingerprint(t) for i, t in given.items()})
    for r in rows:
        if r.doc_id is None:
            assert (r.class_id, r.component_id, r.kept) == (None, None, True)
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id) and r.fp % (1 << 64) == plain_fingerprint(given[r.doc_id])


def test_long_texts_are_counted_in_parts(monkeypatch):
    text = " ".join(f"w{i * i % 997}" for i in range(3_000))
    whole = sh.fingerprint(sh.shingle_hashes(text, 3, 42))
    monkeypatch.setattr(sh, "SHINGLES_AT_ONCE", 7)
    assert sh.fingerprint(sh.shingle_hashes(text, 3, 42)) == whole == plain_fingerprint(text)
    assert len(sh.masks(1)) == 65 and len(set(sh.masks(2))) == 1 + 64 + 64 * 63 // 2
    with pytest.raises(AssertionError):
        sh.links(None, 3)
