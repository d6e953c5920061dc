"""Operators that compare rows with one another, against brute force."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spanforge.llm import anchors, components, minmax_dedup, rindex_dedup, warc
from spanforge.llm import queries as q
from spanforge.llm.common import shared_dir
from spanforge.llm.minmax_sketch import MinMax, WordHashes, linked, set_key, shingles
from spanforge.llm.rindex import RunLengthIndex, repeated_windows
from tests.compare import assert_same, oracle
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"


def shingle_set(text, n=2):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(texts, n=2, percent=80):
    sets = {i: shingle_set(t, n) for i, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = components.joined(links)
    return {i: comp.get(i, i) for i in sets}, {i: len(s) for i, s in sets.items()}


def near_copies(rng, n, words=60, edits=6):
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_op5_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    comp, sizes = brute_components(dict(zip(docs.doc_id, docs.text)))
    for r in q.op5_minmax_dedup(spark, SF).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (sizes[r.doc_id], comp[r.doc_id], comp[r.doc_id] == r.doc_id)


@pytest.mark.parametrize("blocks", [False, True])
def test_near_groups_whose_members_differ_keep_every_link(frame, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(minmax_dedup, "BLOCK_ROWS", 7)
    rng = random.Random(2)
    texts = [t for _ in range(4) for t in near_copies(rng, 30, edits=9)] + ["a", "A", "a b", "a b c", "", None]
    comp, _ = brute_components(dict(enumerate(texts)))
    got = {r.doc_id: r.component_id for r in minmax_dedup.near_duplicates(frame(texts)).collect()}
    assert got == comp and len(set(comp.values())) > 8


def test_near_duplicates_odd(odd, none):
    got = minmax_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert all(r.component_id == r.doc_id for r in got if r.n_shingles == 0 and r.doc_id is not None)
    assert minmax_dedup.near_duplicates(none).count() == 0


def test_sketch_probability_and_sets():
    rng, memo, minmax = np.random.default_rng(1), WordHashes(), MinMax()
    met = 0
    for _ in range(200):
        both = rng.integers(0, 1 << 63, 160, np.uint64)
        a, b = np.unique(np.append(both, rng.integers(0, 1 << 63, 20, np.uint64))), np.unique(np.append(both, rng.integers(0, 1 << 63, 20, np.uint64)))
        assert linked(a, b)
        met += bool(set(minmax.sketch(a).tolist()) & set(minmax.sketch(b).tolist()))
    assert met == 200
    assert len(shingles("A b\ta  B a b", memo)) == 2 and len(shingles("A", memo)) == 1 and len(shingles(None, memo)) == 0
    assert set_key(shingles("x y z", memo)) == set_key(shingles("X\nY Z", memo)) != set_key(shingles("z y x", memo))
    assert not linked(shingles("", memo), shingles("", memo))


def test_block_links_join_what_links_join():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 40, 50)
    sets = [np.unique(np.append(rng.choice(base, 44, False), rng.integers(0, 1 << 40, rng.integers(0, 8)))) for _ in range(40)]
    ids, own = np.arange(40), np.arange(40)
    every = [(i, j) for i in range(40) for j in range(i + 1, 40) if linked(sets[i].astype(np.uint64), sets[j].astype(np.uint64))]
    half = np.arange(40) % 2 == 0
    found = [x for a, b in ((half, half), (half, ~half), (~half, ~half)) for x in minmax_dedup.links_between(ids, own, sets, a, b, 80)]
    assert components.joined(found) == components.joined(every) and every


def test_components_in_rounds_equal_those_in_one_task(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(30)] + [(500, 501 + i) for i in range(40)]
    df = spark.createDataFrame(links, "a long, b long")
    want = components.joined([x for x in links if x[0] != x[1]])
    for find in (components.connected, components.spread):
        assert {r.node: r.component for r in find(df).collect()} == want
        assert find(df.limit(0)).count() == 0


def brute_repeats(raws, width=400):
    times = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - width + 1):
            if times[r[i : i + width]] > 1:
                gone[i : i + width] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_op9_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    want = dict(zip(docs.doc_id, brute_repeats([t.encode() for t in docs.text])))
    got = {r.doc_id: tuple(r)[1:] for r in q.op9_rindex_dedup(spark, SF).collect()}
    assert {i: r[:4] for i, r in got.items()} == want
    split = {i: t.encode().split() for i, t in zip(docs.doc_id, docs.text)}

    def sharing(n):
        held = {}
        for w in split.values():
            for k in {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}:
                held.setdefault(k, set()).add(b" ".join(w))
        return {i for i, w in split.items() if any(len(held[tuple(w[a : a + n])]) > 1 for a in range(len(w) - n + 1))}

    flagged = {i for i, r in got.items() if r[5]}
    assert sharing(51) <= flagged <= sharing(rindex_dedup.PASSAGE_GRAM) and flagged == {i for i, r in got.items() if r[4] > 0}


def test_short_passages_are_screened_and_cut_by_words(frame):
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choice("aeioubcd") for _ in range(rng.randint(1, 9))) for _ in range(n))
    passage, short = text(52), text(40)
    texts = [f"{text(30)} {passage} {text(20)}", f"{text(9)} {passage} {text(70)}", f"{text(60)} {short} {text(5)}", f"{short} {text(80)}", text(100), f"{passage[:-40]}", None, "", text(100)]
    texts.append(texts[-1])
    found = rindex_dedup.repeats(frame(texts), width=200, least_words=51)
    assert {r.doc_id for r in found.collect() if r.n_removed} == {0, 1, 8, 9}
    left = {r.doc_id: r.text for r in rindex_dedup.cut(frame(texts), found).collect()}
    assert passage not in left[0] and short in left[2] and left[4] == texts[4] and left[6] is None and left[8] == ""
    screened = {r.doc_id: r.shares_passage for r in rindex_dedup.repeats(frame(texts), passage_words=51).collect()}
    assert {0, 1} <= {i for i, x in screened.items() if x} <= {0, 1, 2, 3, 5}  # 40 words in common may count, as the gram is shorter


def test_rows_that_share_an_id_are_cut_by_their_texts(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(str(rng.randrange(10**6)) for _ in range(n))
    passage = text(90)
    docs = spark.createDataFrame([(1, f"{text(9)} {passage}"), (1, text(90)), (None, f"{passage} {text(7)}")], "doc_id long, text string")
    left = [(r.doc_id, passage in r.text, len(r.text) > 500) for r in rindex_dedup.cut(docs, rindex_dedup.repeats(docs)).collect()]
    assert sorted(left, key=repr) == [(1, False, False), (1, False, True), (None, False, False)]


@pytest.mark.parametrize("hot", [False, True])
def test_passages_periods_and_overlaps(frame, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(rindex_dedup, "KEY_RUNS", 4)
        monkeypatch.setattr(rindex_dedup, "GROUP_RUNS", 10)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("aeéioubcd") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(120), text(80)
    texts = [f"{text(30)} {passage[a:b]} {text(20)}" for a, b in ((0, 700), (50, 600), (0, 399), (100, 500), (0, 700), (200, 700), (3, 690))]
    texts += [f"{other}{text(9)}{other}", "ab" * 700, "abc" * 170, "x" * 1500, text(200), f"{passage}{other}", "same " * 90, "same " * 90, "y" * 399, "z" * 400, "z" * 400]
    got = {r.doc_id: r for r in rindex_dedup.repeats(frame(texts)).collect()}
    digest = {r.doc_id: tuple(r)[1:] for r in rindex_dedup.digests(rindex_dedup.repeats(frame(texts))).collect()}
    want = brute_repeats([t.encode() for t in texts])
    assert digest == dict(enumerate(want))
    cut = {r.doc_id: r for r in rindex_dedup.cut(frame(texts), rindex_dedup.repeats(frame(texts))).collect()}
    for i, t in enumerate(texts):
        raw = t.encode()
        rest, at = [], 0
        for s in got[i].spans:
            rest.append(raw[at : s.start])
            at = s.end
        assert cut[i].text == b"".join([*rest, raw[at:]]).decode("utf-8", "ignore") and cut[i].lang == "en"


def test_repeats_odd(odd, none):
    got = rindex_dedup.repeats(odd).collect()
    assert len(got) == odd.count() and sum(r.n_removed for r in got if r.n_bytes < 400) == 0
    assert {r.n_bytes: r.n_removed for r in got if r.n_bytes > 400} == {30_000: 30_000, 64_000: 64_000}
    assert rindex_dedup.cut(odd, rindex_dedup.repeats(odd)).count() == odd.count()
    assert rindex_dedup.repeats(none).count() == 0 and rindex_dedup.cut(none, rindex_dedup.repeats(none)).count() == 0


def test_index_on_small_alphabets():
    rng = random.Random(5)
    for _ in range(300):
        width = rng.choice([3, 7, 20])
        base = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(2)]
        strings = [s[rng.randint(0, 10) :] * rng.choice([1, 1, 3]) for s in rng.choices(base, k=rng.randint(1, 5))]
        times = Counter(s[i : i + width] for s in strings for i in range(len(s) - width + 1))
        for s, flags in zip(strings, repeated_windows(strings, width)):
            assert flags.tolist() == [times[s[i : i + width]] > 1 for i in range(len(s) - width + 1)]


def test_index_is_run_compressed():
    text = np.frombuffer((b"the quick brown fox jumps over the lazy dog, " * 200) + b"\xff", np.uint8)
    index = RunLengthIndex(text, 400)
    assert len(index.run_bytes) < len(text) / 50 and index.matching_statistics()[0] >= 400
    last = np.repeat(index.run_bytes, index.run_lengths)  # the transform, inverted
    assert len(last) == len(text) and (np.sort(last) == np.sort(text)).all()


def test_equal_windows_share_keys(monkeypatch):
    monkeypatch.setattr(anchors, "AT_ONCE", 700)
    rng, powers = np.random.default_rng(3), anchors.Powers()
    part = rng.integers(97, 105, 900).astype(np.uint8)
    keys = []
    for before in (0, 17, 1500):
        data = np.concatenate([rng.integers(97, 123, before).astype(np.uint8), part])
        k, first, last, _ = anchors.runs(data, 400, powers)
        assert first[0] == 0 and last[-1] == len(data) - 400 and (first[1:] == last[:-1] + 1).all() and (last - first < 400).all()
        keys.append(np.repeat(k, last - first + 1)[before:])
    assert (keys[0] == keys[1]).all() and (keys[0] == keys[2]).all()


def test_op6_round_trip(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()
    rows = {r.page_id: r for r in q.op6_warc(spark, SF).collect()}
    first = {}
    for p in sorted(pages, key=lambda p: p.page_id):
        first.setdefault(p.html or "", p.page_id)
    assert len(rows) == len(pages)
    for p in pages:
        raw, r = (p.html or "").encode(), rows[p.page_id]
        lead = first[p.html or ""]
        want = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if lead == p.page_id else "revisit", None if lead == p.page_id else lead)
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == want


def test_warc_files(spark, tmp_path):
    noise = random.Random(1).randbytes(17_000_000).decode("latin-1")
    data = [(5, "u\r\nx", "same", 1), (3, None, "same", 1), (4, "u", None, 1), (9, "u", "", 1), (7, "u", "short", 1), (8, "u", "short", 1), (11, "big", noise, 1), (None, "u", "lost", 1), (5, "u\r\nx", "same", 1)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, payload int").repartition(3)
    path = str(tmp_path / "w")
    warc.write(pages, path, archive_bytes=200)
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.read(spark, path, payloads=True).collect()}
    assert got == {5: ("revisit", 3, 4), 3: ("response", None, 4), 4: ("response", None, 0), 9: ("revisit", 4, 0), 7: ("response", None, 5), 8: ("revisit", 7, 5), 11: ("response", None, len(noise.encode()))}
    files = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-") and p.stat().st_size]
    assert len(files) >= 4
    for p in files:  # any gzip reader takes the archives, member by member
        raw, members = p.read_bytes(), 0
        while raw:
            d = zlib.decompressobj(31)
            body = d.decompress(raw) + d.flush()
            assert d.eof and (not body or body.startswith(b"WARC/1.1\r\n") and body.endswith(b"\r\n\r\n"))
            raw, members = d.unused_data, members + 1
        assert members >= 1
    warc.write(pages, path, least_bytes=5)
    assert {r.page_id: r.record_type for r in warc.read(spark, path).collect()} == {5: "response", 3: "response", 4: "response", 9: "response", 7: "response", 8: "revisit", 11: "response"}
    warc.write(pages.limit(0), path)
    assert warc.read(spark, path).count() == 0


def test_round_trip_returns_pages_without_an_id(spark):
    data = [(None, "u", "same"), (3, "u", "same"), (None, "v", "lost"), (None, None, None), (None, "v", "lost"), (5, "u", "same")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    got = [(r.page_id, r.url, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()]
    want = [(None, "u", 4, "revisit", 3), (3, "u", 4, "response", None), (None, "v", 4, "response", None), (None, None, 0, "response", None), (None, "v", 4, "response", None), (5, "u", 4, "revisit", 3)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["op5_minmax_dedup", "op6_warc", "op7_decontamination"])
def test_queries_equal_their_sql(spark, name):
    assert_same(q.QUERIES[name](spark, SF).toPandas(), oracle(q.ORACLES[name], "sf0.001"))


def test_damaged_archives_are_refused():
    good = warc.member(warc.record(1, "u", b"payload", warc.base32_sha1(b"payload"), None))
    assert [f["warc-type"] for f, _ in warc.records(good + good)] == ["response", "response"]
    for step in (1, 7, 1 << 16):
        assert b"".join(warc.inflated(good, step)).startswith(b"WARC")
    other = warc.member(warc.record(1, "u", b"payload", warc.base32_sha1(b"other"), None))
    for bad in (good[:-9], warc.member(b"HTTP\r\n\r\n"), other):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.read_archive(bad))


def test_shared_folder_is_the_sessions(spark):
    assert shared_dir(spark) == shared_dir(spark) and spark.sparkContext.getCheckpointDir()
