import hashlib
import random
import zlib

import pytest

from spanforge.llm import merkle as mk
from spanforge.llm import queries as q
from tests.conftest import DATA

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root int, number string, changed string"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h([field(v) for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)])


def levels_above(nodes):
    """All levels of a tree, its leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def path_of(levels, at):
    """(slot, siblings) of each level."""
    out = []
    for level in levels[:-1]:
        run = level[at // 16 * 16 : at // 16 * 16 + 16]
        out.append((at % 16, run[: at % 16] + run[at % 16 + 1 :]))
        at //= 16
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        mine = sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
        trees.append((mine, levels_above([leaf_of(r, r["text"]) for r in mine])))
    top = levels_above([t[-1][0] for _, t in trees])
    root, out = top[-1][0], []
    for n, (mine, tree) in enumerate(trees):
        for i, r in enumerate(mine):
            path = path_of(tree, i) + path_of(top, n)
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None
            lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "")
            node = leaf_of(r, lowered if tampered else r["text"])
            for slot, others in path:
                node = h([*others[:slot], node, *others[slot:]])
            out.append((r["doc_id"], tree[0][i], tree[-1][0], root, h([x for _, others in path for x in others]), node, node == root))
    return sorted(out, key=str)


def frame(spark, rows, parts=7):
    return spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x", 1, "y", "z") for r in rows], SCHEMA).repartition(parts)


def made(spec, seed=1):
    rng, rows, number = random.Random(seed), [], 0
    for source, n in spec:
        for _ in range(n):
            number += rng.randrange(1, 4)
            rows.append({"doc_id": number, "text": rng.choice(["", None, "Abc é", "low", "UP " * rng.randrange(9)]), "lang": rng.choice(["en", None]), "source": source, "n_chars": rng.choice([None, 5])})
    return rows


def test_op13_equals_brute_force(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()]
    got = sorted(map(tuple, q.op13_merkle(spark, f"{DATA}/sf0.001").collect()), key=str)
    assert got == brute(rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize(
    "spec",
    [
        [("one", 1)],
        [("a", 16)],
        [("a", 17), ("b", 1), (None, 2)],
        [("hot", 600), ("b", 257), ("c", 256), ("", 15), (None, 1), ("é", 33)],
        [(f"s{i}", 1 + i % 3) for i in range(40)],
        [("deep", 4_200), ("x", 1)],
    ],
)
def test_trees_of_all_shapes(spark, spec):
    rows = made(spec)
    assert sorted(map(tuple, mk.manifest(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_odd_rows(spark, odd, none):
    rows = made([("a", 40), (None, 20)])
    rows += [rows[3]] * 40 + [rows[50]] + [rows[0] | {"doc_id": None}] * 3 + [{"doc_id": None, "text": None, "lang": None, "source": None, "n_chars": None}, {"doc_id": 9_999, "text": "Xy " * 50_000, "lang": "en", "source": "a", "n_chars": 0}]
    assert sorted(map(tuple, mk.manifest(frame(spark, rows)).collect()), key=str) == brute(rows)
    assert mk.manifest(odd).count() == odd.count()
    empty = mk.manifest(none)
    assert empty.collect() == [] and empty.columns == [c.split()[0] for c in mk.RESULT.split(", ")]


def test_rows_are_numbered_whatever_the_ranges():
    rows = [(s, i, b"%032d" % i, None) for s, n in ((None, 5), ("a", 40), ("b", 1), ("c", 70)) for i in range(n)]
    whole = None
    for cuts in ([], [3], [5], [20, 21, 44], [5, 45, 46], [0, 0, 46, 46, 100]):
        edges = [0, *cuts, len(rows)]
        parts = [rows[a:b] for a, b in zip(edges, edges[1:])]
        place, sources, most = mk.layout([s for i, p in enumerate(parts) for s in mk.summary(i, iter(p))])
        assert (sources, most) == (4, 70)
        nodes = {}
        for i, p in enumerate(parts):
            for key, children in mk.numbered(place)(i, iter(p)):
                nodes.setdefault(key, []).append(children)
        done = sorted(mk.received(x) for x in nodes.items())
        whole = whole or done
        assert done == whole


def test_a_missing_message_is_an_error_but_sources_are_waited_for():
    children = [(i, False, b"x" * 32, i, None) for i in range(16)]
    for wrong in (children[:7] + children[8:], children[:15], [*children[:3], children[2]]):
        with pytest.raises(ValueError, match="lacks"):
            mk.received(((0, 1, 0), [wrong]))
        assert mk.received(((mk.TOP, 1, 0), [wrong]))[1] is None
    _, (last, own, _), _ = mk.received(((0, 1, 1), [[(0, True, b"x" * 32, 16, None)]]))
    assert last and own == mk.digest([b"x" * 32])  # a last run of one is hashed
