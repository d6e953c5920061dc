"""Merkle manifest of a dataset, built and verified by Pregel-style RDD supersteps.

A row's leaf is the sha256 of its fields, each ``-`` if null, else its UTF-8
byte count, ``:`` and its value. Leaves of a source ascend by id; every ``FAN``
consecutive nodes become one until one is left, the source's subroot. Subroots
in order of their sources (null first, by bytes) make the root in the same way.

Leaves are sorted by ranges over all tasks, so a source of any size is dealt
out, and numbered by one summary a task. Then supersteps run:

* Upward, nodes message their digests to their parent, neighbours' messages
  combined. A parent that holds all its children (``FAN``, or up to the one
  marked as its tree's last) hashes them and messages on. Subroots message the
  tree of sources, whose vertices wait for the deepest of their sources; in a
  source's own tree a missing child fails the job.
* Downward, each node sends its children the path it was sent, with their
  siblings before it. A leaf's parent does so for its own leaves in place, folds
  their digests up the path and holds what results against the root.

Each superstep's nodes are written to the shared folder, so a lost executor
costs that superstep's lost partitions, and removed after the result is written.
Nodes shrink ``FAN`` times a superstep; a path has under FAN digests a level.
Only one record a task, the depth and the root come to the driver.

Rows with a null id are leaves too, first in their source and never tampered
with; repeated rows are a leaf each (those with one source and id in order of
their digests); empty and very long texts are fields as any other. An empty table
gives an empty result. Only the fields are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import checkpoint, remove, shared_dir
from spanforge.shipping import ship

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Key of the tree whose leaves are the sources' subroots.
TOP = -1
#: Nodes of a superstep for each task, unless cores would stand idle.
NODES_A_TASK = 512
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(parts: Iterable[bytes]) -> bytes:
    """sha256 over digests as hex text."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def leaf_column(fields: dict[str, Column]) -> Column:
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.unhex(F.sha2(F.encode(F.concat(*[one(c.cast("string")) for c in fields.values()]), "utf-8"), 256))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def every_fifth(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def leaves(docs: DataFrame, chosen: Callable[[Column], Column], tamper: Callable[[Column], Column]) -> DataFrame:
    """source, doc_id, leaf, and the leaf of the tampered text where the id is chosen; in order, over ranges."""
    kinds = {"doc_id": "long", "n_chars": "long"}
    fields = {c: F.col(f"`{c}`").cast(kinds.get(c, "string")) for c in FIELDS}
    changed = F.when(chosen(fields["doc_id"]), leaf_column(fields | {"text": tamper(fields["text"])}))
    hashed = docs.select(fields["source"].alias("source"), fields["doc_id"].alias("doc_id"), leaf_column(fields).alias("leaf"), changed.alias("changed"))
    # Written with a number of their own, so that sampling for ranges hashes nothing again and repeated rows can be parted.
    rows = checkpoint(hashed.withColumn("number", F.monotonically_increasing_id()))
    order = [F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc("number")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpoint(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("number"))


def summary(number: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Of a task's sorted rows: its number, sources, first source and its rows, last source and its rows, most rows of one, all rows."""
    sources, first, before, count, most, of_first, whole = 0, None, None, 0, 0, 0, 0
    for source, *_ in rows:
        whole += 1
        if sources == 0 or source != before:
            if sources == 0:
                first = source
            elif sources == 1:
                of_first = count
            most, count, before, sources = max(most, count), 0, source, sources + 1
        count += 1
    if sources:
        yield number, sources, first, count if sources == 1 else of_first, before, count, max(most, count), whole


def layout(summaries: list[tuple]) -> tuple[dict[int, tuple[int, int, int]], int, int]:
    """For each task the number of its first source, that source's rows before it and all rows of its last source; the sources; the most rows of one."""
    at, last, rows, held, before = {}, {}, {}, -1, None
    for number, sources, first, of_first, final, of_final, *_ in sorted(summaries, key=lambda s: s[0]):
        if held < 0 or first != before:
            held += 1
        at[number] = (held, rows.get(held, 0))
        rows[held] = rows.get(held, 0) + of_first
        if sources > 1:
            held += sources - 1
            rows[held] = of_final
        last[number], before = held, final
    most = max([*rows.values(), *(s[6] for s in summaries)], default=0)
    return {n: (*at[n], rows[last[n]]) for n in at}, held + 1, most


def depth(nodes: int) -> int:
    """Levels until one node is left."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // FAN), levels + 1
    return levels


def numbered(place: dict[int, tuple[int, int, int]]) -> Callable[[int, Iterator[tuple]], Iterator[tuple]]:
    """Leaves' messages to their parents: ((source, 1, parent), [(slot, last, leaf, doc_id, changed), ...]), neighbours combined."""

    def run(number: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        if number not in place:
            return
        tree, at, total = place[number]
        held = None
        children: list[tuple] = []
        for row in rows:
            if held is not None:
                ends = row[0] != held[0]
                children.append((at % FAN, ends, bytes(held[2]), held[1], held[3] and bytes(held[3])))
                if ends or at % FAN == FAN - 1:
                    yield (tree, 1, at // FAN), children
                    children = []
                tree, at = (tree + 1, 0) if ends else (tree, at + 1)
            held = row
        if held is not None:
            children.append((at % FAN, at == total - 1, bytes(held[2]), held[1], held[3] and bytes(held[3])))
            yield (tree, 1, at // FAN), children

    return run


def received(message: tuple) -> tuple:
    """A vertex that got messages: (key, node, waiting). One that holds all its children is a node (last, digest, children).

    Others wait with what they have, which only the tree of sources may: its
    children come when they are done. A lone leaf's parent is the leaf itself.
    """
    (tree, level, index), parts = message
    children = sorted((c for part in parts for c in part), key=lambda c: c[0])
    last = children[-1][1]
    if [c[0] for c in children] != list(range(len(children))) or not (last or len(children) == FAN) or any(c[1] for c in children[:-1]):
        if tree != TOP:
            raise ValueError(f"node {index} of source {tree}, level {level}, lacks children")
        return (tree, level, index), None, children
    lone = tree != TOP and last and index == 0 and len(children) == 1
    return (tree, level, index), (last, children[0][2] if lone else digest(c[2] for c in children), children), None


def messages_up(sources: int) -> Callable[[tuple], list[tuple]]:
    """What a vertex sends: a node its digest to its parent, a subroot to the tree of sources, a waiting vertex what it has to itself; the root nothing."""

    def run(vertex: tuple) -> list[tuple]:
        (tree, level, index), node, waiting = vertex
        if node is None:
            return [((tree, level, index), waiting)]
        last, own, _ = node
        if not (last and index == 0):
            return [((tree, level + 1, index // FAN), [(index % FAN, last, own)])]
        if tree == TOP or sources == 1:
            return []
        return [((TOP, 1, tree // FAN), [(tree % FAN, tree == sources - 1, own, level)])]

    return run


def siblings(children: list[tuple], slot: int) -> bytes:
    """One level of a path: the slot, the number of siblings, their digests."""
    return bytes((slot, len(children) - 1)) + b"".join(c[2] for c in children if c[0] != slot)


def levels(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(path):
        slot, n = path[at], path[at + 1]
        yield slot, [path[at + 2 + 32 * i : at + 34 + 32 * i] for i in range(n)]
        at += 2 + 32 * n


def folded(own: bytes, path: Iterable[tuple[int, list[bytes]]]) -> bytes:
    """What a digest comes to with a path's siblings."""
    for slot, others in path:
        own = digest([*others[:slot], own, *others[slot:]])
    return own


def messages_down(met: tuple) -> Iterator[tuple]:
    """What a node that was sent its path, (path, subroot), sends its children: theirs. A message whose node isn't here goes on."""
    (tree, level, index), (nodes, sent) = met
    for path, subroot in sent:
        found = False
        for _, _, children in nodes:
            found = True
            for c in children:
                whole = siblings(children, c[0]) + path
                if tree == TOP and level == 1:
                    yield (index * FAN + c[0], c[3], 0), (whole, c[2])
                else:
                    yield (tree, level - 1, index * FAN + c[0]), (whole, subroot)
        if not found:
            yield (tree, level, index), (path, subroot)


def verified(root: bytes) -> Callable[[tuple], Iterator[tuple]]:
    """Rows of RESULT for the leaves of a node."""

    def run(met: tuple) -> Iterator[tuple]:
        key, (nodes, sent) = met
        ((_, own, children),), ((path, subroot),) = nodes, sent
        above, tail = list(levels(path)), "".join(d.hex() for _, others in levels(path) for d in others)
        lone, known = len(children) == 1 and children[0][2] == own, {}
        for slot, _, leaf, doc_id, changed in children:
            others = [c[2] for c in children if c[0] != slot]
            first = changed or leaf
            first = first if lone else folded(first, [(slot, others)])
            if first not in known:
                known[first] = folded(first, above)
            proof = hashlib.sha256(("".join(d.hex() for d in others) + tail).encode()).hexdigest()
            yield doc_id, leaf.hex(), subroot.hex(), root.hex(), proof, known[first].hex(), known[first] == root

    return run


class Store:
    """Nodes of the supersteps, written where all executors can read them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark).rstrip('/')}/merkle-{uuid.uuid4().hex}", 0

    def put(self, nodes: RDD) -> RDD:
        self.n += 1
        nodes.saveAsPickleFile(f"{self.base}/{self.n}")
        return self.spark.sparkContext.pickleFile(f"{self.base}/{self.n}")

    def clear(self) -> None:
        remove(self.spark, self.base)


def manifest(docs: DataFrame, *, chosen: Callable[[Column], Column] = every_fifth, tamper: Callable[[Column], Column] = lower_ascii) -> DataFrame:
    """One row a document (RESULT): its leaf, subroot and root, a digest of its proof, and what the leaf, of the tampered text where ``chosen``, comes to by that proof."""
    spark = docs.sparkSession
    ship(spark)
    rows = leaves(docs, chosen, tamper)
    summaries = rows.rdd.mapPartitionsWithIndex(summary).collect()
    place, sources, most = layout(summaries)
    if not sources:
        return spark.createDataFrame([], RESULT)
    widest, whole, cores = rows.rdd.getNumPartitions(), sum(s[7] for s in summaries), spark.sparkContext.defaultParallelism
    tasks = lambda step: widest if step == 1 else min(widest, max(cores, -(-(sources + whole // FAN**step) // NODES_A_TASK)))
    store, up = Store(spark), messages_up(sources)

    messages, steps = rows.rdd.mapPartitionsWithIndex(numbered(place)), []
    for step in range(1, max(1, depth(most)) + depth(sources) + 1):
        steps.append(store.put(messages.groupByKey(tasks(step)).map(received).coalesce(tasks(step))))
        messages = steps[-1].flatMap(up)
    ((root_key, (_, root, _), _),) = steps[-1].filter(lambda vertex: vertex[1] is not None and not up(vertex)).collect()

    sent = spark.sparkContext.parallelize([(root_key, (b"", root if sources == 1 else None))], 1)
    nodes = [step.filter(lambda vertex: vertex[1] is not None).map(lambda vertex: vertex[:2]) for step in steps]
    for step in range(len(steps), 1, -1):
        sent = store.put(nodes[step - 1].cogroup(sent, tasks(step)).flatMap(messages_down).coalesce(tasks(step)))
    found = checkpoint(spark.createDataFrame(nodes[0].cogroup(sent, widest).flatMap(verified(root)), RESULT, verifySchema=False))
    store.clear()
    return found
