"""SimHash near-dedup with BK-trees.

Fingerprints are dealt to shards; each shard has a BK-tree (children keyed by
their integer Hamming distance to the parent), which is searched along the edges
within the radius only.  A small shard's tree is searched where it is built.  A
shard of more than ``shard_limit`` fingerprints is split into chunks with a tree
each; these trees are stored, streamed in key order and broadcast in groups of at most
``tree_bytes``, and all fingerprints of the group's shards are asked in place.
So no task holds more than one small shard or one group of trees, and no link is lost.

Two kinds of links:

* Fingerprints of at most ``radius`` differing bits (``near_groups``).  They are cut into
  ``radius + t`` blocks; two that link agree in ``t`` blocks at least, so every
  choice of ``t`` blocks gives a shard key.  ``t`` grows with the number of
  fingerprints, so that shards stay small.
* Texts whose shingles have a Jaccard similarity of ``least`` or more
  (``near_texts``).  Texts of similarity 0.8 differ by about 10 of 64 bits, too many for
  blocks; here ``BANDS`` keys of ``ROWS`` minima each of the shingle hashes
  name the shards, the trees find the fingerprints within the radius, and whole shingle
  sets decide.  Two texts of similarity s share a shard with probability 1 - (1 - s^ROWS)^BANDS.
  The first round compares each text with the nearest one on its way
  into the tree.  Shards that then still hold several groups take the shingle sets of their texts
  along, and their trees are asked for all links between different groups, each verified at once; a
  link joins two groups, so those told grow with the texts and not with their pairs, and none is lost.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, discard, identified, ints, join_hot, lean, materialize, mix, steps
from .components import components

_U = np.uint64
BANDS, ROWS = 14, 4
#: Odd factors: each turns shingle hashes into another order.
_FACTORS = mix(np.arange(BANDS * ROWS), 77) | _U(1)
#: Shingles that one step of the minima or of the bit counts holds.
_STEP = 1 << 14
#: Shards up to this size grow their tree by insertion, larger ones node by node for all members at once.
_SMALL = 40
#: Nodes that a task's forest holds before it starts anew (links are then told again, which is harmless).
_FOREST = 1 << 20


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the ``shingle``-word shingles, repeats included, of a UTF-8 text, A-Z lower-cased; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, _U)
    x = xxhash.xxh64_digest
    flat = b" ".join(words)
    if len(words) <= shingle:
        return np.frombuffer(x(flat, 42), ">u8").astype(_U)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(words) - shingle + 1].tolist()
    return np.frombuffer(b"".join([x(flat[s:e], 42) for s, e in zip(start, end[shingle - 1 :].tolist(), strict=True)]), ">u8").astype(_U)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), _STEP):
        ones += np.unpackbits(h[at : at + _STEP].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash of a text's shingles; 0 without words."""
    return majority(shingle_hashes(text, shingle))


def band_keys(h: np.ndarray) -> np.ndarray:
    """``BANDS`` shard keys of a text's shingle hashes."""
    low = np.full(BANDS * ROWS, ~_U(0))
    for at in range(0, len(h), _STEP):
        low = np.minimum(low, (_FACTORS[:, None] * h[at : at + _STEP]).min(axis=1))
    key = np.arange(BANDS).astype(_U)
    for r in range(ROWS):
        key = mix(key ^ low[r::ROWS], r)
    return key


class BKTree:
    """A BK-tree over 64-bit integers, grown by insertion; ``near(x, r)`` follows the edges from d - r to d + r only."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.members: list[list[int]] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int, row: int) -> tuple[int, int]:
        """Insert ``x`` for ``row``; returns the first row of the nearest node on the way and its distance (-1, 64 for the root)."""
        values, children = self.values, self.children
        best, least, at = -1, 64, 0
        while at < len(values):
            d = (values[at] ^ x).bit_count()
            if d < least or best < 0:
                best, least = at, d
            if d == 0:
                self.members[at].append(row)
                break
            at = children[at].setdefault(d, len(values))
        else:
            values.append(x)
            self.members.append([row])
            children.append({})
        return (self.members[best][0] if best >= 0 else -1), least

    def near(self, x: int, radius: int) -> list[int]:
        """Rows within ``radius`` of ``x``."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ x).bit_count()
            if d <= radius:
                found += self.members[at]
            todo += [c for e, c in self.children[at].items() if d - radius <= e <= d + radius]
        return found


class PackedTree:
    """A BK-tree in arrays: ``order`` (members by node), and each node's children as ``edge, node`` from ``begin``."""

    def __init__(self, values: np.ndarray, order: np.ndarray, parent: np.ndarray, edge: np.ndarray) -> None:
        self.values, self.order, self.parent, self.edge = values, order, parent, edge
        self.by_parent = np.argsort(parent[1:], kind="stable") + 1
        self.begin = np.searchsorted(parent[self.by_parent], np.arange(len(values) + 1))

    @classmethod
    def grow(cls, v: np.ndarray) -> PackedTree:
        order, parent, edge = (np.zeros(len(v), np.int32) for _ in range(3))
        todo, n = [(np.arange(len(v)), -1, 0)], 0
        while todo:
            members, above, distance = todo.pop()
            order[n], parent[n], edge[n] = members[0], above, distance
            if len(members) > 1:
                rest = members[1:]
                d = np.bitwise_count(v[rest] ^ v[members[0]])
                by = np.argsort(d, kind="stable")
                cut = np.flatnonzero(np.diff(d[by])) + 1
                todo += [(rest[part], n, int(d[part[0]])) for part in np.split(by, cut)]
            n += 1
        return cls(v[order], order, parent, edge)

    def pack(self) -> bytes:
        return self.values.astype("<u8").tobytes() + self.parent.astype("<i4").tobytes() + self.edge.astype("<i4").tobytes()

    @classmethod
    def unpack(cls, blob: bytes) -> PackedTree:
        n = len(blob) // 16
        return cls(np.frombuffer(blob, "<u8", n), np.arange(n), np.frombuffer(blob, "<i4", n, 8 * n), np.frombuffer(blob, "<i4", n, 12 * n))

    def near(self, queries: np.ndarray, radius: int):
        """``node, hits`` (indexes into ``queries``) for every node with hits; queries that may follow an edge go down together."""
        todo = [(0, np.arange(len(queries)))] if len(self.values) else []
        while todo:
            at, asked = todo.pop()
            d = np.bitwise_count(queries[asked] ^ self.values[at]).astype(np.int16)
            if len(hit := asked[d <= radius]):
                yield at, hit
            for child in self.by_parent[self.begin[at] : self.begin[at + 1]].tolist():
                below = asked[np.abs(d - np.int16(self.edge[child])) <= radius]
                if len(below):
                    todo.append((child, below))


class _Forest:
    """Union-find over the members of one task; ``join`` says whether a link is new to the task."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1) if len(a) or len(b) else 1.0


class Shard:
    """Members of a shard: fingerprints, ids, groups (of known links), and shingle sets where links need a proof."""

    def __init__(self, fp: np.ndarray, ids: np.ndarray, groups: np.ndarray, sets: list[bytes] | None) -> None:
        self.fp, self.ids, self.groups, self.sets = fp, ids, groups, sets

    @classmethod
    def of(cls, batch: pa.RecordBatch, rows: np.ndarray | slice) -> Shard:
        sets = column(batch, "set").take(pa.array(np.arange(batch.num_rows)[rows])).to_pylist() if "set" in batch.schema.names else None
        return cls(ints(batch, "fp").view(_U)[rows], ints(batch, "id")[rows], ints(batch, "group")[rows], sets)

    @classmethod
    def join(cls, parts: list[Shard]) -> Shard:
        sets = None if parts[0].sets is None else [s for p in parts for s in p.sets]
        return cls(*(np.concatenate([getattr(p, x) for p in parts]) for x in ("fp", "ids", "groups")), sets)

    def take(self, order: np.ndarray) -> Shard:
        return Shard(self.fp[order], self.ids[order], self.groups[order], None if self.sets is None else [self.sets[i] for i in order.tolist()])

    def __len__(self) -> int:
        return len(self.fp)


def _shards(batches, least: int = 2):
    """Whole shards of ``least`` members or more with their keys; batches come sorted by key."""
    key, held = None, []
    for b in batches:
        if b.num_rows == 0:
            continue
        keys = ints(b, "key")
        cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)], strict=True):
            if keys[s] != key:
                if sum(map(len, held)) >= least:
                    yield key, Shard.join(held)
                key, held = keys[s], []
            held.append(Shard.of(b, slice(s, e)))
    if sum(map(len, held)) >= least:
        yield key, Shard.join(held)


class _Links:
    """Links that are new to the task: members whose groups it has joined are not compared again."""

    def __init__(self, least: float) -> None:
        self.least, self.forest, self.pairs = least, _Forest(), []

    def begin(self, shard: Shard) -> None:
        self.shard, self.label = shard, np.unique(shard.groups, return_inverse=True)[1]

    def _alike(self, row: int, other: int) -> bool:
        a, b = self.shard.sets[row], self.shard.sets[other]
        if min(len(a), len(b)) < self.least * max(len(a), len(b)):
            return False
        return similarity(np.frombuffer(a, _U), np.frombuffer(b, _U)) >= self.least

    def add(self, row: int, others: np.ndarray) -> None:
        """Link one member of the shard with the groups of other members."""
        while len(others := others[self.label[others] != self.label[row]]):
            group, at = int(self.label[others[0]]), int(others[0])
            if self.shard.sets is not None and not self._alike(row, at):
                others = others[1:]
                continue
            a, b = int(self.shard.ids[row]), int(self.shard.ids[at])
            if self.forest.join(a, b):
                self.pairs.append((a, b))
            self.label[self.label == group] = self.label[row]

    def batch(self, least: int = 1):
        if len(self.pairs) >= least:
            yield _pairs(self.pairs)
            self.pairs = []
        if len(self.forest.up) > _FOREST:
            self.forest = _Forest()


def _pairs(pairs: list) -> pa.RecordBatch:
    a, b = np.array(pairs, np.int64).T
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _search(radius: int, least: float):
    """Links inside each small shard, by its own tree."""

    def run(batches):
        links = _Links(least)
        for _, shard in _shards(batches):
            links.begin(shard)
            if len(shard) <= _SMALL:
                tree = BKTree()
                for i, x in enumerate(shard.fp.tolist()):
                    if found := tree.near(x, radius):
                        links.add(i, np.array(found))
                    tree.add(x, i)
            else:
                tree = PackedTree.grow(shard.fp)
                for node, hit in tree.near(shard.fp, radius):
                    links.add(int(tree.order[node]), hit)
            yield from links.batch(10_000)
        yield from links.batch()

    return lean(run)


def _nearest(radius: int):
    """For each member of a shard the nearest one on its way into the tree, if within the radius; links without a proof."""

    def run(batches):
        pairs = []
        for _, shard in _shards(batches):
            tree, ids = BKTree(), shard.ids.tolist()
            for i, x in enumerate(shard.fp.tolist()):
                row, d = tree.add(x, i)
                if row >= 0 and d <= radius and ids[row] != ids[i]:
                    pairs.append((ids[i], ids[row]))
            if len(pairs) > 10_000:
                yield _pairs(pairs)
                pairs = []
        if pairs:
            yield _pairs(pairs)

    return lean(run)


def _grow(batches):
    for key, shard in _shards(batches, 1):
        tree = PackedTree.grow(shard.fp)
        members = shard.take(tree.order)
        sets = members.sets if members.sets is not None else [b""] * len(members)
        numbers = np.stack((members.ids, members.groups)).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([tree.pack()], pa.binary()), pa.array([numbers], pa.binary()), pa.array([sets], pa.list_(pa.binary()))], names=["key", "tree", "members", "sets"])


def _ask(trees, radius: int, least: float):
    """Links of fingerprints with the broadcast trees of their shards."""

    def run(batches):
        grown: dict[int, list] = {}
        for k, v in trees.value.items():
            for t, m, sets in v:
                tree = PackedTree.unpack(t)
                grown.setdefault(k, []).append((tree, Shard(tree.values, *np.frombuffer(m, np.int64).reshape(2, -1), sets if least else None)))
        links = _Links(least)
        for b in batches:
            if b.num_rows == 0:
                continue
            key = ints(b, "key")
            order = np.argsort(key, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                asking = Shard.of(b, part)
                for tree, members in grown.get(int(key[part[0]]), ()):
                    links.begin(Shard.join([asking, members]))
                    for node, hit in tree.near(asking.fp, radius):
                        links.add(len(part) + node, hit)
                    yield from links.batch(10_000)
        yield from links.batch()

    return lean(run)


def _tree_groups(trees: DataFrame, tree_bytes: int):
    """Trees by key, in key order, at most ``tree_bytes`` (or one tree) at a time on the driver."""
    size = F.length("tree") + F.length("members") + F.aggregate("sets", F.lit(0), lambda n, s: n + F.length(s))
    total = trees.agg(F.sum(size)).first()[0] or 0
    parts = 1 + 4 * total // tree_bytes  # partitions come to the driver one by one
    group: dict[int, list] = {}
    held = 0
    for row in trees.repartitionByRange(parts, "home", "key").sortWithinPartitions("home", "key").toLocalIterator():
        sets = [bytes(s) for s in row["sets"]]
        more = len(row["tree"]) + len(row["members"]) + sum(map(len, sets))
        if group and held + more > tree_bytes:
            yield group
            group, held = {}, 0
        group.setdefault(row["home"], []).append((bytes(row["tree"]), bytes(row["members"]), sets))
        held += more
    if group:
        yield group


def shard_links(keyed: DataFrame, radius: int, shard_limit: int, tree_bytes: int, least: float = 0.0) -> DataFrame:
    """``a, b``: links that connect ids of different groups that share a key and whose fingerprints lie within ``radius``.

    ``keyed`` has ``key, fp, id, group``, and with ``least`` also ``set``: links then need that similarity.
    """
    columns = ["key", "fp", "id", "group", *(["set"] if least else [])]
    counts = keyed.groupBy("key").agg(F.count("*").alias("n"))
    large = materialize(counts.where(F.col("n") > shard_limit), "large-shards")
    if large.isEmpty():
        return keyed.select(*columns).repartition(F.col("key")).sortWithinPartitions("key", "fp", "id").mapInArrow(_search(radius, least), "a long, b long")
    sized = materialize(join_hot(keyed, large.withColumnRenamed("n", "size"), "key", F.xxhash64("id"), keyed.count(), "left", large), "sized-shards")
    small = sized.where("size IS NULL").select(*columns).repartition(F.col("key")).sortWithinPartitions("key", "fp", "id")
    found = small.mapInArrow(_search(radius, least), "a long, b long")
    # Large shards: chunks of one tree each, asked in place by all members of the shard.
    hot = materialize(sized.where("size IS NOT NULL").repartitionByRange("key", "id").sortWithinPartitions("key"), "hot-shards")
    chunk = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / shard_limit))
    chunks = hot.select(F.xxhash64("key", chunk).alias("key"), *columns[1:], F.col("key").alias("home"))
    homes = chunks.groupBy("key").agg(F.min("home").alias("home"))
    grown = chunks.drop("home").repartition(F.col("key")).sortWithinPartitions("key", "fp", "id").mapInArrow(lean(_grow), "key long, tree binary, members binary, sets array<binary>")
    trees = materialize(grown.join(homes, "key"), "shard-trees")
    context = keyed.sparkSession.sparkContext
    for group in _tree_groups(trees, tree_bytes):
        told = context.broadcast(group)
        asked = hot.where(F.col("key").between(min(group), max(group))).select(*columns)
        found = found.unionAll(materialize(asked.mapInArrow(_ask(told, radius, least), "a long, b long"), "tree-links"))
        told.destroy()
    return found


def blocks_taken(radius: int, total: int, each: int = 32) -> int:
    """The number of blocks in a shard key: the least from 2 on with ``each`` random fingerprints a shard or fewer (at most 200 keys)."""
    taken = 2
    while total >> (64 * taken // (radius + taken)) > each and comb(radius + taken + 1, taken + 1) <= 200:
        taken += 1
    return taken


def shard_keys(fp: Column, radius: int, taken: int = 2) -> list[Column]:
    """One key for each choice of ``taken`` of the ``radius + taken`` blocks of a fingerprint column."""
    n = radius + taken
    cuts = [round(64 * i / n) for i in range(n + 1)]
    block = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return [F.xxhash64(F.lit(i), *(block[a] for a in c)) for i, c in enumerate(combinations(range(n), taken))]


def link_fingerprints(nodes: DataFrame, radius: int = 4, shard_limit: int = 2048, tree_bytes: int = 64 << 20, total: int = 0) -> DataFrame:
    """``a, b``: links that connect whatever distinct fingerprints in column ``fp`` lie within ``radius`` (a spanning set, not all pairs)."""
    keys = shard_keys(F.col("fp"), radius, blocks_taken(radius, total))
    keyed = nodes.select("fp", F.explode(F.array(*keys)).alias("key"), F.col("fp").alias("id"), F.col("fp").alias("group"))
    return shard_links(keyed, radius, shard_limit, tree_bytes)


def _prints(shingle: int, bands: bool):
    def run(batches):
        for b in steps(batches):
            h = [shingle_hashes(t, shingle) for t in column(b, "text").to_pylist()]
            fp = np.array([majority(x) for x in h], _U)
            keys = [band_keys(x) if bands else np.zeros(0, _U) for x in h]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(k) for k in keys]))), pa.int32()), pa.array(np.concatenate(keys).view(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "did"), column(b, "th"), pa.array(fp.view(np.int64), pa.int64()), lists], names=["doc_id", "did", "th", "fp", "keys"])

    return lean(run)


_PRINTS = "doc_id long, did long, th long, fp long, keys array<long>"


def _gather(prints: DataFrame, nodes: DataFrame, roots: DataFrame, id_col: str) -> DataFrame:
    """``doc_id, did, th, fp, component_id, root`` of all rows: ``nodes`` has ``id, low, n``, ``roots`` ``node, root``."""
    # Copies share a node and a group its root; either may hold a large part of all rows.
    rooted = materialize(nodes.select("id", "low", "n").join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"), "low", F.col("n").alias("rows")), "rooted")
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    member = join_hot(rooted, least, "root", F.xxhash64("id"), nodes.count()).select(F.col("id").alias(id_col), "component_id", "root", F.col("rows").alias("n"))
    sizes = nodes.select(F.col("id").alias(id_col), "n")
    return join_hot(prints.drop("keys"), member.drop("n"), id_col, F.monotonically_increasing_id(), prints.count(), sizes=sizes).select("doc_id", "did", "th", "fp", "component_id", "root")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, shard_limit: int = 2048, tree_bytes: int = 64 << 20) -> DataFrame:
    """``doc_id, did, th, fp, component_id, root`` for each input row.

    ``component_id`` is the smallest id that links of at most ``radius``
    differing bits reach; ``root``, the smallest fingerprint there, names the
    component where ids are null or repeated.  Null and empty texts have fingerprint 0, which links
    like any other; a null id counts as no id when the smallest is sought (a
    component of null ids only has a null id); identical rows and rows that
    share an id link by their texts alone.  A bit that exactly half of the shingles
    set is 0.  A very long text is hashed whole, in steps; an empty table gives
    no rows; other columns are not read, whatever their names.
    """
    prints = materialize(identified(docs, id_col, text_col).mapInArrow(_prints(shingle, False), _PRINTS), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).withColumn("id", F.col("fp")), "distinct-fingerprints")
    links = link_fingerprints(nodes.select("fp"), radius, shard_limit, tree_bytes, nodes.count())
    return _gather(prints, nodes, components(links, "a", "b"), "fp")


def _sets(shingle: int):
    def run(batches):
        for b in steps(batches):
            sets = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in column(b, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(b, "th"), pa.array(sets, pa.binary())], names=["th", "set"])

    return lean(run)


def _alike(least: float):
    def run(batches):
        for b in steps(batches, "x"):
            pairs = zip(column(b, "x"), column(b, "y"), strict=True)
            keep = pa.array([similarity(*(np.frombuffer(s.as_buffer(), _U) for s in p)) >= least for p in pairs], pa.bool_())
            yield pa.RecordBatch.from_arrays([column(b, c).filter(keep) for c in "ab"], names=["a", "b"])

    return lean(run)


def _shingle_sets(rows: DataFrame, wanted: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """The stored ``th, set`` of the texts whose ids are in ``wanted``."""
    met = wanted.select("id").distinct().join(nodes, "id").select("did", F.col("id").alias("th"))
    # One row of each text; repeated rows are one before the shuffle.
    once = rows.groupBy("did", "th").agg(F.first("text").alias("text"))
    return materialize(once.join(met, ["did", "th"], "left_semi").select("th", "text").mapInArrow(_sets(shingle), "th long, set binary"), "shingle-sets")


def _verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, shingle: int, least: float) -> DataFrame:
    """Those of the ``pairs`` of texts whose whole shingle sets are alike."""
    pairs = materialize(pairs.distinct(), "candidates")
    if not (total := pairs.count()):
        return pairs
    sets = _shingle_sets(rows, pairs.select(F.explode(F.array("a", "b")).alias("id")), nodes, shingle)
    now = pairs
    for one, name, other in (("a", "x", "b"), ("b", "y", "a")):
        sizes = pairs.groupBy(one).agg(F.count("*").alias("n"))
        now = join_hot(now, sets.select(F.col("th").alias(one), F.col("set").alias(name)), one, F.xxhash64(other), total, sizes=sizes)
    alike = materialize(now.select("a", "b", "x", "y").mapInArrow(_alike(least), "a long, b long"), "alike")
    discard(pairs)
    discard(sets)
    return alike


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, radius: int = 18, shard_limit: int = 512, tree_bytes: int = 64 << 20) -> DataFrame:
    """``doc_id, did, th, fp, component_id, root`` for each input row, as ``near_groups``, where texts link that share
    ``least`` or more of their ``shingle``-word shingles; ``root`` is the smallest text hash of the component.

    Texts without words are alike; a text of fewer words is one shingle.  Nulls,
    repeated rows, long texts, empty tables and other columns are treated as by ``near_groups``.
    """
    rows = identified(docs, id_col, text_col)
    prints = materialize(rows.mapInArrow(_prints(shingle, True), _PRINTS), "fingerprints")
    nodes = materialize(prints.groupBy(F.col("th").alias("id")).agg(F.min("did").alias("did"), F.min("doc_id").alias("low"), F.count("*").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "distinct-texts")
    keyed = nodes.select("id", "fp", F.explode("keys").alias("key"))
    # Only shards of two texts or more are kept.
    met = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    total = nodes.count()
    shards = materialize(join_hot(keyed, met.withColumn("size", F.col("n")), "key", F.xxhash64("id"), BANDS * total), "shards")
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / shard_limit))
    first = shards.select(F.xxhash64("key", part).alias("key"), "fp", "id", F.col("id").alias("group")).repartition(F.col("key")).sortWithinPartitions("key", "fp", "id")
    alike = _verified(first.mapInArrow(_nearest(radius), "a long, b long"), rows, nodes, shingle, least)
    groups = components(alike, "a", "b")
    known = materialize(shards.join(groups.withColumnRenamed("node", "id"), "id", "left").select("key", "fp", "id", F.coalesce("root", "id").alias("group")), "grouped-shards")
    discard(shards)
    mixed = known.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n")
    rest = materialize(join_hot(known, mixed, "key", F.xxhash64("id"), known.count()), "open-shards")
    discard(known)
    if not rest.isEmpty():
        sets = _shingle_sets(rows, rest, nodes, shingle)
        more = shard_links(rest.join(sets.withColumnRenamed("th", "id"), "id"), radius, shard_limit, tree_bytes, least)
        alike = alike.unionAll(materialize(more, "alike"))
        discard(sets)
    discard(rest)
    return _gather(prints, nodes, components(alike, "a", "b"), "th")


def op2(spark, sf_dir: str) -> DataFrame:
    """``near_groups`` over all documents, fingerprints in hexadecimal."""
    out = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
