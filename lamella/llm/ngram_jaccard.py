"""N-gram Jaccard join by PartEnum signatures.

Two sets with Jaccard similarity of at least p % have sizes within a factor
100/p and differ in at most k elements, k being fixed by their size band. The
shingle domain is cut into n1 parts of three slots each, with 2 * n1 > k, so
that similar sets differ in at most one element of some part and agree on two
of its three slots. Every pair of slots of every part gives one signature;
similar sets of neighbouring bands share at least one, whatever their texts.

Sets, not documents, are joined: copies are one node. Signatures travel packed
(see ``packed``) and each map task keeps one node per signature, so a group of
near copies of any size reaches a shard as one node per task. Within a bucket
all nodes are compared with the least one, its pivot; where the links found so
far leave the others of a bucket in several components, pairs across
components are searched by how their members differ from a common centre (see
``_cross_pairs``), which loses no link and doesn't list the pairs of a group.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.llm.bloom import bloom_filter, probe
from lamella.llm.common import lower_words_of, map_batches, materialise, mix64, parts_for, prepare
from lamella.llm.components import connected_components
from lamella.llm.packed import pack_sorted, shard_slices, unpack_sorted

#: Slot pairs of a part that make up its signatures.
SLOT_PAIRS = ((0, 1), (0, 2), (1, 2))
#: Signatures that a map task gathers before it sends them, and bytes of input per shard.
FLUSH, SHARD_BYTES = 1 << 20, 64 << 20
#: Members of open buckets with one pivot of which all pairs are taken.
DIRECT = 16
#: Bits of a set's sketch.
SKETCH = 512
_ODD = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_U32 = np.uint64(32)


class WordHashes(dict):
    """64-bit hashes of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer words is one shingle, one without words none."""
    words = lower_words_of(text)
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    if n < size:
        return mix64((h * _ODD[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    out = h[: n - size + 1] * _ODD[0]
    for i in range(1, size):
        out += h[i : n - size + 1 + i] * _ODD[i]
    return np.unique(mix64(out + np.uint64(size)))


def node_of(shingles: np.ndarray) -> int:
    """A set's identity: copies, and texts with equal sets, are one node."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), len(shingles)) - (1 << 63)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Which of SKETCH classes of hashes hold an odd number of the set's elements, as longs; two sets differ in as many elements as their sketches in bits, or more."""
    odd = np.bincount((shingles & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


class Bands:
    """Size bands [low, high] with high = low * 100 // percent, and the most differences k of a pair.

    A pair whose smaller set is in band j has its larger one in band j or
    j + 1 and differs in at most high_j * (100 - percent) // percent elements.
    """

    def __init__(self, percent: int, most: int = 1 << 32) -> None:
        high = [100 // percent]
        while high[-1] < most:
            high.append((high[-1] + 1) * 100 // percent)
        self.high = np.array(high, np.int64)
        k = self.high * (100 - percent) // percent
        # Of n1 parts, at least n1 - k // 2 have one difference at most; all but ``spare`` of these can be done without.
        needed = k // 2 + 1
        self.spare = np.minimum(needed // 12, 2 + needed // 16)
        #: Parts of an instance; none where only equal sets qualify.
        self.parts = np.where(k > 0, needed + self.spare, 0)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.high, sizes)


def _slot_signatures(elements: np.ndarray, starts: np.ndarray, parts: np.ndarray, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of several sets, a row for each part and a column for each pair of slots.

    Returns the signatures, each row's set, and whether the two slots are
    empty. ``elements`` holds each set's sorted hashes from ``starts[i]`` to
    ``starts[i + 1]``. As slots cut the hash space in order, a set's slots are
    runs of its sorted elements.
    """
    slots = 3 * parts
    base = np.concatenate([[0], np.cumsum(slots)])
    sizes = np.diff(starts)
    own = ((elements >> _U32) * np.repeat(slots, sizes).astype(np.uint64) >> _U32).astype(np.int64) + np.repeat(base[:-1], sizes)
    digest = np.zeros(base[-1], np.uint64)
    if len(own):
        first = np.flatnonzero(np.diff(own, prepend=-1))
        digest[own[first]] = np.add.reduceat(mix64(elements + _ODD[40]), first)
    digest = digest.reshape(-1, 3)
    owner = np.repeat(np.arange(len(parts)), parts)
    part = (np.arange(len(owner)) - np.repeat(base[:-1] // 3, parts)).astype(np.uint64)
    out, empty = np.empty(digest.shape, np.uint64), np.empty(digest.shape, bool)
    for j, (a, b) in enumerate(SLOT_PAIRS):
        tag = mix64(salts[owner] + part * _ODD[41] + np.uint64(j + 1) * _ODD[42])
        # An empty slot's digest is 0; sums of mixed hashes are 0 for others with negligible chance.
        out[:, j] = mix64(digest[:, a] * _ODD[43] + digest[:, b] * _ODD[44] + tag)
        empty[:, j] = (digest[:, a] | digest[:, b]) == 0
    return out, owner, empty


def signatures(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of the sets and the index of the set that each belongs to.

    Two empty slots would be one bucket for many unlike sets. There are
    ``spare`` parts more than a pair of similar sets needs, so a set with
    empty slot pairs in no more parts than that leaves them out. Where both
    sets of a pair have more, both also give signatures of a second partition,
    in which empty slots count if there are too many again.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    band = bands.of(sizes)
    entries = [(i, j) for i, b in enumerate(band) if sizes[i] for j in (b, b - 1) if j >= 0 and bands.parts[j]]
    if not entries:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    which, instance = (np.array(x) for x in zip(*entries, strict=True))
    found, owners = [], []
    for second in (False, True):
        chosen = [np.sort(mix64(sets[i] ^ _ODD[46])) if second else sets[i] for i in which]
        starts = np.concatenate([[0], np.cumsum([len(s) for s in chosen])])
        salts = mix64(instance.astype(np.uint64) + _ODD[47 if second else 45])
        sigs, owner, empty = _slot_signatures(np.concatenate(chosen), starts, bands.parts[instance], salts)
        sparse = np.bincount(owner[empty.any(axis=1)], minlength=len(which)) > bands.spare[instance]
        kept = ~empty | sparse[owner][:, None] if second else ~empty
        found.append(sigs[kept])
        owners.append(which[np.broadcast_to(owner[:, None], kept.shape)[kept]])
        which, instance = which[sparse], instance[sparse]
        if not len(which):
            break
    return np.concatenate(found), np.concatenate(owners)


def _runs(sigs: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (signature, node), the least node of each one's run, and whether the run has others."""
    order = np.lexsort((nodes, sigs))
    sigs, nodes = sigs[order], nodes[order]
    new_sig = np.diff(sigs, prepend=~sigs[:1]) != 0
    fresh = new_sig | (np.diff(nodes, prepend=nodes[:1]) != 0)
    sigs, nodes, new_sig = sigs[fresh], nodes[fresh], new_sig[fresh]
    first = np.flatnonzero(new_sig)
    length = np.diff(np.append(first, len(sigs)))
    return sigs, nodes, np.repeat(nodes[first], length), np.repeat(length > 1, length)


def _buckets(docs: DataFrame, size: int, bands: Bands, shards: int) -> DataFrame:
    """Rows (sig, node, pivot) of all signatures that several nodes share, the least node's own row included."""

    def flush(sigs: list[np.ndarray], nodes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        s, n, pivot, several = _runs(np.concatenate(sigs), np.concatenate(nodes))
        rows = []
        for shard, a, b in shard_slices(s, shards):
            keep = n[a:b] == pivot[a:b]
            table, at = np.unique(n[a:b][keep], return_inverse=True)
            inner = np.column_stack([s[a:b].view(np.int64), n[a:b], pivot[a:b]])[several[a:b]]
            place = at.astype(np.uint16 if len(table) <= 1 << 16 else np.uint32)
            rows.append((shard, pack_sorted(s[a:b][keep]), table.tobytes(), place.tobytes(), inner.tobytes()))
        names = ["shard", "sigs", "nodes", "place", "inner"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32()] + [pa.binary()] * 4, strict=True)], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sigs, nodes, held = WordHashes(), [], [], 0
        for batch in batches:
            distinct = {node_of(s): s for t in batch.column("text").to_pylist() if len(s := shingle_set(t, size, hashes))}
            names, sets = np.array(list(distinct), np.int64), list(distinct.values())
            for i in range(0, len(sets), 256):
                found, owner = signatures(sets[i : i + 256], bands)
                sigs.append(found)
                nodes.append(names[i : i + 256][owner])
                held += len(found)
                if held >= FLUSH:
                    yield from flush(sigs, nodes)
                    sigs, nodes, held = [], [], 0
        if held:
            yield from flush(sigs, nodes)

    def gather(group: pa.Table) -> pa.Table:
        sigs, nodes, inner = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty((0, 3), np.int64)]
        for row in group.drop_columns(["shard"]).to_pylist():
            sigs.append(unpack_sorted(row["sigs"]))
            table = np.frombuffer(row["nodes"], np.int64)
            nodes.append(table[np.frombuffer(row["place"], np.uint16 if len(table) <= 1 << 16 else np.uint32)])
            inner.append(np.frombuffer(row["inner"], np.int64).reshape(-1, 3))
        s, n, pivot, several = _runs(np.concatenate(sigs), np.concatenate(nodes))
        rows = np.concatenate([np.column_stack([s.view(np.int64), n, pivot])[several], *inner])
        return pa.table({name: np.ascontiguousarray(rows[:, i]) for i, name in enumerate(("sig", "node", "pivot"))})

    sent = docs.select("text").mapInArrow(run, "shard int, sigs binary, nodes binary, place binary, inner binary")
    return sent.groupBy("shard").applyInArrow(gather, "sig long, node long, pivot long")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets are similar."""
    both = (
        pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, recent = WordHashes(), OrderedDict()

        def get(node: int, text: str) -> np.ndarray:
            if node not in recent:
                recent[node] = shingle_set(text, size, hashes)
                if len(recent) > 64:
                    recent.popitem(last=False)
            return recent[node]

        for batch in batches:
            a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
            hit = [similar(get(x, t), shingle_set(u, size, hashes), percent) for x, t, u in zip(a, ta, tb, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, ok in zip(c, hit, strict=True) if ok], pa.int64()) for c in (a, b)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _texts_of(nodes: DataFrame, owned: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(node, text) for the given nodes, from one document each; unwanted texts are dropped before the shuffle."""
    wanted = materialise(owned.join(nodes, "node").groupBy("node").agg(F.min("id").alias("id")), "jaccard-wanted")
    table = bloom_filter(wanted, "id", wanted.count(), most_bytes=8 << 20)
    found = probe(docs.filter("id is not null"), "id", table, keep_all=False).join(wanted, "id").select("node", "text")

    def own(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = WordHashes()
        mask = [node_of(shingle_set(t, size, hashes)) == n for n, t in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        return batch.filter(pa.array(mask, pa.bool_()))

    return materialise(map_batches(found, own, "node long, text string").dropDuplicates(["node"]), "jaccard-texts")


def _families(open_: DataFrame, shares: DataFrame) -> DataFrame:
    """(pivot, node, label, central) of the members (pivot, node, label) of open buckets, with families that have members in common as one.

    A family goes to the least pivot that a member of it has. All its pairs
    stay together, and a node that was with several pivots is there once, or
    a few times. The ``pivot`` given is the family's centre: the member with
    the most ``shares`` (node, shares), the buckets that it has in common with
    others, as it is the one with fewest changes of its own. ``central`` are
    those in its component.
    """
    least = open_.groupBy("node").agg(F.min("pivot").alias("least"))
    to = open_.join(least, "node").groupBy("pivot").agg(F.min("least").alias("family"))
    merged = materialise(open_.join(to, "pivot").select("family", "node", "label").distinct().join(shares, "node"), "jaccard-families")
    centres = merged.groupBy("family").agg(F.max(F.struct("shares", "node", "label")).alias("centre"))
    return merged.join(centres, "family").select(F.col("centre.node").alias("pivot"), "node", "label", (F.col("label") == F.col("centre.label")).alias("central"))


def _differences(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """``members`` (pivot, node, label, central) with how each one's set differs from its pivot's.

    ``n`` is its size, ``far`` the elements it has and the pivot hasn't,
    ``lost`` the most elements that a set similar to it can lack, ``most`` the
    largest difference from such a set. It is ``near`` if its own elements are
    no more than ``lost``; only then is ``delta``, its whole difference, given.
    It is ``alike`` if it is similar to the pivot, and then central too.
    """
    both = (
        members.join(texts.select("node", F.col("text").alias("text_x")), "node")
        .join(texts.select(F.col("node").alias("pivot"), F.col("text").alias("text_c")), "pivot")
        .select("pivot", "node", "label", "central", "text_x", "text_c")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, recent = WordHashes(), OrderedDict()

        def centre(pivot: int, text: str) -> np.ndarray:
            if pivot not in recent:
                recent[pivot] = shingle_set(text, size, hashes)
                if len(recent) > 64:
                    recent.popitem(last=False)
            return recent[pivot]

        for batch in batches:
            n, lost, most, near, alike, bits, far, delta = [], [], [], [], [], [], [], []
            for r in batch.select(["pivot", "text_x", "text_c"]).to_pylist():
                x, c = shingle_set(r["text_x"], size, hashes), centre(r["pivot"], r["text_c"])
                own = np.setdiff1d(x, c, assume_unique=True)
                n.append(len(x))
                lost.append(len(x) * (100 - percent) // 100)
                most.append(len(x) * (100 - percent) // percent)
                near.append(len(own) <= lost[-1])
                alike.append(100 * (len(x) - len(own)) >= percent * (len(c) + len(own)))
                bits.append(sketch(x))
                far.append(own.view(np.int64))
                delta.append(np.setxor1d(x, c, assume_unique=True).view(np.int64) if near[-1] else None)
            central = pa.array([x or y for x, y in zip(batch.column("central").to_pylist(), alike, strict=True)], pa.bool_())
            numbers = [pa.array(x, pa.int64()) for x in (n, lost, most)]
            arrays = [pa.array(x, pa.list_(pa.int64())) for x in (bits, far, delta)]
            kept = [batch.column(c) for c in ("pivot", "node", "label")]
            yield pa.RecordBatch.from_arrays([*kept, central, *numbers, pa.array(near, pa.bool_()), pa.array(alike, pa.bool_()), *arrays], names)

    schema = "pivot long, node long, label long, central boolean, n long, lost long, most long, near boolean, alike boolean, bits array<long>, far array<long>, delta array<long>"
    names = [x.split()[0] for x in schema.split(", ")]
    return both.mapInArrow(run, schema)


def _numbered(elements: DataFrame) -> DataFrame:
    """Rows (pivot, node, e) that another node of the pivot has too, with each node's ``place``, rarest first, and number of them, ``common``."""
    shared = elements.groupBy("pivot", "e").agg(F.count("*").alias("times")).filter("times > 1")
    own = Window.partitionBy("pivot", "node")
    return elements.join(shared, ["pivot", "e"]).withColumns({"place": F.row_number().over(own.orderBy("times", "e")), "common": F.count("*").over(own)}).drop("times")


def _cross_pairs(buckets: DataFrame, pairs: DataFrame, roots: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Untested pairs (a, b) of different components that share a bucket and can be similar.

    A bucket in which all nodes have been compared with one pivot is open only
    if its other nodes are in several components; where tasks had pivots of
    their own, it is open if it has several components at all. The members of
    open buckets with one least node are a family. Of up to DIRECT members, all
    pairs are taken, which is less than to compare their elements. Larger
    families that have members in common are joined and get a centre, their
    pivot from here on (see ``_families``). Members that are similar to it are
    pairs with it; they and those in its component are searched only as
    partners of others. A set has at most ``lost`` elements that a similar
    one lacks. So a member with more than that which the pivot lacks shares one
    of its ``lost`` + 1 rarest with all that are similar to it. Where neither of
    two has so many, they differ in d(x) + d(y) - 2 c elements, where d is the
    size of a difference from the pivot and c what these differences have in
    common: they need a common element among the rarest of their differences
    unless both are next to the pivot. So neither a passage that many sets
    share nor a group of near copies is compared pair by pair, and no link is
    lost. Nor is one by the sketches, which differ in no more bits than the sets
    in elements: pairs whose sketches differ in more than similar sets can are
    left out.
    """
    label = F.coalesce("root", "node")
    labelled = buckets.join(roots, "node", "left").select("sig", "node", "pivot", label.alias("label"))
    other = F.when(F.col("node") != F.col("pivot"), F.col("label"))
    facts = [f(c).alias(f"{f.__name__}_{n}") for n, c in (("pivot", F.col("pivot")), ("label", F.col("label")), ("other", other)) for f in (F.min, F.max)]
    mixed = labelled.groupBy("sig").agg(*facts).filter("min_label <> max_label and (min_pivot <> max_pivot or min_other <> max_other)").select("sig", "min_pivot")
    open_ = materialise(labelled.drop("pivot").join(mixed, "sig").select(F.col("min_pivot").alias("pivot"), "node", "label").distinct(), "jaccard-open")
    sizes = open_.groupBy("pivot").agg(F.count("*").alias("members"))
    few = open_.join(sizes.filter(f"members <= {DIRECT}").select("pivot"), "pivot")
    direct = few.alias("l").join(few.alias("r"), F.expr("l.pivot = r.pivot and l.node < r.node and l.label <> r.label")).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))
    many = open_.join(sizes.filter(f"members > {DIRECT}").select("pivot"), "pivot")
    members = _families(many, buckets.groupBy("node").agg(F.count("*").alias("shares")))
    found = materialise(_differences(members, texts, size, percent), "jaccard-differences")
    centred = found.filter("alike and node <> pivot").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b"))
    facts = found.select("pivot", "node", "label", "central", "bits", "n", "lost", "most", "near", F.size("far").alias("own"), F.when(F.col("near"), F.size("delta")).cast("long").alias("d"))
    bits = " + ".join(f"bit_count(l.bits[{i}] ^ r.bits[{i}])" for i in range(SKETCH // 64))
    can = f"l.label <> r.label and least(l.n, r.n) * 100 >= greatest(l.n, r.n) * {percent} and ({bits}) * {100 + percent} <= (l.n + r.n) * {100 - percent}"

    rare = _numbered(found.select("pivot", "node", F.explode("far").alias("e"))).join(facts, ["pivot", "node"])
    # Elements that no other member has come before those counted by ``place``.
    posted = rare.withColumn("spot", F.expr("place + own - common")).filter("near or spot <= lost + 1")
    posted = materialise(posted.selectExpr("pivot", "node", "e", "label", "central", "bits", "n", "near", "own", "spot", "common - place as after"), "jaccard-posted")
    # Similar sets of these sizes have ``both`` elements in common at least, so each lacks n - both at most: the first
    # element that two have in common is among so many and one, and enough others follow in both.
    both = f"ceil({percent} * (l.n + r.n) / {100 + percent})"
    early = " and ".join(f"{x}.spot <= {x}.n - {both} + 1" for x in "lr")
    enough = f"1 + least(l.after, r.after) >= greatest(l.own - l.n, r.own - r.n) + {both}"
    apart = posted.filter("not central").alias("l").join(posted.alias("r"), F.expr(f"l.pivot = r.pivot and l.e = r.e and not (l.near and r.near) and {can} and {early} and {enough}"))

    close = facts.filter("near").drop("near", "lost", "own")
    ends = _numbered(found.filter("near").select("pivot", "node", F.explode("delta").alias("e"))).join(close, ["pivot", "node"])
    # A partner's d is d - most at least, so d - most elements at least are in common.
    prefix = materialise(ends.filter("place <= common - greatest(1, d - most) + 1").withColumn("after", F.expr("common - place")), "jaccard-prefix")
    fits = f"{can} and abs(l.d - r.d) <= least(l.most, r.most)"
    overlap = "2 + 2 * least(l.after, r.after) >= l.d + r.d - least(l.most, r.most)"
    beside = prefix.filter("not central").alias("l").join(prefix.alias("r"), F.expr(f"l.pivot = r.pivot and l.e = r.e and {overlap} and {fits}"))
    next_to = close.filter("d <= most")
    touching = next_to.filter("not central").alias("l").join(next_to.alias("r"), F.expr(f"l.pivot = r.pivot and l.d + r.d <= least(l.most, r.most) and {fits}"))
    found = [x.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct() for x in (apart, beside, touching)]
    return direct.unionByName(centred).unionByName(found[0]).unionByName(found[1]).unionByName(found[2]).distinct().join(pairs, ["a", "b"], "left_anti")


def join_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80
) -> DataFrame:
    """id, n_shingles and component_id (the least id that links reach) of every row.

    Two rows link when their sets of ``shingle_words``-word shingles have at
    least ``percent`` % of their union in common. A text with fewer words is
    one shingle; a null text or one without words has none, links with nothing
    and is its own component. Rows with equal sets are one node however many
    there are. A row with a null id takes no part and has a null component_id;
    rows that share an id are judged by their own texts. Nothing is cut off:
    very long texts have as many signatures as they need. An empty table gives
    no rows.
    """
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    bands = Bands(percent)

    def identify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, shingle_words, hashes) for t in batch.column("text").to_pylist()]
            nodes = [node_of(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64())], ["id", "n", "node"])

    owned = materialise(rows.mapInArrow(identify, f"id {rows.schema['id'].dataType.simpleString()}, n long, node long"), "jaccard-nodes")
    shards = parts_for(rows, SHARD_BYTES, least=96)
    buckets = materialise(_buckets(rows.filter("id is not null"), shingle_words, bands, shards), "jaccard-buckets")
    pairs = buckets.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    pairs = materialise(pairs, "jaccard-pairs")
    texts = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), owned, rows, shingle_words)
    links = materialise(_verified(pairs, texts, shingle_words, percent), "jaccard-links")
    roots = materialise(connected_components(links), "jaccard-roots")

    cross = materialise(_cross_pairs(buckets, pairs, roots, texts, shingle_words, percent), "jaccard-cross")
    more = materialise(_verified(cross, texts, shingle_words, percent), "jaccard-more")
    if not more.isEmpty():
        roots = materialise(connected_components(links.unionByName(more)), "jaccard-roots")

    named = owned.join(roots, "node", "left").select("id", "n", F.coalesce("root", "node").alias("label"))
    least = named.filter("label is not null and id is not null").groupBy("label").agg(F.min("id").alias("least"))
    return named.join(least, "label", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).alias("component_id")
    )


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, 4-word shingles, similarity of 85 % or more."""
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=4, percent=85)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s
  FROM (SELECT doc_id, unnest(CASE WHEN len(w) < 4 THEN [w] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]) END) AS s FROM w WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
keyed AS (SELECT doc_id, hash(s) AS h, s FROM shingles),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM keyed a JOIN keyed b ON a.h = b.h AND a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON r = a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)
"""
