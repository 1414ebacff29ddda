"""Near-duplicate grouping with SuperMinHash signatures.

1. Each text becomes the set of its distinct five-word shingles (64-bit hashes). Texts with equal
   sets form a class; one row, by a row number of its own, stands for it, and only these go on.
2. Every representative gets a SuperMinHash signature: an element brings correlated ranks, a random
   permutation of the slots drawn one step at a time, and step j can only set ranks in [j, j + 1). So
   as soon as all slots hold ranks below j the remaining steps are skipped.
3. Banding: representatives that agree on all rows of a band share a bucket. 50 bands of 5 rows miss
   a pair at similarity 0.75 with probability 1e-6, more similar pairs less.
4. Verification on the full sets in two passes, so that no pass emits all pairs of a bucket of copies:
   each member against its bucket's smallest; then, inside tasks that hold bounded blocks of a bucket,
   members of still different components against each other, the most similar first and one link
   for each component. The second pass estimates the similarity from the signatures and drops a pair
   below 155 of 250 equal slots (a true link falls below it with probability 6e-7).
5. Union-find grouping: each task contracts its links with a union-find, and alternating large-star
   and small-star joins finish the components. Nothing is gathered on the driver.

Nulls, empty texts and texts without words have an empty set, link with nothing and stand alone.
Links are between texts, whatever their ids. In near_duplicates a repeated doc_id is one node with several
texts: what its texts link is linked. A row without doc_id belongs to its class's component (null if no
row of the component has an id). Extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import frugal, materialise, pieces, rows
from scorelake.llm.words import mix, shingles, stream, word_hashes

BANDS, ROWS = 50, 5
SLOTS = BANDS * ROWS
LEAST_EQUAL = 155  # of SLOTS, see above
BLOCK = 1024  # bucket members that one task holds against the streamed others
_NONE = np.uint64(2**64 - 1)
_RANK, _SWAP, _BAND, _ROW = stream(101, SLOTS), stream(102, SLOTS), stream(103, BANDS), stream(104, ROWS) | np.uint64(1)


def superminhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures of non-empty sets, a row of 64-bit ranks each: the step number in the top byte and a
    random fraction below. Works on all sets of the list at once, one step of every unfinished set at
    a time; the order does not matter, as a slot keeps its least rank."""
    assert slots <= 256
    ranks = np.full((len(sets), slots), _NONE, np.uint64)
    flat = ranks.reshape(-1)
    elements = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = None  # each element's partly drawn permutation, from the second step on
    for step in range(slots):
        draw = (mix(elements + _SWAP[step]) >> np.uint64(32)) * np.uint64(slots - step) >> np.uint64(32)
        pick = draw.astype(np.int64) + step
        if order is not None:
            each = np.arange(len(elements))
            slot = order[each, pick].astype(np.int64)
            order[each, pick] = order[:, step]
        else:
            slot = pick
        rank = (mix(elements ^ _RANK[step]) >> np.uint64(8)) | np.uint64(step << 56)
        np.minimum.at(flat, owner * slots + slot, rank)
        full = ~(ranks == _NONE).any(axis=1)
        if full.all():
            break
        left = ~full[owner]
        if order is None:
            order = np.tile(np.arange(slots, dtype=np.uint8), (int(left.sum()), 1))
            each = np.arange(len(order))
            order[each, pick[left]] = 0
        else:
            order = order[left]
        elements, owner = elements[left], owner[left]
    return ranks


def band_keys(ranks: np.ndarray) -> np.ndarray:
    """One 64-bit key for each signature and band."""
    cut = ranks.reshape(len(ranks), BANDS, ROWS)
    return mix((mix(cut) * _ROW).sum(axis=2, dtype=np.uint64) + _BAND).view(np.int64)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("n_shingles", pa.int64()), ("shape", pa.binary()), ("signature", pa.binary()), ("bands", pa.list_(pa.int64()))])
_SETS = pa.schema([("shape", pa.binary()), ("shingles", pa.binary())])


def _lowered(batch: pa.RecordBatch) -> list[bytes]:
    return [b"" if t is None else t.encode().lower() for t in batch.column(1).to_pylist()]


def _shape(shingles_: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles_.tobytes()) if len(shingles_) else None


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, "text", 1 << 18):
            sets = [shingles(h) for h in word_hashes(_lowered(batch))]
            some = [i for i, s in enumerate(sets) if len(s)]
            ranks = superminhash([sets[i] for i in some])
            keys, low = band_keys(ranks), mix(ranks).astype(np.uint8)
            signature, bands = [None] * len(sets), [None] * len(sets)
            for k, i in enumerate(some):
                signature[i], bands[i] = low[k].tobytes(), keys[k]
            shape = [_shape(s) for s in sets]
            yield rows(_SIGNED, batch.column(0), batch.column(2), [len(s) for s in sets], shape, signature, bands)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, "text", 1 << 20):
            sets = [shingles(h) for h in word_hashes(_lowered(batch))]
            yield rows(_SETS, [_shape(s) for s in sets], [s.tobytes() for s in sets])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, on whole sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < 75 * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= 75 * (len(a) + len(b) - both)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        left, right = batch.column(2), batch.column(3)
        keep = [linked(np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)) for i in range(len(batch))]
        yield rows(schema, batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_())))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return both.mapInArrow(frugal(_confirm), "a long, b long")


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one task's links: a spanning star of each local component."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for at in range(0, len(nodes), 50_000):
        part = nodes[at:at + 50_000]
        yield rows(schema, part, [root(x) for x in part])


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node with a link: label is the least node of its component. Each round
    costs a few shuffles of the contracted links; their number falls to one per node, and the rounds
    are logarithmic in a component's width (two for stars)."""
    edges = materialise(links.select("a", "b").where("a <> b").mapInArrow(frugal(_contract), "a long, b long"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lower, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        edges = materialise(small.select("e.*").where("a <> b").distinct())
        now = state(edges)
        if now == before:
            break
        before = now
    top = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(top)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


class _Held:
    """The members of one bucket block, as arrays."""

    def __init__(self, members: list[tuple]):
        self.nodes, self.labels, self.sizes = (np.array([m[k] for m in members], np.int64) for k in range(3))
        self.slots = np.frombuffer(b"".join(m[3] for m in members), np.uint8).reshape(len(members), SLOTS)
        self.bands = np.array([m[4] for m in members], np.int64)
        self.sets = [np.frombuffer(m[5], np.uint64) for m in members]

    def links(self, key: int, node: int, label: int, n: int, signature: bytes, bands: list[int], shingles_: bytes) -> list[int]:
        """Members of other components that the probe is linked with, one of each component: the most
        promising first. A pair is tried in the first bucket that it shares."""
        some = np.flatnonzero((self.labels != label) & (100 * np.minimum(self.sizes, n) >= 75 * np.maximum(self.sizes, n)))
        if not len(some):
            return []
        equal = (self.slots[some] == np.frombuffer(signature, np.uint8)).sum(axis=1)
        own = np.array(bands, np.int64)
        some, equal = some[equal >= LEAST_EQUAL], equal[equal >= LEAST_EQUAL]
        here = (self.bands[some] == own).argmax(axis=1) == int((own == key).argmax()) if len(some) else np.empty(0, bool)
        some, equal = some[here], equal[here]
        found, done, own_set = [], set(), np.frombuffer(shingles_, np.uint64)
        for i in some[np.lexsort((self.nodes[some], -equal))].tolist():
            other = int(self.labels[i])
            if other not in done and linked(own_set, self.sets[i]):
                done.add(other)
                found.append(int(self.nodes[i]))
        return found


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket and block, held members before the probes that stream past them."""
    key, members, held = None, [], None
    for batch in batches:
        out: list[tuple[int, int]] = []
        for bucket, block, probe, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (bucket, block):
                key, members, held = (bucket, block), [], None
            if not probe:
                members.append(tuple(row))
            elif members:
                held = held or _Held(members)
                out += [(row[0], other) for other in held.links(bucket, *row)]
        if out:
            yield rows(_LINKS, *zip(*out, strict=True))


def _between(members: DataFrame, labels: DataFrame, known: DataFrame) -> DataFrame:
    """Links (a, b) between bucket members of different components. Only members outside a bucket's
    largest component are compared with the rest, in blocks of bounded size."""
    named = members.select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    tally = named.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = tally.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("groups")).where("groups > 1")
    mixed = mixed.select("key", F.col("top.label").alias("main"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    here = materialise(named.join(mixed, "key"))
    full = here.join(known, "node")
    columns = ["node", "label", "n_shingles", "signature", "bands", "shingles"]
    held = full.select("key", F.pmod(F.hash("node"), F.col("blocks")).alias("block"), F.lit(False).alias("probe"), *columns)
    probes = full.where("label <> main").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("probe"), *columns)
    dealt = held.unionByName(probes).repartition("key", "block").sortWithinPartitions("key", "block", "probe")
    return dealt.mapInArrow(frugal(_near), "a long, b long")


def _digest() -> Column:
    return F.sha2(F.col("text").cast("string"), 256)


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row of ``docs`` as (doc_id, digest, n_shingles, node), where node is its class's, and (node, label) of the
    linked classes."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _digest().alias("digest"))
    signed = texts.mapInArrow(frugal(_sign), "doc_id long, digest string, n_shingles long, shape binary, signature binary, bands array<long>")
    signed = materialise(signed.withColumn("row", F.monotonically_increasing_id()))
    order = F.coalesce("doc_id", F.lit(2**63 - 1))
    classes = materialise(signed.where("shape is not null").groupBy("shape").agg(F.min_by("row", order).alias("node")))
    heads = signed.join(classes.select(F.col("node").alias("row")), "row", "leftsemi")

    keyed = heads.select(F.col("row").alias("node"), F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key", "low")
    members = materialise(keyed.join(buckets, "key").select("key", "node", "low"))
    nodes = members.select(F.col("node").alias("row")).distinct()
    known = materialise(heads.join(nodes, "row", "leftsemi").select(F.col("row").alias("node"), "doc_id", "shape", "n_shingles", "signature", "bands"))
    ids = known.select("doc_id").distinct()
    packed = texts.join(ids, texts["doc_id"].eqNullSafe(ids["doc_id"]), "leftsemi").mapInArrow(frugal(_pack), "shape binary, shingles binary")
    sets = materialise(packed.join(known.select("shape", "node"), "shape").groupBy("node").agg(F.first("shingles").alias("shingles")))
    tried = members.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    labels = materialise(components(confirmed(tried, sets)))
    known = sets.join(known.drop("doc_id", "shape"), "node")
    stars = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    labels = materialise(components(stars.unionByName(_between(members, labels, known))))
    return materialise(signed.select("doc_id", "digest", "n_shingles", "shape").join(classes, "shape", "left").drop("shape")), labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text)."""
    each, labels = _grouped(docs)
    shared = each.where("doc_id is not null and node is not null").groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("doc_id", "low")
    bridges = materialise(each.where("node is not null").join(shared, "doc_id").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct())
    if bridges.head(1):
        labels = materialise(components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(bridges)))
    named = each.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    out = named.join(least, "label", "left")
    out = out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of linked texts, with all columns: the one with the smallest doc_id (rows without one
    come last). A repeated doc_id links nothing here. Of rows that repeat both id and text any one stays."""
    each, labels = _grouped(docs)
    named = each.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("first")
    kept = named.where("label is not null").groupBy("label").agg(first).select("first.doc_id", "first.digest")
    kept = materialise(kept.unionByName(named.where("label is null").select("doc_id", "digest").distinct()))
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), _digest().alias("mark"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & F.col("mark").eqNullSafe(F.col("digest"))
    return marked.join(kept, same, "leftsemi").dropDuplicates(["id", "mark"]).select("row.*")
