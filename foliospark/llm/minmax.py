"""Near-duplicate documents by min-max hashing.

Each permutation of a document's shingles gives two values, its minimum and its
maximum: twice the signature for the same hashing, and the two agree between
two sets with the probability of their Jaccard similarity. Bands of the
signature propose candidates; every link is confirmed on the full sets.

1. One pass turns each text into its set of hashed shingles. Documents with
   equal sets form a class; only one of a class goes on.
2. Classes that share a band meet in a bucket. A bucket links its members to a
   centre, never to each other, and those links are confirmed. Components that
   still share a bucket meet block by block, all members of the one against all
   of the other until a link is found: no cap drops a link. Blocks are bounded
   by rows and by bytes, and two blocks meet only where the sizes of their sets
   allow a link.
3. Components are labelled by the smallest document id, by rounds of joins:
   each label hooks on to its least neighbour, and chains of labels are halved.

With 120 permutations in 40 bands of six values a pair at similarity 0.8 misses
every band once in 170,000 times. In blocks, two signatures must agree in 65 % of
their values before the sets are compared; a pair at 0.8 fails that, six
deviations off, less than once in 10 million times.

Defined cases
  null or empty text, no words   empty set, linked with nothing; component_id is its own doc_id
  fewer words than a shingle     the whole sequence is the one shingle
  null doc_id                    never names a component unless all its documents have null ids; kept is false then
  repeated rows                  each row is judged; rows with one id are one node
  very long text                 its whole set is held by one task: 8 bytes a shingle
  ties, equal sets               one class
  empty table                    empty result
  clashing columns               a column of the input with the name of an output column is replaced
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import settled, small, stored, text_key

PERMUTATIONS, BANDS, SEED = 120, 40, 20_240_229
#: Rounds of centres before components meet block by block, and members of a block.
ROUNDS, BLOCK = 2, 500
#: Bytes of the sets in a block, but for a single larger set; rows that one centre meets in a task; least agreement of signatures.
BLOCK_BYTES, MEETS, AGREE = 8 * 1024 * 1024, 500, 0.65
#: Words whose hashes a task remembers.
KNOWN_WORDS = 1_000_000
#: Labels from here on stand for documents without an id.
UNNAMED = 2**62


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashed shingles, as sorted uint64 arrays."""

    def __init__(self, size: int) -> None:
        self.size, self.known = size, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        try:
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > KNOWN_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.size, len(words))
        out = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(words) - n + 1 + i])
        return np.unique(out)


def signatures(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation, as 32-bit values."""
    low, high = np.full(len(a), 0xFFFFFFFF, np.uint32), np.zeros(len(a), np.uint32)
    for at in range(0, len(shingles), 1024):
        x = shingles[None, at : at + 1024] * a[:, None]
        x += b[:, None]
        x >>= np.uint64(32)
        low, high = np.minimum(low, x.min(axis=1).astype(np.uint32)), np.maximum(high, x.max(axis=1).astype(np.uint32))
    return np.stack([low, high], axis=1).ravel()


def pieces(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """A batch in parts; what is made of a part is larger than its texts."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def made(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def signed(docs: DataFrame, text: str, doc_id: str, size: int, permutations: int, bands: int) -> DataFrame:
    """(doc_id, key, cls, n_shingles, bands, sig) for each document; cls names its set and is null for an empty one."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(1, 2**63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, permutations, dtype=np.uint64)
    salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
    out = pa.schema([("cls", pa.binary()), ("n_shingles", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(size)
        for part in (p for batch in batches for p in pieces(batch)):
            rows = []
            for t in part.column("text"):
                found = shingle(t.as_py())
                if not len(found):
                    rows.append((None, 0, [], None))
                    continue
                sig = signatures(found, a, b)
                parts, band = sig.reshape(bands, -1), salt
                for k in range(parts.shape[1]):
                    band = mix(band * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
                rows.append((xxhash.xxh3_128_digest(found.tobytes()), len(found), band.view(np.int64).tolist(), (sig & 0xFF).astype(np.uint8).tobytes()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), *made(rows, out).columns], names=["doc_id", "key", *out.names])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, key struct<a:long,b:long,n:int>, cls binary, n_shingles long, bands array<long>, sig binary")


def full_sets(docs: DataFrame, wanted: DataFrame, text: str, doc_id: str, size: int) -> DataFrame:
    """(node, shingles) of the documents named by wanted (node, rep: struct<doc_id, key>)."""
    out = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(size)
        for part in (p for batch in batches for p in pieces(batch)):
            yield made([(n, shingle(t.as_py()).tobytes()) for n, t in zip(part.column("node").to_pylist(), part.column("text"), strict=True)], out)

    wanted = wanted.select("node", F.col("rep.key").alias("_key"), F.col("rep.doc_id").alias("_doc"))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    return texts.join(wanted, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).select("node", "text").mapInArrow(run, "node long, shingles binary")


def blocks_of(members: DataFrame) -> DataFrame:
    """(host, block, lo, hi, rows): the rows of a host in blocks of similar sizes; members has host, node, label, sig and shingles.

    A block holds about BLOCK rows and BLOCK_BYTES of sets. Sets are put into classes by the logarithm of their size, so
    that a block's sizes lie within a tenth of each other; classes are split by a hash.
    """
    size = F.octet_length("shingles") / 8
    classed = members.withColumn("n", size.cast("long")).withColumn("cls", F.floor(F.log(size) / F.log(F.lit(1.1))))
    room = F.greatest(F.count("*") / BLOCK, F.sum(F.octet_length("shingles")) / BLOCK_BYTES)
    sizes = classed.groupBy("host", "cls").agg(F.ceil(room).alias("_n")).toDF("_host", "_cls", "_n")
    salted = classed.join(sizes, (F.col("host") == F.col("_host")) & (F.col("cls") == F.col("_cls")))
    salted = salted.withColumn("block", F.struct("cls", F.pmod(F.xxhash64("node"), F.col("_n")).alias("part")))
    rows = F.collect_list(F.struct("node", "label", "sig", "shingles")).alias("rows")
    return salted.groupBy("host", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), rows)


def blockwise(at: DataFrame, few: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that still share a bucket, at least one for each two that have one.

    The component with most nodes in a bucket is the host of the bucket's other
    nodes. A block of a host's guests meets the blocks of its members and those
    of its other guests, each two of them in a row of its own; what agrees in its
    signatures is confirmed there on the full sets, so no list of pairs is ever made.
    """
    most = at.groupBy("bucket", "label").count().groupBy("bucket").agg(F.max(F.struct("count", "label")).alias("top"))
    top = small(stored(most.select("bucket", F.col("top.label").alias("host")), "hosts"))
    guests = stored(at.join(top, "bucket").filter(F.col("label") != F.col("host")).select("host", "node").distinct(), "guests")
    nodes = at.select("node", "label").distinct().join(few.select("node", "sig"), "node").join(full, "node")
    nodes = stored(nodes.dropDuplicates(["node"]), "unresolved")
    hosts = small(stored(guests.select("host").distinct(), "hosts"))
    members = nodes.join(hosts, F.col("label") == F.col("host"))
    left = stored(blocks_of(guests.join(nodes, "node")), "guest-blocks")
    own = stored(blocks_of(members), "host-blocks")

    def names(blocks: DataFrame, suffix: str) -> DataFrame:
        return blocks.select("host", *(F.col(c).alias(f"{c}{suffix}") for c in ("block", "lo", "hi")))

    ids = names(own, "2").withColumn("kind", F.lit(0)).unionByName(names(left, "2").withColumn("kind", F.lit(1)))
    fits = (100 * F.col("hi") >= percent * F.col("lo2")) & (100 * F.col("hi2") >= percent * F.col("lo"))
    meet = names(left, "").join(ids, "host").filter(fits & ((F.col("kind") == 0) | (F.col("block") <= F.col("block2"))))
    meet = stored(meet.select("host", "block", "block2", "kind"), "meet")
    right = own.select("host", F.col("block").alias("block2"), F.lit(0).alias("kind"), F.col("rows").alias("own"))
    right = right.unionByName(left.select("host", F.col("block").alias("block2"), F.lit(1).alias("kind"), F.col("rows").alias("own")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, rows = batch.column("own")[i].as_py(), batch.column("rows")[i].as_py()
                table, labels = np.array([np.frombuffer(m["sig"], np.uint8) for m in own]), np.array([m["label"] for m in own])
                sets, done, found = [np.frombuffer(m["shingles"], np.uint64) for m in own], set(), []
                for g in rows:
                    t = np.frombuffer(g["shingles"], np.uint64)
                    agree = ((table == np.frombuffer(g["sig"], np.uint8)).mean(axis=1) >= AGREE * percent / 80) & (labels != g["label"])
                    for j in np.flatnonzero(agree):
                        if (g["label"], labels[j]) not in done and alike(sets[j], t, percent):
                            found.append((g["node"], own[j]["node"]))
                            done.add((g["label"], labels[j]))
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    both = meet.join(left.select("host", "block", "rows"), ["host", "block"]).join(right, ["host", "block2", "kind"])
    return both.select("rows", "own").mapInArrow(run, "a long, b long")


def alike(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted sets."""
    both = int((s[np.minimum(np.searchsorted(s, t), len(s) - 1)] == t).sum())
    return 100 * both >= percent * (len(s) + len(t) - both)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The stored pairs (a, b) with 100 * intersection >= percent * union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, s = [], None, None
            for b, x, y in zip(batch.column("b").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
                if b != last:
                    last, s = b, np.frombuffer(y.as_py(), np.uint64)
                keep.append(alike(s, np.frombuffer(x.as_py(), np.uint64), percent))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    # a centre that meets many nodes is dealt out: each MEETS of them get a copy of its set
    meets = pairs.groupBy(F.col("b").alias("_b")).agg(F.ceil(F.count("*") / MEETS).alias("_n"))
    meets = small(stored(meets, "meets"))
    salted = pairs.join(meets, F.col("b") == F.col("_b")).select("a", "b", F.pmod(F.xxhash64("a"), F.col("_n")).alias("salt"))
    salted = small(stored(salted, "salted"))  # where it is few, only the sets that they name are shuffled
    left = sets.join(salted, F.col("node") == F.col("a")).select("a", "b", "salt", F.col("shingles").alias("x"))
    right = sets.join(meets, F.col("node") == F.col("_b")).select(F.col("node").alias("b"), F.col("shingles").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("salt"))
    return left.join(right, ["b", "salt"]).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def least_labels(edges: DataFrame) -> DataFrame:
    """(was, root): each node of the edges (u, v) with the least node of its component."""
    return settled(lambda: hooked(edges), "roots")


def hooked(edges: DataFrame) -> DataFrame:
    """least_labels, by rounds in which each node hooks on to its least neighbour and chains are halved."""
    total, edges = None, stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    while edges.limit(1).count():
        up = stored(edges.groupBy(F.col("u").alias("was")).agg(F.min("v").alias("root")), "up")
        while True:  # chains halve
            over = up.select(F.col("was").alias("_w"), F.col("root").alias("_r"))
            new = stored(up.join(over, F.col("root") == F.col("_w"), "left").select("was", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "up")
            moved, up = new.filter("moved").limit(1).count(), new.select("was", "root")
            if not moved:
                break
        one, two = up.toDF("_u", "_ru"), up.toDF("_v", "_rv")
        if total is None:
            total = up
        else:
            joined = total.join(two, F.col("root") == F.col("_v"), "left").select("was", F.coalesce("_rv", "root").alias("root"))
            total = stored(joined.union(up.join(total.select("was"), "was", "left_anti")), "total")
        edges = edges.join(one, F.col("u") == F.col("_u"), "left").join(two, F.col("v") == F.col("_v"), "left")
        edges = edges.select(F.coalesce("_ru", "u").alias("x"), F.coalesce("_rv", "v").alias("y"))
        edges = stored(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u > v").distinct(), "edges")
    return edges.select(F.col("u").alias("was"), F.col("v").alias("root")) if total is None else total


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 5, percent: int = 80, permutations: int = PERMUTATIONS, bands: int = BANDS
) -> DataFrame:
    """(doc_id, key, n_shingles, label, component_id, kept), a row for each row of docs; key is common.text_key of the text."""
    return settled(lambda: judged(docs, text, doc_id, size, percent, permutations, bands), "near-duplicates")


def judged(docs: DataFrame, text: str, doc_id: str, size: int, percent: int, permutations: int, bands: int) -> DataFrame:
    """near_duplicates, before its intermediate tables are deleted."""
    sets = stored(signed(docs, text, doc_id, size, permutations, bands), "sets")
    # a class is known by its least id; the rare classes of documents without ids by a number beyond all ids
    named = F.coalesce(F.min("doc_id"), F.lit(UNNAMED) + F.pmod(F.xxhash64("cls"), F.lit(UNNAMED)))
    nodes = sets.filter(F.col("cls").isNotNull()).groupBy("cls").agg(
        named.alias("node"), F.min(F.struct("doc_id", "key")).alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig")
    )
    nodes = stored(nodes, "nodes")
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("bucket")
    buckets = stored(buckets.join(shared, "bucket"), "buckets")
    met = small(stored(buckets.select("node").distinct(), "met"))
    few = stored(nodes.join(met, "node", "left_semi").select("node", "rep", "sig"), "few")
    full = stored(full_sets(docs, small(few.select("node", "rep")), text, doc_id, size), "full")

    state = few.select("node", F.col("node").alias("label")).distinct()
    tried, turn = None, 0
    while turn <= ROUNDS:
        at = buckets.join(state, "node")
        centre = F.min_by(F.struct("node", "label"), F.xxhash64("node", F.lit(turn)))
        mixed = at.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), centre.alias("c")).filter("lo < hi")
        mixed = stored(mixed.select("bucket", "c"), "mixed")
        if not mixed.limit(1).count():
            break
        if turn < ROUNDS:
            to = at.join(mixed, "bucket").filter(F.col("label") != F.col("c.label")).select(F.col("node").alias("a"), F.col("c.node").alias("b"))
            # at first one centre for each node, then all of them
            pairs = to.groupBy("a").agg(F.min("b").alias("b")) if tried is None else to.distinct().join(tried, ["a", "b"], "left_anti")
            pairs = stored(pairs, "pairs")
            links, tried = confirmed(pairs, full, percent), pairs
        else:
            links = blockwise(at.join(mixed.select("bucket"), "bucket"), few, full, percent)
        a, b = state.toDF("a", "u"), state.toDF("b", "v")
        roots = least_labels(links.join(a, "a").join(b, "b").select("u", "v"))
        state = stored(state.join(roots, F.col("label") == F.col("was"), "left").select("node", F.coalesce("root", "label").alias("label")), "state")
        turn += 1
    labels = nodes.select("cls", "node").join(state, "node", "left").select(F.col("cls").alias("_c"), F.coalesce("label", "node").alias("label"))
    out = sets.select("doc_id", "key", "n_shingles", "cls").join(labels, F.col("cls") == F.col("_c"), "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).when(F.col("label") < UNNAMED, F.col("label"))
    out = out.select("doc_id", "key", "n_shingles", "label", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how: int) -> DataFrame:
    """docs with one row of each group of near copies left; rows without words all stay."""
    judged = near_duplicates(docs, text, doc_id, **how).filter(F.col("label").isNotNull()).select("doc_id", "key", "label")
    first = F.struct(F.coalesce((F.col("doc_id") != F.col("label")).cast("int"), F.lit(1)).alias("other"), "doc_id", "key")
    stay = judged.groupBy("label").agg(F.min(first).alias("k")).select(F.col("k.doc_id").alias("_doc"), F.col("k.key").alias("_key"))
    texts = docs.withColumn("_k", text_key(F.coalesce(F.col(text), F.lit(""))))
    bare = ~F.coalesce(F.col(text), F.lit("")).rlike(r"\S")
    same = (F.col("_k") == F.col("_key")) & F.col(doc_id).eqNullSafe(F.col("_doc"))
    kept = texts.filter(~bare).join(stay, same, "left_semi")
    again = judged.groupBy("doc_id", "key").count().filter("count > 1").join(stay, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
    if again.limit(1).count():  # the same row twice
        kept = kept.dropDuplicates([doc_id, "_k"])
    return kept.union(texts.filter(bare)).drop("_k")
