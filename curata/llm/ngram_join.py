"""N-gram Jaccard join by token-combination prefixes.

A document's set holds its distinct word n-grams. Sets are ordered by rising document frequency, and two sets of Jaccard
likeness t share at least k elements among the first |x| - ceil(t |x|) + k of each. Elements in one document only fill
prefix places and link nothing, which drops most documents. Equal sets become one node. Frequencies come from packed,
sorted hashes, one a chunk of documents, so a shingle of a third of all documents is one entry a chunk.

The index has prefixes extended to k = 2: a rare element is a key of its own, and every two frequent elements of a prefix
are one key. Linked sets share two elements of these prefixes, so they share a rare one or a pair of frequent ones. The
class bound is the least document frequency at which pairs add no more keys than there are elements.

Links are then found in two steps. Stars: every node is checked against a few pivots of each of its keys, which joins
large groups of near copies in linear work. Completion: where a key's nodes still lie in several components, nodes of like
size meet across them. So each link is checked or lies inside a component already found. Nodes that share many keys would
meet at each of them, so a node carries the least key of each of a few classes, and two nodes that have one of these in
common are paired at the first such key alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.llm import common as C
from curata.llm.components import components

BASE, SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Document frequencies that may part rare from frequent elements; counts of documents stop at the last.
CLASSES = [2**k for k in range(1, 16)] + [65535]
#: Nodes of one key that one task joins with all of the key.
SPLIT = 2000
#: Pivots tried for each element: the node with the fewest elements of its own, as an original among its edited copies
#: has, and others by hash.
PIVOTS = 3
#: 64-bit words of a set's parities: 512 classes of elements.
PARITIES = 8
#: Classes of a node's open keys, of each of which it keeps the least.
LEASTS = 8


def shingle_sets(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each text, ascending: sizes, offsets, hashes. Fewer than n words: all of them as one."""
    offsets, flat = C.split_words(pc.ascii_lower(pc.fill_null(text, "")))
    h = C.word_hashes(flat)
    at = np.flatnonzero(C.inside(offsets, n))
    doc = np.searchsorted(offsets, at, side="right") - 1
    rolled = C.rolling(h, n, BASE)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((np.diff(offsets) > 0) & (np.diff(offsets) < n))
    whole = np.array([xxhash.xxh3_64_intdigest(h[offsets[i] : offsets[i + 1]].tobytes()) for i in short], np.uint64)
    doc, rolled = np.concatenate([doc, short]), np.concatenate([rolled, whole])
    by = np.lexsort((rolled, doc))
    doc, rolled = doc[by], rolled[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (rolled[1:] != rolled[:-1])
    doc, rolled = doc[new], rolled[new]
    sizes = np.bincount(doc, minlength=len(text)).astype(np.int64)
    return sizes, np.concatenate([[0], np.cumsum(sizes)]), rolled


def _send(chunk: int, hashes: np.ndarray, bits: int, n_buckets: int) -> pa.Table:
    """The distinct hashes of a chunk, cut to their high bits, with the number of its documents that hold each, at most
    255; a row for each bucket, a range of hashes."""
    u, c = np.unique(hashes >> np.uint64(64 - bits), return_counts=True)
    c = np.minimum(c, 255).astype(np.uint8)
    b = u // np.uint64(-(-(1 << bits) // n_buckets))
    which, starts = np.unique(b, return_index=True)
    ends = np.append(starts[1:], len(u))
    u = u - which.repeat(ends - starts) * np.uint64(-(-(1 << bits) // n_buckets))
    spans = list(zip(starts, ends, strict=True))
    return pa.table(
        {"bucket": pa.array(which.astype(np.int32)), "chunk": pa.array(np.full(len(which), chunk, np.int64)), "hashes": pa.array([C.pack(u[s:e]) for s, e in spans], pa.binary()), "counts": pa.array([c[s:e].tobytes() for s, e in spans], pa.binary())},
    )


def _reply(base: int, table: pa.Table) -> pa.Table:
    """To each chunk, those of its cut hashes that two or more documents hold, and in how many (at most 65535)."""
    chunks, parts = table["chunk"].to_pylist(), [C.unpack(x) for x in table["hashes"].to_pylist()]
    h = np.concatenate(parts) + np.uint64(base)
    n = np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint8).astype(np.int64)
    u, back = np.unique(h, return_inverse=True)
    df = np.minimum(np.bincount(back, weights=n), 65535).astype(np.uint16)[back]
    ends = np.cumsum([len(x) for x in parts])
    out = []
    for chunk, s, e in zip(chunks, [0, *ends[:-1]], ends, strict=True):
        if len(x := h[s:e][keep := df[s:e] > 1]):
            out.append((chunk, C.pack(x), df[s:e][keep].tobytes()))
    return pa.table({"chunk": pa.array([x[0] for x in out], pa.int64()), "hashes": pa.array([x[1] for x in out], pa.binary()), "counts": pa.array([x[2] for x in out], pa.binary())})


def _marked(ids: pa.Array, text: pa.Array, told: pa.Table, n: int, percent: int, bits: int) -> dict:
    """Each document's set size and, if it can link at all, its node name, its set, the number of its elements that other
    documents may hold, its parities (for each class of elements, whether it has an odd number), its prefix and the document frequencies in it."""
    sizes, offsets, hashes = shingle_sets(text, n)
    known = np.concatenate([np.zeros(0, np.uint64), *(C.unpack(x) for x in told["hashes"].to_pylist())])
    counts = np.frombuffer(b"".join(told["counts"].to_pylist()), np.uint16)
    by = np.argsort(known)
    known, counts = known[by], counts[by]
    df = np.ones(len(hashes), np.int64)
    if len(known):
        cut = hashes >> np.uint64(64 - bits)
        at = np.minimum(np.searchsorted(known, cut), len(known) - 1)
        df = np.where(known[at] == cut, counts[at], 1).astype(np.int64)
    shared = np.concatenate([[0], np.cumsum(df > 1)])
    shared = shared[offsets[1:]] - shared[offsets[:-1]]
    need = -(-percent * sizes // 100)
    rows = len(sizes)
    node, sets, parities, prefixes, freqs = ([None] * rows for _ in range(5))
    for i in np.flatnonzero((sizes > 0) & (shared >= need)):
        x, d = hashes[offsets[i] : offsets[i + 1]], df[offsets[i] : offsets[i + 1]]
        node[i] = xxhash.xxh3_128_hexdigest(x.tobytes())
        sets[i] = x.view(np.int64)
        order = np.lexsort((x, d))[: sizes[i] - need[i] + 2]
        order = order[d[order] > 1]
        prefixes[i], freqs[i] = x[order].view(np.int64), d[order]
        odd = np.bincount(((x * np.uint64(SECOND)) >> np.uint64(55)).astype(np.int64), minlength=64 * PARITIES) & 1
        parities[i] = np.packbits(odd).view(np.int64)
    longs = pa.list_(pa.int64())
    return {"id": ids, "size": pa.array(sizes), "node": pa.array(node, pa.string()), "shared": pa.array(shared), "items": pa.array(sets, longs), "parities": pa.array(parities, longs), "prefix": pa.array(prefixes, longs), "freqs": pa.array(freqs, longs)}


def _alike(percent: int) -> Column:
    both = F.size(F.array_intersect("items", "other_items"))
    return 100 * both >= percent * (F.col("size") + F.col("other_size") - both)


def _close(percent: int) -> Column:
    """Sizes that a link allows."""
    return 100 * F.least("size", "other_size") >= percent * F.greatest("size", "other_size")


def _may_link(percent: int) -> Column:
    """What a link needs: enough elements that others hold, and parities that differ in no more places than the sets may."""
    both = F.least("shared", "other_shared")
    apart = sum((F.bit_count(F.get("parities", F.lit(k)).bitwiseXOR(F.get("other_parities", F.lit(k)))) for k in range(PARITIES)), F.lit(0))
    sizes = F.col("size") + F.col("other_size")
    return (100 * both >= percent * (sizes - both)) & ((100 + percent) * apart <= (100 - percent) * sizes)


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (node, other) whose sets are alike enough, as edges."""
    sets = nodes.select("node", "size", "items")
    full = pairs.select("node", "other").distinct().join(sets, "node").join(sets.toDF("other", "other_size", "other_items"), "other")
    return full.where(_alike(percent)).select(F.col("node").alias("a"), F.col("other").alias("b"))


def _labelled(df: DataFrame, roots: DataFrame) -> DataFrame:
    return df.join(roots.toDF("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def class_bound(nodes: DataFrame) -> int:
    """The least document frequency in CLASSES above which pairs of a prefix's elements are no more than all elements."""
    often = {t: F.size(F.filter("freqs", lambda d: d > t)).cast("long") for t in CLASSES}  # noqa: B023
    elements, *pairs = nodes.agg(F.sum(F.size("freqs")), *(F.sum(n * (n - 1) / 2) for n in often.values())).first()
    return next((t for t, n in zip(CLASSES, pairs, strict=True) if (n or 0) <= (elements or 0)), CLASSES[-1])


def keys(nodes: DataFrame, bound: int) -> DataFrame:
    """node, size, own, key, combined: the index. Rare elements alone; frequent ones, more than `bound` documents have them,
    two and two."""
    own = [F.col("node"), F.col("size"), (F.col("size") - F.col("shared")).alias("own")]
    part = lambda frequent: F.filter("prefix", lambda x, i: (F.get("freqs", i) > bound) == frequent)
    rare = nodes.select(*own, F.explode(part(False)).alias("key"), F.lit(False).alias("combined"))
    often = nodes.select(*own, F.array_sort(part(True)).alias("its"))
    pairs = often.select(*own[:2], "own", "its", F.posexplode("its").alias("i", "item")).select("node", "size", "own", "item", F.explode(F.expr("slice(its, i + 2, size(its))")).alias("second"))
    return rare.unionAll(pairs.select("node", "size", "own", F.xxhash64("item", "second").alias("key"), F.lit(True).alias("combined")))


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of one key in different components that may link: those outside the key's largest component meet
    those of the key in bands of like size. A key of many nodes is split over several tasks. Nodes with a least key in
    common are a pair at the first of these only: both have it, so they meet there."""
    per = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    top = per.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.count(F.lit(1)).alias("n_comps"), F.sum("n").alias("n")).where("n_comps > 1")
    band = F.floor(F.log("size") / F.log(F.lit(100 / percent))).cast("int")  # linked sizes lie in one band or in two adjoining ones
    rows = rows.join(top.select("key", F.col("top.comp").alias("top"), F.ceil(F.col("n") / SPLIT).cast("int").alias("parts")), "key").withColumn("band", band)
    own = ["node", "size", "comp", "shared", "parities", "leasts"]
    few = rows.where("comp <> top").select("key", *own, F.pmod(F.xxhash64("node"), "parts").alias("part"), F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1)))).alias("band"))
    many = rows.select("key", "band", *(F.col(c).alias("other" if c == "node" else f"other_{c}") for c in own), "top", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"))
    least = lambda k: F.get("leasts", F.lit(k))
    place = F.coalesce(*(F.when(least(k) == F.get("other_leasts", F.lit(k)), least(k)) for k in range(LEASTS)), "key")
    cond = (F.col("comp") != F.col("other_comp")) & ((F.col("other_comp") == F.col("top")) | (F.col("node") < F.col("other"))) & _close(percent) & _may_link(percent) & (place == F.col("key"))
    return few.join(many, ["key", "band", "part"]).where(cond).select("node", "other")


def near_duplicate_components(df: DataFrame, id_col: str, text_col: str, n: int = 5, percent: int = 80, chunk_chars: int = C.CHUNK_CHARS) -> DataFrame:
    """id_col, size (of the n-gram set, over lower-cased words) and component (least id reachable by links), a row for each row.

    Documents link when 100 * |intersection| >= percent * |union|; exact, for percent over 66 (prefixes then share two
    elements wherever different sets link). Texts without words have empty sets and link with nothing; a text of 1 to
    n - 1 words has its whole sequence as its one element. Null texts are empty. Rows with equal ids are rows of their
    own; a null id is kept and can be a component's least id only if all its ids are null. An empty table gives an empty
    result. Only id and text are read. Elements are 64-bit hashes, and nodes 128-bit hashes of sets.
    """
    with C.Scratch(df.sparkSession) as scratch:
        found = _components(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), n, percent, chunk_chars, scratch)
        return C.materialise(found.withColumnRenamed("id", id_col))


def _components(docs: DataFrame, n: int, percent: int, chunk_chars: int, scratch: C.Scratch) -> DataFrame:
    """id, size, component, over tables in scratch."""
    spark = docs.sparkSession
    C.bound_batches(spark)
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    # Any deal of the documents will do; a hash of id and text spreads copies.
    n_chunks = max(2 * C.partitions(spark), chars // chunk_chars)
    chunked = docs.withColumn("__chunk", F.pmod(F.xxhash64("id", "text"), F.lit(n_chunks)))
    n_buckets = max(2 * C.partitions(spark), n_chunks * chunk_chars // 6 // 4_000_000)
    # Hashes cut to these bits only ever count too many documents, for one element in a thousand or less.
    bits = min(64, max(32, (n_chunks * chunk_chars).bit_length() + 8))

    def send(key: tuple, table: pa.Table) -> pa.Table:
        return _send(key[0].as_py(), shingle_sets(table["text"].combine_chunks(), n)[2], bits, n_buckets)

    def reply(key: tuple, table: pa.Table) -> pa.Table:
        return _reply(key[0].as_py() * -(-(1 << bits) // n_buckets), table)

    texts = chunked.groupBy("__chunk")  # used twice with the same columns, so that Spark shuffles them once
    sent = texts.applyInArrow(C.tidy_group(send), "bucket int, chunk long, hashes binary, counts binary")
    replies = sent.groupBy("bucket").applyInArrow(C.tidy_group(reply), "chunk long, hashes binary, counts binary")

    def mark(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        return pa.table(_marked(table["id"].combine_chunks(), table["text"].combine_chunks(), told, n, percent, bits))

    schema = T.StructType([docs.schema["id"], *T._parse_datatype_string("size long, node string, shared long, items array<long>, parities array<long>, prefix array<long>, freqs array<long>").fields])
    marked = scratch.store(texts.cogroup(replies.groupBy("chunk")).applyInArrow(C.tidy_groups(mark), schema))

    classes = marked.where("node is not null").groupBy("node").agg(*(F.first(c).alias(c) for c in ("size", "shared", "items", "parities", "prefix", "freqs")))
    named = scratch.store(classes.withColumnRenamed("node", "name").withColumn("node", F.monotonically_increasing_id()))
    nodes = named.drop("name")
    index = keys(nodes, class_bound(nodes))

    # Stars.
    pivots = index.groupBy("key").agg(*(F.min(F.struct((F.lit(0) if k else F.col("own")).cast("long").alias("own"), F.xxhash64(F.lit(k), "node").alias("h"), "node", "size")).alias(f"p{k}") for k in range(PIVOTS)), F.count(F.lit(1)).alias("n")).where("n > 1")
    options = pivots.select("key", F.explode(F.array_distinct(F.array(*(f"p{k}" for k in range(PIVOTS))))).alias("p")).select("key", F.col("p.node").alias("other"), F.col("p.size").alias("other_size"))
    star = index.drop("own", "combined").join(options, "key").where((F.col("node") != F.col("other")) & _close(percent))
    edges = scratch.store(_verified(star.select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other")), nodes, percent))
    roots = components(edges, scratch)

    # Completion.
    rows = _labelled(index.select("node", "key"), roots)
    spread = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    # Back to a row a node with those of its keys that lie in several components.
    leasts = F.array(*(F.min(F.when(F.pmod("key", F.lit(LEASTS)) == k, F.col("key"))) for k in range(LEASTS)))
    mine = rows.join(spread, "key").groupBy("node", "comp").agg(F.collect_list("key").alias("keys"), leasts.alias("leasts"))
    open_ = scratch.store(mine.join(nodes.select("node", "size", "shared", "parities"), "node"))
    pairs = _across(open_.select("node", "comp", "size", "shared", "parities", "leasts", F.explode("keys").alias("key")), percent)
    more = scratch.store(_verified(pairs, nodes, percent))
    if more.limit(1).count():
        roots = components(edges.unionAll(more), scratch)

    own_node = named.select(F.col("name").alias("node"), F.col("node").alias("nid"))
    member = _labelled(marked.select("id", "size", "node").join(own_node, "node", "left").select("id", "size", F.col("nid").alias("node")), roots)
    least = scratch.store(member.where("comp is not null").groupBy("comp").agg(F.min("id").alias("least")))  # so that its size is known
    return member.join(least, "comp", "left").select("id", "size", F.coalesce("least", "id").alias("component"))
