"""SimHash near-duplicates by multi-index hashing.

Every text gets a 64-bit SimHash of its word shingles. Equal fingerprints are one node. A fingerprint is cut into
segments; by the pigeonhole principle two fingerprints within `distance` bits agree up to distance // segments bits in
some segment (here: two segments, one bit). Each node is listed once per segment in a table and probes that table with
the Hamming ball of its segment; candidates are verified by the complete distance. Of two nodes whose segments differ
in one bit, the one with the 0 there probes, so that each ball is halved. Linked nodes are joined into components by
alternating star contraction; nothing is gathered on the driver.

For similarities of 0.8 in shingles of five words a fingerprint of shingles is too noisy: of such pairs of the test
tables it puts one in eight within 3 bits. keep_one() takes a fingerprint of the set of a text's words instead, in which
an edited word is one feature and not five, and distances up to 7 (four segments, balls of one bit): 107 of 107 such
pairs in a sample of 6,000 test documents were within it, and 33 of 180,000 pairs of other documents (exact copies among
them). These are candidates only: groups of them have many links, so the nodes of a bucket are linked where they meet,
and only a spanning forest of each bucket's links goes on. Within a group of candidates every pair of distinct texts
in reach is then verified on the sets of its five-word shingles (64-bit hashes, Jaccard similarity 0.8 or more).

Cases: null and wordless texts have fingerprint zero and are linked like others; texts of fewer words than a shingle
are one shingle; repeated rows share a node; null doc_ids never name a component (one of null doc_ids only is null);
texts may have any length; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, free_name, materialize

SEED = 42


def simhash(text: str | None, words: int = 3) -> int:
    """SimHash of the lower-cased (A-Z) text's shingles, hashed by XXH64; as a signed 64-bit number.

    words: of a shingle; 0 for the set of the text's words.
    """
    import numpy as np
    from xxhash import xxh64_intdigest as xxh

    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined, ends, at = b" ".join(parts), [], -1
    for p in parts:
        at += len(p) + 1
        ends.append(at)
    if not words:
        hashes = [xxh(p, SEED) for p in set(parts)]
    elif len(parts) <= words:
        hashes = [xxh(joined, SEED)]
    else:
        starts = [0, *(e + 1 for e in ends)]
        hashes = [xxh(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])]  # noqa: B905
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        block = np.array(hashes[i : i + 65_536], "<u8").view(np.uint8)
        ones += np.unpackbits(block, bitorder="little").reshape(-1, 64).sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (signed 64-bit)."""
    bound_batches(documents.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([simhash(t, words) for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "fp"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, fp long")


def links(nodes: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column fp of nodes) at `distance` bits or fewer, at most 3."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments with balls of one bit find distances up to 3")
    halves = F.array(F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    keyed = nodes.select("fp", F.posexplode(halves).alias("segment", "key"))
    flips = F.expr("filter(transform(sequence(0, 31), i -> key | shiftleft(1L, i)), k -> k != key)")
    probes = keyed.select(F.col("fp").alias("x"), "segment", F.explode(F.concat(F.array("key"), flips)).alias("key"))
    listed = keyed.withColumnRenamed("fp", "y")
    far = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
    pair = probes.join(listed, ["segment", "key"]).where((F.col("x") != F.col("y")) & (far <= distance))
    return pair.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def bucket_links(nodes: DataFrame, distance: int = 7, segments: int = 4, similarity: float = 0.8) -> DataFrame:
    """Pairs a < b of fingerprints that connect all that chains of links of `distance` bits or fewer connect.

    distance < 2 * segments. A node goes to the bucket of each segment's value and to those with one bit more set, so
    two nodes within the distance meet in some bucket. Buckets are dealt out by hash; each is read in sorted order and
    compared block by block, and gives at most one pair for each of its nodes. Where nodes have the columns node and
    size, pairs are of node, and only sizes of a ratio of `similarity` or more are linked.
    """
    width = 64 // segments
    if distance >= 2 * segments:
        raise ValueError("balls of one bit find distances under twice the number of segments")
    keys = F.expr(f"transform(sequence(0, {segments - 1}), s -> shiftrightunsigned(fp, s * {width}) & {(1 << width) - 1}L)")
    own = ["node", "size"] if "node" in nodes.columns else [F.col("fp").alias("node"), F.lit(1).alias("size")]
    each = nodes.select("fp", *own, F.posexplode(keys).alias("segment", "key"))
    more = F.expr(f"concat(array(key), filter(transform(sequence(0, {width - 1}), i -> key | shiftleft(1L, i)), k -> k != key))")
    met = each.select("fp", "segment", F.explode(more).alias("key"), "node", "size")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def forest(x, node, size):
            """Of each node but the first of its component in x, the pair with that first one."""
            label, block = np.arange(len(x)), max(1, 4_000_000 // len(x))
            while True:
                new = label.copy()
                for i in range(0, len(x), block):
                    near = np.bitwise_count(x[i : i + block, None] ^ x[None]) <= distance
                    at, to = size[i : i + block, None], size[None]
                    near &= (at >= similarity * to) & (to >= similarity * at)
                    new[i : i + block] = np.where(near, label[None], len(x)).min(1)
                new = new[new]
                if np.array_equal(new, label):
                    other = np.flatnonzero(label != np.arange(len(x)))
                    return node[other], node[label[other]]
                label = new

        def pairs(codes, *columns):
            cut = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            size = np.diff(np.append(cut, len(codes)))
            found = [forest(*(c[a : a + n] for c in columns)) for a, n in zip(cut[size > 1], size[size > 1], strict=True)]
            p, q = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])

        held = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        for b in batches:
            codes = b.column(1).to_numpy().astype(np.int64) << np.int64(width) | b.column(2).to_numpy()
            new = codes, b.column(0).to_numpy().view(np.uint64), b.column(3).to_numpy(), b.column(4).to_numpy()
            held = [np.concatenate(c) for c in zip(held, new, strict=True)]
            last = np.searchsorted(held[0] == held[0][-1], True) if len(held[0]) else 0
            if last:
                yield pairs(*(c[:last] for c in held))
            held = [c[last:] for c in held]
        if len(held[0]):
            yield pairs(*held)

    dealt = met.repartition("segment", "key").sortWithinPartitions("segment", "key")
    return dealt.mapInArrow(run, "a long, b long").where("a != b").distinct()


def attach(rows: DataFrame, keyed: DataFrame, key: str, total: int, share: int = 10_000, least: int = 256) -> DataFrame:
    """rows with the columns of keyed, which has one row a key and n, the number of rows of that key; total: all rows.

    Keys of more than a `share`-th of all rows (and of more than `least`) are fewer than `share`, so these rows of keyed
    are broadcast and theirs stay where they are; only the others are dealt out by the key.
    """
    cut = max(least, total // share)
    hot = F.broadcast(keyed.where(F.col("n") > cut))
    cold = rows.join(hot.select(key), key, "left_anti").join(keyed.where(F.col("n") <= cut), key)
    return rows.join(hot, key).unionByName(cold)


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, root (its component's smallest node) of every node of edges (a, b), by large-star and small-star steps.

    Each step is a groupBy with map-side minimum and a join (hubs by attach()), written to the shared folder; it raises
    if `most` rounds don't converge, which needs components of more than 2**most nodes.
    """
    edges = materialize(edges.select("a", "b"), "components")
    state, total = None, 2 * edges.count()
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "components-low")
        large = attach(both, low, "a", total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(low, "a")
        small = linked.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = materialize(small.distinct(), "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 30)), F.count_distinct("a")).first()
        if state == now and now[0] == now[2]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())
        state, total = now, 2 * now[0]
    raise RuntimeError("components did not converge")


def _least_of_components(nodes: DataFrame, name: str, root: DataFrame) -> DataFrame:
    """nodes (of a column `name` and of first, its smallest doc_id) with root and component_id; root: node, root of the linked ones."""
    linked = materialize(nodes.withColumnRenamed(name, "node").select("node", "first").join(root, "node"), "linked")
    least = materialize(linked.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")), "linked-least")
    placed = attach(linked.select("node", "root"), least, "root", linked.count()).select(F.col("node").alias(name), "root", "component_id")
    return nodes.join(placed, name, "left").select(name, F.coalesce("root", name).alias("root"), F.coalesce("component_id", "first").alias("component_id"))


def near_duplicates(documents: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach) for every row of documents."""
    prints = materialize(fingerprints(documents, words), "simhash")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    root = components(links(nodes.select("fp"), distance) if distance <= 3 else bucket_links(nodes.select("fp"), distance))
    placed = _least_of_components(nodes, "fp", root)
    return prints.join(placed.select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _parts(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(parts: list[bytes], words: int = 5):
    """Sorted hashes of the distinct shingles; fewer words than a shingle are one."""
    import numpy as np
    from xxhash import xxh64_intdigest as xxh

    return np.unique(np.array([xxh(b" ".join(parts[i : i + words]), SEED) for i in range(max(1, len(parts) - words + 1))], np.uint64))


def _name(parts: list[bytes]) -> int:
    """Signed 64-bit hash of a text's words."""
    from xxhash import xxh64_intdigest as xxh

    x = xxh(b" ".join(parts), SEED + 1)
    return x - (1 << 64) if x >> 63 else x


def _linked_in_slices(dealt: DataFrame, distance: int, similarity: float, shingle: int) -> DataFrame:
    """Pairs a < b of verified links in each slice, enough to connect what all of the slice's would.

    dealt: root, i, j (the slice), node, fp, text, cluster (of nodes that are connected already), side. Rows of side 0
    are compared with those of side 1, and rows of side 2 with each other.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def pairs(rows):
            x = np.array([r[1] for r in rows], np.int64).view(np.uint64)
            cluster, side = (np.array([r[k] for r in rows], np.int64) for k in (3, 4))
            first, sets, found = {}, {}, []
            up = [first.setdefault(r[3], k) for k, r in enumerate(rows)]

            def top(k):
                while up[k] != k:
                    up[k] = up[up[k]]
                    k = up[k]
                return k

            def grams(k):
                if k not in sets:
                    sets[k] = shingles(_parts(rows[k][2]), shingle)
                return sets[k]

            left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            block = max(1, 4_000_000 // max(1, len(right)))
            for at in range(0, len(left), block):
                part = left[at : at + block, None]
                near = (np.bitwise_count(x[part] ^ x[right]) <= distance) & (cluster[part] != cluster[right])
                near &= (side[part] != 2) | (part < right)
                for a, b in zip(*(v.tolist() for v in np.nonzero(near)), strict=True):
                    a, b = int(left[at + a]), int(right[b])
                    if (p := top(a)) == (q := top(b)):
                        continue
                    m, n = len(grams(a)), len(grams(b))
                    if min(m, n) < similarity * max(m, n):
                        continue
                    both = len(np.intersect1d(grams(a), grams(b), assume_unique=True))
                    if both >= similarity * (m + n - both):
                        up[q] = p
                        found.append(sorted((rows[a][0], rows[b][0])))
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        key, rows = None, []
        for b in batches:
            for *k, node, fp, text, cluster, side in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != key:
                    if len(rows) > 1:
                        yield pairs(rows)
                    key, rows = k, []
                rows.append((node, fp, text, cluster, side))
        if len(rows) > 1:
            yield pairs(rows)

    by = ["root", "i", "j"]
    sorted_ = dealt.select(*by, "node", "fp", "text", "cluster", "side").repartition(*by).sortWithinPartitions(*by)
    return sorted_.mapInArrow(run, "a long, b long").distinct()


def verified_links(members: DataFrame, distance: int = 7, similarity: float = 0.8, shingle: int = 5, chunk: int = 1_000) -> DataFrame:
    """Pairs a < b of nodes that connect all that chains of verified links connect.

    members: node, fp, text, root (the smallest node of a group that no link leaves), n (the group's nodes); a table
    that can be read again. A link is a pair within `distance` bits whose texts' sets of shingles have a Jaccard
    similarity of `similarity` or more. Groups are cut into slices of some `chunk` nodes. First each slice is linked,
    together with a copy of the group's root, so that a large group of copies of one text is one cluster by then. Only
    groups of several clusters go on: their nodes outside the largest cluster, m of n, are compared with all the others,
    which copies m * n / chunk texts (n where m is under `chunk`) and no text of groups that are one cluster.
    """
    k = F.ceil(F.col("n") / chunk).cast("int")
    slices = F.when(F.col("node") == F.col("root"), F.sequence(F.lit(0), k - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), k).cast("int")))
    once = members.select("root", F.explode(slices).alias("i"), F.lit(0).alias("j"), "node", "fp", "text", F.col("node").alias("cluster"), F.lit(2).alias("side"))
    found = materialize(_linked_in_slices(once, distance, similarity, shingle), "simhash-slices")
    large = members.where(F.col("n") > chunk)
    total = large.count()
    if not total:
        return found
    linked = components(found).withColumnRenamed("root", "cluster")
    own = materialize(large.select("node", "root").join(linked, "node", "left").select("node", "root", F.coalesce("cluster", "node").alias("cluster")), "simhash-clusters")
    counted = own.groupBy("root", "cluster").agg(F.count("*").alias("c"))
    groups = counted.groupBy("root").agg(F.sum("c").alias("n"), F.max(F.struct("c", "cluster")).alias("top"))
    several = materialize(groups.where("top.c < n").select("root", "n", F.col("top.cluster").alias("largest"), (F.col("n") - F.col("top.c")).alias("m")), "simhash-several")
    placed = attach(own, several, "root", total).select("node", "cluster", "largest", "m")
    texts = large.join(placed, "node").withColumns({"k": k, "r": F.ceil(F.col("m") / chunk).cast("int")})
    at = {x: F.pmod(F.xxhash64("node"), F.col(x)).cast("int") for x in "kr"}
    slot = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    every = F.transform(F.sequence(F.lit(0), F.col("r") - 1), lambda j: slot(at["k"], j, 0))
    other = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: slot(i, at["r"], 1))
    slots = F.when(F.col("cluster") == F.col("largest"), every).otherwise(F.concat(every, other))
    dealt = texts.withColumn("at", F.explode(slots)).select("root", "at.i", "at.j", "node", "fp", "text", "cluster", "at.side")
    return found.union(_linked_in_slices(dealt, distance, similarity, shingle))


def similar(documents: DataFrame, words: int = 0, distance: int = 7, similarity: float = 0.8, shingle: int = 5, chunk: int = 1_000) -> DataFrame:
    """doc_id, text_hash, node (hash of the text's words), root (of its component), component_id (the smallest doc_id that verified links reach) for every row."""
    bound_batches(documents.sparkSession)
    of = documents.schema["doc_id"].dataType.simpleString()

    def sketch(batches):
        import pyarrow as pa

        for b in batches:
            texts = b.column(1).to_pylist()
            parts = [_parts(t) for t in texts]
            columns = [[simhash(t, words) for t in texts], [_name(p) for p in parts]]
            sizes = pa.array([len(shingles(p, shingle)) for p in parts], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(c, pa.int64()) for c in columns), sizes], names=["doc_id", "text_hash", "fp", "node", "size"])

    def named(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_name(_parts(t)) for t in b.column(0).to_pylist()], pa.int64()), b.column(0)], names=["node", "text"])

    prints = materialize(documents.select("doc_id", "text", F.xxhash64("text")).mapInArrow(sketch, f"doc_id {of}, text_hash long, fp long, node long, size int"), "simhash")
    nodes = materialize(prints.groupBy("node").agg(F.min("fp").alias("fp"), F.min("size").alias("size"), F.min("doc_id").alias("first")), "simhash-nodes")
    groups = components(bucket_links(nodes.select("fp", "node", "size"), distance, similarity=similarity))
    sizes = materialize(groups.groupBy("root").agg(F.count("*").alias("n")), "simhash-sizes")
    placed = attach(groups, sizes, "root", groups.count()).join(nodes.select("node", "fp"), "node")
    texts = documents.select("text").mapInArrow(named, "node long, text string").groupBy("node").agg(F.min("text").alias("text"))
    members = materialize(texts.join(placed, "node"), "simhash-members")
    root = components(verified_links(members, distance, similarity, shingle, chunk))
    placed = _least_of_components(nodes.select("node", "first"), "node", root)
    return prints.join(placed, "node").select("doc_id", "text_hash", "node", "root", "component_id")


def keep_one(documents: DataFrame, words: int = 0, distance: int = 7, similarity: float = 0.8) -> DataFrame:
    """documents less the near-duplicates: of each component of similar() one row of its smallest doc_id.

    Where that doc_id stands on several texts of the component, the text of least hash stays; a text of the same doc_id
    in another component stays for that one. Of rows equal in doc_id and text one stays. Rows of null doc_id stay.
    """
    found = similar(documents, words, distance, similarity).where("doc_id is not null")
    kept = found.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select("k")
    name = free_name(documents, "_key")
    named = documents.withColumn(name, F.struct("doc_id", F.xxhash64("text").alias("text_hash")))
    once = named.where("doc_id is not null").join(kept.withColumnRenamed("k", name), name, "left_semi").dropDuplicates([name]).drop(name)
    return once.unionByName(documents.where("doc_id is null"))
