"""SimHash near-duplicates: vantage-point trees over fingerprints, and components of their links.

A fingerprint is `words` numbers of 64 bits, majorities over the hashes of a text's shingles.

A vantage-point tree partitions fingerprints by their Hamming distance to vantage points: with a
vantage point v and a distance mu, the inner branch takes d <= mu + radius and the outer one
d > mu, so by the triangle inequality every pair within the radius is together in a branch, and a
fingerprint near the boundary is in both.  Over whole fingerprints that prunes little: random ones
of 64 bits lie 32 +- 4 bits apart, which is no more than a radius of 4.  Each fingerprint is
therefore cut into parts of bits, with one tree for the distance on each part at the radius 1,
where a branch is about 0.58 of its parent: two fingerprints within 2 * parts - 1 bits in all are
within one bit on a part (pigeonhole), hence together in a leaf of that part's tree.

The upper levels of the trees are fitted on a bounded sample of `sample` fingerprints, chosen by a
hash, and deal all fingerprints to shards; a shard goes on in memory down to leaves, where the
points within one bit on the part are compared on the bits of `check` words.  A shard of more than
`most` rows is dealt in cells of two of its blocks, each pair of which is in one cell.

A task reduces the links of its shards to a spanning star for each component that it sees, so a
group of thousands of near copies gives a few links a member, not its pairs.  Components come from
alternating large and small stars over tables in the shared folder.

Defined results: a null or wordless text has fingerprint 0, linked like any other; null ids belong
to a component but never name it unless all are null; repeated rows share fingerprint and
component; empty tables give empty results; only the named columns are read, and near_dedup()
returns all columns, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch, sized, small_batches, spread, table, unused
from .rolling import mix, shingle_sets

BYTES_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of `shingle` words, repeats included; of the whole, if it has fewer; none without words."""
    words = text.encode().translate(BYTES_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: -shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """Of hashes (n, words): bit i is set if it is set in more than half of them; zero for none."""
    n, words = hashes.shape
    total = np.zeros(64 * words, np.int64)
    for i in range(0, n, 255):  # sums of 255 bits fit a byte
        part = np.ascontiguousarray(hashes[i : i + 255]).view(np.uint8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(total * 2 > n, bitorder="little").view(np.uint64)


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Bit i is set if it is set in more than half of the shingles' XXH64; as a signed 64-bit number."""
    return int(majority(shingle_hashes(text, shingle, seed)[:, None]).view(np.int64)[0])


def fingerprints(docs: DataFrame, *, id_col="doc_id", text_col="text", shingle: int = 4, keep=()) -> DataFrame:
    """doc_id, fp (long) and the columns `keep`."""
    small_batches(docs.sparkSession)

    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    made.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return docs.select(F.col(id_col).alias("doc_id"), *keep, F.pandas_udf(made, "long")(F.col(text_col)).alias("fp"))


def set_fingerprints(keyed: DataFrame, shingle: int, words: int) -> DataFrame:
    """keyed with its `text` replaced by p0, p1, ...: majorities over the text's distinct shingles."""
    names = [f"p{w}" for w in range(words)]
    others = [c for c in keyed.columns if c != "text"]
    salt = mix(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def made(batches):
        for batch in batches:
            found = [majority(mix(h[:, None] ^ salt)) for h in shingle_sets(batch.column("text"), shingle)]
            x = np.array(found, np.uint64).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *(pa.array(np.ascontiguousarray(x[:, w])) for w in range(words))], [*others, *names])

    schema = ", ".join([*(f"`{c}` {keyed.schema[c].dataType.simpleString()}" for c in others), *(f"{p} long" for p in names)])
    return keyed.mapInArrow(made, schema)


def parts_of(words: int, each: int) -> list[tuple[int, int]]:
    """(word, mask) of `each` parts of the bits of every word."""
    edges = [64 * i // each for i in range(each + 1)]
    return [(w, (1 << b) - (1 << a)) for w in range(words) for a, b in zip(edges, edges[1:], strict=False)]


def _split(x: np.ndarray, tries: int, near: int = 1):
    """(vantage point, mu) that leave the fewest pairs to compare in the two branches of x; None if no split saves a tenth."""
    best, least = None, 0.9 * len(x) ** 2
    for k in range(tries):
        v = x[(2 * k + 1) * len(x) // (2 * tries)]
        count = np.bincount(np.bitwise_count(x ^ v), minlength=65 + near).cumsum()
        cost = count[near:65].astype(float) ** 2 + (len(x) - count[: 65 - near]).astype(float) ** 2
        mu = int(cost.argmin())
        if cost[mu] < least:
            best, least = (v, mu), cost[mu]
    return best


def grow_tree(x: np.ndarray, most: float):
    """A vantage-point tree over the part of sampled points x: (v, mu, inner, outer), or a leaf's number.

    Leaves hold at most `most` points, or more where no vantage point tells them apart.
    """
    count = [0]

    def node(x):
        cut = _split(x, 5) if len(x) > max(most, 16) else None
        if cut is None:
            count[0] += 1
            return count[0] - 1
        v, mu = cut
        d = np.bitwise_count(x ^ v)
        return (v, mu, node(x[d <= mu + 1]), node(x[d > mu]))

    return node(x)


def walk_tree(tree, x: np.ndarray):
    """(leaf, indices of the points x that belong to it), boundary points in several leaves."""
    stack = [(tree, np.arange(len(x)))]
    while stack:
        node, at = stack.pop()
        if not len(at):
            continue
        if not isinstance(node, tuple):
            yield node, at
            continue
        v, mu, inner, outer = node
        d = np.bitwise_count(x[at] ^ v)
        stack += [(inner, at[d <= mu + 1]), (outer, at[d > mu])]


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of points (words in the last axis) on all bits."""
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)


def _reach(x: np.ndarray, within: int):
    """Links of points x (n, words), each from the point that reached it: a point queries those not reached yet."""
    left, out = np.arange(len(x)), []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = _far(x[left], x[at]) <= within
            if near.any():
                found, left = left[near], left[~near]
                out.append((np.full(len(found), at), found))
                todo.extend(found.tolist())
    return out


def _leaf(x: np.ndarray, sub: np.ndarray, within: int, block: int = 128) -> list:
    """Links that join all points x whose parts `sub` are within one bit and that are within `within` themselves."""
    out = []
    for i in range(0, len(x), block):
        near = np.bitwise_count(sub[i : i + block, None] ^ sub[None, i:]) <= 1
        if np.count_nonzero(near) > 32 * block:  # a dense group: its pairs are not listed
            return _reach(x, within)
        at = np.flatnonzero(near)
        a, b = at // near.shape[1], at % near.shape[1]
        a, b = a[b > a] + i, b[b > a] + i
        near = _far(x[a], x[b]) <= within
        out.append((a[near], b[near]))
    return out


def search(x: np.ndarray, sub: np.ndarray, within: int, leaf: int = 384) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (indices) of points x (n, words): a vantage-point tree over their parts `sub`, walked as it is made."""
    out, stack = [], [np.arange(len(x))]
    while stack:
        at = stack.pop()
        cut = _split(sub[at], 2) if len(at) > leaf else None
        if cut is not None:
            d = np.bitwise_count(sub[at] ^ cut[0])
            stack += [at[d <= cut[1] + 1], at[d > cut[1]]]
        elif len(at) > 1:
            out += [(at[a], at[b]) for a, b in _leaf(x[at], sub[at], within) if len(a)]
    return out


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes of links (a, b) that are not the least themselves."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    far = root != np.arange(len(ids))
    return ids[far], ids[root[far]]


def _links(names, within: int):
    """Arrow function over rows (shard, id, part, names...) sorted by shard: the stars of a partition."""

    def made(batches):
        held, found, last = [], [], None

        def close():
            ids, part, *x = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            some = search(np.stack(x, axis=1).view(np.uint64), part.view(np.uint64), within)
            if some:
                a, b = (ids[np.concatenate(c)] for c in zip(*some, strict=True))
                found.append(stars(a, b))

        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column("shard").to_numpy()
            rows = [batch.column(c).to_numpy() for c in ("id", "part", *names)]
            cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and shard[a] != last:
                    close()
                last = shard[a]
                held.append([r[a:b] for r in rows])
            if len(found) > 64:
                found[:] = [stars(*(np.concatenate(c) for c in zip(*found, strict=True)))]
        if held:
            close()
        if found:
            a, b = stars(*(np.concatenate(c) for c in zip(*found, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return made


def links(nodes: DataFrame, *, words: int = 1, check: int = 1, parts: list[tuple[int, int]], within: int, sample: int = 1 << 20, shard: int = 1 << 19, shards: int = 8, most: int = 1 << 20, scratch: Scratch) -> DataFrame:
    """Links (a, b), b < a, of nodes (id, p0, p1, ...), ids distinct, that join every pair which differs
    in at most one bit on one of the `parts` and in at most `within` on the first `check` words.

    A tree aims at shards of `shard` rows, and at `shards` shards of its own at least, so that there
    is work for many tasks.  Trees are fitted on 32 fingerprints a shard, on 2^14 at least and on
    `sample` at most, which bounds what the driver holds and how many shards there are.
    """
    names = [f"p{w}" for w in range(words)]
    n = nodes.count()
    sample = min(sample, max(1 << 14, 32 * n // shard))
    share = min(1 << 30, (sample << 30) // max(1, n))
    some = nodes.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < share).select(*names).limit(2 * sample).toPandas()
    x = np.ascontiguousarray(some.to_numpy(np.int64)).view(np.uint64).reshape(-1, words)
    target = min(shard * len(x) / max(1, n), len(x) / shards)
    trees = nodes.sparkSession.sparkContext.broadcast([grow_tree(x[:, w] & np.uint64(mask), target) for w, mask in parts])

    def gathered(batches, rows: int = 1 << 14):
        held: list = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if sum(b.num_rows for b in held):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def deal(batches):
        for batch in gathered(batches):
            x = np.stack([batch.column(c).to_numpy() for c in names], axis=1).view(np.uint64)
            for t, ((w, mask), tree) in enumerate(zip(parts, trees.value, strict=True)):
                part = x[:, w] & np.uint64(mask)
                found = list(walk_tree(tree, part))
                if found:
                    at = np.concatenate([a for _, a in found])
                    number = np.repeat([t << 40 | leaf for leaf, _ in found], [len(a) for _, a in found])
                    rows = batch.take(pa.array(at))
                    columns = [pa.array(number), rows.column("id"), pa.array(part[at].view(np.int64)), *(rows.column(c) for c in names[:check])]
                    yield pa.RecordBatch.from_arrays(columns, ["shard", "id", "part", *names[:check]])

    schema = ", ".join(["shard long, id long, part long", *(f"{p} long" for p in names[:check])])
    dealt = spread(nodes.select("id", *names)).mapInArrow(deal, schema)
    # Shards that a task cannot hold go to cells of two blocks, each block in as many cells as there are blocks.
    large = scratch.save(dealt.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("blocks")).filter("blocks > 1"), "large")
    if not large.isEmpty():
        # At most one large shard for `most` rows, two numbers each.
        cut = dealt.join(F.broadcast(large), "shard", "left").withColumn("own", F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int"))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        cell = F.when(F.col("blocks").isNull(), F.col("shard")).otherwise(F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")))
        dealt = cut.select(cell.alias("shard"), "id", "part", *names[:check])
    found = dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(_links(names[:check], within), "a long, b long")
    return found.distinct()


def components(edges: DataFrame, scratch: Scratch, label: str = "edges") -> DataFrame:
    """(node, root): root is the least node of the component of every node in `edges` (a, b).

    Least neighbours are written before they are joined: an aggregation beside the join would keep
    Spark from splitting the links of a node that very many have.
    """
    now, before = scratch.save(edges.select("a", "b").filter("a <> b").distinct(), f"{label}-0"), None
    k = 0
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.save(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{label}-least")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        k += 1
        large = scratch.save(large, f"{label}-{k}")
        least = scratch.save(large.groupBy("a").agg(F.min("b").alias("m")), f"{label}-least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        k += 1
        small = scratch.save(small.filter("a <> b").distinct(), f"{label}-{k}")
        mark = tuple(small.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
        for old in (k - 1, k - 2):
            scratch.drop(f"{label}-{old}")
        if mark == before:
            return small.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(small.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        now, before = small, mark


def near_duplicates(prints: DataFrame, *, radius: int = 4, scratch: Scratch, **how) -> DataFrame:
    """(fp, component_id): the least doc_id that each fingerprint of `prints` (doc_id, fp) can reach."""
    nodes = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("doc")), "nodes")
    points = nodes.select(F.col("fp").alias("id"), F.col("fp").alias("p0"))
    found = links(points, parts=parts_of(1, radius // 2 + 1), within=radius, scratch=scratch, **how)
    roots = scratch.save(components(found, scratch), "roots")
    rooted = scratch.save(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "doc", F.coalesce("root", "fp").alias("root")), "rooted")
    least = scratch.save(rooted.groupBy("root").agg(F.min("doc").alias("component_id")), "least")
    return rooted.join(least, "root").select("fp", "component_id")


def overlap_groups(texts, shingle: int = 5, least: float = 0.8) -> np.ndarray:
    """For each text the place of the first of its group: components of shingle sets with a Jaccard of `least` or more.

    Texts without words are one group.  Each text queries those not reached yet.
    """
    sets = list(shingle_sets(pa.array(texts, pa.large_string()), shingle))
    size = np.array([len(x) for x in sets])
    flat, owner = np.unique(np.concatenate(sets), return_inverse=True)[1], np.repeat(np.arange(len(sets)), size)
    at = np.concatenate([[0], np.cumsum(size)])
    ids, mark = flat, np.zeros(len(flat) + 1, bool)
    group, left = np.full(len(sets), -1), np.ones(len(sets), bool)
    for first in range(len(sets)):
        todo = [first] if left[first] else []
        group[todo], left[todo] = first, False
        while todo and left.any():
            q = todo.pop()
            own = flat[at[q] : at[q + 1]]
            mark[own] = True
            both = np.bincount(owner[mark[ids]], minlength=len(sets)) if len(own) else np.zeros(len(sets), int)
            mark[own] = False
            near = np.flatnonzero(left & (both >= least * (size + len(own) - both)))
            if len(near):
                group[near], left[near] = first, False
                todo.extend(near.tolist())
                rest = left[owner]
                ids, owner = ids[rest], owner[rest]
    return group


def _groups_of(shingle: int, least: float):
    """pandas function: links (a, b) inside every `cell` of rows (cell, id, text)."""

    def made(x: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in x.sort_values(["cell", "id"]).groupby("cell", sort=False):
            ids = g["id"].to_numpy()
            first = ids[overlap_groups(g["text"], shingle, least)]
            out.append(pd.DataFrame({"a": ids[first != ids], "b": first[first != ids]}))
        return pd.concat(out)

    return made


def _same(shingle: int, least: float):
    """Arrow function: (id, root, alike, text) of rows (id, root, text, hub): whether text and hub are alike."""

    def made(batches):
        held: dict = {}
        for batch in batches:
            hubs = batch.column("hub").to_pylist()
            new = list(dict.fromkeys(h for h in hubs if h not in held))
            if len(held) > 64:
                held.clear()
                new = list(dict.fromkeys(hubs))
            held.update(zip(new, shingle_sets(pa.array(new, pa.large_string()), shingle), strict=True))
            alike = []
            for x, h in zip(shingle_sets(batch.column("text"), shingle), hubs, strict=True):
                both = len(np.intersect1d(x, held[h], assume_unique=True))
                alike.append(both >= least * (len(x) + len(held[h]) - both))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("root"), pa.array(alike, pa.bool_()), batch.column("text")], ["id", "root", "alike", "text"])

    return made


def alike_links(members: DataFrame, *, shingle: int = 5, least: float = 0.8, most: int = 1000, most_bytes: int = 8 << 20, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join the members (id, root, bytes, p0, text) of a component whose shingle sets have a Jaccard of `least` or more, exactly.

    A component of at most `most` texts and `most_bytes` is compared in one task.  In a larger one
    all texts are first compared with a hub, the text nearest to the majority of the fingerprints;
    what is not like the hub is compared with all texts in cells of two blocks of such a size.
    """
    groups = _groups_of(shingle, least)
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / most, F.sum("bytes") / most_bytes)).cast("int")
    sizes = scratch.save(members.groupBy("root").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("n")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    large = scratch.save(sizes.filter("blocks > 1").select("root"), "large-roots")
    n_large = large.count()
    small = members.join(sized(large, n_large), "root", "left_anti") if n_large else members
    dealt = F.pmod(F.xxhash64("root"), F.lit(max(1, total // most)))
    found = small.select(dealt.alias("deal"), F.col("root").alias("cell"), "id", "text").groupBy("deal").applyInPandas(groups, "a long, b long")
    if not n_large:
        return found
    found = scratch.save(found, "links-small")
    big = members.join(sized(large, n_large), "root", "left_semi")
    ones = [F.sum(F.shiftright("p0", i).bitwiseAND(F.lit(1))).alias(f"s{i}") for i in range(64)]
    bits = big.groupBy("root").agg(F.count(F.lit(1)).alias("n"), *ones)
    usual = [F.when(2 * F.col(f"s{i}") > F.col("n"), F.lit(-(1 << 63) if i == 63 else 1 << i)).otherwise(F.lit(0)) for i in range(64)]
    bits = scratch.save(bits.select("root", sum(usual[1:], usual[0]).alias("usual")), "usual")
    far = F.struct(F.bit_count(F.col("p0").bitwiseXOR(F.col("usual"))), "id")
    hubs = scratch.save(big.select("root", "id", "p0").join(sized(bits, n_large), "root").groupBy("root").agg(F.min_by("id", far).alias("hub_id")), "hub-ids")
    hubs = scratch.save(big.join(sized(hubs, n_large), "root").filter("id = hub_id").select("root", "hub_id", F.coalesce("text", F.lit("")).alias("hub")).dropDuplicates(["root"]), "hubs")
    told = big.select("id", "root", "text").join(hubs, "root").select("id", "root", "text", "hub").mapInArrow(_same(shingle, least), "id long, root long, alike boolean, text string")
    told = scratch.save(told, "told")
    near = told.filter("alike").join(sized(hubs.select("root", "hub_id"), n_large), "root").select(F.col("id").alias("a"), F.col("hub_id").alias("b"))
    found = found.unionByName(near)
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    count = lambda side: F.ceil(F.greatest(F.sum(F.when(side, 1)) / most, F.sum(F.when(side, size)) / most_bytes))
    cells = told.groupBy("root").agg(count(~F.col("alike")).cast("int").alias("rest"), count(F.col("alike")).cast("int").alias("done")).filter("rest > 0")
    cells = scratch.save(cells, "cells")
    own = F.pmod(F.xxhash64("id"), F.when(F.col("alike"), F.col("done")).otherwise(F.col("rest"))).cast("int")
    others = lambda n, kind: F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("i")))
    none = F.array().cast("array<struct<kind:int,i:int>>")
    # Texts unlike the hub meet each other (kind 0) and those like it (kind 1); the latter need not meet again.
    meets = F.when(F.col("alike"), others(F.col("rest"), 1)).otherwise(F.concat(others(F.col("rest"), 0), F.when(F.col("done") > 0, others(F.col("done"), 1)).otherwise(none)))
    dealt = told.join(sized(cells, n_large), "root").withColumn("own", own).withColumn("m", F.explode(meets))
    pair = F.when(F.col("m.kind") == 0, F.struct(F.least("own", "m.i").alias("i"), F.greatest("own", "m.i").alias("j"))).otherwise(
        F.when(F.col("alike"), F.struct(F.col("m.i").alias("i"), F.col("own").alias("j"))).otherwise(F.struct(F.col("own").alias("i"), F.col("m.i").alias("j")))
    )
    dealt = dealt.select(F.xxhash64("root", "m.kind", pair).alias("cell"), "id", "text")
    return found.unionByName(dealt.groupBy("cell").applyInPandas(groups, "a long, b long"))


def near_dedup(docs: DataFrame, *, id_col="doc_id", text_col="text", shingle: int = 5, least: float = 0.8, words: int = 12, check: int = 4, within: int = 54, scratch: Scratch | None = None, **how) -> DataFrame:
    """The rows of docs, of each group of near copies only the one of the least id (null ids last, then the least hash).

    Texts are near copies if their sets of `shingle` words have a Jaccard of `least` or more, or by
    links of such pairs.  Pairs are looked for with fingerprints of 64 * words bits: a candidate
    differs in at most one bit on one of 3 * words parts, and in at most `within` on the first `check`
    words.  A bit of texts with a Jaccard of 0.8 differs with a probability of 0.15, so a direct
    candidate is missed with about 0.007 there and less above.  Fingerprints only choose what is
    compared; the comparison is exact, so no row goes without a text like it.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "near-dedup")
    small_batches(spark)
    names = [f"p{w}" for w in range(words)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    key = F.xxhash64("doc_id", "text").alias("key")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")
    keyed = spread(rows).select("doc_id", key, F.xxhash64("text").alias("s"), F.xxhash64(F.lit(1), "text").alias("s2"), size, "text")
    prints = scratch.save(set_fingerprints(keyed, shingle, words), "prints")
    # Of equal texts the row of the least id, null ids last, then of the least key.
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    first = prints.groupBy("s", "s2").agg(F.min_by(F.struct("key", "doc_id", "bytes", *names), order).alias("f"))
    nodes = scratch.save(first.select(F.col("f.key").alias("id"), "f.doc_id", "f.bytes", *[f"f.{p}" for p in names]), "nodes")
    found = links(nodes.select("id", *names), words=words, check=check, parts=parts_of(words, 3), within=within, scratch=scratch, **how)
    roots = scratch.save(components(found, scratch), "roots")
    members = scratch.save(nodes.join(roots, F.col("id") == F.col("node")).select("id", "root", "bytes", "p0"), "members")
    n = members.count()
    texts = rows.select(key, "text").join(sized(members.withColumnRenamed("id", "key"), n), "key")
    texts = scratch.save(texts.select(F.col("key").alias("id"), "root", "bytes", "p0", "text"), "texts")
    groups = scratch.save(components(alike_links(texts, shingle=shingle, least=least, scratch=scratch), scratch, "alike"), "groups")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "id")
    heads = nodes.join(groups, F.col("id") == F.col("node")).groupBy("root").agg(F.min_by("id", order).alias("head"))
    gone = scratch.save(groups.join(heads.select("head"), F.col("node") == F.col("head"), "left_anti").select(F.col("node").alias("id")), "gone")
    kept = nodes.join(gone, "id", "left_anti").select(F.col("id").alias("k"), F.col("doc_id").alias("d"))
    # Keys are hashes of id and text, so equal ones are repeated rows, of which one stays.
    same = (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))
    seen = scratch.save(prints.groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("n")), "seen")
    dropped = scratch.save(seen.join(kept, same, "left_anti").select("key", "doc_id"), "dropped")
    twice = scratch.save(seen.filter("n > 1").join(dropped.withColumnsRenamed({"key": "k", "doc_id": "d"}), same, "left_anti").select("key", "doc_id"), "twice")
    k, d, rk = unused(docs, "k", "d", "key")
    with_key = docs.withColumn(rk, F.xxhash64(F.col(id_col), F.col(text_col)))
    same = (F.col(rk) == F.col(k)) & F.col(id_col).eqNullSafe(F.col(d))
    left = with_key.join(sized(dropped.toDF(k, d), dropped.count()), same, "left_anti")
    n_twice = twice.count()
    if n_twice:
        again = sized(twice.toDF(k, d), n_twice)
        left = left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates([id_col, rk]))
    return left.drop(rk)


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "simhash")
    prints = scratch.save(fingerprints(spread(table(spark, sf_dir, "documents"))), "prints")
    found = near_duplicates(prints, scratch=scratch)
    return prints.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
