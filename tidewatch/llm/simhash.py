"""Near duplicates by SimHash fingerprints and pigeonhole blocks.

Narrow form (64 bits, a few differing bits): every choice of blocks that a close pair must share is a
key, so no close pair is missed. Wide form (256 bits, similarity of shingle sets): a pair at the
wanted similarity differs in about a sixth of the bits, too many for blocks that are certain to be
shared, so many sampled blocks are keys and a close pair shares one with high probability. Both meet
in buckets by key and are compared by Hamming distance. In the narrow form the distance decides; in
the wide form it only proposes pairs, and the similarity of their shingle sets decides.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import TASK_ROWS, arrow_schema, in_arrow, sized_for, stored, with_row_id
from tidewatch.llm.components import components

#: Words of a shingle, the distance and the blocks of the narrow form.
SHINGLE, DISTANCE, BLOCKS = 3, 3, 5
#: Wide form: 64-bit words of a fingerprint, and the share of pairs at the wanted similarity that
#: sampled blocks have to propose. Bits and number of the blocks follow from the number of texts.
WIDTH, RECALL = 4, 0.99
#: Least bits of a sampled block; texts that share a block of that many bits by chance, about. A row
#: that is shuffled costs about as much as a hundred comparisons in its bucket.
LEAST_BITS, SHARED = 12, 64
#: Share of the sampled blocks that find the dense groups first, so that not all of their pairs are proposed.
FIRST_SHARE = 0.5
#: Shingles that one block of texts to compare holds at most (or one text).
ROOM = 1 << 19
#: Members of a bucket that one task compares with as many others; larger buckets are cut.
CHUNK = 4096
_AT_ONCE = 1 << 14
#: Pairs that a task holds before it passes them on.
PAIRS = 1 << 16
#: Pairs a member that a bucket proposes at most; a bucket with more hands on its members instead. A pair
#: that is decided elsewhere costs about a hundred bytes, a member its text.
CROWD = 8
#: Fixed odd multipliers that spread a shingle's hash over the words of a wide fingerprint.
_SPREAD = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64) for k in range(64)], np.uint64)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of each shingle in order; a text of fewer words is one shingle, no words are none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    whole, size = b" ".join(words), len(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    last = (ends - 1)[min(shingle, size) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[s:e], 42) for s, e in zip(starts, last)), np.uint64, len(last))


def fingerprint(text: str | None, shingle: int = SHINGLE, width: int = 1, repeats: bool = True) -> list[int]:
    """The SimHash of a text, 64 bits a word: a bit is set if set in over half of the shingle hashes.

    The first word comes from XXH64 (seed 42) itself; further words mix it anew. No words: zero.
    Without ``repeats`` each different shingle counts once, as in the similarity of sets.
    """
    hashes = shingle_hashes(text, shingle)
    return _majority(hashes if repeats else np.unique(hashes), width)


def _majority(all_hashes: np.ndarray, width: int) -> list[int]:
    """The words of the fingerprint of these hashes; none: zero."""
    ones, seen = np.zeros((width, 64), np.int64), len(all_hashes)
    for at in range(0, seen, _AT_ONCE):
        hashes = all_hashes[at : at + _AT_ONCE]
        for k in range(width):
            mixed = hashes
            if k:
                mixed = (hashes ^ (hashes >> np.uint64(31))) * _SPREAD[k]
                mixed = (mixed ^ (mixed >> np.uint64(29))) * _SPREAD[k + 16]
                mixed ^= mixed >> np.uint64(32)
            bits = np.unpackbits(mixed.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones[k] += bits.sum(axis=0, dtype=np.int32)
    return [int.from_bytes(np.packbits(2 * o > seen).tobytes(), "big") for o in ones]


def fingerprints(
    docs: DataFrame, text: str = "text", shingle: int = SHINGLE, width: int = 1, repeats: bool = True
) -> DataFrame:
    """One row per row of ``docs``: _rid, doc_id, and the words f0, f1, ... as signed longs.

    Without ``repeats`` also n and total, the number and the wrapped sum of the different shingle
    hashes: texts that agree in all of them have the same shingle set.
    """
    names = [f"f{k}" for k in range(width)] + ([] if repeats else ["n", "total"])
    schema = ", ".join(f"{c} long" for c in ["_rid", "doc_id", *names])
    kind = arrow_schema(schema)

    def of(text: str | None) -> list[int]:
        hashes = shingle_hashes(text, shingle)
        if repeats:
            return _majority(hashes, width)
        hashes = np.unique(hashes)
        return [*_majority(hashes, width), len(hashes), int(hashes.sum(dtype=np.uint64))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [of(t.as_py()) for t in b.column("_text")]
            got = np.array(got, np.uint64).reshape(-1, len(names)).view(np.int64)
            words = [pa.array(np.ascontiguousarray(got[:, k])) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([b.column("_rid"), b.column("doc_id"), *words], schema=kind)

    rows = with_row_id(docs.select(F.col("doc_id").cast("long"), F.col(text).alias("_text")))
    return rows.select("_rid", "doc_id", "_text").transform(in_arrow, run, schema)


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Masks of every choice of blocks of which two fingerprints in range share one at least.

    ``distance`` differing bits spoil at most as many blocks, so ``blocks - distance`` stay equal.
    """
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    return [sum(pick) for pick in combinations(parts, blocks - distance)]


def pigeonhole_keys(nodes: DataFrame, blocks: int, distance: int) -> DataFrame:
    """(node, f0) → one row per choice of blocks: t, key, node, f0."""
    signed = [m - (1 << 64) if m >> 63 else m for m in block_masks(blocks, distance)]
    keys = [
        F.struct(F.lit(t).cast("long").alias("t"), F.col("f0").bitwiseAND(F.lit(m)).alias("key"))
        for t, m in enumerate(signed)
    ]
    return nodes.select("node", "f0", F.explode(F.array(*keys)).alias("k")).select("k.t", "k.key", "node", "f0")


def shape(texts: int, similarity: float, width: int = WIDTH, recall: float = RECALL) -> tuple[int, int]:
    """(samples, bits) of the sampled blocks for so many texts.

    A block has as many bits as leave about ``SHARED`` unrelated texts in a bucket; there are as many
    blocks as propose a pair at ``similarity`` with a probability of ``recall``, its distance being
    binomial and within ``reach``.
    """
    whole, p = 64 * width, math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = max(LEAST_BITS, math.ceil(math.log2(max(texts, 2) / SHARED)))
    apart = range(reach(similarity, width) + 1)
    weight = [math.comb(whole, d) * p**d * (1 - p) ** (whole - d) for d in apart]
    differ = [1 - math.comb(whole - d, bits) / math.comb(whole, bits) for d in apart]
    samples, part = 1, list(differ)
    # What no number of blocks can propose is out of reach; ``recall`` is asked of the rest.
    while sum(w * (1 - x) for w, x in zip(weight, part)) < recall * sum(weight):
        samples, part = samples + 1, [x * d for x, d in zip(part, differ)]
    return samples, bits


def sample_places(width: int, samples: int, bits: int, seed: int = 7) -> list[np.ndarray]:
    """The bits that each sampled block takes of a fingerprint."""
    chance = np.random.default_rng(seed)
    return [np.sort(chance.choice(64 * width, bits, replace=False)) for _ in range(samples)]


def sample_masks(width: int, samples: int, bits: int) -> np.ndarray:
    """The same as masks over the words of a fingerprint: two share a block if they agree under its mask."""
    ones = np.zeros((samples, 64 * width), np.uint8)
    for row, places in zip(ones, sample_places(width, samples, bits)):
        row[places] = 1
    return np.packbits(ones, axis=1).view(">u8").astype(np.uint64)


def sampled_keys(
    nodes: DataFrame, width: int, samples: int, bits: int, rows: int | None = None, also: tuple[str, ...] = ()
) -> DataFrame:
    """(node, f0, ...) → one row per sampled block: t, key, node, f0, ... and the long columns ``also``.

    With ``rows``, the number of nodes, they are spread first over as many tasks as the rows made of
    them need.
    """
    if rows is not None:
        nodes = nodes.repartition(max(1, -(-rows * samples // TASK_ROWS)))
    names = [f"f{k}" for k in range(width)]
    schema = ", ".join(f"{c} long" for c in ["t", "key", "node", *names, *also])
    kind = arrow_schema(schema)
    picks = sample_places(width, samples, bits)
    place = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = np.stack([b.column(c).to_numpy() for c in names], axis=1)
            set_bits = np.unpackbits(words.astype(">i8").view(np.uint8).reshape(len(words), -1), axis=1)
            for t, pick in enumerate(picks):
                key = pa.array(set_bits[:, pick].astype(np.int64) @ place)
                rest = [b.column(c) for c in ("node", *names, *also)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), t)), key, *rest], schema=kind)

    return nodes.select("node", *names, *also).transform(in_arrow, run, schema)


def _near(left: tuple, right: tuple | None, distance: int) -> list[tuple[int, int]]:
    """Links between (nodes, words) arrays that join what is linked: a forest, not all pairs.

    ``right`` None: inside ``left``. A member that a tree already holds is not linked to it again.
    """
    same = right is None
    nodes = left[0] if same else np.concatenate([left[0], right[0]])
    words, base = (left[1], 0) if same else (right[1], len(left[0]))
    parent = np.arange(len(nodes))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for i in range(len(left[0])):
        lo = i + 1 if same else 0
        apart = np.bitwise_count(words[lo:] ^ left[1][i]).sum(axis=1)
        hits = np.flatnonzero(apart <= distance) + lo + base
        mine = root(i)
        for h in hits[parent[hits] != mine].tolist():
            other = root(h)
            if other != mine:
                parent[other] = mine
                links.append((int(nodes[i]), int(nodes[h])))
    return links


def _nearest(left: tuple, right: tuple | None, distance: int) -> list[tuple[int, int]]:
    """As ``_near``, but each member is linked to the nearest one: a minimum spanning forest of the distances.

    The copies of one text are then linked to that text where it is among them, not to each other.
    """
    nodes, words = left if right is None else tuple(np.concatenate(x) for x in zip(left, right))
    count, links, last = len(nodes), [], 0
    least, by = np.full(count, 1 << 30), np.zeros(count, np.int64)
    out = np.arange(1, count)
    while len(out):
        apart = np.bitwise_count(words[out] ^ words[last]).sum(axis=1)
        closer = apart < least[out]
        least[out[closer]], by[out[closer]] = apart[closer], last
        at = int(np.argmin(least[out]))
        last = int(out[at])
        if least[last] <= distance:
            links.append((int(nodes[by[last]]), int(nodes[last])))
        out = np.delete(out, at)
    return links


def links(keyed: DataFrame, width: int, distance: int, chunk: int = CHUNK, near: Callable = _near) -> DataFrame:
    """Bucket rows (t, key, node, f0, ...) → (a, b): nodes within ``distance`` bits that share a bucket.

    Links connect whatever is close in a bucket but are not all its pairs; ``near`` chooses them. A
    bucket of more than ``chunk`` members is cut by hash and every two of its parts meet in a task of
    their own.
    """
    names = [f"f{k}" for k in range(width)]
    full = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk)
    # Parts are two thirds full on average, so hashing hardly ever fills one beyond a chunk.
    parts = F.ceil(1.5 * F.col("n") / chunk).cast("int").alias("parts")
    hot = stored(full.select("t", "key", parts), "hot-buckets")
    if hot.isEmpty():
        return _packed_links(keyed, names, distance, near).distinct()
    met = keyed.join(hot, ["t", "key"])
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")),
    )
    met = met.withColumn("own", own).withColumn("pair", F.explode(others))
    met = met.select("t", "key", "pair.i", "pair.j", "own", "node", *names)
    kind = arrow_schema("a long, b long")

    def compare(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        words = np.stack([table.column(c).to_numpy() for c in names], axis=1).view(np.uint64)
        own = table.column("own").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = ((node[own == k], words[own == k]) for k in (i, j))
        found = near(left, None if i == j else right, distance)
        return pa.Table.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=kind)

    from_hot = met.groupBy("t", "key", "i", "j").applyInArrow(compare, "a long, b long")
    rest = keyed.join(hot.select("t", "key"), ["t", "key"], "left_anti")
    return _packed_links(rest, names, distance, near).unionByName(from_hot).distinct()


def _packed_links(rows: DataFrame, names: list[str], distance: int, near: Callable, few: int = 16) -> DataFrame:
    """Links inside buckets of at most a chunk: sorted by bucket, many of them in one Arrow batch."""
    kind = arrow_schema("a long, b long")

    def inside(t: np.ndarray, key: np.ndarray, node: np.ndarray, words: np.ndarray) -> list[tuple[int, int]]:
        turn = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
        edges = np.concatenate([[0], turn, [len(t)]])
        sizes = np.diff(edges)
        of, found = np.repeat(sizes, sizes), []
        # Buckets of a few: neighbours at each offset, all buckets at once.
        for step in range(1, few):
            at = np.flatnonzero((of[:-step] <= few) & (t[step:] == t[:-step]) & (key[step:] == key[:-step]))
            if not len(at):
                break
            at = at[np.bitwise_count(words[at] ^ words[at + step]).sum(axis=1) <= distance]
            found += zip(node[at].tolist(), node[at + step].tolist())
        for k in np.flatnonzero(sizes > few):
            lo, hi = edges[k], edges[k + 1]
            found += near((node[lo:hi], words[lo:hi]), None, distance)
        return found

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            now = [b.column(c).to_numpy() for c in ("t", "key", "node", *names)]
            now = [*now[:3], np.stack(now[3:], axis=1).view(np.uint64)]
            if held is not None:
                now = [np.concatenate(pair) for pair in zip(held, now)]
            if not len(now[0]):
                continue
            # The last bucket may go on in the next batch.
            t, key = now[0], now[1]
            open_from = int(np.flatnonzero((t != t[-1]) | (key != key[-1]))[-1]) + 1 if (
                (t[0] != t[-1]) or (key[0] != key[-1])
            ) else 0
            held = [x[open_from:] for x in now]
            yield of(inside(*[x[:open_from] for x in now]))
        if held is not None:
            yield of(inside(*held))

    def of(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=kind)

    return rows.repartition("t", "key").sortWithinPartitions("t", "key").transform(in_arrow, walk, "a long, b long")


def _labelled(rows: DataFrame, names: list[str], component_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows → each with component_id and kept; rows that agree in ``names`` are one node."""
    # Copies collapse here: what follows has one row per fingerprint, named by its first row.
    n = rows.count()
    own = rows.groupBy(*names).agg(F.min("doc_id").alias("least"), F.min(_first_of()).alias("head"))
    own = stored(sized_for(own, n), "nodes")
    own = own.withColumn("node", F.col("head.rid"))
    found = component_of(own.select("node", *names))
    named = own.join(found.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    named = named.select(*names, "least", "head", F.coalesce("component", "node").alias("component"))
    named = stored(sized_for(named, n), "named")
    whole = named.groupBy("component").agg(F.min("least").alias("component_id"), F.min("head").alias("first"))
    of_fp = stored(sized_for(named.select(*names, "component").join(whole, "component"), n), "of-fingerprint")
    return rows.join(of_fp, names).withColumn("kept", F.col("_rid") == F.col("first.rid"))


def _first_of() -> Column:
    """Orders rows by doc_id, nulls last, then by their place in the scan."""
    return F.struct(
        F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_rid").alias("rid")
    )


def grouped(
    docs: DataFrame, text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, blocks: int = BLOCKS
) -> DataFrame:
    """Every row with its 64-bit fingerprint and near-duplicate group; no link is missed.

    Returned: _rid, doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id
    that links reach, itself included), kept (one row of each group: that of component_id, the first
    of the scan among repeats). Null and empty texts have fingerprint zero and are linked like any
    other; null doc_ids are passed over in component_id unless a group has no other.
    """
    rows = stored(fingerprints(docs, text, shingle), "fingerprints")
    named = _labelled(
        rows, ["f0"], lambda nodes: components(links(pigeonhole_keys(nodes, blocks, distance), 1, distance))
    )
    return named.select(
        "_rid", "doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id", "kept"
    )


def reach(similarity: float, width: int = WIDTH, deviations: float = 3.0) -> int:
    """The bits in which fingerprints of shingle sets of this similarity differ, and some deviations more.

    Sets of Jaccard similarity s have cosine 2s / (1 + s); a bit differs with probability angle / pi.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(64 * width * p + deviations * math.sqrt(64 * width * p * (1 - p)))


def _across(
    node: np.ndarray, part: np.ndarray, size: np.ndarray, own: np.ndarray, words: np.ndarray, near: Callable
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one bucket's members that are near and of different parts, a member's at a time.

    With two values in ``own``, only pairs of both. Members of the largest part are only compared with others.
    """
    _, of, counts = np.unique(part, return_inverse=True, return_counts=True)
    if len(counts) == 1:
        return
    turn = np.lexsort((of, counts[of]))
    of, size, own, words = of[turn], size[turn], own[turn], words[turn]
    ends = np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, len(of))
    apart = own.min() != own.max()
    for i in range(ends[-2]):
        lo = ends[np.searchsorted(ends, i, "right")]
        hits = lo + np.flatnonzero(near(words[lo:], words[i], size[lo:], size[i]))
        hits = hits[own[hits] != own[i]] if apart else hits
        if len(hits):
            yield np.full(len(hits), turn[i]), turn[hits]


def _first_shared(t: int, masks: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Which of the pairs, given by the bits they differ in, share no block before block ``t``."""
    keep = np.ones(len(differ), bool)
    for mask in masks[:t]:
        keep[keep] = (differ[keep] & mask).any(axis=1)
    return keep


def _fits(left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Which set sizes allow the similarity."""
    return np.minimum(left, right) >= similarity * np.maximum(left, right) - 1e-9


def proposals(
    keyed: DataFrame,
    width: int,
    distance: int,
    similarity: float,
    chunk: int = CHUNK,
    few: int = 256,
    masks: np.ndarray | None = None,
    crowd: int | None = None,
    room: int = ROOM,
) -> DataFrame:
    """Bucket rows (t, key, node, f0, ..., part, n) → (a, b), a < b: every pair of nodes of different parts
    that share a bucket, are within ``distance`` bits and whose set sizes allow ``similarity``.

    A bucket of more than ``chunk`` members is cut by hash and every two of its parts meet in a task.
    With the blocks' ``masks`` (by t) a pair belongs to the first block it shares, so it is made once;
    without, repeats are removed. Pairs leave a task in batches of about ``PAIRS``.

    With ``crowd`` (and ``masks``) a bucket of more than ``crowd`` pairs a member makes none of them. It
    makes rows with ``b`` null, one a member: t, g and side, for ``crowds_verified`` to find and decide
    the same pairs. Members of more than ``room`` shingles are cut and every two cuts are a group g;
    with two sides, its pairs are those of both. So rows grow with the members, not with their pairs.
    """
    names, schema = [f"f{k}" for k in range(width)], "a long, b long" + (", t long, g long, side long" if crowd else "")
    kind = arrow_schema(schema)
    full = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > chunk)
    hot = stored(full.select("t", "key", F.ceil(1.5 * F.col("m") / chunk).alias("cuts")), "hot-buckets")
    if hot.isEmpty():
        met = keyed.withColumns({c: F.lit(0).cast("long") for c in ("own", "i", "j")})
    else:
        met = keyed.join(hot, ["t", "key"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
        met = met.withColumn("own", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("long"))
        others = F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1),
            lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")),
        )
        met = met.withColumn("pair", F.explode(others)).withColumn("i", F.col("pair.i")).withColumn("j", F.col("pair.j"))
    bucket = ["t", "key", "i", "j"]
    met = met.select(*bucket, "node", "part", "n", "own", *names)

    def near(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
        return _fits(n_left, n_right, similarity) & (np.bitwise_count(left ^ right).sum(axis=-1) <= distance)

    def own_pairs(at: np.ndarray, words: np.ndarray, held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """The pairs found, without those that an earlier block makes."""
        left, right = (np.concatenate(x) for x in zip(*held))
        if masks is None:
            return left, right
        keep = np.ones(len(left), bool)
        for t in np.unique(at[left, 0]):
            here = np.flatnonzero(at[left, 0] == t)
            keep[here] = _first_shared(t, masks, words[left[here]] ^ words[right[here]])
        return left[keep], right[keep]

    def pair_rows(facts: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
        a, b = facts[left, 0], facts[right, 0]
        none = [pa.nulls(len(a), pa.int64())] * (len(kind) - 2)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), *none], schema=kind)

    def member_rows(at: np.ndarray, node: np.ndarray, n: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The members of one crowded bucket, for each two cuts of them that meet."""
        cuts = []
        for side in np.unique(own):
            mine = np.flatnonzero(own == side)
            cut = np.cumsum(n[mine]) // room
            cuts += [(side, mine[cut == c]) for c in np.unique(cut)]
        for x, y in combinations_with_replacement(range(len(cuts)), 2):
            # Where two parts of a cut bucket meet, the pairs inside each of them are another task's.
            if at[2] != at[3] and cuts[x][0] == cuts[y][0]:
                continue
            of = [cuts[x][1]] if x == y else [cuts[x][1], cuts[y][1]]
            g = xxhash.xxh64_intdigest(np.array([*at, x, y], np.int64).tobytes()) - (1 << 63)
            rows = np.concatenate(of)
            side = np.repeat(np.arange(len(of)), [len(o) for o in of])
            columns = [node[rows], np.full(len(rows), at[0]), np.full(len(rows), g), side]
            a, t, g, side = (pa.array(c, pa.int64()) for c in columns)
            yield pa.RecordBatch.from_arrays([a, pa.nulls(len(rows), pa.int64()), t, g, side], schema=kind)

    def pairs(at: np.ndarray, facts: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
        turn = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
        edges = np.concatenate([[0], turn, [len(at)]])
        sizes = np.diff(edges)
        of = np.repeat(np.arange(len(sizes)), sizes)
        small = (sizes <= few)[of] & (at[:, 2] == at[:, 3])
        _, part, n, own = facts.T
        # Buckets of a few: neighbours at each offset, all buckets at once. They fit into one Arrow batch.
        held = []
        for step in range(1, min(few, len(of))):
            k = np.flatnonzero(small[:-step] & (of[step:] == of[:-step]))
            if not len(k):
                break
            k = k[part[k] != part[k + step]]
            k = k[near(words[k], words[k + step], n[k], n[k + step])]
            held.append((k, k + step))
        if held:
            left, right = own_pairs(at, words, held)
            if crowd:
                full = np.bincount(of[left], minlength=len(sizes)) > crowd * sizes
                for b in np.flatnonzero(full):
                    rows = np.unique(np.concatenate([x[of[left] == b] for x in (left, right)]))
                    yield from member_rows(at[edges[b]], facts[rows, 0], n[rows], own[rows])
                left, right = left[~full[of[left]]], right[~full[of[left]]]
            if len(left):
                yield pair_rows(facts, left, right)
        for b in np.flatnonzero(~small[edges[:-1]]):
            lo, hi = edges[b], edges[b + 1]
            if at[lo, 2] != at[lo, 3] and own[lo:hi].min() == own[lo:hi].max():
                continue
            yield from large(at[lo:hi], facts[lo:hi], words[lo:hi])

    def large(at: np.ndarray, facts: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, part, n, own = facts.T
        held, count, done, made = [], 0, [], 0
        for found in _across(node, part, n, own, words, near):
            held.append(found)
            count += len(found[0])
            if count >= PAIRS:
                done.append(own_pairs(at, words, held))
                made += len(done[-1][0])
                held, count = [], 0
                if crowd and made > crowd * len(at):
                    break
                if not crowd:
                    yield pair_rows(facts, *done.pop())
        if held:
            done.append(own_pairs(at, words, held))
            made += len(done[-1][0])
        if crowd and made > crowd * len(at):
            yield from member_rows(at[0], node, n, own)
        else:
            for found in done:
                yield pair_rows(facts, *found)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            now = [np.stack([b.column(c).to_numpy() for c in cs], axis=1) for cs in (bucket, ["node", "part", "n", "own"], names)]
            now[2] = now[2].view(np.uint64)
            # The last bucket may go on in the next batch.
            differs = np.flatnonzero((now[0] != now[0][-1]).any(axis=1))
            goes_on = bool(held) and (now[0][0] == held[-1][0][-1]).all()
            open_from = int(differs[-1]) + 1 if len(differs) else 0
            if not open_from and (goes_on or not held):
                held.append(now)
                continue
            done = [np.concatenate(x) for x in zip(*held, [x[:open_from] for x in now])]
            held = [[x[open_from:] for x in now]]
            yield from pairs(*done)
        if held:
            yield from pairs(*[np.concatenate(x) for x in zip(*held)])

    sorted_rows = met.repartition(*bucket).sortWithinPartitions(*bucket)
    found = sorted_rows.transform(in_arrow, walk, schema)
    return found if masks is not None else found.distinct()


def crowds_verified(
    members: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float, distance: int, masks: np.ndarray
) -> DataFrame:
    """Members (a, t, g, side) of crowded buckets → (a, b): links that join what their similar pairs join.

    ``nodes``: (node, f0, ..., n, part); ``texts``: (node, text). A task holds one group at a time: the
    pairs that ``proposals`` would have made of it are found by their fingerprints again, and those that
    no link joins yet are decided by their shingle sets.
    """
    names = [f"f{k}" for k in range(masks.shape[1])]
    facts = ["t", "g", "side", "node", "part", "n", *names]
    rows = members.select("t", "g", "side", F.col("a").alias("node")).join(nodes.select("node", "part", "n", *names), "node")
    rows = rows.join(texts, "node").select(*facts, F.coalesce("text", F.lit("")).alias("text"))
    kind = arrow_schema("a long, b long")

    def links_of(facts: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        side, node, part, n = facts[:, 2:6].T
        words, two = np.ascontiguousarray(facts[:, 6:]).view(np.uint64), side.min() != side.max()
        # The hashes of a group by number, so that one text's are marked and the others' looked up.
        size = np.array([len(x) for x in sets])
        known, flat = np.unique(np.concatenate(sets), return_inverse=True)
        numbers = np.split(flat, np.cumsum(size)[:-1])
        marked, group = np.zeros(len(known), bool), part.copy()
        for i in range(len(node) - 1):
            rest = np.arange(i + 1, len(node))
            rest = rest[(group[rest] != group[i]) & ((side[rest] != side[i]) | (not two))]
            rest = rest[_fits(n[rest], n[i], similarity)]
            rest = rest[np.bitwise_count(words[rest] ^ words[i]).sum(axis=1) <= distance]
            rest = rest[_first_shared(facts[0, 0], masks, words[rest] ^ words[i])]
            if not len(rest):
                continue
            marked[numbers[i]] = True
            shared = np.append(0, np.cumsum(marked[np.concatenate([numbers[k] for k in rest])]))
            marked[numbers[i]] = False
            both = np.diff(shared[np.append(0, np.cumsum(size[rest]))])
            for k in rest[both / (size[rest] + size[i] - both) >= similarity]:
                if group[k] != group[i]:
                    group[group == group[k]] = group[i]
                    yield int(node[i]), int(node[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sets = [], []

        def batch() -> pa.RecordBatch:
            found = list(links_of(np.concatenate(held), sets))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=kind)

        for b in batches:
            if not b.num_rows:
                continue
            now = np.stack([b.column(c).to_numpy() for c in facts], axis=1)
            hashes = (np.unique(shingle_hashes(x.as_py(), shingle)) for x in b.column("text"))
            turn = np.flatnonzero((now[1:, :2] != now[:-1, :2]).any(axis=1)) + 1
            for piece in np.split(now, turn):
                if held and (held[-1][-1, :2] != piece[0, :2]).any():
                    yield batch()
                    held, sets = [], []
                held.append(piece)
                sets += [next(hashes) for _ in piece]
        if sets:
            yield batch()

    return rows.repartition("t", "g").sortWithinPartitions("t", "g").transform(in_arrow, run, "a long, b long")


def verified(
    pairs: DataFrame, sizes: DataFrame, texts: DataFrame, shingle: int, similarity: float, room: int = ROOM
) -> DataFrame:
    """Of the distinct (a, b) those whose shingle sets have a Jaccard similarity of ``similarity`` or more.

    ``sizes``: (node, n) of every node; ``texts``: (node, text). Nodes are put in blocks of at most
    ``room`` shingles beside their partners; a task compares two blocks, so a text travels once for
    each block that its partners are in, not once a pair. A pair that the links found in the same
    task already connect may be left out: (a, b) connects what all similar pairs connect.
    """
    both = pairs.select(F.col("a").alias("node"), "b").unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("b")))
    beside = both.groupBy("node").agg(F.least(F.min("b"), F.col("node")).alias("low")).join(sizes, "node")
    beside = stored(beside, "beside")
    parts = beside.groupBy("low").agg(F.ceil(F.sum("n") / room).alias("parts"))
    placed = beside.join(parts, "low").select(
        "node", F.xxhash64("low", F.pmod(F.xxhash64("node"), F.greatest("parts", F.lit(1)))).alias("block")
    )
    placed = stored(placed, "blocks")
    met = pairs.join(placed.select(F.col("node").alias("a"), F.col("block").alias("i")), "a").join(
        placed.select(F.col("node").alias("b"), F.col("block").alias("j")), "b"
    )
    met = stored(met.select(F.xxhash64(F.least("i", "j"), F.greatest("i", "j")).alias("g"), "a", "b"), "block-pairs")
    need = met.select("g", F.col("a").alias("node")).unionByName(met.select("g", F.col("b").alias("node"))).distinct()
    held = need.join(texts, "node").select(
        "g", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = held.unionByName(met.select("g", "a", "b", F.lit(None).cast("string").alias("text")))
    kind = arrow_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sets, above = None, {}, {}

        def root(x: int) -> int:
            while above.get(x, x) != x:
                above[x] = above.get(above[x], above[x])
                x = above[x]
            return x

        for batch in batches:
            found = []
            for g, a, b, text in zip(*(batch.column(c).to_pylist() for c in ("g", "a", "b", "text"))):
                if g != group:
                    group, sets, above = g, {}, {}
                if b is None:
                    sets[a] = np.unique(shingle_hashes(text, shingle))
                elif root(a) != root(b) and jaccard(sets[a], sets[b]) >= similarity:
                    above[root(a)] = root(b)
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=kind)

    order = rows.repartition("g").sortWithinPartitions("g", F.col("text").isNull())
    return order.transform(in_arrow, run, "a long, b long")


def jaccard(left: np.ndarray, right: np.ndarray) -> float:
    """The similarity of two sorted arrays of different values; two empty ones are equal."""
    if len(left) > len(right):
        left, right = right, left
    if not len(left):
        return float(not len(right))
    at = np.minimum(np.searchsorted(right, left), len(right) - 1)
    both = int(np.count_nonzero(right[at] == left))
    return both / (len(left) + len(right) - both)


def _similar_components(nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float, width: int, recall: float) -> DataFrame:
    """(node, f0, ..., n) and the texts of nodes → (node, component) of nodes with a verified link."""
    rows = nodes.count()
    samples, bits = shape(rows, similarity, width, recall)
    sizes, first = nodes.select("node", "n"), math.ceil(FIRST_SHARE * samples)
    # Dense groups first: a forest of nearest pairs, verified. What it connects needs no other pair.
    close = links(sampled_keys(nodes, width, first, bits, rows), width, reach(similarity, width, 0.0), near=_nearest)
    close = stored(close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "close")
    close = stored(verified(close, sizes, texts, shingle, similarity), "close-links")
    part = components(close).withColumnRenamed("node", "_node")
    parted = nodes.join(part, F.col("node") == F.col("_node"), "left").drop("_node")
    parted = stored(parted.withColumn("part", F.coalesce("component", "node")).drop("component"), "parted")
    keyed = sampled_keys(parted, width, samples, bits, rows, also=("part", "n"))
    masks = sample_masks(width, samples, bits)
    within = reach(similarity, width)
    found = stored(proposals(keyed, width, within, similarity, masks=masks, crowd=CROWD), "proposals")
    pairs, members = found.where("b IS NOT NULL").select("a", "b"), found.where("b IS NULL")
    decided = close.unionByName(verified(pairs, sizes, texts, shingle, similarity))
    if not members.isEmpty():
        decided = decided.unionByName(crowds_verified(members, parted, texts, shingle, similarity, within, masks))
    return components(decided)


def similar(
    docs: DataFrame,
    text: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    width: int = WIDTH,
    recall: float = RECALL,
) -> DataFrame:
    """Every row with its group of similar texts: _rid, doc_id, component_id, kept (as ``grouped``).

    Links are pairs whose shingle sets (as sets of 64-bit hashes) have a Jaccard similarity of
    ``similarity`` or more, never less. Fingerprints propose them: a pair at ``similarity`` shares a
    sampled block with a probability of ``recall`` by the binomial, if it is within reach (0.998),
    and a closer one with more; ``shape`` says how many blocks of how many bits that takes.
    Texts without words are one group. ``docs`` is a stored table.
    """
    rows = stored(fingerprints(docs, text, shingle, width, repeats=False), "fingerprints")
    texts = with_row_id(docs.select(F.col(text).alias("text")), "node").select("node", "text")
    names = [f"f{k}" for k in range(width)] + ["n", "total"]
    named = _labelled(
        rows, names, lambda nodes: _similar_components(nodes, texts, shingle, similarity, width, recall)
    )
    return named.select("_rid", "doc_id", "component_id", "kept")


def one_of_each(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """One row of each group of similar texts, with all columns. ``docs`` is a stored table."""
    stay = similar(docs, text, **how).where("kept").select(F.col("_rid").alias("__kept_row"))
    rows = with_row_id(docs, "__row")
    return rows.join(stay, F.col("__row") == F.col("__kept_row"), "left_semi").drop("__row")
