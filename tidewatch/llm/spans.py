"""Substring duplicates by lookup of content-chosen blocks and of windows.

The reference is every document with a smaller doc_id. Its index is made of blocks of five words at
places that the words themselves choose (the least hash among nine neighbours), so equal passages
have equal blocks wherever they lie. Around a block that the reference holds too, all words of the
neighbourhood are covered if the reference has that neighbourhood. Where the block is known but not
its neighbourhood, every window of thirteen words is looked up by itself. Words under any covered
stretch go. This stands in for a greedy relative Lempel-Ziv parse: no position in the reference is
kept and no match is extended. What is called a factor here is a union of covered stretches, and the
words are the same, since a word goes exactly if a window over it occurs in the reference.

Keys travel as packed arrays, at most two entries per key and chunk (the least and the largest
doc_id), so a passage of a third of all documents meets as a few entries per chunk in its bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import arrow_schema, chunk_of, in_arrow, partitions, stored, with_row_id

#: Words of a window, and of a block; blocks that compete for a place.
WINDOW, BLOCK = 13, 5
CHOICE = WINDOW - BLOCK + 1
#: Keys that a task holds before it passes them on; bytes of text packed together.
HELD, PACK_BYTES = 2_000_000, 4 << 20
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_NONE = np.iinfo(np.int64).max


def _mix(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _over(hashes: np.ndarray, size: int, by: np.uint64, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of ``size`` words from each start (or from the starts ``at``)."""
    starts = np.arange(len(hashes) - size + 1) if at is None else at
    total = np.zeros(len(starts), np.uint64)
    for k in range(size):
        total = total * by + hashes[starts + k]
    return _mix(total)


def neighbourhoods(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of a text: keys of block (even) and neighbourhood (odd), first and last window start.

    Each window belongs to the block of least hash in it, the first of equals; a block's windows are
    neighbours, and its neighbourhood is all words under them.
    """
    n = len(hashes)
    if n < WINDOW:
        none = np.zeros(0, np.uint64)
        return none, none, none.astype(np.int64), none.astype(np.int64)
    blocks = _over(hashes, BLOCK, _FIRST)
    place = np.lib.stride_tricks.sliding_window_view(blocks, CHOICE).argmin(axis=1) + np.arange(n - WINDOW + 1)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    last = np.append(first[1:], len(place)) - 1
    at = place[first]
    size = last - first + WINDOW
    whole = np.zeros(len(first), np.uint64)
    for k in range(WINDOW + CHOICE - 1):
        under = k < size
        whole[under] = whole[under] * _SECOND + hashes[first[under] + k]
    whole = _mix(whole + (size * 64 + (at - first)).astype(np.uint64) * _FIRST)
    one = np.uint64(1)
    return blocks[at] & ~one, whole | one, first, last


def windows(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent keys of the windows that begin at ``starts``, 64 and 16 bits."""
    return _over(hashes, WINDOW, _FIRST, starts), _over(hashes, WINDOW, _SECOND, starts).astype(np.uint16)


def _ends(doc: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Indices of the first and last entry of each key, in the order of key and doc."""
    order = np.lexsort((doc, *reversed(keys)))
    if not len(order):
        return order
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order[new | np.append(new[1:], True)]


def _span(doc: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, least, largest): entries in key order and the least and largest doc of their key."""
    order = np.lexsort((doc, *reversed(keys)))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    group = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(order)) - 1
    return order, doc[order][at][group], doc[order][ends][group]


def _bytes(v: np.ndarray) -> bytes:
    return np.ascontiguousarray(v).tobytes()


def _ints(blobs: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in blobs.to_pylist()]


def _spread(bucket: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Entries by bucket, by doc inside; steps between docs pack well."""
    order = np.lexsort((doc, bucket))
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), part


def _steps(doc: np.ndarray) -> bytes:
    return _bytes(np.diff(doc, prepend=np.int64(0)))


def _from_steps(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, np.int64))


_KEYED = "bucket int, chunk long, a binary, b binary, doc binary"
_PACKED = "chunk long, docs binary"
_ANSWERED = "chunk long, kind int, x binary, y binary, z binary"
_NOTED = "chunk long, bucket int, a binary, b binary, doc binary, notes binary"


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def packs(rows: DataFrame) -> DataFrame:
    """(chunk, _rid, doc_id, _text) → (chunk, docs): rows of a chunk compressed a few megabytes at a time."""
    kind = arrow_schema(_PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        size: dict[int, int] = {}

        def out(chunk: int) -> pa.RecordBatch:
            docs = pa.Table.from_batches(held.pop(chunk)).combine_chunks()
            size.pop(chunk)
            return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([_pack(docs)], pa.binary())], schema=kind)

        for b in batches:
            chunks = b.column("chunk").to_numpy()
            for chunk in np.unique(chunks).tolist():
                part = b.filter(pa.array(chunks == chunk)).select(["_rid", "doc_id", "_text"])
                held.setdefault(chunk, []).append(part)
                size[chunk] = size.get(chunk, 0) + part.nbytes
                if size[chunk] >= PACK_BYTES:
                    yield out(chunk)
        for chunk in list(held):
            yield out(chunk)

    return rows.select("chunk", "_rid", "doc_id", "_text").transform(in_arrow, run, _PACKED)


def _documents(group: pa.Table) -> Iterator[tuple[int, int | None, list[bytes]]]:
    for blob in group.column("docs").to_pylist():
        docs = _unpack(blob)
        for rid, doc, text in zip(docs.column("_rid").to_pylist(), docs.column("doc_id").to_pylist(), docs.column("_text")):
            yield rid, doc, (text.as_py() or "").encode().split()


def index(rows: DataFrame, buckets: int) -> DataFrame:
    """(chunk, doc_id, _text) → keys of all blocks and neighbourhoods, packed by bucket and chunk."""
    kind = arrow_schema(_KEYED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        count = 0

        def out() -> Iterator[pa.RecordBatch]:
            for chunk, parts in held.items():
                key, doc = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
                ends = _ends(doc, key)
                key, doc = key[ends], doc[ends]
                made = [[], [], [], [], []]
                for bucket, part in _spread((key >> np.uint64(1)) % np.uint64(buckets), doc):
                    for column, v in zip(made, (bucket, chunk, _bytes(key[part]), None, _steps(doc[part]))):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, kind)], schema=kind)

        for b in batches:
            for chunk, doc, text in zip(b.column("chunk").to_pylist(), b.column("doc_id").to_pylist(), b.column("_text")):
                block, whole, _, _ = neighbourhoods(word_hashes((text.as_py() or "").encode().split()))
                if len(block):
                    key = np.concatenate([block, whole])
                    held.setdefault(chunk, []).append((key, np.full(len(key), _NONE if doc is None else doc)))
                    count += len(key)
            if count > HELD:
                yield from out()
                held, count = {}, 0
        yield from out()

    return rows.select("chunk", "doc_id", "_text").transform(in_arrow, run, _KEYED)


def _gathered(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, doc, chunk) of a bucket's entries."""
    key = _ints(group.column("a"), np.uint64)
    doc = [_from_steps(x) for x in group.column("doc").to_pylist()]
    chunk = np.repeat(group.column("chunk").to_numpy(), [len(k) for k in key])
    return np.concatenate(key), np.concatenate(doc), chunk


def resolve(keyed: DataFrame) -> DataFrame:
    """Per bucket: tell each chunk which of its blocks other documents share, and which of its
    neighbourhoods the reference has (with the least doc_id that has it)."""
    kind = arrow_schema(_ANSWERED)

    def run(group: pa.Table) -> pa.Table:
        key, doc, chunk = _gathered(group)
        order, least, largest = _span(doc, key)
        key, doc, chunk = key[order], doc[order], chunk[order]
        odd = (key & np.uint64(1)).astype(bool)
        # A chunk's own largest doc of a key is the one that may have a smaller one elsewhere.
        told = np.where(odd, doc > least, largest > least)
        key, chunk, least, odd = key[told], chunk[told], least[told], odd[told]
        made = [[], [], [], [], []]
        for c, part in _spread(chunk, least):
            shared, known = part[~odd[part]], part[odd[part]]
            for column, v in zip(
                made, (c, 0, _bytes(np.unique(key[shared])), _bytes(key[known]), _bytes(least[known]))
            ):
                column.append(v)
        return pa.table([pa.array(c, f.type) for c, f in zip(made, kind)], schema=kind)

    return keyed.groupBy("bucket").applyInArrow(run, _ANSWERED)


def factor(packed: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """Per chunk: factors found by neighbourhood, noted per document, and the keys of the windows at
    factor boundaries, packed by bucket."""
    kind = arrow_schema(_NOTED)
    notes_kind = pa.schema([("_rid", pa.int64()), ("spans", pa.list_(pa.int32())), ("open", pa.list_(pa.int32()))])

    def run(group: pa.Table, told: pa.Table) -> pa.Table:
        none = [np.zeros(0, np.uint64)]
        shared = np.unique(np.concatenate([*none, *_ints(told.column("x"), np.uint64)]))
        known = np.concatenate([*none, *_ints(told.column("y"), np.uint64)])
        least = np.concatenate([np.zeros(0, np.int64), *_ints(told.column("z"), np.int64)])
        order = np.argsort(known)
        known, least = known[order], least[order]
        chunk, notes, keys = group.column("chunk")[0].as_py(), [[], [], []], ([], [], [])
        for rid, doc, words in _documents(group):
            hashes = word_hashes(words)
            block, whole, first, last = neighbourhoods(hashes)
            own = _NONE if doc is None else doc
            at = np.minimum(np.searchsorted(known, whole), max(0, len(known) - 1))
            found = (known[at] == whole) & (least[at] < own) if len(known) else np.zeros(len(whole), bool)
            at = np.minimum(np.searchsorted(shared, block), max(0, len(shared) - 1))
            ajar = ~found & (shared[at] == block) if len(shared) else np.zeros(len(whole), bool)
            starts = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b + 1) for a, b in zip(first[ajar], last[ajar]))])
            notes[0].append(rid)
            notes[1].append(np.stack([first[found], last[found] + WINDOW], axis=1).ravel().astype(np.int32))
            notes[2].append(starts.astype(np.int32))
            if len(starts):
                a, b = windows(hashes, starts)
                for column, v in zip(keys, (a, b, np.full(len(a), own))):
                    column.append(v)
        blob = _pack(pa.table([pa.array(c, f.type) for c, f in zip(notes, notes_kind)], schema=notes_kind))
        made = [[chunk], [None], [None], [None], [None], [blob]]
        if keys[0]:
            a, b, doc = (np.concatenate(c) for c in keys)
            ends = _ends(doc, a, b)
            a, b, doc = a[ends], b[ends], doc[ends]
            for bucket, part in _spread(a % np.uint64(buckets), doc):
                for column, v in zip(made, (chunk, bucket, _bytes(a[part]), _bytes(b[part]), _steps(doc[part]), None)):
                    column.append(v)
        return pa.table([pa.array(c, f.type) for c, f in zip(made, kind)], schema=kind)

    return packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, _NOTED)


def check_windows(noted: DataFrame) -> DataFrame:
    """Per bucket: tell each chunk which of its boundary windows the reference has."""
    kind = arrow_schema(_ANSWERED)

    def run(group: pa.Table) -> pa.Table:
        a, doc, chunk = _gathered(group)
        b = np.concatenate(_ints(group.column("b"), np.uint16))
        order, least, _ = _span(doc, a, b)
        a, b, doc, chunk = a[order], b[order], doc[order], chunk[order]
        told = doc > least
        a, b, chunk, least = a[told], b[told], chunk[told], least[told]
        made = [[], [], [], [], []]
        for c, part in _spread(chunk, least):
            for column, v in zip(made, (c, 1, _bytes(a[part]), _bytes(b[part]), _bytes(least[part]))):
                column.append(v)
        return pa.table([pa.array(c, f.type) for c, f in zip(made, kind)], schema=kind)

    return noted.where("bucket is not null").groupBy("bucket").applyInArrow(run, _ANSWERED)


def keep(packed: DataFrame, noted: DataFrame, answers: DataFrame) -> DataFrame:
    """Per chunk: the words of each document that no factor covers."""
    schema = "_rid long, doc_id long, n_words long, n_removed long, kept string"
    kind = arrow_schema(schema)
    notes = noted.where("notes is not null").select(
        "chunk", F.lit(2).alias("kind"), F.col("notes").alias("x"), F.lit(None).cast("binary").alias("y"), F.lit(None).cast("binary").alias("z")
    )
    told = notes.unionByName(answers)

    def run(group: pa.Table, told: pa.Table) -> pa.Table:
        kinds, noted = told.column("kind").to_numpy(), {}
        for blob in told.column("x").filter(pa.array(kinds == 2)).to_pylist():
            t = _unpack(blob)
            noted.update(zip(t.column("_rid").to_pylist(), zip(t.column("spans"), t.column("open"))))
        told = told.filter(pa.array(kinds == 1))
        a = np.concatenate([np.zeros(0, np.uint64), *_ints(told.column("x"), np.uint64)])
        b = np.concatenate([np.zeros(0, np.uint16), *_ints(told.column("y"), np.uint16)])
        least = np.concatenate([np.zeros(0, np.int64), *_ints(told.column("z"), np.int64)])
        order = np.lexsort((b, a))
        a, b, least = a[order], b[order], least[order]
        # Windows whose first keys agree lie together; few do, so a step at a time finds the second.
        made = [[], [], [], [], []]
        for rid, doc, words in _documents(group):
            spans, starts = (np.asarray(x.values.to_numpy()) for x in noted[rid])
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, spans[::2], 1)
            np.add.at(edge, spans[1::2], -1)
            if len(starts) and len(a):
                one, two = windows(word_hashes(words), starts)
                at, left, found = np.searchsorted(a, one), np.arange(len(starts)), np.zeros(len(starts), bool)
                own = _NONE if doc is None else doc
                while len(left):
                    inside = at < len(a)
                    at, left = at[inside], left[inside]
                    same = a[at] == one[left]
                    at, left = at[same], left[same]
                    hit = b[at] == two[left]
                    found[left[hit]] = least[at[hit]] < own
                    at, left = at[~hit] + 1, left[~hit]
                np.add.at(edge, starts[found], 1)
                np.add.at(edge, starts[found] + WINDOW, -1)
            stay = np.cumsum(edge[:-1]) == 0
            kept = b" ".join([w for w, s in zip(words, stay.tolist()) if s]).decode()
            for column, v in zip(made, (rid, doc, len(words), int(len(words) - stay.sum()), kept)):
                column.append(v)
        return pa.table([pa.array(c, f.type) for c, f in zip(made, kind)], schema=kind)

    return packed.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(run, schema)


def without_repeats(docs: DataFrame, text: str | Column = "text") -> DataFrame:
    """Every row without the words that a smaller doc_id already has in a run of thirteen or more.

    Returned: _rid, doc_id, n_words, n_removed, kept (the words that stay, joined by one space).
    Windows are judged on the input. Null and empty texts have no words; texts under thirteen words
    stay whole. A null doc_id counts as larger than all others; rows that share a doc_id are not
    smaller than each other. ``docs`` is a stored table; an empty one gives an empty result.
    """
    body = F.col(text) if isinstance(text, str) else text
    rows = with_row_id(docs.select(F.col("doc_id").cast("long"), body.alias("_text")))
    rows = rows.withColumn("chunk", chunk_of(rows))
    buckets = 4 * partitions(docs.sparkSession)
    answers = stored(resolve(index(rows, buckets)), "block-answers")
    noted = stored(factor(packs(rows), answers, buckets), "factors")
    return keep(packs(rows), noted, check_windows(noted))
