"""Byte-level BPE by replaying merges over a corpus at a time."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import arrow_schema, in_arrow

#: Words remembered by a task; beyond it they are forgotten and replayed when met again.
REMEMBERED = 200_000
_SHIFT = 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes → rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class MergeReplay:
    """Encodes many words at once.

    All words lie in one array of tokens with links to the neighbours. An inverted index maps each
    adjacent token pair to its positions; pairs are merged in rank order, each merge at all its
    positions together, and only the pairs beside a merged position are indexed anew.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.merged: dict[int, int] = {}

    def rank(self, pair: int) -> int:
        """The rank of what a pair merges to; -1 if to nothing."""
        found = self.merged.get(pair)
        if found is None:
            both = self.token[pair >> _SHIFT] + self.token[pair & ((1 << _SHIFT) - 1)]
            found = self.merged[pair] = self.ranks.get(both, -1)
        return found

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The token ids of each word, as 32-bit integers side by side."""
        out = [np.int32(self.ranks[w]).tobytes() if w in self.ranks else b"" for w in words]
        rest = [i for i, ids in enumerate(out) if not ids and words[i]]
        if not rest:
            return out
        tok, start = self._replay([words[i] for i in rest])
        alive = np.flatnonzero(tok >= 0)
        ids, edges = tok[alive].astype(np.int32).tobytes(), (4 * np.searchsorted(alive, start)).tolist()
        for i, lo, hi in zip(rest, edges, edges[1:]):
            out[i] = ids[lo:hi]
        return out

    def _replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(w) for w in words], np.int64)
        start = np.concatenate([[0], np.cumsum(size)])
        tok = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        right = np.arange(1, len(tok) + 1)
        right[start[1:] - 1] = -1
        left = np.arange(-1, len(tok) - 1)
        left[start[:-1]] = -1
        index: dict[int, list[np.ndarray]] = {}
        queue: list[tuple[int, int]] = []

        def add(pairs: np.ndarray, at: np.ndarray) -> None:
            order = np.argsort(pairs, kind="stable")
            pairs, at = pairs[order], at[order]
            cuts = np.flatnonzero(pairs[1:] != pairs[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(pairs)]
            for lo, hi in zip(bounds, bounds[1:]):
                if lo == hi:
                    continue
                pair = int(pairs[lo])
                known = index.get(pair)
                if known is not None:
                    known.append(at[lo:hi])
                elif (rank := self.rank(pair)) >= 0:
                    index[pair] = [at[lo:hi]]
                    heapq.heappush(queue, (rank, pair))

        first = np.flatnonzero(right >= 0)
        add((tok[first] << _SHIFT) | tok[first + 1], first)
        while queue:
            rank, pair = heapq.heappop(queue)
            a, b = pair >> _SHIFT, pair & ((1 << _SHIFT) - 1)
            found = index.pop(pair)
            at = np.unique(np.concatenate(found))
            at = at[tok[at] == a]
            at = at[right[at] >= 0]
            at = at[tok[right[at]] == b]
            if a == b and len(at) > 1:
                # In a run of one token the first two merge, then the next two.
                begins = np.concatenate([[True], right[at[:-1]] != at[1:]])
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0]
            if not len(at):
                continue
            gone = right[at]
            after = right[gone]
            tok[at], tok[gone], right[at] = rank, -1, after
            open_end = after >= 0
            left[after[open_end]] = at[open_end]
            before = left[at]
            has = before >= 0
            add(
                np.concatenate([(tok[before[has]] << _SHIFT) | rank, (rank << _SHIFT) | tok[after[open_end]]]),
                np.concatenate([before[has], at[open_end]]),
            )
        return tok, start


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Every row of ``docs`` with the token ids of its whole text (array<int>; null text: no ids).

    Each match of ``pattern`` is encoded on its own. The distinct new matches of an Arrow batch are
    the corpus of one replay; a task remembers the ids of words it has met. A column named like
    ``ids`` is replaced; repeated rows are encoded alike.
    """
    rows = docs.select(*[c for c in docs.columns if c != ids])
    schema = rows.select("*", F.array().cast("array<int>").alias(ids)).schema
    kind, carried = arrow_schema(schema), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        replay, split = MergeReplay(load_ranks(path)), regex.compile(pattern).findall
        known: dict[str, bytes] = {}
        for b in batches:
            matches = [split(t.as_py() or "") for t in b.column(text)]
            if len(known) > REMEMBERED:
                known = {}
            new = list(set(chain.from_iterable(matches)).difference(known))
            known.update(zip(new, replay.encode([w.encode() for w in new])))
            per = [b"".join(map(known.__getitem__, m)) for m in matches]
            edges = np.concatenate([[0], np.cumsum([len(x) // 4 for x in per])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(per), np.int32))
            columns = [*(b.column(c) for c in carried), pa.ListArray.from_arrays(edges, values)]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, kind)], schema=kind)

    return rows.transform(in_arrow, run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Every row with the bytes that its ids stand for (binary; null ids: empty)."""
    rows = encoded.select(*[c for c in encoded.columns if c != out])
    schema = rows.select("*", F.lit(b"").alias(out)).schema
    kind, carried = arrow_schema(schema), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        table: list[bytes] = [b""] * (max(ranks.values(), default=0) + 1)
        for t, i in ranks.items():
            table[i] = t
        tokens = pa.array(table, pa.large_binary())
        for b in batches:
            lists = b.column(ids)
            # Looked up side by side, the tokens of a row already are its bytes; only the row's
            # edges among them have to be found.
            bytes_of = tokens.take(lists.flatten())
            at = np.frombuffer(bytes_of.buffers()[1], np.int64)[bytes_of.offset :]
            sizes = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
            edges = at[np.concatenate([[0], np.cumsum(sizes)])]
            whole = pa.Array.from_buffers(
                pa.large_binary(), b.num_rows, [None, pa.py_buffer(edges.tobytes()), bytes_of.buffers()[2]]
            )
            columns = [*(b.column(c) for c in carried), whole.cast(kind.field(out).type)]
            yield pa.RecordBatch.from_arrays(columns, schema=kind)

    return rows.transform(in_arrow, run, schema)
