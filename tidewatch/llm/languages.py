"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import arrow_schema, in_arrow, with_row_id

#: Length of the hypervectors; letters of an n-gram, 3 at most.
DIMENSIONS, GRAM = 512, 3
#: What is returned for a text without a letter.
UNKNOWN = "und"
#: Bound n-grams that a task remembers.
REMEMBERED = 20_000
_AT_ONCE = 4096


class Letters:
    """Random vectors of -1 and 1 for letters, and the n-grams bound from them.

    The vector of a code point is drawn from a generator seeded with it, so every task has the same
    one. A letter at place k of an n-gram is rotated by the places after it, and the n-gram's vector
    is the product of its rotated letters. Bound n-grams are remembered, up to a fixed number.
    """

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM):
        self.dimensions, self.gram = dimensions, gram
        self.is_letter = np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)])
        self.drawn: dict[int, np.ndarray] = {}
        self.row_of: dict[int, int] = {}
        self.bound = np.zeros((REMEMBERED, dimensions), np.float32)

    def vector(self, letter: int) -> np.ndarray:
        found = self.drawn.get(letter)
        if found is None:
            chance = np.random.default_rng(1_000_003 + letter)
            found = self.drawn[letter] = (2 * chance.integers(0, 2, self.dimensions) - 1).astype(np.float32)
        return found

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams of a text, 21 bits a letter, and their counts.

        Lower-cased letters; each run of other characters is one space, at both ends too.
        """
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.is_letter[points]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        kept = np.where(letter, points, 32)[keep].astype(np.int64)
        if not len(kept):
            return kept, kept
        whole = np.concatenate([[32], kept, [] if kept[-1] == 32 else [32]]).astype(np.int64)
        size = len(whole) - self.gram + 1
        codes = whole[:size]
        for k in range(1, self.gram):
            codes = (codes << 21) | whole[k : k + size]
        return np.unique(codes, return_counts=True)

    def _row(self, code: int) -> int:
        row = self.row_of.get(code)
        if row is None:
            row = self.row_of[code] = len(self.row_of)
            vector = np.ones(self.dimensions, np.float32)
            for k in range(self.gram):
                vector = vector * np.roll(self.vector((code >> (21 * k)) & ((1 << 21) - 1)), k)
            self.bound[row] = vector
        return row

    def bundle(self, text: str) -> np.ndarray:
        """The sum of a text's n-gram vectors; zero if it has no letter."""
        codes, counts = self.grams(text)
        total = np.zeros(self.dimensions, np.float32)
        for at in range(0, len(codes), _AT_ONCE):
            part = codes[at : at + _AT_ONCE].tolist()
            if len(self.row_of) + len(part) > REMEMBERED:
                self.row_of = {}
            rows = [self._row(c) for c in part]
            total += counts[at : at + _AT_ONCE].astype(np.float32) @ self.bound[rows]
        return total


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v)
    return v / size if size else v


def prototypes(
    labelled: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, gram: int = GRAM
) -> dict[str, np.ndarray]:
    """One vector per language: the sum of its texts' vectors, each scaled to length one.

    Every labelled row counts; rows of null text or label, or without a letter, add nothing. Tasks
    add up their own rows first, and sums meet per language and dimension. The result has one vector
    for each value of ``lang``, a closed set of languages, and is all that reaches the driver.
    """
    schema = "lang string, sums array<double>"
    kind = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = Letters(dimensions, gram), {}
        for b in batches:
            for name, body in zip(b.column("_lang").to_pylist(), b.column("_text")):
                sums.setdefault(name, np.zeros(dimensions))
                sums[name] += _unit(letters.bundle(body.as_py()))
        columns = [pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], kind.field("sums").type)]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kind)], schema=kind)

    rows = labelled.select(F.col(lang).alias("_lang"), F.col(text).alias("_text")).dropna()
    parts = rows.transform(in_arrow, run, schema).select("lang", F.posexplode("sums").alias("place", "value"))
    whole = parts.groupBy("lang", "place").agg(F.sum("value").alias("value"))
    per = whole.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("v"))
    return {r["lang"]: np.array([x["value"] for x in r["v"]]) for r in per.collect()}


def identify(
    docs: DataFrame,
    languages: dict[str, np.ndarray],
    text: str = "text",
    dimensions: int = DIMENSIONS,
    gram: int = GRAM,
) -> DataFrame:
    """Every row of ``docs`` with _rid, lang_pred and score; nothing but the text is looked at.

    The language whose prototype has the largest cosine with the whole text's vector, the first by
    name if several have; score is that cosine, 0 if negative. A text that is null or has no letter,
    or any text when no language is known, gets ``und`` and 0. Columns of these names are replaced.
    """
    names = sorted(n for n, v in languages.items() if v.any())
    table = np.stack([_unit(languages[n]) for n in names]) if names else np.zeros((0, dimensions))
    schema = "_rid long, doc_id long, lang_pred string, score double"
    kind = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters(dimensions, gram)
        for b in batches:
            best, score = [], []
            for body in b.column("_text"):
                vector = _unit(letters.bundle(body.as_py() or ""))
                if not len(names) or not vector.any():
                    best.append(UNKNOWN)
                    score.append(0.0)
                    continue
                near = table @ vector
                k = int(np.argmax(near))
                best.append(names[k])
                score.append(float(min(max(near[k], 0.0), 1.0)))
            columns = [b.column("_rid"), b.column("doc_id"), pa.array(best, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kind)], schema=kind)

    rows = with_row_id(docs.select(F.col("doc_id").cast("long"), F.col(text).alias("_text")))
    return rows.select("_rid", "doc_id", "_text").transform(in_arrow, run, schema)
