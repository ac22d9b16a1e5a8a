"""Document fingerprints by locally consistent parsing.

Deterministic coin tossing labels each symbol by the lowest bit in which it differs from its left neighbour; a few
rounds leave labels below six, no two neighbours alike, and phrases begin at local minima. A phrase is named by a
hash of its symbols, and the phrases are the symbols of the next level. Where a phrase begins depends on a few
neighbours only, so equal substrings share all interior names at any offset. A fingerprint is the bottom-k sketch of
the names at levels two and three.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as t
from ._blobs import buckets
from ._frames import NO_ID, id_and_text, table
from ._repeats import Units

SKETCH = 64
LEVELS = (2, 3)
_BYTES = t.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_RUN = np.uint64(0xA0761D6478BD642F)


def _labels(x: np.ndarray, head: np.ndarray, rounds: int) -> np.ndarray:
    """Coin tossing; head marks each row's first symbol, which differs from nothing and takes its lowest bit."""
    for _ in range(rounds):
        d = np.empty_like(x)
        d[0] = 1
        d[1:] = x[1:] ^ x[:-1]
        d[head] = 1
        low = np.bitwise_count((d & (~d + x.dtype.type(1))) - x.dtype.type(1))
        x = (2 * low + ((x >> low.astype(x.dtype)) & x.dtype.type(1)).astype(np.uint8)).astype(np.uint8)
    return x


def _level(x: np.ndarray, names: np.ndarray, first: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(names, first) of the phrases over symbols x, whose hashes are `names`."""
    n = len(x)
    border = np.zeros(n, bool)
    border[first[:-1][first[:-1] < n]] = True
    new = border.copy()
    new[1:] |= x[1:] != x[:-1]
    new[0] = True
    at = np.flatnonzero(new)  # runs of equal symbols are one symbol
    count = np.diff(np.append(at, n))
    x, names, border = x[at], names[at], border[at]
    long = count > 1
    names[long] = t.mix(names[long] ^ (count[long].astype(np.uint64) * _RUN))
    first = np.searchsorted(at, first)
    lab = _labels(x, np.flatnonzero(border), rounds)
    begins = border.copy()
    begins[1:-1] |= (lab[1:-1] < lab[:-2]) & (lab[1:-1] < lab[2:])
    after = np.flatnonzero(border[1:])  # a row's last symbol begins no phrase
    begins[after] = border[after]
    start = np.flatnonzero(begins)
    units = Units(names, first)
    return units.hashes(start, np.append(start[1:], len(x))), np.searchsorted(start, first)


def phrases(buf: np.ndarray, offsets: np.ndarray, levels: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """(names, first) of every level, 1 to `levels`."""
    if not len(buf):
        none = (np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
        return [none] * levels
    out = [_level(buf, _BYTES[buf], offsets, 3)]
    for _ in range(levels - 1):
        names, first = out[-1]
        out.append(_level(names, names.copy(), first, 4))
    return out


def sketches(buf: np.ndarray, offsets: np.ndarray, k: int = SKETCH) -> list[np.ndarray]:
    """The k least distinct 32-bit names of each row, ascending."""
    rows = len(offsets) - 1
    levels = phrases(buf, offsets, max(LEVELS))
    value = np.concatenate([levels[n - 1][0] for n in LEVELS]) >> np.uint64(32)
    row = np.concatenate([t.row_of(levels[n - 1][1], len(levels[n - 1][0])) for n in LEVELS])
    count = np.bincount(row, minlength=rows)
    # most names of a long text are too large to count: look at those below a bound first
    bound = np.where(count > 4 * k, (4.0 * k / np.maximum(count, 1)) * 2.0**32, 2.0**32)
    low = value < bound[row]

    def take(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.unique(row[chosen].astype(np.uint64) << np.uint64(32) | value[chosen])
        r = (key >> np.uint64(32)).astype(np.int64)
        first = np.searchsorted(r, np.arange(rows + 1))
        return (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), first

    values, first = take(low)
    out = [values[i : min(j, i + k)] for i, j in zip(first[:-1].tolist(), first[1:].tolist())]
    short = np.flatnonzero((np.diff(first) < k) & (bound < 2.0**32))
    if len(short):
        values, first = take(np.isin(row, short))
        for i in short.tolist():
            out[i] = values[first[i] : min(first[i + 1], first[i] + k)]
    return out


def likeness(a: np.ndarray, b: np.ndarray, k: int = SKETCH) -> float:
    """The estimated share of common names; two empty fingerprints are alike."""
    both = np.union1d(a, b)[:k]
    if not len(both):
        return 1.0
    return float(np.isin(both, a, assume_unique=True).astype(int) @ np.isin(both, b, assume_unique=True).astype(int)) / len(both)


def text_of(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint), one row per row of docs; null and empty texts have the empty fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [text_of(s) for _, _, buf, offsets in t.chunks(b.column("text")) for s in sketches(buf, offsets)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fingerprint string")


_COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _sketch_all(texts: list[str]) -> list[np.ndarray]:
    return [s for _, _, buf, offsets in t.chunks(pa.array(texts, pa.large_string())) for s in sketches(buf, offsets)]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order, part after part; each is compared with the one that follows it."""
    held: list[tuple] = []
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            part = b.slice(at, 1024)
            rows = held + list(zip(part.column("part").to_pylist(), part.column("lent").to_pylist(), part.column("doc_id").to_pylist(), (x or "" for x in part.column("text").to_pylist())))
            held = rows[-1:]
            pairs = [(x, y) for x, y in zip(rows, rows[1:]) if x[0] == y[0] and not x[1]]
            if not pairs:
                continue
            edited = []
            for x, y in pairs:
                n = len(x[3])
                cut = n // 3
                edited.append(x[3][: n - cut] + y[3][:cut])
            own, changed, following = _sketch_all([x[3] for x, _ in pairs]), _sketch_all(edited), None
            following = own[1:] + _sketch_all([pairs[-1][1][3]])
            for k in range(len(pairs) - 1):
                if pairs[k][1] is not pairs[k + 1][0]:
                    following[k] = _sketch_all([pairs[k][1][3]])[0]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None if x[2] == NO_ID else x[2] for x, _ in pairs], pa.int64()),
                    pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                    pa.array([text_of(s) for s in own]),
                    pa.array([text_of(s) for s in changed]),
                    pa.array([likeness(a, c) for a, c in zip(own, changed)]),
                    pa.array([likeness(a, c) for a, c in zip(own, following)]),
                ],
                [x.split()[0] for x in _COMPARED.split(", ")],
            )


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per row.

    The next document is the one that follows in descending doc_id (null ids are least, equal ids follow each other
    by text); the last is followed by the first, a lone document by itself. Null texts are empty. An empty table
    gives no rows.

    Documents are dealt to ranges of doc_id whose borders are quantiles; the first document of each range is lent to
    the range before it, so that each text is shuffled once. At most 4096 borders are held on the driver.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    parts = min(4096, buckets(rows))
    borders = sorted({int(b) for b in rows.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.25 / parts)}) if parts > 1 else []
    # two short searches: first among every 64th border, then among the 64 that follow it
    groups = [borders[i : i + 64] for i in range(0, len(borders), 64)]
    below = lambda found: F.size(F.filter(found, lambda b: b <= F.col("doc_id")))
    group = below(F.array(*(F.lit(g[0]) for g in groups)).cast("array<bigint>"))
    inside = F.element_at(F.array(*(F.array(*map(F.lit, g)).cast("array<bigint>") for g in groups)), group) if groups else None
    part = F.when(group > 0, (group - 1) * 64 + below(inside)).otherwise(0) if groups else F.lit(0)
    tops = sorted((r["part"], r["top"]) for r in rows.select(part.alias("part"), "doc_id").groupBy("part").agg(F.max("doc_id").alias("top")).collect())  # at most 4096
    if not tops:
        return spark.createDataFrame([], _COMPARED)
    lend = {top: tops[(k + 1) % len(tops)][0] for k, (_, top) in enumerate(tops)}
    pairs = [F.lit(x) for top, to in lend.items() for x in (top, to)]
    target = F.element_at(F.create_map(*pairs), F.col("doc_id"))
    own = F.struct(part.alias("part"), F.lit(False).alias("lent"))
    loan = F.struct(target.alias("part"), F.lit(True).alias("lent"))
    dealt = rows.withColumn("to", F.explode(F.when(target.isNull(), F.array(own)).otherwise(F.array(own, loan)))).select(F.col("to.part").alias("part"), F.col("to.lent").alias("lent"), "doc_id", "text")
    ordered = dealt.repartition(len(tops), "part").sortWithinPartitions(F.asc("part"), F.asc("lent"), F.desc("doc_id"), F.asc_nulls_first("text"))
    return ordered.mapInArrow(_compare, _COMPARED)


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """compare_with_edits() of all documents."""
    return compare_with_edits(table(spark, sf_dir, "documents"))
