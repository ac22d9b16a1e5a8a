"""Benchmark decontamination with training suffix arrays.

Each shard of training documents (an Arrow batch) gets a sparse suffix array over its words: only suffixes whose
first word and second word follow each other somewhere in the benchmark are kept, since no other suffix can match
a test suffix for more than one word. Every test suffix that begins a window is binary-searched in the array, and the
interval of its window's prefix holds all its locations. Locations that follow each other in the document and in the
item together are one verbatim match; the longest of a document is reported with its place.

The benchmark is handled in blocks of at most `block_bytes` of text: what goes to the executors has that bound,
and a benchmark of any size takes as many passes as it has blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as t
from ._frames import id_and_text, table

WINDOW = 13
BLOCK_BYTES = 16 << 20
#: Windows whose keys are in memory at a time.
SEARCHED = 1 << 15
_END = np.uint32(0xFFFFFFFF)


def _hashed(column) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each row) of a text column."""
    parts, counts = [], [np.zeros(1, np.int64)]
    for _, _, buf, offsets in t.chunks(column):
        low = t.lower(buf)
        starts, ends, first = t.words(low, offsets, t.ALNUM_WORDS)
        parts.append(t.span_hashes(low, starts, ends))
        counts.append(np.diff(first))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.cumsum(np.concatenate(counts))


class TestSuffixes:
    """The benchmark's words as codes. What is sent to the executors is four bytes a word, the vocabulary and the word pairs;
    the windows that are searched for follow from it, and their keys are made in slices."""

    def __init__(self, items: pa.Table, width: int):
        self.width = width
        h, self.first = _hashed(items.column("text"))
        self.vocabulary, _, code, _ = t.distinct(h)
        self.code = code.astype(np.int32)
        self.names = items.column("item_id").to_pylist()
        size = np.diff(self.first)
        pair = np.unique(self.code[:-1].astype(np.uint64) << np.uint64(32) | self.code[1:].astype(np.uint64)) if (size == 1).sum() + (size == 0).sum() < len(size) else np.zeros(0, np.uint64)
        self.pairs = pair  # those across a border between two items only keep a few suffixes more
        self.single = np.unique(self.code[self.first[:-1][size == 1]]).astype(np.int64)

    @cached_property
    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, first word, words) of every window."""
        item = t.row_of(self.first, len(self.code))
        left, size = self.first[1:][item] - np.arange(len(self.code)), np.diff(self.first)[item]
        start = np.flatnonzero((left >= self.width) | ((size < self.width) & (left == size)))
        return item[start].astype(np.int32), start.astype(np.int32), np.minimum(left[start], self.width).astype(np.int32)

    def found_in(self, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place in `suffixes`) of every suffix that begins with a window: binary searches, a slice at a time."""
        _, start, length = self.windows
        windows, places = [], []
        for i in range(0, len(start), SEARCHED):
            lo, hi = (np.searchsorted(suffixes, _prefixes(self.code, start[i : i + SEARCHED], length[i : i + SEARCHED], self.width + 1, fill), "left") for fill in (np.uint32(0), _END))
            count = np.maximum(hi - lo, 0)
            places.append(t.ranges(lo, count))
            windows.append(np.repeat(np.arange(i, i + len(lo)), count))
        return (np.concatenate(windows), np.concatenate(places)) if windows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _prefixes(code: np.ndarray, start: np.ndarray, length: np.ndarray, width: int, fill=np.uint32(0)) -> np.ndarray:
    """Fixed-width byte strings that sort as the first `width` word codes do; past `length` comes `fill`."""
    at = start[:, None] + np.arange(width)
    inside = np.arange(width) < np.minimum(length, width)[:, None]
    m = np.full(at.shape, fill, dtype=np.uint32)
    m[inside] = (code[at[inside]] + 1).astype(np.uint32)
    return np.ascontiguousarray(m.astype(">u4")).view(f"S{4 * width}").ravel()


def _mark(tests: TestSuffixes, column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each row, row-wise hit flags of all words, window and word of each location)."""
    h, first = _hashed(column)
    n = len(h)
    at, known = t.member_index(tests.vocabulary, h)
    code = np.where(known, at, -1)
    row_end = np.repeat(first[1:], np.diff(first))
    left = row_end - np.arange(n)
    here = np.flatnonzero(known)
    two = here[(left[here] >= 2)]
    two = two[known[two + 1]] if len(two) else two
    _, follows = t.member_index(tests.pairs, (code[two].astype(np.uint64) << np.uint64(32)) | code[two + 1].astype(np.uint64))
    keep = two[follows]
    if len(tests.single):
        keep = np.union1d(keep, here[t.member_index(tests.single, code[here])[1]])
    # words that the benchmark lacks end a suffix as a document's end does: code 0
    length = np.minimum(left[keep], tests.width)
    suffix = _prefixes(code, keep, length, tests.width + 1)
    order = np.argsort(suffix, kind="stable")
    window, place = tests.found_in(suffix[order])
    place = keep[order[place]]
    edge = np.bincount(place, minlength=n + 1) - np.bincount(place + tests.windows[2][window], minlength=n + 1)
    # windows end within their row, so the running count is zero at each row's start
    return first, np.cumsum(edge)[:n] > 0, window, place, row_end


def _longest(tests: TestSuffixes, first: np.ndarray, row: np.ndarray, window: np.ndarray, place: np.ndarray) -> list[dict | None]:
    """Each row's longest verbatim match: its words [start, end) and the item; of equals the first."""
    out: list[dict | None] = [None] * (len(first) - 1)
    if not len(place):
        return out
    items, starts, lengths = tests.windows
    order = np.lexsort((place, starts[window] - place, items[window], row))
    row, window, place = row[order], window[order], place[order]
    new = np.ones(len(place), bool)
    # on one diagonal, one word further on in both
    new[1:] = (row[1:] != row[:-1]) | (items[window[1:]] != items[window[:-1]]) | (place[1:] != place[:-1] + 1) | (np.diff(starts[window]) != 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(place)) - 1
    begin, end = place[at] - first[row[at]], place[last] + lengths[window[last]] - first[row[at]]
    for k in np.lexsort((begin, begin - end, row[at])).tolist():
        i = int(row[at[k]])
        if out[i] is None:
            out[i] = {"start": int(begin[k]), "end": int(end[k]), "item": tests.names[items[window[at[k]]]]}
    return out


_MATCH = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("item", pa.string())])
_RUNS = "doc_id long, version long, n_words long, runs array<struct<start:long,end:long>>, items array<string>, longest struct<start:long,end:long,item:string>"


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests: TestSuffixes = shared.value
        for b in batches:
            first, hit, window, place, _ = _mark(tests, b.column("text"))
            rows = b.num_rows
            row = np.searchsorted(first, place, "right") - 1
            pair = np.unique(row * len(tests.names) + tests.windows[0][window]) if len(row) else np.zeros(0, np.int64)
            r, item = np.divmod(pair, max(1, len(tests.names)))
            items: list[list[str]] = [[] for _ in range(rows)]
            for i, k in zip(r.tolist(), item.tolist()):
                if tests.names[k] is not None:
                    items[i].append(tests.names[k])
            edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])) if len(hit) else np.zeros(1, np.int8)
            # runs of hit words, cut at row borders
            cut = first[1:-1]
            start = np.union1d(np.flatnonzero(edge == 1), cut[(cut < len(hit)) & (hit[np.minimum(cut, max(0, len(hit) - 1))] if len(hit) else False)])
            end = np.union1d(np.flatnonzero(edge == -1), cut[(cut > 0) & (hit[np.maximum(cut - 1, 0)] if len(hit) else False)])
            owner = np.searchsorted(first, start, "right") - 1
            runs: list[list[dict]] = [[] for _ in range(rows)]
            for i, s, e in zip(owner.tolist(), start.tolist(), end.tolist()):
                runs[i].append({"start": s - int(first[i]), "end": e - int(first[i])})
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("version"), pa.array(np.diff(first)), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.string())), pa.array(_longest(tests, first, row, window, place), _MATCH)],
                ["doc_id", "version", "n_words", "runs", "items", "longest"],
            )

    return run


def _version(text: Column) -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def blocks(items: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The benchmark in parts of about block_bytes of text at most, by a hash of its items."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    total = items.agg(F.sum(size).alias("n")).first()["n"] or 0
    if total <= block_bytes:
        return [items]
    parts = -(-4 * total // (3 * block_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    return [items.where(part == k) for k in range(parts)]


def match_runs(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, version, n_words, runs, items, longest): the runs of words inside occurring windows, whose windows occur,
    and the longest verbatim match.

    One row per row of docs; runs are maximal word ranges [start, end) that windows of any items cover.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    out = None
    for part in blocks(items, block_bytes):
        tests = TestSuffixes(part.toArrow(), width)
        found = id_and_text(docs).withColumn("version", _version(F.col("text"))).mapInArrow(_scan(spark.sparkContext.broadcast(tests)), _RUNS)
        out = found if out is None else out.unionByName(found)
        last = found
    if out is not last:
        merged = out.groupBy("doc_id", "version").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.max_by("longest", F.struct(F.coalesce(F.col("longest.end") - F.col("longest.start"), F.lit(0)), -F.col("longest.start"))).alias("longest"), F.count("*").alias("copies"))
        out = merged.mapInArrow(_union_runs, f"{_RUNS}, copies long")
        out = out.withColumn("copies", F.explode(F.sequence(F.lit(1), (F.col("copies") / len(blocks(items, block_bytes))).cast("int")))).drop("copies")
    return out


def _union_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        joined = []
        for runs in b.column("runs").to_pylist():
            out: list[dict] = []
            for r in sorted(runs, key=lambda r: r["start"]):
                if out and r["start"] <= out[-1]["end"]:
                    out[-1]["end"] = max(out[-1]["end"], r["end"])
                else:
                    out.append(dict(r))
            joined.append(out)
        yield b.set_column(b.schema.get_field_index("runs"), "runs", pa.array(joined, b.column("runs").type))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, version), one row per row of docs.

    Null and empty texts have no words and are clean. An item of fewer words than `width` is one window; an item
    without words matches nothing. An empty benchmark hits nothing. Equal item ids count once; items without an id hit
    words but are not counted among the items. `longest` is the longest verbatim match of at least a window, as
    (start, end, item) in words, null where there is none; of equals the first. Repeated rows each get their result.
    """
    runs = match_runs(docs, benchmark, width, block_bytes)
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda total, r: total + r["end"] - r["start"])
    named = F.array_sort(F.array_distinct("items"))
    return runs.select("doc_id", "n_words", n_hit.alias("n_hit"), named.alias("items"), "longest", "version").select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "longest",
        "version",
    )


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without contaminated documents; all columns stay, and repeated rows go or stay together. Rows are judged by
    doc_id and text, so rows with a null or a shared doc_id are told apart."""
    bad = contamination(docs, benchmark, **how).where("contaminated").select(F.col("doc_id").alias("__bad_id"), F.col("version").alias("__bad_version")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["__bad_id"]) & (_version(docs["text"]) == bad["__bad_version"]), "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contamination() of all documents by the benchmark."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4_SQL = f"""
with d as (select doc_id, {_WORDS.format(text="text")} w from documents),
b as (select item_id, {_WORDS.format(text="text")} w from benchmark),
windows as (select distinct item_id, least(len(w), {WINDOW}) k, unnest(list_transform(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1), lambda i: array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' '))) t
            from b where len(w) > 0),
sizes as (select distinct k from windows),
placed as (select doc_id, k, unnest(range(1, len(w) - k + 2)) i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) t
           from d, sizes where len(w) >= k),
hits as (select doc_id, item_id, i, k from placed join windows using (k, t)),
covered as (select doc_id, count(distinct j) n_hit from (select doc_id, unnest(range(i, i + k)) j from hits) group by doc_id),
named as (select doc_id, count(distinct item_id) n_items, sha256(string_agg(item_id, ',' order by item_id)) s
          from (select distinct doc_id, item_id::varchar item_id from hits) group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, coalesce(s, sha256('')) items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join covered using (doc_id) left join named using (doc_id)
"""
