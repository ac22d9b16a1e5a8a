"""Exact repeats of fixed-length windows, found by way of content-defined anchors.

Windows are L consecutive units (bytes or words) of one document. A sampler names, for each window, one anchor: a
range of units inside it, chosen by the window's content alone. So equal windows have equal anchors at equal
places, and only places whose anchor occurs more than once can be repeats. Three exchanges follow:

1. Every anchor goes, with a hash of its context (all units that windows around it can span), to the bucket of its
   place in one order of all anchors: by the sampler's leading words, name, context, and a tie-breaker. The borders of
   the buckets are quantiles of a sample, so that a name or a context of very many anchors spreads over several
   buckets. A bucket sorts its anchors and judges each: alone; certain (its whole context occurs elsewhere as the
   rule asks); or uncertain, when the name occurs elsewhere in other contexts. A name at a border may go on in the next
   bucket: its anchors that are not certain already are uncertain, and exchange 2 compares them across the border.
2. Documents with uncertain anchors send the hashes of those anchors' windows, and one sender of each certain context
   that such anchors may meet sends its own. Equal hashes are the remaining repeats.
3. What is certain and what exchange 2 found goes back to the documents.

Senders settle among themselves what they can: of equal contexts or windows that one task holds, one goes on. Contexts
and windows are compared by 96 and 128 bits: two polynomial hashes over different bases. No group's pairs are formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _blobs
from . import _text as t
from ._frames import NO_ID, id_and_text, written

CERTAIN, UNCERTAIN, PUBLISHED = 1, 2, 3
#: Bytes of entries that a Python worker gathers before it sends them.
SEND_BYTES = 12 << 20
#: Bytes of text for which one bucket is made: a worker sorts a bucket's anchors with all that belongs to them, which takes
#: some 12 times the bytes of their texts.
BUCKET_TEXT = 4 << 20
#: Most borders that the driver finds; beyond, a range is parted by a hash of the names.
MOST_RANGES = 1 << 14
#: Bytes of text that are sampled for each border, and of how many anchors there one is taken.
SAMPLE_BYTES, THIN = 32 << 10, 16
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BASE = np.uint64(_BASES[0])
_SECOND = np.uint64(0x27D4EB2F165667C5)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        p = np.full(1 << max(0, n - 1).bit_length(), base, dtype=np.uint64)
        p[0] = 1
        _POWERS[base] = np.multiply.accumulate(p)
    return _POWERS[base]


def _sums(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * _powers(base, len(values) + 1)[: len(values)], out=sums[1:])
    return sums, _powers(pow(base, -1, 1 << 64), len(values) + 1)


@dataclass
class Units:
    """A chunk's units as 64-bit values; any range's hash is two lookups."""

    values: np.ndarray
    first: np.ndarray  # units of row i are first[i]:first[i+1]

    @cached_property
    def _one(self) -> tuple[np.ndarray, np.ndarray]:
        return _sums(self.values, _BASES[0])

    @cached_property
    def _two(self) -> tuple[np.ndarray, np.ndarray]:
        return _sums(t.mix(self.values ^ _SECOND), _BASES[1])

    def hashes(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        sums, down = self._one
        return t.mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))

    def seconds(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hashes of the same ranges over another base."""
        sums, down = self._two
        return t.mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))


class Sampler(Protocol):
    """length: units in a window; leads: leading words of an anchor by which anchors are ordered first."""

    length: int
    leads: int

    def units(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[Units, object]: ...

    def anchors(self, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first unit, units in it, first window, windows) of each anchor, in order of windows."""
        ...

    def lead(self, buf: np.ndarray, pos: np.ndarray) -> list[np.ndarray]:
        """`leads` words whose order as numbers is that of the anchors' first units."""
        ...


def _ids(column) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _code(pos: np.ndarray, size: np.ndarray, before: np.ndarray, count: np.ndarray, flag) -> np.ndarray:
    """An anchor in one number: place, units, windows before its place, windows, judgement."""
    return (((pos.astype(np.int64) << 8 | size) << 8 | before) << 8 | count) << 2 | flag


def _decode(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return code >> 26, code >> 18 & 255, code >> 10 & 255, code >> 2 & 255, code & 3


def _hash_bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def _versions(buf: np.ndarray, offsets: np.ndarray, twins: bool) -> np.ndarray:
    return t.span_hashes(buf, offsets[:-1], offsets[1:], seed=1).view(np.int64) if twins else np.zeros(len(offsets) - 1, np.int64)


def _tie(doc: np.ndarray, version: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Parts equal contexts of different places; copies of a row in full stay together."""
    return t.mix(doc.view(np.uint64) * _BASE ^ version.view(np.uint64) + pos.astype(np.uint64))


def _as_bytes(*words: np.ndarray) -> np.ndarray:
    """Byte strings that sort as the rows of words do."""
    return np.ascontiguousarray(np.stack(words, 1).astype(">u8")).view(f"S{8 * len(words)}").ravel()


@dataclass
class Ranges:
    """Borders of the buckets in the order of all anchors; at most MOST_RANGES, so it may be broadcast."""

    borders: np.ndarray  # byte strings of lead words, name, context, tie
    names: np.ndarray  # names at borders, ascending
    parts: int  # buckets of a range

    @property
    def buckets(self) -> int:
        return (len(self.borders) + 1) * self.parts

    def of(self, keys: np.ndarray, name: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.borders, keys, "right") * self.parts + _hash_bucket(name, self.parts)


def _new(*keys: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def _anchor_parts(sampler: Sampler, batches: Iterator[pa.RecordBatch], twins: bool) -> Iterator[tuple]:
    """(lead words..., name, two context hashes, doc, version, code, twice) of each chunk's anchors."""
    for b in batches:
        ids = _ids(b.column("doc_id"))
        for i, j, buf, offsets in t.chunks(b.column("text")):
            units, _ = sampler.units(buf, offsets)
            pos, size, plo, count = sampler.anchors(units)
            if not len(pos):
                continue
            row = np.searchsorted(units.first, pos, "right") - 1
            start, end = units.first[row], units.first[row + 1]
            lo, hi = np.maximum(start, pos + size - sampler.length), np.minimum(end, pos + sampler.length)
            place = ((pos - lo) * 1024 + (hi - pos)).astype(np.uint64) * _BASE
            c1, c2 = t.mix(units.hashes(lo, hi) + place), t.mix(units.seconds(lo, hi) + place)
            code = _code(pos - start, size, pos - plo, count, 0)
            yield (*sampler.lead(buf, pos), units.hashes(pos, pos + size), c1, (c2 >> np.uint64(32)).astype(np.uint32), ids[i:j][row], _versions(buf, offsets, twins)[row], code, np.zeros(len(pos), np.uint8))


def _gathered(parts: Iterator[tuple], limit: int) -> Iterator[list[np.ndarray]]:
    """Parts put together up to `limit` bytes, over all of a task's batches."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += sum(a.nbytes for a in part)
        if size >= limit:
            whole = [np.concatenate(x) for x in zip(*held)]
            held, size = [], 0
            yield whole
            del whole
            _blobs.release()
    if held:
        yield [np.concatenate(x) for x in zip(*held)]
    _blobs.release()


def _replies(doc: np.ndarray, version: np.ndarray, code: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Judgements that need no bucket travel through any; three arrays tell them from entries."""
    if len(doc):
        yield _blobs.batch([int(t.mix(doc[:1].view(np.uint64))[0] % np.uint64(n_buckets))], [_blobs.pack(doc, version, code)])


def _keys_sample(sampler: Sampler, twins: bool):
    """Packed keys of some anchors, a row for each SEND_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *lead, name, c1, _, doc, version, code, _ in _gathered(_anchor_parts(sampler, batches, twins), SEND_BYTES):
            tie = _tie(doc, version, code >> 26)
            some = np.flatnonzero(tie % np.uint64(THIN) == 0)
            yield _blobs.batch([0], [np.stack([x[some] for x in (*lead, name, c1, tie)], 1).astype(">u8").tobytes()])

    return run


def _ranges(rows: DataFrame, sampler: Sampler, twins: bool) -> Ranges:
    """Borders from a sample of documents: some SAMPLE_BYTES of text for each of at most MOST_RANGES, whatever the input."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = _blobs.buckets(rows, total, BUCKET_TEXT)
    count = min(n, MOST_RANGES)
    every = max(1, total // (count * SAMPLE_BYTES))
    some = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0) if every > 1 else rows
    found = b"".join(r["payload"] for r in some.mapInArrow(_keys_sample(sampler, twins), _blobs.SCHEMA).collect())
    keys = np.sort(np.frombuffer(found, f"S{8 * (sampler.leads + 3)}"))
    borders = keys[np.arange(1, count) * len(keys) // count] if len(keys) else keys
    words = np.frombuffer(borders.tobytes(), ">u8").reshape(len(borders), sampler.leads + 3)
    return Ranges(borders, np.unique(words[:, sampler.leads].astype(np.uint64)), -(-n // (len(borders) + 1)))


def _send_anchors(sampler: Sampler, shared, twins: bool, smaller: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: Ranges = shared.value
        for whole in _gathered(_anchor_parts(sampler, batches, twins), SEND_BYTES):
            *_, c1, c2, doc, version, code, twice = whole
            order = np.lexsort((doc, c2, c1)) if smaller else np.lexsort((c2, c1))
            new = _new(c1[order], c2[order])
            if smaller:
                # a smaller document of this task has the same context
                settled = doc[order] > doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
            else:
                settled = ~new
                twice[order] = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1
            at = order[settled]
            yield from _replies(doc[at], version[at], code[at] | CERTAIN, ranges.buckets)
            at = order[~settled]
            at = at[t.sort_order(whole[0][at])[0]]
            whole = [x[at] for x in whole]
            *lead, name, c1, _, doc, version, code, _ = whole
            bucket = ranges.of(_as_bytes(*lead, name, c1, _tie(doc, version, code >> 26)), name)
            yield _blobs.split(bucket, ranges.buckets, *whole)

    return run


def _gather(payloads, replies: int) -> tuple[list[np.ndarray] | None, list[list[np.ndarray]]]:
    """(columns of all entries or None, judgements that only pass through)."""
    blobs = [_blobs.unpack(p) for p in payloads.to_pylist()]
    entries = [b for b in blobs if len(b) != replies]
    return ([np.concatenate(x) for x in zip(*entries)] if entries else None), [b for b in blobs if len(b) == replies]


_REPLY = "doc_id long, version long, code long"


def _reply(doc: np.ndarray, version: np.ndarray, code: np.ndarray, passing: list[list[np.ndarray]]) -> pa.Table:
    columns = [np.concatenate([x, *more]) for x, *more in zip((doc, version, code), *passing)]
    return pa.table(dict(zip(("doc_id", "version", "code"), map(pa.array, columns))))


_NO_LONGS = np.zeros(0, np.int64)


def _judge(shared, smaller: bool):
    def run(table: pa.Table) -> pa.Table:
        whole, passing = _gather(table.column("payload"), 3)
        if whole is None:
            return _reply(_NO_LONGS, _NO_LONGS, _NO_LONGS, passing)
        *lead, name, c1, c2, doc, version, code, twice = whole
        keys = [*lead, name, c1, c2.astype(np.uint64)] + ([doc.view(np.uint64) ^ np.uint64(1 << 63)] if smaller else [])
        order = t.multikey_order(keys)
        del keys, lead, whole
        name, c1, c2, doc, version, code, twice = (x[order] for x in (name, c1, c2, doc, version, code, twice))
        new_name, new_context = _new(name), _new(name, c1, c2)
        g, c = np.cumsum(new_name) - 1, np.cumsum(new_context) - 1
        border = t.member_index(shared.value.names, name)[1]
        if smaller:
            at_name, at_context = np.flatnonzero(new_name), np.flatnonzero(new_context)
            least, most = np.minimum.reduceat(doc, at_name)[g], np.maximum.reduceat(doc, at_name)[g]
            first = doc[at_context][c]  # sorted by doc within a context
            others = np.bincount(g[at_context])[g] > 1
            flag = np.where(doc > first, CERTAIN, np.where((doc == least) & ~border, PUBLISHED, UNCERTAIN))
            keep = np.flatnonzero(border | (least < most) & ((flag == CERTAIN) | others))
        else:
            both = np.bincount(c, weights=1 + twice.astype(np.float64))[c] > 1
            many = border | both | (np.bincount(g)[g] > 1)
            met = border | (np.bincount(g, weights=many & ~both)[g] > 0)
            flag = np.where(both, np.where(new_context & met, PUBLISHED, CERTAIN), UNCERTAIN)
            keep = np.flatnonzero(many)
        _blobs.release()
        return _reply(doc[keep], version[keep], code[keep] | flag[keep], passing)

    return run


def _window_parts(sampler: Sampler, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(two hashes, doc, version, place, twice) of the windows of uncertain and published anchors."""
    for b in batches:
        ids, versions = _ids(b.column("doc_id")), b.column("version").to_numpy()
        codes = b.column("codes")
        flat, ends = codes.flatten().to_numpy(), np.cumsum([0] + [len(x) for x in codes])
        for i, j, buf, offsets in t.chunks(b.column("text")):
            units, _ = sampler.units(buf, offsets)
            row = np.repeat(np.arange(j - i), np.diff(ends[i : j + 1]))
            pos, _, before, count, flag = _decode(flat[ends[i] : ends[j]])
            send = flag != CERTAIN
            row, plo, count = row[send], (pos - before)[send], count[send]
            p = t.ranges(plo, count)
            row = np.repeat(row, count)
            at = units.first[row] + p
            yield units.hashes(at, at + sampler.length), units.seconds(at, at + sampler.length), ids[i:j][row], versions[i:j][row], p.astype(np.uint32), np.zeros(len(p), np.uint8)


def _send_windows(sampler: Sampler, n_buckets: int, smaller: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _gathered(_window_parts(sampler, batches), SEND_BYTES):
            h1, h2, doc, version, p, twice = whole
            if not len(h1):
                continue
            order = np.lexsort((doc, h2, h1)) if smaller else np.lexsort((h2, h1))
            new = _new(h1[order], h2[order])
            g = np.cumsum(new) - 1
            if smaller:
                settled = doc[order] > doc[order][np.flatnonzero(new)][g]
                at = order[settled]
            else:
                settled = ~new
                both = np.bincount(g)[g] > 1
                twice[order] = both
                at = order[both]  # the one that goes on is a repeat as well
            yield from _replies(doc[at], version[at], -1 - p[at].astype(np.int64), n_buckets)
            at = order[~settled]  # ascending by hash
            yield _blobs.split(_hash_bucket(h1[at], n_buckets), n_buckets, *(x[at] for x in whole))

    return run


def _match(smaller: bool):
    def run(table: pa.Table) -> pa.Table:
        whole, passing = _gather(table.column("payload"), 3)
        if whole is None:
            return _reply(_NO_LONGS, _NO_LONGS, _NO_LONGS, passing)
        order = t.multikey_order(whole[:2])
        h1, h2, doc, version, p, twice = (x[order] for x in whole)
        new = _new(h1, h2)
        g = np.cumsum(new) - 1
        keep = np.flatnonzero(doc > np.minimum.reduceat(doc, np.flatnonzero(new))[g] if smaller else np.bincount(g)[g] > 1)
        return _reply(doc[keep], version[keep], -1 - p[keep].astype(np.int64), passing)

    return run


def covered(sampler: Sampler, codes: np.ndarray, row: np.ndarray, first: np.ndarray, whole_flags: tuple[int, ...]) -> np.ndarray:
    """Which units of a chunk the repeats among `codes` (of rows `row`) cover. Negative codes are single windows."""
    single = codes < 0
    p = -1 - codes[single]
    lo1 = first[row[single]] + p
    hi1 = lo1 + sampler.length
    pos, size, _, _, flag = _decode(codes[~single])
    sure = np.isin(flag, whole_flags)
    r = row[~single][sure]
    at = first[r] + pos[sure]
    lo2, hi2 = np.maximum(first[r], at + size[sure] - sampler.length), np.minimum(first[r + 1], at + sampler.length)
    n = int(first[-1])
    edge = np.bincount(np.concatenate([lo1, lo2]), minlength=n + 1) - np.bincount(np.concatenate([hi1, hi2]), minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def find_repeats(docs: DataFrame, sampler: Sampler, smaller: bool) -> DataFrame:
    """(doc_id, text, codes) with every repeat's code, one row per row of docs.

    smaller: a window counts only against documents of smaller doc_id; else against any other place.
    A null doc_id is less than all others. Rows sharing a doc_id are told apart by their text. A worker holds
    SEND_BYTES of entries and the arrays of one chunk, which is at least one whole text.
    """
    rows = id_and_text(docs)
    context = docs.sparkSession.sparkContext
    twins = bool(rows.groupBy("doc_id").count().where("count > 1").limit(1).count())
    ranges = _ranges(rows, sampler, twins)
    shared, n = context.broadcast(ranges), ranges.buckets
    sent = rows.mapInArrow(_send_anchors(sampler, shared, twins, smaller), _blobs.SCHEMA)
    judged = written(sent.groupBy("bucket").applyInArrow(_judge(shared, smaller), _REPLY), "anchors")
    keyed = rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    if twins:
        keyed = keyed.mapInArrow(_with_version, "doc_id long, text string, version long")
    keys = ["doc_id", "version"] if twins else ["doc_id"]
    # the same exchange of the texts serves both joins
    texts = keyed.repartition(*keys)
    unsure = judged.groupBy(*keys).agg(F.collect_list("code").alias("codes"), F.max(F.col("code").bitwiseAND(3)).alias("most")).where("most > 1").drop("most")
    sending = texts.dropDuplicates(keys) if twins and not smaller else texts
    windows = sending.join(unsure.hint("merge"), keys).select("doc_id", F.col("version") if twins else F.lit(0).cast("long").alias("version"), "text", "codes").mapInArrow(_send_windows(sampler, n, smaller), _blobs.SCHEMA)
    matched = windows.groupBy("bucket").applyInArrow(_match(smaller), _REPLY)
    codes = judged.unionByName(matched).groupBy(*keys).agg(F.collect_list("code").alias("codes"))
    return texts.join(codes.hint("merge"), keys, "left").select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", "codes")


def _with_version(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf, offsets = t.utf8(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_versions(buf, offsets, True))], ["doc_id", "text", "version"])


def finish(sampler: Sampler, whole_flags: tuple[int, ...], result, schema: str):
    """A mapInArrow kernel: result(buf, offsets, units, extra, removed) makes the columns after doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, codes = [], b.column("codes").fill_null([])
            flat, ends = codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum([0] + [len(x) for x in codes])
            for i, j, buf, offsets in t.chunks(b.column("text")):
                units, extra = sampler.units(buf, offsets)
                row = np.repeat(np.arange(j - i), np.diff(ends[i : j + 1]))
                removed = covered(sampler, flat[ends[i] : ends[j]], row, units.first, whole_flags)
                parts.append(result(buf, offsets, units, extra, removed))
            if parts:
                columns = [pa.array(np.concatenate(x)) if isinstance(x[0], np.ndarray) else pa.array([y for part in x for y in part]) for x in zip(*parts)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], [x.split()[0] for x in schema.split(", ")])

    return run
