"""Removal of repeated byte strings with a sparse suffix order.

Suffixes are sampled where a rolling hash of the next `GRAM` bytes is the least of its window, so that every
200-byte string holds a sampled suffix at a place its content fixes. Splitters taken from a sample of them
range-partition the suffixes by their leading bytes; a bucket sorts its suffixes by multikey quicksort, eight bytes at a
time, with what follows the leading 32 bytes ordered by 64-bit hashes, and judges each against its neighbours. What
lies at a splitter is compared with the other side's, and what contexts leave open is settled, by equal 200-byte windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ._frames import table
from ._repeats import CERTAIN, PUBLISHED, Units, find_repeats, finish

LENGTH = 200
GRAM = 64
#: Words of eight bytes by which suffixes are ordered before hashes stand in.
LEADS = 4
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)


class ByteSampler:
    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        if not 0 < gram <= length < 256:
            raise ValueError("need 0 < gram <= length < 256")
        self.length, self.gram, self.leads = length, gram, min(gram // 8, LEADS)

    def lead(self, buf: np.ndarray, pos: np.ndarray) -> list[np.ndarray]:
        eights = np.ndarray((len(buf) - 7,), dtype=">u8", buffer=buf, strides=(1,)) if self.leads else None
        return [eights[pos + 8 * k].astype(np.uint64) for k in range(self.leads)]

    def units(self, buf: np.ndarray, offsets: np.ndarray):
        return Units(_TABLE[buf], offsets), None

    def anchors(self, units: Units):
        n, width = len(units.values), self.length - self.gram + 1
        empty = np.zeros(0, np.int64)
        if n < self.length:
            return empty, empty, empty, empty
        at = np.arange(n - self.gram + 1)
        # least hash; of equals the last
        key = (units.hashes(at, at + self.gram) & np.uint64(0xFFFFFFFF00000000)) | (n - at).astype(np.uint64)
        have = 1
        while 2 * have <= width:
            key = np.minimum(key[:-have], key[have:])
            have *= 2
        windows = n - self.length + 1
        key = np.minimum(key[:windows], key[width - have : width - have + windows])
        owner = n - (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        edge = np.zeros(n + 1, np.int64)
        size = np.diff(units.first)
        whole = size >= self.length
        np.add.at(edge, units.first[:-1][whole], 1)
        np.add.at(edge, units.first[1:][whole] - self.length + 1, -1)
        p = np.flatnonzero(np.cumsum(edge)[:windows] > 0)
        if not len(p):
            return empty, empty, empty, empty
        own = owner[p]
        new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (p[1:] != p[:-1] + 1)]))
        return own[new], np.full(len(new), self.gram), p[new], np.diff(np.append(new, len(p)))


def _bytes_left(buf, offsets, units, extra, removed):
    n_bytes = np.diff(offsets)
    gone = np.concatenate([[0], np.cumsum(removed)])
    n_removed = gone[offsets[1:]] - gone[offsets[:-1]]
    begins = removed.copy()
    begins[1:] &= ~removed[:-1]
    edge = offsets[:-1][offsets[:-1] < len(buf)]
    begins[edge] = removed[edge]
    runs = np.concatenate([[0], np.cumsum(begins)])
    kept = buf[~removed].tobytes()
    ends = offsets - gone[offsets]
    digests = [hashlib.sha256(kept[i:j]).hexdigest() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return n_bytes, n_removed, runs[offsets[1:]] - runs[offsets[:-1]], digests


def _texts_left(buf, offsets, units, extra, removed):
    gone = np.concatenate([[0], np.cumsum(removed)])
    kept = buf[~removed].tobytes()
    ends = offsets - gone[offsets]
    return ([kept[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())],)


_REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def repeat_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per row of docs.

    Null and empty texts have no bytes; texts shorter than `length` lose nothing. Repeated rows repeat each other's
    strings, so both lose them. A null doc_id stays null. An empty table gives no rows.
    """
    sampler = ByteSampler(length)
    found = find_repeats(docs, sampler, smaller=False)
    return found.mapInArrow(finish(sampler, (CERTAIN, PUBLISHED), _bytes_left, _REPORT), _REPORT)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, kept): the remaining bytes of each text. They may cut a character, so they stay binary."""
    sampler = ByteSampler(length)
    found = find_repeats(docs, sampler, smaller=False)
    schema = "doc_id long, kept binary"
    return found.mapInArrow(finish(sampler, (CERTAIN, PUBLISHED), _texts_left, schema), schema)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repeat_report() of all documents."""
    return repeat_report(table(spark, sf_dir, "documents"))
