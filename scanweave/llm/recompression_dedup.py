"""Removal of repeated word sequences by recompression.

Runs of equal words are named first; then rounds name pairs: a hash splits the symbols into left and right ones, and
every left symbol followed by a right one becomes a pair. Names are hashes of what they stand for, so that all
executors name alike without a shared dictionary, and equal substrings get equal interior symbols. Each symbol
carries the range of words that its formation depended on; a window may use a symbol if that range lies inside it.
Every 13-word window is anchored at its leftmost symbol of the highest round; shared anchors reveal repeats, and
their windows are verified through 128 bits of hashes over all their words.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import _text as t
from ._frames import table
from ._repeats import CERTAIN, Units, find_repeats, finish

LENGTH = 13
ROUNDS = 4
_ROUND = np.uint64(0xD6E8FEB86659FD93)
_SALTS = np.arange(1, 65, dtype=np.uint64) * _ROUND


class RecompressionSampler:
    def __init__(self, length: int = LENGTH, rounds: int = ROUNDS):
        if not (1 <= length < 256 and 0 <= rounds <= len(_SALTS)):
            raise ValueError("need 1 <= length < 256 and rounds of at most 64")
        self.length, self.rounds, self.leads = length, rounds, 0

    def lead(self, buf: np.ndarray, pos: np.ndarray) -> list[np.ndarray]:
        """Symbols are ordered by their names alone."""
        return []

    def units(self, buf: np.ndarray, offsets: np.ndarray):
        starts, ends, first = t.words(buf, offsets, t.BLANK_WORDS)
        return Units(t.span_hashes(buf, starts, ends), first), (starts, ends)

    def anchors(self, units: Units):
        n, first, length = len(units.values), units.first, self.length
        empty = np.zeros(0, np.int64)
        if n < length:
            return empty, empty, empty, empty
        row = t.row_of(first, n)
        shift = row + 1  # a border stands before each row and after the last
        total = n + len(first)
        name, dead = np.zeros(total, np.uint64), np.ones(total, bool)
        name[np.arange(n) + shift] = units.values
        dead[np.arange(n) + shift] = False
        word = np.flatnonzero(first[1:][row] - np.arange(n) >= length)
        if not len(word):
            return empty, empty, empty, empty
        p = word + shift[word]
        from_, to = p.copy(), p + 1  # the window's first word serves where no symbol does

        def use(lo: np.ndarray, hi: np.ndarray) -> None:
            i = np.minimum(np.searchsorted(lo, p), len(lo) - 1)
            fits = (lo[i] >= p) & (hi[i] <= p + length)
            from_[fits], to[fits] = lo[i][fits], hi[i][fits]

        head = np.ones(total, bool)
        head[1:] = (name[1:] != name[:-1]) | dead[1:] | dead[:-1]
        at = np.flatnonzero(head)
        count = np.diff(np.append(at, total))
        name, dead = name[at], dead[at]
        name = np.where(count > 1, t.mix(name ^ (count.astype(np.uint64) * _ROUND)), name)
        lo, hi = np.maximum(at - 1, 0), np.minimum(at + count + 1, total)  # a run ends where its neighbours differ
        use(lo, hi)
        for k in range(1, self.rounds + 1):
            right = (t.mix(name + _SALTS[k - 1]) >> np.uint64(63)).astype(bool)
            is_left, is_right = ~right & ~dead, right & ~dead
            pair = np.zeros(len(name), bool)
            pair[:-1] = is_left[:-1] & is_right[1:]
            second = np.zeros(len(name), bool)
            second[1:] = pair[:-1]
            new_lo, new_hi = lo.copy(), hi.copy()
            alone = is_right & ~second  # it would have been second after a left symbol
            alone[0] = False
            i = np.flatnonzero(alone)
            new_lo[i] = lo[i - 1]
            i = np.flatnonzero(is_left & ~pair)
            new_hi[i] = hi[np.minimum(i + 1, len(hi) - 1)]
            i = np.flatnonzero(pair)
            new_hi[i] = hi[i + 1]
            name[i] = t.mix(name[i] * _ROUND ^ name[i + 1])
            name, dead, lo, hi = name[~second], dead[~second], new_lo[~second], new_hi[~second]
            use(lo, hi)
        new = np.flatnonzero(np.concatenate([[True], (from_[1:] != from_[:-1]) | (to[1:] != to[:-1]) | (p[1:] != p[:-1] + 1)]))
        s = shift[word[new]]
        return from_[new] - s, (to - from_)[new], word[new], np.diff(np.append(new, len(p)))


def _kept(buf, units, spans, removed):
    starts, ends = spans
    raw = buf.tobytes()
    keep = np.flatnonzero(~removed)
    cut = np.searchsorted(keep, units.first)
    s, e = starts[keep].tolist(), ends[keep].tolist()
    return [b" ".join([raw[s[k] : e[k]] for k in range(i, j)]) for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]


def _report(buf, offsets, units, spans, removed):
    return np.diff(units.first), t.row_sums(removed.astype(np.int64), units.first), [hashlib.sha256(x).hexdigest() for x in _kept(buf, units, spans, removed)]


def _texts(buf, offsets, units, spans, removed):
    return ([x.decode() for x in _kept(buf, units, spans, removed)],)


_REPORT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def repeat_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row per row of docs.

    Null, empty and blank texts have no words. Rows of one doc_id never count as each other's earlier document. A
    null doc_id is less than all others and stays null. An empty table gives no rows.
    """
    sampler = RecompressionSampler(length)
    found = find_repeats(docs, sampler, smaller=True)
    return found.mapInArrow(finish(sampler, (CERTAIN,), _report, _REPORT), _REPORT)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, text): the kept words of each text, joined by one blank."""
    sampler = RecompressionSampler(length)
    found = find_repeats(docs, sampler, smaller=True)
    schema = "doc_id long, text string"
    return found.mapInArrow(finish(sampler, (CERTAIN,), _texts, schema), schema)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repeat_report() of all documents."""
    return repeat_report(table(spark, sf_dir, "documents"))


OP9_SQL = rf"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
windows as (select doc_id, unnest(range(1, len(w) - {LENGTH - 2})) i, unnest(list_transform(range(1, len(w) - {LENGTH - 2}), lambda i: md5_number(array_to_string(w[i:i + {LENGTH - 1}], ' ')))) t from d where len(w) >= {LENGTH}),
firsts as (select t, min(doc_id) least from windows group by t having min(doc_id) < max(doc_id)),
hit as (select distinct doc_id, unnest(range(i, i + {LENGTH})) j from windows join firsts using (t) where doc_id > least),
words as (select doc_id, unnest(range(1, len(w) + 1)) j, unnest(w) x from d),
kept as (select doc_id, string_agg(x, ' ' order by j) k, count(*) n from words anti join hit using (doc_id, j) group by doc_id)
select d.doc_id, len(w)::bigint n_words, (len(w) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(k, '')) kept_sha256 from d left join kept using (doc_id)
"""
