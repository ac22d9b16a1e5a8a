"""Katz back-off language model: Good-Turing discounted bigrams over all words of the training documents.

    P(b | a) = d(c(a,b)) c(a,b) / c(a)      if c(a,b) > 0
             = alpha(a) P(b)                 else,
    alpha(a) = (1 - sum over seen b of d c / c(a)) / (1 - sum over seen b of P(b)),
    P(b)     = (c(b) + 0.5) / (N + 0.5 (V + 1)),  all unseen words sharing the one slot beyond the V seen ones,

where c(a) is one larger for contexts that no count discounts, so that something is left for what is unseen. Both
levels sum to one. No word is left out of the vocabulary: the commonest travel as ranks, all others as hashes.

Bigram counts live in a table partitioned by context (very common contexts are split by the whole pair, so that none
fills a bucket). The counts of rarer words meet the buckets that ask for them in a shuffle join, and travel to them
with the bigrams; what is broadcast is bounded by `hot_limit` words and by 1 / WIDE_CONTEXT contexts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _blobs
from . import _text as t
from ._frames import id_and_text, table, written
from .token_counts import common

#: Words whose counts are broadcast; what is computed does not depend on it.
HOT_LIMIT = 1 << 18
#: Contexts with at least this share of the bigrams are split over all buckets.
WIDE_CONTEXT = 1e-4
KATZ_LIMIT = 5
#: Text that one packed send covers; bounds a Python worker's memory.
SEND_BYTES = 8 << 20
#: Buckets where other exchanges have one: a bucket's model and all that is asked of it are in one worker.
SPLIT = 3
#: Set in every word's hash, so that ranks and hashes never meet.
_TOP = np.uint64(1 << 63)
_END = np.uint64(0x5EED0FE4D0000001) | _TOP


def _training(ids: list) -> np.ndarray:
    """Rows to learn from; null ids are among them."""
    return np.array([i is None or zlib.crc32(str(i).encode()) % 5 != 1 for i in ids], dtype=bool)


def _tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token with an end after each row's words, first token of each row)."""
    low = t.lower(buf)
    starts, ends, first = t.words(low, offsets, t.BLANK_WORDS)
    out = np.full(len(starts) + len(offsets) - 1, _END, dtype=np.uint64)
    out[np.arange(len(starts)) + t.row_of(first, len(starts))] = t.span_hashes(low, starts, ends) | _TOP
    return out, first + np.arange(len(first))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        learn = _training(b.column("doc_id").to_pylist())
        keys, counts = [], []
        for i, j, buf, offsets in t.chunks(b.column("text")):
            h, first = _tokens(buf, offsets)
            u, _, _, n = t.distinct(h[np.repeat(learn[i:j], np.diff(first))])
            keys.append(u)
            counts.append(n)
        if keys:
            u, _, inverse, _ = t.distinct(np.concatenate(keys))
            n = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(u)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["h", "freq"])


@dataclass
class Words:
    """The commonest words with their counts, and the corpus totals."""

    keys: np.ndarray  # hashes, ascending
    counts: np.ndarray
    total: int  # tokens
    types: int  # distinct words
    wide: np.ndarray  # which ranks, and the begin of a document, are wide contexts

    @property
    def begin(self) -> int:
        return len(self.keys)

    def of(self, h: np.ndarray) -> np.ndarray:
        """Codes of hashes: the rank of common words, the hash of others."""
        at, there = t.member_index(self.keys, h)
        return np.where(there, at.astype(np.uint64), h)

    def is_wide(self, code: np.ndarray) -> np.ndarray:
        return (code < _TOP) & self.wide[np.minimum(code, np.uint64(self.begin)).astype(np.int64)]

    def counted(self, code: np.ndarray, rare: np.ndarray, rare_counts: np.ndarray) -> np.ndarray:
        """The count of each code, those of rare words from a table of ascending hashes."""
        common_ = code < _TOP
        out = np.zeros(len(code), np.int64)
        out[common_] = self.counts[code[common_].astype(np.int64)]
        at, there = t.member_index(rare, code[~common_])
        out[~common_] = np.where(there, rare_counts[at], 0) if len(rare) else 0
        return out

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.total + 0.5 * (self.types + 1))


def _run_lengths(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[at], np.diff(np.append(at, len(x)))


def _bucket(context: np.ndarray, word: np.ndarray, words: Words, n: int) -> np.ndarray:
    key = t.mix(context + np.uint64(1))
    key = np.where(words.is_wide(context), t.mix(key ^ word), key)
    return ((key >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, token hashes, first token of each row) of at most SEND_BYTES of text, or of one longer text."""
    for b in batches:
        for i, j in t.slices(t.utf8(b.column("text"))[1], SEND_BYTES):
            part = b.slice(i, j - i)
            tokens, counts = [], [np.zeros(1, np.int64)]
            for _, _, buf, offsets in t.chunks(part.column("text")):
                h, first = _tokens(buf, offsets)
                tokens.append(h)
                counts.append(np.diff(first))
            h = np.concatenate(tokens)
            del tokens
            yield part, h, np.cumsum(np.concatenate(counts))
            _blobs.release()


def _asked(shared, n_buckets: int):
    """Which bucket asks for the count of which rare word; once for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Words = shared.value
        for _, h, first in _parts(batches):
            code = words.of(h)
            at = np.flatnonzero(code >= _TOP)
            before = np.where(np.isin(at, first[:-1]), np.uint64(words.begin), code[at - 1])
            bucket = _bucket(before, code[at], words, n_buckets)
            order = np.lexsort((code[at], bucket))
            bucket, rare = bucket[order], code[at][order]
            new = np.ones(len(rare), bool)
            new[1:] = (rare[1:] != rare[:-1]) | (bucket[1:] != bucket[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(bucket[new], pa.int32()), pa.array(rare[new].view(np.int64))], ["bucket", "h"])

    return run


def _send_counts(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket, h, freq = (b.column(c).to_numpy() for c in ("bucket", "h", "freq"))
            order = t.sort_order(h.view(np.uint64))[0]
            yield _blobs.split(bucket[order].astype(np.int64), n_buckets, h.view(np.uint64)[order], freq[order])

    return run


def _send_pairs(shared, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Words = shared.value
        task = TaskContext.get().partitionId()
        for ordinal, (part, h, first) in enumerate(_parts(batches)):
            out = _packed(part.column("doc_id").to_pylist(), h, first, words, n_buckets, np.array([task, ordinal], np.int64))
            _blobs.release()
            yield out
            del out, part, h, first

    return run


def _packed(ids: list, h: np.ndarray, first: np.ndarray, words: Words, n_buckets: int, sender: np.ndarray) -> pa.RecordBatch:
    """A part's tokens by bucket, context, word and row, each once, with how often it occurs."""
    rows, (u, _, inverse, _) = len(first) - 1, t.distinct(h)
    code = np.append(words.of(u), np.uint64(words.begin))
    known = code[:-1] < _TOP
    base = np.zeros(len(u))
    base[known] = np.log10(words.unigram(words.counts[code[:-1][known].astype(np.int64)]))
    # the sender's rows travel with one of its buckets
    names = [np.array([x if x is not None else 0 for x in ids], np.int64), np.array([x is None for x in ids], np.uint8), np.diff(first), t.row_sums(known[inverse].astype(np.int64), first), t.row_sums(base[inverse], first)]
    learn = _training(ids).astype(np.uint8)
    width, low = np.uint64(len(u).bit_length()), np.uint64(max(1, rows - 1).bit_length())
    if 2 * int(width) + int(low) > 64:
        raise ValueError("too many distinct words and rows in one part for a 64-bit key")
    key = np.empty(len(h), np.uint64)
    key[1:] = inverse[:-1]
    key[first[:-1]] = len(u)
    key <<= width
    key |= inverse.astype(np.uint64)
    key <<= low
    key |= t.row_of(first, len(h)).astype(np.uint64)
    del inverse
    key.sort()
    key, freq = _run_lengths(key)
    freq = freq.astype(np.uint32)
    row = (key & ((np.uint64(1) << low) - np.uint64(1))).astype(np.uint16 if rows <= 1 << 16 else np.uint32)
    key >>= low
    pair, entries = _run_lengths(key)
    del key
    context, word = (pair >> width).astype(np.int32), (pair & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int32)
    del pair
    bucket = np.concatenate([_bucket(code[context[i : i + 65536]], code[word[i : i + 65536]], words, n_buckets).astype(np.int32) for i in range(0, len(context), 65536)])
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    del bucket
    start = np.cumsum(entries) - entries
    out, first_bucket = [[], []], int(sender[0] * 31 + sender[1]) % n_buckets
    for k in range(n_buckets):
        own = order[edges[k] : edges[k + 1]]
        if not len(own) and k != first_bucket:
            continue
        c, n = _run_lengths(code[context[own]])
        at = t.ranges(start[own], entries[own])
        out[0].append(k)
        out[1].append(_blobs.pack(sender, learn, c, n.astype(np.uint32), code[word[own]], entries[own].astype(np.uint32), row[at], freq[at], *(names if k == first_bucket else [x[:0] for x in names])))
    return _blobs.batch(*out)


_BUCKET = "bucket int, model binary, rare binary, senders array<binary>"


def _merge(table: pa.Table) -> pa.Table:
    """One bucket's bigram counts and the counts of its rare words, and what its senders asked, by place in the model.

    The model holds every pair that occurs, those of held-out documents alone with a count of zero.
    """
    payloads = table.column("payload").to_pylist()
    rare = [_blobs.unpack(p) for p in payloads if p[0] == 2]
    asked = [p for p in payloads if p[0] > 2]
    contexts, words, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0)]
    for p in asked:
        _, learn, c, n, word, entries, row, freq, *_ = _blobs.unpack(p)
        contexts.append(np.repeat(c, n))
        words.append(word)
        counts.append(t.row_sums(freq * learn[row].astype(np.int64), np.concatenate([[0], np.cumsum(entries.astype(np.int64))])))
    edges = np.cumsum([len(x) for x in words])
    context, word, count = np.concatenate(contexts), np.concatenate(words), np.concatenate(counts)
    del contexts, words, counts
    order = t.multikey_order([context, word])
    context, word = context[order], word[order]
    new = np.ones(len(order), bool)
    new[1:] = (context[1:] != context[:-1]) | (word[1:] != word[:-1])
    at, place = np.flatnonzero(new), np.empty(len(order), np.uint32)
    place[order] = np.cumsum(new) - 1
    count = np.add.reduceat(count[order], at) if len(at) else count
    c, n = _run_lengths(context[at])
    model = _blobs.pack(c, n.astype(np.uint32), word[at], count.astype(np.uint64))
    del order, context, word, new, at
    senders = []
    for k, p in enumerate(asked):
        sender, learn, _, _, _, entries, row, freq, *names = _blobs.unpack(p)
        own = place[edges[k] : edges[k + 1]]
        by = np.argsort(own, kind="stable")
        moved = t.ranges((np.cumsum(entries) - entries)[by].astype(np.int64), entries[by].astype(np.int64))
        senders.append(_blobs.pack(sender, np.diff(own[by], prepend=np.uint32(0)), entries[by], row[moved], freq[moved], *names))
    h, freq = (np.concatenate(x) for x in zip(*rare)) if rare else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    by = t.sort_order(h)[0]
    _blobs.release()
    return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), "model": pa.array([model], pa.binary()), "rare": pa.array([_blobs.pack(h[by], freq[by])], pa.binary()), "senders": pa.array([senders], pa.list_(pa.binary()))})


def _counts_of_counts(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload in b.column("model").to_pylist():
                c = _blobs.unpack(payload)[3].astype(np.int64)
                n = np.bincount(np.minimum(c, limit + 2), minlength=limit + 3)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, limit + 2)), pa.array(n[1 : limit + 2])], ["r", "n"])

    return run


def discounts(n: dict[int, int], limit: int = KATZ_LIMIT) -> np.ndarray:
    """d(0..limit), by Katz; where the counts of counts give no value in (0, 1), absolute discounting stands in."""
    d = np.ones(limit + 1)
    n1, n2 = n.get(1, 0), n.get(2, 0)
    off = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    far = (limit + 1) * n.get(limit + 1, 0) / n1 if n1 else 1.0
    for r in range(1, limit + 1):
        star = (r + 1) * n.get(r + 1, 0) / (r * n[r]) if n.get(r) else 0.0
        good = (star - far) / (1 - far) if far != 1 else 0.0
        d[r] = good if 0 < good < 1 else 1 - min(0.9, max(off, 0.1)) / r
    return d


def _discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(c < len(d), d[np.minimum(c, len(d) - 1)], 1.0) * c


@dataclass
class Sums:
    """Per context: its count, the mass its seen words keep, and their unigram mass."""

    context: np.ndarray  # codes, ascending
    count: np.ndarray
    mass: np.ndarray
    lower: np.ndarray

    @staticmethod
    def of(model: list[np.ndarray], words: Words, d: np.ndarray, rare: list[np.ndarray]) -> "Sums":
        context, n, word, c = model
        c = c.astype(np.int64)
        at = np.cumsum(n.astype(np.int64)) - n.astype(np.int64)
        add = lambda x: np.add.reduceat(x.astype(np.float64), at) if len(at) else np.zeros(0)
        return Sums(context, add(c), add(_discounted(c, d)), add(np.where(c > 0, words.unigram(words.counted(word, *rare)), 0.0)))

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """(count, back-off weight): a context whose counts all exceed the discounted ones would leave nothing: it counts one more."""
        count = self.count + (self.count - self.mass < 1e-9 * self.count)
        return count, (1 - self.mass / np.maximum(count, 1)) / np.maximum(1 - self.lower, 1e-300)


def _wide_sums(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, d = shared.value
        for b in batches:
            for model, rare in zip(b.column("model").to_pylist(), b.column("rare").to_pylist()):
                s = Sums.of(_blobs.unpack(model), words, d, _blobs.unpack(rare))
                wide = words.is_wide(s.context)
                yield pa.RecordBatch.from_arrays([pa.array(s.context[wide].view(np.int64)), *(pa.array(x[wide]) for x in (s.count, s.mass, s.lower))], ["context", "count", "mass", "lower"])

    return run


def _evaluate(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, d, wide_context, wide_count, wide_alpha = shared.value
        for b in batches:
            for k in range(b.num_rows):
                model, rare = (_blobs.unpack(b.column(c)[k].as_py()) for c in ("model", "rare"))
                sums = Sums.of(model, words, d, rare)
                count, alpha = sums.weights()
                # whole contexts are this bucket's own; those of wide ones were added up over all buckets
                at, there = t.member_index(wide_context, sums.context)
                count[there], alpha[there] = wide_count[at[there]], wide_alpha[at[there]]
                _, n, word, times = model
                count, alpha, times = np.repeat(count, n), np.repeat(alpha, n), times.astype(np.int64)
                occurs = words.counted(word, *rare)
                lower = np.log10(words.unigram(occurs))
                logp = np.where(times > 0, np.log10(np.maximum(_discounted(times, d), 1e-300) / np.maximum(count, 1)), np.log10(alpha) + lower)
                rare_base, rare_known = np.where(word >= _TOP, lower, 0.0), (word >= _TOP) & (occurs > 0)
                keys, answers = [], []
                for s in b.column("senders")[k].values:
                    sender, gaps, entries, row, freq, *names = _blobs.unpack(s.as_py())
                    at = np.repeat(np.cumsum(gaps, dtype=np.int64), entries)
                    rows, of = np.unique(row, return_inverse=True)
                    add = lambda x: np.bincount(of, weights=x[at] * freq, minlength=len(rows))  # noqa: E731, B023
                    keys.append(int(sender[0] << 32 | sender[1]))
                    answers.append(_blobs.pack(rows, add(logp), add(rare_base), add(rare_known).astype(np.uint32), *names))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(answers, pa.binary())], ["sender", "payload"])
                _blobs.release()

    return run


_SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _add_up(table: pa.Table) -> pa.Table:
    blobs = [_blobs.unpack(p) for p in sorted(table.column("payload").to_pylist())]  # in a fixed order, so that sums repeat exactly
    ids, null, tokens, known, base = next(b[4:] for b in blobs if len(b[4]))
    score, base, known = np.zeros(len(ids)), base.copy(), known.copy()
    for rows, katz, rare_base, rare_known, *_ in blobs:
        score[rows] += katz
        base[rows] += rare_base
        known[rows] += rare_known
    return pa.table({"doc_id": pa.array(ids, mask=null.astype(bool)), "n_tokens": pa.array(tokens), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(score)})


def score(docs: DataFrame, hot_limit: int = HOT_LIMIT, limit: int = KATZ_LIMIT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of docs.

    Null and empty texts are one end token. Null ids are learnt from and stay null. Rows repeated in full are learnt
    from and scored as often as they occur. If no row is learnt from, every token has the one slot of the unseen. An
    empty table gives no rows. Columns besides doc_id and text are not looked at.
    """
    spark = docs.sparkSession
    rows, share = id_and_text(docs), spark.sparkContext.broadcast
    counted = written(rows.mapInArrow(_count_words, "h long, freq long").groupBy("h").agg(F.sum("freq").alias("freq")), "unigrams")
    sizes = counted.agg(F.sum("freq").alias("total"), F.count("*").alias("types")).first()
    top = common(counted, hot_limit).toArrow()
    keys = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    own, total = top.column("freq").to_numpy()[order], int(sizes["total"] or 0)
    words = Words(keys[order], own, total, int(sizes["types"] or 0), np.append(own >= WIDE_CONTEXT * max(1, total), True))
    shared, n = share(words), SPLIT * _blobs.buckets(rows)

    asked = rows.mapInArrow(_asked(shared, n), "bucket int, h long").join(counted, "h").select("bucket", "h", "freq")
    sent = rows.mapInArrow(_send_pairs(shared, n), _blobs.SCHEMA).unionByName(asked.mapInArrow(_send_counts(n), _blobs.SCHEMA))
    bigrams = written(sent.groupBy("bucket").applyInArrow(_merge, _BUCKET), "bigrams")
    n_r = {r["r"]: r["n"] for r in bigrams.select("model").mapInArrow(_counts_of_counts(limit), "r long, n long").groupBy("r").agg(F.sum("n").alias("n")).collect()}  # limit + 1 rows
    d = discounts(n_r, limit)
    wide = bigrams.select("model", "rare").mapInArrow(_wide_sums(share((words, d))), "context long, count double, mass double, lower double")
    wide = wide.groupBy("context").agg(*(F.sum(x).alias(x) for x in ("count", "mass", "lower"))).orderBy("context").toArrow()  # at most 1 / WIDE_CONTEXT rows
    sums = Sums(wide.column("context").to_numpy().view(np.uint64), *(wide.column(x).to_numpy() for x in ("count", "mass", "lower")))
    answers = bigrams.select("model", "rare", "senders").mapInArrow(_evaluate(share((words, d, sums.context, *sums.weights()))), "sender long, payload binary")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    found = answers.groupBy("sender").applyInArrow(_add_up, _SCORED)
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op7_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score() of all documents."""
    return score(table(spark, sf_dir, "documents"))
