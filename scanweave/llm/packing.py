"""Packing by minimum bin slack.

Documents become token streams; whole windows are cut off first, and what remains of each document is a piece of
less than a window. Only the histogram of piece lengths (at most `window` numbers) reaches the driver. There a
subset-sum dynamic programme over bitsets picks, again and again, the multiset of lengths that fills a window
closest to capacity, backtracks its counts and repeats it as often as the histogram allows. Pieces then find their
place by their rank among the pieces of their length. Lengths that no multiset fills exactly are laid end to end and
cut at window borders; the last, part-filled window is cut into power-of-two sequences, which need no padding.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _text as t
from ._frames import id_and_text, table, written

WINDOW = 2048
END_ID = 1
#: Distinct words whose ids a Python worker remembers; beyond, it forgets all and starts anew.
CACHE_WORDS = 1 << 20
#: Ids of cut documents that are broadcast rather than shuffled.
BROADCAST_IDS = 1 << 17
_CACHES: dict[str, "WordIds"] = {}


class WordIds:
    """Token ids of blank-free words, each distinct word encoded once.

    The vocabulary's tokenizer drops white space and never joins what it parts, so the ids of a text are those of
    its words in order.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.keys, self.start, self.count, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, ids of each)."""
        flat, counts = [], []
        groups = [words[i : i + 256] for i in range(0, len(words), 256)]
        for group, e in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
            at = np.cumsum([0] + [len(w) + 1 for w in group])
            token_start = np.fromiter((o[0] for o in e.offsets), np.int64, len(e))
            flat.append(np.array(e.ids, dtype=np.uint32))
            counts.append(np.bincount(np.searchsorted(at, token_start, "right") - 1, minlength=len(group))[: len(group)])
        return (np.concatenate(flat), np.concatenate(counts)) if flat else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        """keys ascend and are new."""
        if len(self.keys) + len(keys) > CACHE_WORDS:
            self.forget()
        flat, counts = self.encode(words)
        start = np.cumsum(counts) - counts + len(self.flat)
        self.flat = np.concatenate([self.flat, flat])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.start, self.count = np.insert(self.keys, at, keys), np.insert(self.start, at, start), np.insert(self.count, at, counts)

    def texts(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids before each text and after the last)."""
        starts, ends, first = t.words(buf, offsets, t.BLANK_WORDS)
        u, at, inverse, _ = t.distinct(t.span_hashes(buf, starts, ends))
        _, there = t.member_index(self.keys, u)
        if not there.all():
            new, raw = at[~there], buf.tobytes()
            missing, words = u[~there], [raw[i:j].decode() for i, j in zip(starts[new].tolist(), ends[new].tolist())]
            if len(self.keys) + len(missing) > CACHE_WORDS:  # then the known ones go too
                missing, words = u, [raw[i:j].decode() for i, j in zip(starts[at].tolist(), ends[at].tolist())]
            self.learn(missing, words)
        place = np.searchsorted(self.keys, u)
        counts = self.count[place][inverse]
        ids = self.flat[t.ranges(self.start[place][inverse], counts)]
        return ids, np.concatenate([[0], np.cumsum(counts)])[first]


def _cache(path: str) -> WordIds:
    if path not in _CACHES:
        _CACHES[path] = WordIds(path)
    return _CACHES[path]


_PIECE = "doc_id long, version long, start long, length long, ids_crc32 long, doc_tokens long"


def _cut(path: str, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = _cache(path), np.array([end_id], np.uint32)
        for b in batches:
            row, start, length, crc, tokens, version = [], [], [], [], [], []
            for i, j, buf, offsets in t.chunks(b.column("text"), 1 << 21):
                ids, first = words.texts(buf, offsets)
                version.append(t.span_hashes(buf, offsets[:-1], offsets[1:], seed=1).view(np.int64))
                for k in range(j - i):
                    doc = np.concatenate([ids[first[k] : first[k + 1]], end]).astype("<u4")
                    for s in range(0, len(doc), window):
                        part = doc[s : s + window]
                        row.append(i + k)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        tokens.append(len(doc))
            if row:
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(take), pa.array(np.concatenate(version)).take(take), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens))],
                    ["doc_id", "version", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return run


def fill(counts: dict[int, int], window: int) -> dict[int, int]:
    """The multiset of lengths, within counts, whose sum is closest to the window.

    One bitset of reachable sums per length and power-of-two bundle of it; backtracking reads the counts off.
    """
    full = (1 << (window + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], window // length)
        size = 1
        while left > 0:
            take = min(size, left)
            steps.append((length, take, reach))
            reach |= (reach << (take * length)) & full
            left -= take
            size *= 2
        if reach >> window & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= take * length
    return chosen


def plan(counts: dict[int, int], window: int) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """([(multiset that fills a window exactly, how often)], lengths left over with their counts)."""
    left, patterns = {k: v for k, v in counts.items() if v}, []
    while left:
        best = fill(left, window)
        if sum(k * v for k, v in best.items()) < window:
            break
        times = min(left[k] // v for k, v in best.items())
        patterns.append((best, times))
        for k, v in best.items():
            left[k] -= v * times
            if not left[k]:
                del left[k]
    return patterns, left


class Places:
    """Where the piece of a given length and rank goes."""

    def __init__(self, counts: dict[int, int], window: int):
        patterns, left = plan(counts, window)
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for chosen, times in patterns:
            offset = 0
            for length, m in sorted(chosen.items(), reverse=True):
                rows.append((length, used.get(length, 0), m, sequence, offset))
                used[length] = used.get(length, 0) + m * times
                offset += m * length
            sequence += times
        # what is left lies end to end from position 0 of a stream of its own
        self.stream_from = sequence
        at = 0
        for length in sorted(left, reverse=True):
            rows.append((length, used.get(length, 0), 0, 0, at))
            at += length * left[length]
        self.stream = at
        rows.sort()
        self.length, self.rank, self.m, self.sequence, self.offset = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(5))
        self.window = window
        rest, borders = at % window, []
        for bit in reversed(range(window.bit_length())):
            if rest >> bit & 1:
                borders.append(1 << bit)
        #: the last window's sequences: ends within it
        self.ends = np.cumsum(borders, dtype=np.int64)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, offset there, position in the stream of leftovers or -1)."""
        bits = np.int64(40)
        i = np.searchsorted((self.length << bits) + self.rank, (length << bits) + rank, "right") - 1
        k, m = rank - self.rank[i], self.m[i]
        times = np.maximum(m, 1)
        stream = np.where(m == 0, self.offset[i] + k * length, -1)
        return self.sequence[i] + k // times, self.offset[i] + (k % times) * length, stream

    def cuts(self, position: int, length: int) -> list[tuple[int, int, int, int]]:
        """(start within the piece, length, sequence, offset) of what borders make of a leftover piece."""
        out, done = [], 0
        while done < length:
            at = position + done
            w, offset = divmod(at, self.window)
            if w < self.stream // self.window:
                sequence, border = self.stream_from + w, self.window
            else:
                k = int(np.searchsorted(self.ends, offset, "right"))
                sequence, border = self.stream_from + w + k, int(self.ends[k])
                offset -= int(self.ends[k - 1]) if k else 0
                border -= int(self.ends[k - 1]) if k else 0
            part = min(length - done, border - offset)
            out.append((done, part, sequence, offset))
            done += part
        return out


_PLACED = _PIECE + ", sequence_id long, offset long"


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: Places = shared.value
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            if not len(length):
                continue
            sequence, offset, stream = places.find(length, rank)
            take, start, part, seq, off, whole = [], [], [], [], [], []
            for i in np.flatnonzero(stream >= 0).tolist():
                for s, n, q, o in places.cuts(int(stream[i]), int(length[i])):
                    take.append(i)
                    start.append(s)
                    part.append(n)
                    seq.append(q)
                    off.append(o)
                    whole.append(n == length[i])
            plain = np.flatnonzero(stream < 0)
            rows = pa.array(np.concatenate([plain, np.array(take, np.int64)]))
            crc = b.column("ids_crc32").take(rows)
            crc = pa.array(crc.to_numpy(), mask=np.concatenate([np.zeros(len(plain), bool), ~np.array(whole, bool)]))
            starts = b.column("start").take(rows).to_numpy() + np.concatenate([np.zeros(len(plain), np.int64), np.array(start, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(rows), b.column("version").take(rows), pa.array(starts), pa.array(np.concatenate([length[plain], np.array(part, np.int64)])), crc, b.column("doc_tokens").take(rows)]
                + [pa.array(np.concatenate([x[plain], np.array(y, np.int64)])) for x, y in ((sequence, seq), (offset, off))],
                ["doc_id", "version", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def _crc_of_cuts(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = _cache(path), np.array([end_id], np.uint32)
        for b in batches:
            crc = []
            at = list(zip(b.column("start").to_pylist(), b.column("length").to_pylist()))
            for i, j, buf, offsets in t.chunks(b.column("text"), 1 << 21):
                ids, first = words.texts(buf, offsets)
                for k in range(j - i):
                    s, n = at[i + k]
                    crc.append(zlib.crc32(np.concatenate([ids[first[k] : first[k + 1]], end])[s : s + n].astype("<u4").tobytes()))
            out = b.drop_columns(["text"])
            yield out.set_column(out.schema.get_field_index("ids_crc32"), "ids_crc32", pa.array(crc, pa.int64()))

    return run


def cut_pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, version, start, length, ids_crc32, doc_tokens): each document's whole windows and its rest."""
    return id_and_text(docs).mapInArrow(_cut(tokenizer_path, window, end_id), _PIECE)


def _ranked(pieces: DataFrame, total: int) -> DataFrame:
    """pieces with `rank`, 0 to n-1 among those of equal length.

    Lengths are split by a hash of the piece before they are numbered; the splits' sizes, added up, shift the
    numbers, so that no length's pieces meet in one task.
    """
    splits = max(16, total // 500_000)
    keyed = pieces.withColumn("split", F.pmod(F.xxhash64("doc_id", "version", "start"), F.lit(splits)))
    sizes = keyed.groupBy("length", "split").agg(F.count("*").alias("n"))
    before = sizes.withColumn("shift", F.sum("n").over(Window.partitionBy("length").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))).select("length", "split", F.coalesce("shift", F.lit(0)).alias("shift"))
    own = F.row_number().over(Window.partitionBy("length", "split").orderBy("doc_id", "version", "start")) - 1
    return keyed.withColumn("own", own).join(before, ["length", "split"]).withColumn("rank", F.col("own") + F.col("shift")).drop("own", "shift", "split")


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row per piece.

    Null and empty texts are the end id alone. Rows repeated in full are packed as often as they occur (their
    pieces are alike, so which copy lies where does not matter); a null doc_id stays null. An empty table packs into
    nothing. window must be a power of two.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    spark = docs.sparkSession
    pieces = written(cut_pieces(docs, tokenizer_path, window, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    places = spark.sparkContext.broadcast(Places(counts, window))
    ranked = _ranked(pieces, sum(counts.values())).select("doc_id", "version", "start", "length", "ids_crc32", "doc_tokens", "rank")
    placed = written(ranked.mapInArrow(_place(places), _PLACED), "placed")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole, cut = placed.where("ids_crc32 is not null"), placed.where("ids_crc32 is null")
    cut_ids = cut.select(F.col("doc_id").alias("__cut_id")).distinct()
    # only the pieces at borders of leftover windows are cut, mostly few; the result is the same either way
    cut_ids = F.broadcast(cut_ids) if cut_ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else cut_ids
    texts = id_and_text(docs).withColumnRenamed("doc_id", "__id").join(cut_ids, F.col("__id").eqNullSafe(F.col("__cut_id")), "left_semi")
    texts = texts.mapInArrow(_versions, "__id long, text string, __version long").dropDuplicates(["__id", "__version"])
    again = cut.join(texts, cut["doc_id"].eqNullSafe(texts["__id"]) & (cut["version"] == texts["__version"])).drop("__id", "__version")
    crcs = again.select("doc_id", "version", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "text").mapInArrow(_crc_of_cuts(tokenizer_path, end_id), _PLACED)
    return whole.select(*columns).unionByName(crcs.select(*columns))


def _versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf, offsets = t.utf8(b.column("text"))
        version = t.span_hashes(buf, offsets[:-1], offsets[1:], seed=1)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(version.view(np.int64))], ["__id", "text", "__version"])


def sequences(docs: DataFrame, packed: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, for pieces that pack() has placed."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = _cache(tokenizer_path), np.array([end_id], np.uint32)
        for b in batches:
            parts = []
            at = list(zip(b.column("start").to_pylist(), b.column("length").to_pylist()))
            for i, j, buf, offsets in t.chunks(b.column("text"), 1 << 21):
                ids, first = words.texts(buf, offsets)
                parts += [np.concatenate([ids[first[k] : first[k + 1]], end])[at[i + k][0] : sum(at[i + k])].tolist() for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([b.column("sequence_id"), b.column("offset"), pa.array(parts, pa.list_(pa.int32()))], ["sequence_id", "offset", "ids"])

    texts = id_and_text(docs).dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "__id")
    joined = packed.join(texts, packed["doc_id"].eqNullSafe(texts["__id"])).select("sequence_id", "offset", "start", "length", "text")
    return joined.mapInArrow(cut, "sequence_id long, offset long, ids array<int>").groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack() of all documents into windows of 2,048 ids."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
