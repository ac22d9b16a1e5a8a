"""Token counts: pieces are counted once per distinct pre-token, and ids are never materialised.

A pre-token of the sentence-piece vocabulary is a word with the blanks before it: no piece of the vocabulary has
a blank after another character, so merges never cross that border. The distinct pre-tokens of the corpus are
counted once each. The commonest (at most `hot_limit`, a fixed bound) go to the executors as two arrays; the
rest, each of them rare, meet their documents' frequencies in a shuffle join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as t
from ._frames import id_and_text, table, written

HOT_LIMIT = 1 << 20
_NOT_BLANK = np.arange(256) != 0x20
_MODELS: dict = {}


def _pretokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row, lone): the text of each pre-token less the one blank that the tokenizer puts first.

    lone counts, for each row, trailing single blanks: a piece of their own with no text left.
    """
    starts, ends, first = t.words(buf, offsets, _NOT_BLANK)
    rows = t.row_of(first, len(starts))
    begin = np.empty_like(starts)
    if len(starts):
        begin[1:] = ends[:-1] + 1
        has = first[1:] > first[:-1]
        begin[first[:-1][has]] = offsets[:-1][has]
    filled = np.diff(offsets) > 0
    empty = filled & (first[1:] == first[:-1])
    last = np.where(first[1:] > first[:-1], ends[np.maximum(first[1:] - 1, 0)] if len(ends) else 0, 0)
    tail = filled & ~empty & (last < offsets[1:])
    more_start = np.concatenate([offsets[:-1][empty], last[tail] + 1])
    more_end = np.concatenate([offsets[1:][empty], offsets[1:][tail]])
    more_row = np.concatenate([np.flatnonzero(empty), np.flatnonzero(tail)])
    some = more_end > more_start
    lone = np.bincount(more_row[~some], minlength=len(offsets) - 1)
    return np.concatenate([begin, more_start[some]]), np.concatenate([ends, more_end[some]]), np.concatenate([rows, more_row[some]]), lone


def _distinct_pretokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, texts, counts = [], [], []
        for _, _, buf, offsets in t.chunks(b.column("text")):
            starts, ends, _, _ = _pretokens(buf, offsets)
            u, at, _, n = t.distinct(t.span_hashes(buf, starts, ends))
            raw = buf.tobytes()
            keys.append(u)
            counts.append(n)
            texts.extend(raw[i:j] for i, j in zip(starts[at].tolist(), ends[at].tolist()))
        if keys:
            u, at, inverse, _ = t.distinct(np.concatenate(keys))
            n = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(u)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array([texts[i] for i in at.tolist()], pa.binary()), pa.array(n)], ["h", "pretoken", "freq"])


def _count_pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        if path not in _MODELS:
            _MODELS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        for b in batches:
            texts = [x.decode() for x in b.column("pretoken").to_pylist()]
            n = np.fromiter((len(x) for x in _MODELS[path].encode(texts, num_threads=1)), np.int32, len(texts)) if texts else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(n), b.column("freq")], ["h", "pieces", "freq"])

    return run


def _check_model(path: str) -> None:
    """Pieces that hold a blank after another character would join what is counted apart."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for k in range(model.get_piece_size()):
        if "\u2581" in model.id_to_piece(k).lstrip("\u2581"):
            raise ValueError(f"piece {k} of {path} crosses a blank")


def piece_table(docs: DataFrame, model_path: str) -> DataFrame:
    """(h, pieces, freq): each distinct pre-token of the corpus by its hash, its number of pieces and of occurrences."""
    found = id_and_text(docs).select("text").mapInArrow(_distinct_pretokens, "h long, pretoken binary, freq long")
    once = found.groupBy("h").agg(F.first("pretoken").alias("pretoken"), F.sum("freq").alias("freq"))
    return once.mapInArrow(_count_pieces(model_path), "h long, pieces int, freq long")


def common(pieces: DataFrame, limit: int) -> DataFrame:
    """The `limit` commonest pre-tokens, or all if there are fewer; of equal frequency those with the least hash."""
    total = 0
    for r in pieces.groupBy("freq").agg(F.count("*").alias("n")).orderBy(F.desc("freq")).toLocalIterator():  # stops after at most limit + 1 rows
        if total + r["n"] > limit:
            rest = limit - total
            # hashes are uniform: below this one lie `rest` of the n words, and a few more
            share = min(1.0, (rest + 6 * rest**0.5 + 16) / r["n"])
            least = -(1 << 63) + min((1 << 64) - 1, int(share * (1 << 64)))
            level = pieces.where((F.col("freq") == r["freq"]) & (F.col("h") <= least)).orderBy("h").limit(rest)
            return pieces.where(F.col("freq") > r["freq"]).unionByName(level)
        total += r["n"]
    return pieces


def _document_rows(hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, pieces = hot.value
        names = ["doc_id", "version", "n_bytes", "h", "freq", "known"]
        for b in batches:
            ids, parts = b.column("doc_id"), [[] for _ in names]
            for i, j, buf, offsets in t.chunks(b.column("text")):
                starts, ends, rows, lone = _pretokens(buf, offsets)
                version = t.span_hashes(buf, offsets[:-1], offsets[1:], seed=1)
                u, _, inverse, _ = t.distinct(t.span_hashes(buf, starts, ends))
                at, there = t.member_index(keys, u)
                value = np.where(there, pieces[at] if len(pieces) else 0, 0)[inverse]
                known = np.bincount(rows, weights=value, minlength=j - i).astype(np.int64) + lone
                rare = np.flatnonzero(~there[inverse])
                pair, freq = np.unique(rows[rare] * len(u) + inverse[rare], return_counts=True)
                r, w = np.divmod(pair, max(1, len(u)))
                zero = np.zeros(len(r), np.int64)
                # a document's own row gets a key that no pre-token has a reason to share, mixed with its place in the batch,
                # so that such rows spread out though texts or ids repeat
                own = t.mix(version ^ t.mix(np.arange(i, j).astype(np.uint64)))
                for part, whole, tail in zip(parts, (ids.slice(i, j - i), version.view(np.int64), np.diff(offsets), own.view(np.int64), np.zeros(j - i, np.int64), known), (ids.slice(i, j - i).take(pa.array(r)), version[r].view(np.int64), zero, u[w].view(np.int64), freq.astype(np.int64), zero)):
                    part.extend([whole if isinstance(whole, pa.Array) else pa.array(whole), tail if isinstance(tail, pa.Array) else pa.array(tail)])
            if parts[0]:
                own = pa.array(np.concatenate([np.full(len(x), k % 2 == 0) for k, x in enumerate(parts[0])]))
                yield pa.RecordBatch.from_arrays([*(pa.concat_arrays(p) for p in parts), own], [*names, "own"])

    return run


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, hot_limit: int = HOT_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per row of docs.

    Null texts are empty: no bytes, no tokens. A null doc_id stays null. Rows repeated in full give their result as
    often as they occur; rows that share a doc_id but not a text are counted apart. An empty table gives no rows.
    """
    spark = docs.sparkSession
    _check_model(model_path)
    pieces = written(piece_table(docs, model_path), "pieces")
    top = common(pieces, hot_limit).select("h", "pieces").toArrow()
    keys = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    hot = spark.sparkContext.broadcast((keys[order], top.column("pieces").to_numpy()[order].astype(np.int32)))
    rows = id_and_text(docs).mapInArrow(_document_rows(hot), "doc_id long, version long, n_bytes long, h long, freq long, known long, own boolean")
    joined = rows.join(pieces.select("h", "pieces"), "h", "left")
    per_doc = joined.groupBy("doc_id", "version").agg(
        F.sum(F.col("known") + F.col("freq") * F.coalesce("pieces", F.lit(0))).alias("total"), F.max("n_bytes").alias("n_bytes"), F.count_if("own").alias("copies")
    )
    n_tokens = (F.col("total") / F.col("copies")).cast("long")
    return per_doc.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """count_tokens() of all documents with the 32k sentence-piece vocabulary."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
