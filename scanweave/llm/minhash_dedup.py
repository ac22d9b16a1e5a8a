"""Near-duplicate groups with an LSH forest.

Documents are sets of word shingles; equal sets are one class and only its least document goes on. Each of `TREES`
trees orders the documents by `DEPTH` min-hashes of its own. Documents that share a tree's first `LEAST` min-hashes are
a region; a region with many documents is looked at again at each greater depth. Candidates are neighbours in the
order, which have the longest common prefixes, and a region's centre with each of its members; a sketch of two bits
per min-hash drops pairs far below the wanted similarity. Every candidate that could still join two groups is then
confirmed on the full shingle sets, the likeliest of each group first.

A large region compares few of its pairs, so its documents also meet by an exact prefix-filter join: shingles have one
order, rare ones first, and two sets at the wanted similarity share one of the first n - ceil(similarity n) + 1 of each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.components import connected_components
from . import _blobs
from . import _text as t
from ._frames import NO_ID, id_and_text, table, written

TREES, DEPTH, LEAST = 24, 6, 4
#: Regions above LARGE are split by the next min-hash for further centres. Regions of at most SMALL documents compare
#: each with all others, larger ones with the NEAR next ones in order.
LARGE, SMALL, NEAR = 64, 8, 2
#: Slots of the shingle tally that gives the order of the prefix join (it decides the cost only), and the documents of
#: one shingle above which their pairs are dealt to several cells.
SLOTS, CROWD = 1 << 20, 1024
_FACTORS = t.mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_EVERY_OTHER = np.uint64(0x5555555555555555)
_WORDS = -(-2 * TREES * DEPTH // 64)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes by row, ascending in each; first of each row)."""
    low = t.lower(buf)
    starts, ends, first = t.words(low, offsets, t.BLANK_WORDS)
    h = t.span_hashes(low, starts, ends)
    n, rows = np.diff(first), len(offsets) - 1
    row = t.row_of(first, len(h))
    whole = np.flatnonzero(first[1:][row] - np.arange(len(h)) >= size) if len(h) else np.zeros(0, np.int64)
    shingle = t.window_hashes(h, size)[whole] if len(whole) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < size))
    # a text of fewer words is one shingle: all of it
    rest = [int(t.window_hashes(h[first[i] : first[i + 1]], int(n[i]))[0]) ^ int(n[i]) for i in short.tolist()]
    shingle = np.concatenate([shingle, np.array(rest, np.uint64)])
    row = np.concatenate([row[whole], short])
    order, x = t.sort_order(shingle)
    by_row = np.argsort(row[order].astype(np.int16) if rows < 1 << 15 else row[order], kind="stable")
    x, row = x[by_row], row[order][by_row]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    return x[new], np.searchsorted(row[new], np.arange(rows + 1))


def _min_hashes(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row of TREES * DEPTH min-hashes for each set that is not empty."""
    at = first[:-1][np.diff(first) > 0]
    out = np.empty((len(at), len(_FACTORS)), np.uint32)
    if len(at):
        for k, a in enumerate(_FACTORS):
            out[:, k] = np.minimum.reduceat(x * a, at) >> np.uint64(32)
    return out


def _ids(column) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _describe(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, hashes, signatures = [], [], []
            for _, _, buf, offsets in t.chunks(b.column("text")):
                x, first = shingle_sets(buf, offsets, size)
                n = np.diff(first)
                counts.append(n)
                hashes.extend(hashlib.blake2b(x[i:j].tobytes(), digest_size=16).digest() for i, j in zip(first[:-1].tolist(), first[1:].tolist()))
                rows = iter(_min_hashes(x, first))
                signatures.extend(next(rows).tobytes() if k else None for k in n.tolist())
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array(_ids(b.column("doc_id"))), pa.array(np.concatenate(counts)), pa.array(hashes, pa.binary()), pa.array(signatures, pa.binary())], ["doc_id", "n_shingles", "class", "signature"])

    return run


def _plant(n_buckets: int):
    """Each document's entry in every tree: region, order within it, and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("doc_id").to_numpy()
            m = np.frombuffer(b"".join(b.column("signature").to_pylist()), np.uint32).reshape(-1, TREES * DEPTH)
            bits = np.zeros((len(m), _WORDS), np.uint64)
            for k in range(TREES * DEPTH):
                bits[:, k // 32] |= (m[:, k].astype(np.uint64) & np.uint64(3)) << np.uint64(2 * (k % 32))
            parts = []
            for tree in range(TREES):
                own = m[:, tree * DEPTH : (tree + 1) * DEPTH].astype(np.uint64)
                region = np.full(len(m), tree + 1, np.uint64)
                for d in range(LEAST):
                    region = t.mix(region * np.uint64(0x9E3779B97F4A7C15) ^ own[:, d])
                parts.append((region, own[:, LEAST] << np.uint64(32) | own[:, LEAST + 1], ids, *bits.T))
            whole = [np.concatenate(x) for x in zip(*parts)]
            yield _blobs.split(((whole[0] >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int64), n_buckets, *whole)

    return run


def _unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-hashes whose two bits differ, for rows of sketches."""
    d = a ^ b
    return np.bitwise_count((d | d >> np.uint64(1)) & _EVERY_OTHER).sum(-1)


def _most_unlike(similarity: float) -> float:
    """Differing min-hashes that a pair at the threshold passes but once in ten million."""
    n, p = TREES * DEPTH, 0.75 * (1 - similarity)
    return n * p + 5.2 * np.sqrt(n * p * (1 - p))


def _centres(first: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """For each group of rows, the row nearest to the majority of the group's bits."""
    n = int(first[-1])
    flags = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1)
    size = np.diff(first)
    majority = np.packbits(2 * np.add.reduceat(flags.astype(np.int32), first[:-1], axis=0) > size[:, None], axis=1).view(np.uint64)
    group = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((np.arange(n), _unlike(bits, majority[group]), group))
    return order[first[:-1]]


def _candidates(similarity: float):
    most = _most_unlike(similarity)

    def run(table: pa.Table) -> pa.Table:
        blobs = [_blobs.unpack(p) for p in table.column("payload").to_pylist()]
        region, deeper, ids, *bits = (np.concatenate(x) for x in zip(*blobs))
        order = np.lexsort((ids, deeper, region))
        region, deeper, ids, bits = region[order], deeper[order], ids[order], np.stack(bits, 1)[order]
        size = np.diff(np.append(np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]])), len(region)))
        small = np.repeat(size <= SMALL, size)
        crowded = np.unique(ids[~small])
        left, right = [], []
        for step in range(1, SMALL):
            # in a large region every document meets its neighbours and the centres: pairs in proportion to its size
            i = np.flatnonzero((region[step:] == region[:-step]) & (small[step:] | (step <= NEAR)))
            left.append(i)
            right.append(i + step)
        left, right = np.concatenate(left), np.concatenate(right)
        for depth in range(LEAST, DEPTH + 1):
            key = deeper >> np.uint64(32) if depth == LEAST + 1 else deeper
            new = np.ones(len(region), bool)
            new[1:] = (region[1:] != region[:-1]) | ((key[1:] != key[:-1]) if depth > LEAST else False)
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, len(region)))
            many = size > (SMALL if depth == LEAST else LARGE)
            if many.any():
                rows = t.ranges(at[many], size[many])
                first = np.concatenate([[0], np.cumsum(size[many])])
                centre = np.repeat(rows[_centres(first, bits[rows])], size[many])
                left, right = np.concatenate([left, centre]), np.concatenate([right, rows])
        a, b = np.minimum(ids[left], ids[right]), np.maximum(ids[left], ids[right])
        unlike = _unlike(bits[left], bits[right])
        keep = (a != b) & (unlike <= most)
        # members of large regions, each as a pair with itself
        a, b, unlike = np.concatenate([a[keep], crowded]), np.concatenate([b[keep], crowded]), np.concatenate([unlike[keep], np.zeros(len(crowded), np.int64)])
        return pa.table({"a": pa.array(a), "b": pa.array(b), "unlike": pa.array(unlike.astype(np.int32))})

    return run


def _slot(x: np.ndarray) -> np.ndarray:
    return (t.mix(x) % np.uint64(SLOTS)).astype(np.int64)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLOTS, np.uint32)
    for b in batches:
        for s in b.column("shingles").to_pylist():
            np.add.at(total, _slot(np.cumsum(_blobs.unpack(s)[0], dtype=np.uint64)), 1)
    if total.any():
        parts = total.reshape(16, -1)
        yield _blobs.batch(list(range(16)), [_blobs.pack(p) for p in parts])


def _add_tallies(table: pa.Table) -> pa.Table:
    total = sum(_blobs.unpack(p)[0].astype(np.int64) for p in table.column("payload").to_pylist())
    return pa.Table.from_batches([_blobs.batch([table.column("bucket")[0].as_py()], [_blobs.pack(np.minimum(total, 0xFFFFFFFF).astype(np.uint32))])])


def _prefixes(shared, percent: int, n_buckets: int):
    """Each set's prefix: (cell, part, diagonal) of the pairs of a shingle's documents, and what bounds a pair's overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = shared.value
        for b in batches:
            parts = []
            for doc, group, s in zip(b.column("doc_id").to_pylist(), b.column("g").to_pylist(), b.column("shingles").to_pylist()):
                x = np.cumsum(_blobs.unpack(s)[0], dtype=np.uint64)
                n = len(x)
                seen = tally[_slot(x)]
                first = np.lexsort((x, seen))[: n + (-percent * n // 100) + 1]
                # of k parts of a shingle's documents, every two meet in a cell of their own
                k = (seen[first].astype(np.int64) - 1) // CROWD + 1
                at = np.repeat(np.arange(len(first)), k)
                other = (np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k)).astype(np.int64)
                own = (int(t.mix(np.array([doc], np.int64).view(np.uint64))[0] >> np.uint64(1)) % k)[at]
                low, high = np.minimum(own, other), np.maximum(own, other)
                cell = t.mix(x[first][at] ^ t.mix((low << 32 | high).astype(np.uint64)))
                same = lambda v: np.full(len(at), v, np.int64)
                parts.append((cell, own, (low == high).astype(np.uint8), same(n), at, same(doc), same(group)))
            if parts:
                whole = [np.concatenate(x) for x in zip(*parts)]
                yield _blobs.split(((whole[0] >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int64), n_buckets, *whole)

    return run


def _meetings(percent: int):
    """Pairs of different groups that share a prefix shingle, and whose sizes and places in order leave room for enough more."""

    def run(table: pa.Table) -> pa.Table:
        blobs = [_blobs.unpack(p) for p in table.column("payload").to_pylist()]
        columns = [np.concatenate(x) for x in zip(*blobs)]
        order = np.lexsort((columns[3], columns[0]))
        cell, part, diagonal, n, at, doc, group = (x[order] for x in columns)
        found, waiting, step, i = np.zeros((0, 2), np.int64), [], 0, np.arange(len(cell))
        while len(i):
            step += 1
            i = i[i + step < len(cell)]
            # sizes ascend in a cell: who is too small for one is too small for all that follow
            i = i[(cell[i + step] == cell[i]) & (100 * n[i] >= percent * n[i + step])]
            j = i + step
            room = np.minimum(n[i] - at[i], n[j] - at[j])  # this shingle and all behind it
            good = (group[i] != group[j]) & (doc[i] != doc[j]) & ((diagonal[i] > 0) | (part[i] != part[j])) & ((100 + percent) * room >= percent * (n[i] + n[j]))
            x, y = doc[i[good]], doc[j[good]]
            waiting.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
            if not len(i) or sum(map(len, waiting)) > 1 << 20:
                found, waiting = np.unique(np.concatenate([found, *waiting]), axis=0), []
        return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    return run


def _prefix_pairs(crowded: DataFrame, sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of crowded documents of different groups that can reach the threshold, by prefix filter."""
    spark = sets.sparkSession
    own = sets.join(crowded.withColumnRenamed("a", "doc_id"), "doc_id", "left_semi")
    own = own.join(groups.select(F.col("node").alias("doc_id"), F.col("component").alias("g")), "doc_id", "left").select("doc_id", "shingles", F.coalesce("g", "doc_id").alias("g"))
    own = written(own, "crowded")
    sums = own.select("shingles").mapInArrow(_tally, _blobs.SCHEMA).groupBy("bucket").applyInArrow(_add_tallies, _blobs.SCHEMA).collect()  # 16 rows of at most SLOTS / 4 bytes
    if not sums:
        return own.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).limit(0)
    tally = np.concatenate([_blobs.unpack(r["payload"])[0] for r in sorted(sums, key=lambda r: r["bucket"])])
    n = _blobs.buckets(own)
    sent = own.mapInArrow(_prefixes(spark.sparkContext.broadcast(tally), percent, n), _blobs.SCHEMA)
    return sent.groupBy("bucket").applyInArrow(_meetings(percent), "a long, b long").distinct()


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payload = []
            for _, _, buf, offsets in t.chunks(b.column("text")):
                x, first = shingle_sets(buf, offsets, size)
                payload += [_blobs.pack(np.diff(x[i:j], prepend=np.uint64(0))) for i, j in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(payload, pa.binary())], ["doc_id", "shingles"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = zip(b.column("x").to_pylist(), b.column("y").to_pylist())
            linked = []
            for p, q in sides:
                x, y = (np.cumsum(_blobs.unpack(s)[0], dtype=np.uint64) for s in (p, q))
                common = int(t.member_index(x, y)[1].sum())
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return run


def _groups_of(pairs: DataFrame, crowded: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) over the documents of candidate pairs, joining what the full sets confirm.

    A pair inside a group decides nothing and is not looked at: first each group's likeliest pair is, then its four
    likeliest, then all that still lie between groups, with all of the prefix join of the crowded documents.
    """
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    links, groups, open_pairs = None, None, pairs.withColumns({"ga": F.col("a"), "gb": F.col("b")})
    for most in (1, 4, None):
        chosen = open_pairs
        if most:
            # each group's likeliest pair on either side, or the likeliest of each of `most` hashes: no group is sorted
            keyed = open_pairs.select("ga", "gb", F.pmod(F.xxhash64("a", "b"), F.lit(most)).alias("k"), F.struct("unlike", "a", "b").alias("p"))
            sides = [keyed.groupBy(F.col(side).alias("g"), "k").agg(F.min("p").alias("p")) for side in ("ga", "gb")]
            chosen = sides[0].unionByName(sides[1]).groupBy("g", "k").agg(F.min("p").alias("p")).select("p.a", "p.b").distinct()
        else:
            chosen = open_pairs.select("a", "b").unionByName(_prefix_pairs(crowded, sets, g, percent)).distinct()
        judged = chosen.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long, linked boolean")
        judged = written(judged, "judged")
        new = judged.where("linked").select("a", "b")
        links = new if links is None else links.unionByName(new)
        groups = connected_components(links)
        if most:
            g = written(groups, "groups")
            rest = open_pairs.select("a", "b", "unlike").join(judged.select("a", "b"), ["a", "b"], "left_anti")
            rest = rest.join(g.select(F.col("node").alias("a"), F.col("component").alias("ga")), "a", "left").join(g.select(F.col("node").alias("b"), F.col("component").alias("gb")), "b", "left")
            open_pairs = written(rest.select("a", "b", "unlike", F.coalesce("ga", "a").alias("ga"), F.coalesce("gb", "b").alias("gb")).where("ga <> gb"), "open")
    return groups


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of docs.

    Words are lower-cased A-Z runs of non-blanks; a text of fewer words than `size` is one shingle; null, empty and
    blank texts have none and are linked with nothing. Documents are linked when 100 |common| >= percent |union|.
    Documents whose whole sets have one 128-bit digest are equal. component_id is the least doc_id that a document reaches. A null doc_id is less than all others and stays null;
    such documents, and rows that share a doc_id but not a text, belong together by their id. An empty table gives
    no rows.
    """
    rows = id_and_text(docs)
    described = written(rows.mapInArrow(_describe(size), "doc_id long, n_shingles long, class binary, signature binary"), "signatures")
    full = described.where("n_shingles > 0")
    classes = written(full.groupBy("class", "n_shingles").agg(F.min("doc_id").alias("least")), "classes")
    least = classes.select(F.col("least").alias("doc_id"), "class")
    one_each = full.select("doc_id", "class", "signature").join(least, ["doc_id", "class"], "left_semi").dropDuplicates(["class"])
    n = _blobs.buckets(rows)
    planted = one_each.select("doc_id", "signature").mapInArrow(_plant(n), _blobs.SCHEMA)
    pairs = planted.groupBy("bucket").applyInArrow(_candidates(percent / 100), "a long, b long, unlike int").groupBy("a", "b").agg(F.min("unlike").alias("unlike"))
    met = written(pairs, "candidates")
    pairs, crowded = met.where("a <> b"), met.where("a = b").select("a")
    involved = met.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text").join(involved.hint("merge"), "doc_id", "left_semi")
    sets = written(texts.mapInArrow(_sets(size), "doc_id long, shingles binary"), "sets")
    groups = _groups_of(pairs, crowded, sets, percent)
    # a class's documents follow its least one; ids that several classes hold tie these together
    shared = full.select("doc_id", "class", "n_shingles").join(classes, ["class", "n_shingles"]).where("doc_id <> least").select("doc_id", "least", "class", "n_shingles").distinct()
    many_texts = described.select("doc_id", "class").distinct().groupBy("doc_id").count().where("count > 1").limit(1).count()
    if many_texts:
        edges = groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(shared.select(F.col("doc_id").alias("a"), F.col("least").alias("b")))
        groups = connected_components(edges)
        of = described.select("doc_id", "n_shingles").join(groups.withColumnsRenamed({"node": "doc_id", "component": "c"}), "doc_id", "left").withColumn("component", F.coalesce("c", "doc_id"))
    else:
        label = classes.join(groups, classes["least"] == groups["node"], "left").select("class", "n_shingles", F.coalesce("component", "least").alias("c"))
        of = described.select("doc_id", "n_shingles", "class").join(label, ["class", "n_shingles"], "left").withColumn("component", F.coalesce("c", "doc_id"))
    return of.select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_shingles", F.nullif("component", F.lit(NO_ID)).alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept")
    )


def keep_one_each(docs: DataFrame, **how) -> DataFrame:
    """docs with the least doc_id of each group only; all columns stay.

    Of rows that share a doc_id, the one with the least text stays (null first). Rows without an id all stay.
    """
    dropped = near_duplicates(docs, **how).where(~F.col("kept")).select(F.col("doc_id").alias("__dropped")).distinct()
    left = docs.join(dropped, docs["doc_id"].cast("long") == dropped["__dropped"], "left_anti")
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        return left
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.asc_nulls_first("text")))
    return left.withColumn("__rank", rank).where(F.col("doc_id").isNull() | (F.col("__rank") == 1)).drop("__rank")


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all documents on shingles of two words."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


OP10_SQL = r"""
with recursive d as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as materialized (select distinct doc_id, unnest(case when len(w) = 1 then w when len(w) = 0 then [] else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) x from d),
n as materialized (select doc_id, count(*) n from s group by doc_id),
common as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by all),
links as materialized (select a, b from common join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)),
e as materialized (select a, b from links union all select b, a from links),
reach(a, b) as (select a, b from e union select reach.a, e.b from reach join e on reach.b = e.a)
select d.doc_id, coalesce(n, 0)::bigint n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) component_id, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) kept
from d left join n using (doc_id) left join (select a doc_id, min(b) m from reach group by a) using (doc_id)
"""
