"""Shards of nearly equal bytes by histogram sort: count below probes, refine them, then exchange once.

Documents are ordered by (hash of the text, doc_id, row): equal texts stand together. For each border between two shards
Spark counts the exact bytes below evenly spaced probes within the range of keys that still can hold the border; the next
round's range is that of the one bin where the wanted number of bytes is passed. A round costs one scan of the narrow key
table and returns at most 257 rows for each border. When the bin has one text only, the border goes before or after that
group where this is within the tolerance, else on into the group by doc_id and then by row, to the nearest row. Rows then
move once, by ranges of (shard, key). All of it is DataFrame code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._frames import table, written

SHARDS = 8
#: How far, as a share of an even shard, a border may lie off for the sake of keeping a group of equal texts whole.
TOLERANCE = 0.001
#: A round's bins for each border are at most so many, and one more.
BINS = 256
#: The key of a row, most significant part first. Values are longs; `row` is unique, so the order is total.
KEY = ("h", "id", "row")
_LEAST = -(1 << 63)


@dataclass
class Search:
    """One border: `target` is the wanted bytes below it, `base` the exact bytes below the keys that still can hold it.

    Those keys equal `fixed` in their first parts and lie from `low` to `high` in the next one.
    """

    target: float
    base: int
    fixed: tuple[int, ...]
    low: int
    high: int

    def part(self) -> str:
        return KEY[len(self.fixed)]

    def shift(self) -> int:
        """Probes stand at multiples of 2^shift, the least power with at most BINS + 1 bins from low to high."""
        s = 0
        while (self.high >> s) - (self.low >> s) > BINS:
            s += 1
        return s

    def range(self) -> tuple:
        return (self.fixed, self.low, self.high)

    def bin(self) -> Column:
        """The bin of a row, null outside the range. Arithmetic shifts keep the order of negative keys."""
        inside = F.col(self.part()).between(self.low, self.high)
        for name, value in zip(KEY, self.fixed):
            inside = (F.col(name) == value) & inside
        return F.when(inside, F.shiftright(F.col(self.part()), self.shift()))


def _counts(keys: DataFrame, ranges: list[Search]) -> dict[int, list[tuple[int, int, int, int]]]:
    """range -> [(bytes, rows, least, greatest key part)] of its bins that have rows, in order: one pass over the keys."""
    bins = [F.when(r.bin().isNotNull(), F.struct(F.lit(k).alias("k"), r.bin().alias("bin"), F.col(r.part()).alias("v"))) for k, r in enumerate(ranges)]
    hit = keys.select("size", F.explode(F.array_compact(F.array(*bins))).alias("b"))
    found = hit.groupBy("b.k", "b.bin").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("b.v").alias("low"), F.max("b.v").alias("high"))
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    for r in sorted(found.collect(), key=lambda r: (r["k"], r["bin"])):  # at most BINS + 1 rows for each border
        out.setdefault(r["k"], []).append((r["bytes"], r["rows"], r["low"], r["high"]))
    return out


def splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, ...]]:
    """The greatest key, or first parts of one, below each of the shards - 1 borders.

    keys: h, id, row, size. A border is the one between groups of equal h that is nearest to its share of the bytes, the
    lower of two; where that is more than `tolerance` of a shard off, the nearest between rows.
    """
    whole = keys.agg(F.sum("size").alias("bytes"), F.min("h").alias("low"), F.max("h").alias("high")).first()
    if whole["bytes"] is None:
        return []
    total = whole["bytes"]
    open_: dict[int, Search] = {k: Search(k * total / shards, 0, (), whole["low"], whole["high"]) for k in range(1, shards)}
    done: dict[int, tuple[int, ...]] = {}
    while open_:
        ranges = list({s.range(): s for s in open_.values()}.values())
        number = {r.range(): k for k, r in enumerate(ranges)}
        bins = _counts(keys, ranges)
        for border, s in list(open_.items()):
            below = s.base
            for size, rows, low, high in bins[number[s.range()]]:
                if s.target < below + size:
                    break
                below += size
            above = below + size
            lower = s.target - below <= above - s.target
            off = min(s.target - below, above - s.target)
            if low < high:
                open_[border] = Search(s.target, below, s.fixed, low, high)
            elif rows == 1 or not s.fixed and off <= tolerance * total / shards:
                done[border] = (*s.fixed, low - 1 if lower else low)
                del open_[border]
            else:
                # into the group: its keys' next part may be anything
                open_[border] = Search(s.target, below, (*s.fixed, low), _LEAST, -_LEAST - 1)
    return [done[k] for k in sorted(done)]


def above(splitter: tuple[int, ...]) -> Column:
    """Whether a row's key is above the splitter."""
    out = F.lit(False)
    for name, value in reversed(list(zip(KEY, splitter))):
        out = (F.col(name) > value) | (F.col(name) == value) & out
    return out


def shard_documents(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """docs' columns (or only `columns`), with size, text_crc32, shard and slot, which replace columns of these names.

    size: UTF-8 bytes of the text and one; a null text has no bytes and counts as an empty one. Shards are of nearly equal
    size: a border lies at most `tolerance` of a shard off its place, or as near to it as a border between two rows can.
    A document may be larger than a shard; then shards about it are empty. Within a shard, slots count from 0 in the order
    of (text's hash, id, row). Repeated rows and null ids are rows like others, null ids first among equal texts. Which of
    two rows with equal texts and ids comes first is up to their order in docs. An empty table gives an empty one.
    """
    kept = [c for c in (docs.columns if columns is None else columns) if c not in ("size", "text_crc32", "shard", "slot")]
    text = F.col(text_col).cast("string")
    plain = F.coalesce(text, F.lit(""))
    keys = {
        "size": F.octet_length(plain).cast("long") + 1,
        "text_crc32": F.crc32(plain.cast("binary")),
        "h": F.conv(F.substring(F.md5(plain.cast("binary")), 1, 15), 16, 10).cast("long"),  # 60 bits
        "id": F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)),
        "row": F.monotonically_increasing_id(),
    }
    # written, so that `row` stays and each round reads the key columns only
    keyed = written(docs.select(F.struct(*kept).alias("of"), *(c.alias(n) for n, c in keys.items())), "shard-keys")
    shard = F.lit(0)
    for s in splitters(keyed.select("h", "id", "row", "size"), shards, tolerance):
        shard = shard + above(s).cast("int")
    ordered = keyed.withColumn("shard", shard).repartitionByRange("shard", *KEY).sortWithinPartitions("shard", *KEY)
    placed = written(ordered.select("of", "size", "text_crc32", "shard", F.monotonically_increasing_id().alias("place")), "shards")
    # a place is the number of its partition times 2^33 and the row's number there; partitions have ranges of the order
    part = F.shiftright("place", 33)
    runs = placed.groupBy(part.alias("part"), "shard").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select("part", F.col("shard").alias("in_shard"), (before - F.col("first")).alias("offset"))
    # a row for each partition of the exchange, and one more for each border: some 20 bytes for a task's worth of data
    joined = placed.withColumn("part", part).join(F.broadcast(starts.withColumnRenamed("part", "in_part")), (F.col("part") == F.col("in_part")) & (F.col("shard") == F.col("in_shard")))
    return joined.select("of.*", "size", "text_crc32", "shard", (F.col("place") + F.col("offset")).alias("slot"))


def write_shards(sharded: DataFrame, folder: str) -> None:
    """One folder of Parquet files for each shard that has rows."""
    sharded.write.mode("overwrite").partitionBy("shard").parquet(folder)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards under the law `bytes`; see shard_documents()."""
    out = shard_documents(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The reversed polynomial of CRC-32 over hexadecimal bytes, a table step for each byte.
_CRC = """crc_table as (select list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) order by i) t from range(256) r(i))"""
OP11_SQL = f"""with {_CRC},
d as (select doc_id, coalesce(text, '') x from documents),
s as (select doc_id, (strlen(x) + 1)::bigint size, ('0x' || substr(md5(x), 1, 15))::bigint h,
        xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(x), '..'), lambda b: ('0x' || b)::bigint)),
            lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)::bigint text_crc32 from d, crc_table),
c as (select *, sum(size) over (order by h, doc_id rows unbounded preceding)::bigint upto, sum(size) over ()::bigint total, lead(h) over (order by h, doc_id) is distinct from h ends from s),
e as (select upto, total, ends from c union all select 0, max(total), true from c),
b as (select k, arg_min(upto, (abs(8*upto - k*total), upto)) filter (ends) by_group, arg_min(upto, (abs(8*upto - k*total), upto)) by_row, max(total) total from e, range(1, 8) r(k) group by k),
borders as (select case when abs(8*by_group - k*total)*1000 <= total then by_group else by_row end border from b),
p as (select c.*, (select count(*) from borders where border <= upto - size)::int shard from c)
select doc_id, size, text_crc32, 'bytes' law, shard, row_number() over (partition by shard order by upto) - 1 slot, null::int grown_shard from p"""
