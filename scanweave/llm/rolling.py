"""Rolling windows with ranks: a treap with subtree sizes for each window length, over blocks of time.

Rows of equal group, time, length and language are counted first. The counts go to blocks of time of their group, those
near the end of a block to the next ones too, so that each block has all that its windows reach back to. A task walks its
blocks in order of time, row by row: what has left a window goes out of the window's treap, ranks are taken by walking down
the subtree sizes, then the group of rows with this time goes in. All rows of a group and time share their windows, so the
results are few and join back to the rows.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import table
from ..shipping import ship

WINDOWS = (3600, 21600)
#: Percent of the rows with a length that the two ranks count up to.
MEDIAN, HIGH = 50, 75
_RESULT = "array<struct<window_s: bigint, n_events: bigint, sum_chars: bigint, n_langs: bigint, median_chars: bigint, high_chars: bigint>>"


class Treap:
    """Weighted keys in order. Nodes are places in lists; node 0 is none. A key's priority is a hash of it, so the shape
    depends on the keys alone. Adding, removing and ranks walk down one path of expected logarithmic length."""

    def __init__(self):
        self.key, self.rank, self.left, self.right, self.own, self.size = [0], [-1], [0], [0], [0], [0]
        self.root, self.free = 0, []

    def __len__(self) -> int:
        """The weight of all keys."""
        return self.size[self.root]

    def _node(self, key: int, weight: int, rank: int) -> int:
        if self.free:
            n = self.free.pop()
            self.key[n], self.rank[n], self.left[n], self.right[n], self.own[n], self.size[n] = key, rank, 0, 0, weight, weight
            return n
        for column, v in ((self.key, key), (self.rank, rank), (self.left, 0), (self.right, 0), (self.own, weight), (self.size, weight)):
            column.append(v)
        return len(self.key) - 1

    def _hang(self, parent: int, from_left: bool, node: int) -> None:
        if not parent:
            self.root = node
        elif from_left:
            self.left[parent] = node
        else:
            self.right[parent] = node

    def add(self, key: int, weight: int) -> None:
        """Gives a key more weight, or less; a key without weight leaves."""
        keys, left, right, own, size, rank = self.key, self.left, self.right, self.own, self.size, self.rank
        node, parent, from_left, path = self.root, 0, False, []
        while node and keys[node] != key:
            path.append(node)
            parent, from_left = node, key < keys[node]
            node = left[node] if from_left else right[node]
        for p in path:
            size[p] += weight
        if node:
            own[node] += weight
            size[node] += weight
            if not own[node]:
                self._hang(parent, from_left, self._merge(left[node], right[node]))
                self.free.append(node)
            return
        # the new key's place is above the first node on its path that has a lower priority
        high = zlib.crc32(b"%d" % key)
        new, above, below = self._node(key, weight, high), 0, 0
        for p in path:
            if rank[p] < high:
                below = p
                break
            above = p
        if below:
            for p in path[path.index(below) :]:
                size[p] -= weight
            left[new], right[new] = self._split(below, key)
            size[new] = weight + size[left[new]] + size[right[new]]
        self._hang(above, bool(above) and key < keys[above], new)

    def _split(self, node: int, key: int) -> tuple[int, int]:
        """(nodes below key, nodes above it); key itself is not there."""
        low, high, path = [], [], []
        while node:
            path.append(node)
            if self.key[node] < key:
                low.append(node)
                node = self.right[node]
            else:
                high.append(node)
                node = self.left[node]
        for a, b in zip(low, [*low[1:], 0]):
            self.right[a] = b
        for a, b in zip(high, [*high[1:], 0]):
            self.left[a] = b
        for n in reversed(path):
            self.size[n] = self.own[n] + self.size[self.left[n]] + self.size[self.right[n]]
        return (low or [0])[0], (high or [0])[0]

    def _merge(self, a: int, b: int) -> int:
        """One tree of two, all keys of a being below those of b."""
        top, parent, from_left = 0, 0, False
        while a or b:
            take_a = bool(a) and (not b or self.rank[a] >= self.rank[b])
            node = a if take_a else b
            if a and b:
                self.size[node] += self.size[b if take_a else a]
            if not parent:
                top = node
            elif from_left:
                self.left[parent] = node
            else:
                self.right[parent] = node
            if not (a and b):
                break
            parent, from_left = node, not take_a
            if take_a:
                a = self.right[node]
            else:
                b = self.left[node]
        return top

    def select(self, place: int) -> int:
        """The key at a place, counted from 1."""
        node, left, size, own = self.root, self.left, self.size, self.own
        while True:
            below = size[left[node]]
            if place <= below:
                node = left[node]
            elif place <= below + own[node]:
                return self.key[node]
            else:
                place -= below + own[node]
                node = self.right[node]


class Window:
    """What lies in the window of one length: rows, their lengths in a treap, their languages."""

    def __init__(self, length: int):
        self.length, self.events, self.chars, self.langs, self.tree = length, 0, 0, {}, Treap()
        self.held: deque = deque()

    def move(self, now: int) -> None:
        """Lets go of all that is older than the window before `now`."""
        while self.held and self.held[0][0] < now - self.length:
            for entry in self.held.popleft()[1]:
                self._count(*entry, -1)

    def put(self, time: int, entries: list[tuple]) -> None:
        self.held.append((time, entries))
        for entry in entries:
            self._count(*entry, 1)

    def _count(self, chars: int | None, lang: str | None, n: int, sign: int) -> None:
        self.events += sign * n
        if lang is not None:
            left = self.langs.get(lang, 0) + sign * n
            if left:
                self.langs[lang] = left
            else:
                del self.langs[lang]
        if chars is not None:
            self.chars += sign * n * chars
            self.tree.add(chars, sign * n)

    def result(self) -> tuple:
        m = len(self.tree)
        at = lambda percent: self.tree.select(-(-percent * m // 100)) if m else None
        return self.length, self.events, self.chars, len(self.langs), at(MEDIAN), at(HIGH)


def _walk(windows: tuple[int, ...], block_s: int):
    """Rows of (grp, block, time, chars, lang, n), sorted by the first three, to (grp, time, per): results of the block's own times."""
    kinds = [("window_s", 0), ("n_events", 1), ("sum_chars", 2), ("n_langs", 3), ("median_chars", 4), ("high_chars", 5)]

    def packed(done: list[tuple]) -> pa.RecordBatch:
        flat = [r for _, _, rs in done for r in rs]
        per = pa.StructArray.from_arrays([pa.array([r[k] for r in flat], pa.int64()) for _, k in kinds], [n for n, _ in kinds])
        lists = pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, len(windows)), pa.int32()), per)
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), lists], ["grp", "time", "per"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, now, entries, state, done = None, None, [], [], []

        def close() -> None:
            if not entries:
                return
            own = now >= here[1] * block_s
            for w in state:
                if own:
                    w.move(now)
            if own:
                done.append((here[0], now, [w.result() for w in state]))
            for w in state:
                w.put(now, entries)

        for batch in batches:
            for grp, block, time, chars, lang, n in zip(*(c.to_pylist() for c in batch.columns)):
                if (grp, block) != here or time != now:
                    close()
                    if (grp, block) != here:
                        here, state = (grp, block), [Window(w) for w in windows]
                    now, entries = time, []
                entries.append((chars, lang, n))
            if len(done) >= 1024:
                yield packed(done)
                done.clear()
        close()
        yield packed(done)

    return run


def whole_part(value: Column, by: int) -> Column:
    """floor(value / by) of longs, exactly; null where it does not fit."""
    return F.call_function("div", F.try_subtract(value, F.pmod(value, F.lit(by)).cast("long")), F.lit(by))


def rolling_windows(events: DataFrame, windows: tuple[int, ...] = WINDOWS, block_s: int | None = None) -> DataFrame:
    """(grp, time, per) for all groups and times: per holds a result for each window length W, over the group's rows with
    time - W <= their time < time.

    events: grp string, time long, chars long, lang string. A null group is one group. Rows without a time are in no window
    and have no results. Null lengths count as rows only; of the others, ascending with repeats, median_chars is number
    ceil(m / 2) and high_chars number ceil(75 m / 100), both null where there are none. Null languages do not count.
    Repeated rows count as often as they stand. An empty table gives an empty one. block_s: length of the blocks of time,
    the longest window unless given. A task holds the windows of one group at one time, never all of a group.
    """
    ship(events.sparkSession)
    block = block_s or max(windows)
    counted = events.where("time is not null").groupBy("grp", "time", "chars", "lang").agg(F.count("*").alias("n"))
    blocks = F.sequence(whole_part(F.col("time"), block), whole_part(F.col("time") + max(windows), block))
    dealt = counted.select("grp", F.explode(blocks).alias("block"), "time", "chars", "lang", "n").repartitionByRange("grp", "block").sortWithinPartitions("grp", "block", "time")
    return dealt.mapInArrow(_walk(tuple(windows), block), f"grp string, time bigint, per {_RESULT}")


def rolling_features(docs: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """A row for each row of docs and window length, with event_s from the id; see rolling_windows().

    Needs doc_id, text, source and lang; other columns are not looked at. A row with a null id, or one so large that its
    time does not fit into a long, has no event_s: no row, no lengths and no languages are in its windows, and it is in nobody's.
    """
    doc = F.col("doc_id").cast("long")
    rows = docs.select(doc.alias("doc_id"), F.col("source").cast("string").alias("grp"), F.col("lang").cast("string").alias("lang"), F.length(F.col("text").cast("string")).cast("long").alias("chars"), F.try_multiply(F.lit(60).cast("long"), whole_part(F.try_add(doc, F.crc32(doc.cast("string").cast("binary")) % 4000), 6)).alias("time"))
    found = rolling_windows(rows.drop("doc_id"), windows).select(F.col("grp").alias("r_grp"), F.col("time").alias("r_time"), "per")
    joined = rows.select("doc_id", "grp", "time").join(found, F.col("grp").eqNullSafe(F.col("r_grp")) & (F.col("time") == F.col("r_time")), "left")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    empty = F.array(*(F.struct(F.lit(w).cast("long").alias("window_s"), zero.alias("n_events"), zero.alias("sum_chars"), zero.alias("n_langs"), none.alias("median_chars"), none.alias("high_chars")) for w in windows))
    return joined.select("doc_id", F.col("time").alias("event_s"), F.explode(F.coalesce("per", empty)).alias("w")).select("doc_id", "w.window_s", "event_s", "w.n_events", "w.sum_chars", "w.n_langs", "w.median_chars", "w.high_chars")


def op12_rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rolling_features() of all documents for windows of an hour and of six."""
    return rolling_features(table(spark, sf_dir, "documents"))


OP12_SQL = """with crc_table as (select list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) order by i) t from range(256) r(i)),
d as (select doc_id, source, lang, length(text) chars, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)::bigint h from documents, crc_table),
e as (select *, 60 * ((doc_id + h % 4000) // 6) event_s from d),
w as (select a.doc_id, a.event_s, window_s, count(b.event_s) n_events, coalesce(sum(b.chars), 0)::bigint sum_chars, count(distinct b.lang) n_langs, list_sort(list(b.chars) filter (b.chars is not null)) l
  from e a cross join (select unnest([3600, 21600]) window_s) left join e b on b.source is not distinct from a.source and b.event_s < a.event_s and b.event_s >= a.event_s - window_s group by all)
select doc_id, window_s, event_s, n_events, sum_chars, n_langs, l[(len(l) + 1) // 2]::bigint median_chars, l[(75*len(l) + 99) // 100]::bigint high_chars from
(select doc_id, window_s, event_s, n_events, sum_chars, n_langs, l from w)"""
