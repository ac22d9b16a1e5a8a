"""Sharding, rolling windows and whitening against brute force on tables with nulls, ties, repeats and clashing columns."""

import hashlib
import pickle
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scanweave.llm import _repeats, decontamination, quality, recompression_dedup, rolling, secret_scan, sharding, token_counts, whitening

SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


def odd_docs():
    rng = random.Random(7)
    word = lambda n: "".join(rng.choices("abé日 ", k=n))
    rows = [(i, word(rng.choice([0, 3, 3, 50, 400])), rng.choice(["a", "a", "a", "b", None]), rng.choice(["x", "y", None])) for i in range(-40, 160)]
    rows += [(i, "copy of a text", "a", "x") for i in range(200, 300)] + [(7, "same", None, None)] * 5
    return rows + [(None, "no id", "a", "x"), (None, None, None, None), (300, None, "b", "y"), (301, "", "b", "y"), (-(1 << 63), "least", "b", "x")]


# ---- sharding


def plain_shards(rows, shards, tolerance):
    """(id, text, size, shard, slot) by sorting all rows in one list."""
    keyed = []
    for i, x, *_ in rows:
        raw = (x or "").encode()
        keyed.append((int(hashlib.md5(raw).hexdigest()[:15], 16), -(1 << 63) if i is None else i, i, x, len(raw) + 1))
    keyed.sort(key=lambda r: r[:2])
    ends, upto = [0], 0
    for r in keyed:
        upto += r[4]
        ends.append(upto)
    total = upto
    whole = [0] + [e for k, e in enumerate(ends) if k and (k == len(keyed) or keyed[k][0] != keyed[k - 1][0])]
    borders = []
    for k in range(1, shards):
        target = Fraction(k * total, shards)
        near = lambda at: min(at, key=lambda e: (abs(e - target), e))
        group = near(whole)
        borders.append(group if abs(group - target) <= tolerance * total / shards else near(ends))
    out, slots = [], Counter()
    for r, start in zip(keyed, ends):
        shard = sum(b <= start for b in borders)
        out.append((r[2], r[3], r[4], shard, slots[shard]))
        slots[shard] += 1
    return out


@pytest.mark.parametrize(("shards", "tolerance"), [(8, 0.001), (3, 0.2), (1, 0.0), (50, 0.0)])
def test_shards_equal_a_sorted_list(spark, shards, tolerance):
    rows = odd_docs()
    got = sorted((r.doc_id, r.text, r.size, r.shard, r.slot) if r.doc_id is not None else (1 << 62, r.text, r.size, r.shard, r.slot) for r in sharding.shard_documents(docs(spark, rows).repartition(5), shards, tolerance).collect() if r.text is not None)
    want = sorted((1 << 62 if i is None else i, x, n, s, k) for i, x, n, s, k in plain_shards(rows, shards, tolerance) if x is not None)
    assert got == want


def test_a_group_of_a_third_is_split_and_others_are_kept(spark):
    rows = [(i, "hot " * 10, "a", "x") for i in range(600)] + [(1000 + i, f"cold {i} " * 5, "a", "x") for i in range(1200)]
    out = sharding.shard_documents(docs(spark, rows), 8).groupBy("shard").agg(F.sum("size").alias("n"), F.max("slot").alias("last"), F.count("*").alias("k")).collect()
    sizes = [r.n for r in out]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 2 * 51 and all(r.last == r.k - 1 for r in out)


def test_a_text_larger_than_a_shard_and_empty_tables(spark):
    out = sharding.shard_documents(docs(spark, [(1, "x" * 1000, None, None), (2, "y", None, None), (3, None, None, None)]), 4).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in out) == [(1, 1001, zlib.crc32(b"x" * 1000)), (2, 2, zlib.crc32(b"y")), (3, 1, 0)]
    assert all(0 <= r.shard < 4 for r in out)
    none = sharding.shard_documents(docs(spark, []))
    assert none.count() == 0 and none.columns == ["doc_id", "text", "source", "lang", "size", "text_crc32", "shard", "slot"]


def test_clashing_columns_and_shard_files(spark, tmp_path):
    rows = docs(spark, odd_docs()[:50]).withColumns({c: F.lit(c) for c in ("of", "h", "id", "row", "size", "place", "part", "shard", "slot", "n", "in_part")})
    out = sharding.shard_documents(rows, 3)
    assert out.count() == 50 and dict(out.dtypes)["size"] == "bigint" and out.first()["place"] == "place"
    sharding.write_shards(out, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().count() == 3


# ---- rolling windows


def test_treap_against_a_sorted_list():
    rng, tree, bag = random.Random(3), rolling.Treap(), Counter()
    for step in range(6000):
        key = rng.randrange(200)
        if bag[key] and rng.random() < 0.55:
            n = rng.randint(1, bag[key])
            bag[key] -= n
            tree.add(key, -n)
        else:
            n = rng.randint(1, 3)
            bag[key] += n
            tree.add(key, n)
        if step % 50 == 0:
            flat = sorted(bag.elements())
            assert len(tree) == len(flat) and [tree.select(i + 1) for i in range(len(flat))] == flat
    assert len(tree.key) <= 201  # places of keys that left are used again


def plain_windows(events, windows):
    out = []
    for grp, time, *_ in events:
        for w in windows:
            inside = [] if time is None else [e for e in events if e[0] == grp and e[1] is not None and time - w <= e[1] < time]
            chars = sorted(c for _, _, c, _ in inside if c is not None)
            m = len(chars)
            pick = lambda p: chars[-(-p * m // 100) - 1] if m else None
            out.append((grp, time, w, len(inside), sum(chars), len({x for *_, x in inside if x is not None}), pick(50), pick(75)))
    return out


@pytest.mark.parametrize("block", [None, 7, 1000])
def test_rolling_windows_against_all_pairs(spark, block):
    rng = random.Random(5)
    events = [(rng.choice(["a", "a", "b", None]), rng.choice([None, rng.randrange(-300, 300)]), rng.choice([None, 0, rng.randrange(30)]), rng.choice(["x", "y", "z", None])) for _ in range(400)]
    events += [("a", 50, 9, "x")] * 150  # one time of a third of the rows
    got = rolling.rolling_windows(spark.createDataFrame(events, "grp string, time long, chars long, lang string"), (20, 100), block)
    got = {(r.grp, r.time, *w) for r in got.collect() for w in r.per}
    assert got == {r for r in plain_windows(events, (20, 100)) if r[1] is not None}


def test_rolling_features_of_odd_documents(spark):
    rows = odd_docs()
    when = lambda i: None if i is None or i < -(1 << 60) else 60 * ((i + zlib.crc32(str(i).encode()) % 4000) // 6)
    events = [(s, when(i), None if x is None else len(x), lang) for i, x, s, lang in rows]
    want = sorted(((i, w, t, n, c, k, a, b) for (i, *_), r in zip(rows, zip(*[iter(plain_windows(events, rolling.WINDOWS))] * 2)) for _, t, w, n, c, k, a, b in r), key=str)
    clash = docs(spark, rows).withColumns({c: F.lit(1) for c in ("grp", "time", "block", "per", "n", "r_grp", "event_s", "window_s", "w")})
    assert sorted(map(tuple, rolling.rolling_features(clash).collect()), key=str) == want
    assert rolling.rolling_features(docs(spark, [])).count() == 0


# ---- whitening


def plain_whitening(vectors, k):
    x = np.floor(64 * np.asarray(vectors, float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(0)
    y = x - total / n
    v = (y.T @ y) / n
    values, axes = np.linalg.eigh(v)
    order = np.argsort(values)[::-1][:k]
    return y @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum(), ((n * x - total) ** 2).sum(1)


@pytest.mark.parametrize("width", [5, 16, 40])
def test_whitening_against_numpy(spark, width):
    rng = np.random.default_rng(width)
    v = (rng.normal(size=(3000, width)) @ rng.normal(size=(width, width))).round(3).astype(np.float32)
    v[100:1100] = v[7]  # a third of the rows are equal
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(v)]
    bad = [(-1, None), (-2, [float("nan")] * width), (-3, [None] + [1.0] * (width - 1)), (-4, [float("-inf")] * width), (-5, [1.0]), (-6, []), (-7, [1e30] * width)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumns({c: F.lit("c") for c in ("v", "id", "n", "component", "label")})
    got = whitening.whiten(df.repartition(5)).toPandas().sort_values(["vec_id", "component"])
    k = min(32, width)
    want, share, deviation = plain_whitening(v, k)
    assert len(got) == 3000 * k and set(got.n) == {3000} and got.vec_id.min() == 0
    w = got.whitened.to_numpy().reshape(3000, k)
    assert np.abs(w * np.sign((w * want).sum(0)) - want).max() < 1e-8
    assert np.allclose(got.explained.to_numpy().reshape(3000, k), share, rtol=1e-9) and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    assert (got.deviation.to_numpy().reshape(3000, k)[:, 0] == deviation).all()


def test_whitening_of_few_and_of_equal_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(make([])).count() == 0 and whitening.whiten(make([(1, None)])).count() == 0
    assert whitening.whiten(make([(1, [1.0, 2.0])] * 3)).count() == 0
    line = whitening.whiten(make([(None, [0.0, 0.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [r.component for r in line] == [1, 1, 1] and sorted(r.vec_id or 0 for r in line) == [0, 2, 2] and all(abs(r.explained - 1) < 1e-12 for r in line)


def test_deviations_beyond_a_long_are_null():
    w = whitening.Whitening(3, [6, 9], np.eye(2), 2)
    assert w.deviation(np.array([[2, 3], [4, 3]])) == [0, 36]
    huge = whitening.Whitening(1 << 31, [0, 0], np.eye(2), 2)
    assert huge.deviation(np.array([[1, 0], [1 << 30, 0], [1 << 31, 0]])) == [1 << 62, None, None]


# ---- what the other operators promise about memory, spread and parameters


def test_risk_and_gradient_of_the_classifier_against_finite_differences(monkeypatch):
    rng = np.random.default_rng(2)
    positive, unlabelled = rng.normal(0.6, 1, (80, quality.BINS + quality.EXTRA)).astype(np.float32), rng.normal(0, 1, (120, quality.BINS + quality.EXTRA)).astype(np.float32)
    caught = []
    monkeypatch.setattr(quality, "_adam", lambda gradient, size, steps, rate=0.05: caught.append(gradient) or np.zeros(size))
    prior, decay = 0.7, 3e-3
    quality.fit(positive, unlabelled, prior, decay=decay)
    (gradient,) = caught
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + np.float32(1e-2)
    p, u = (np.hstack([(x - mean) / scale, np.ones((len(x), 1))]).astype(float) for x in (positive, unlabelled))

    def parts(w):
        loss = lambda z: np.mean([max(v, 0) + np.log1p(np.exp(-abs(v))) for v in z])
        return prior * loss(-(p @ w)), loss(u @ w) - prior * loss(p @ w), 0.5 * decay * (w[:-1] @ w[:-1])

    seen = set()
    for strength in (0.0, 0.002, 0.05):
        w = strength * (p.mean(0) - u.mean(0)) + 0.001 * rng.normal(size=p.shape[1])
        good, negative, shrink = parts(w)
        # where the estimate of the negative risk is below zero, the step goes up it alone
        goal = (lambda v: sum(parts(v))) if negative >= 0 else (lambda v: parts(v)[2] - parts(v)[1])
        seen.add(negative >= 0)
        got = np.asarray(gradient(w), float)
        for k in (0, 1, 7, 500, p.shape[1] - 1):
            step = np.zeros(len(w))
            step[k] = 1e-4
            assert abs((goal(w + step) - goal(w - step)) / 2e-4 - got[k]) < 2e-4
    assert seen == {True, False}


def test_owners_and_repositories_are_parameters(spark):
    value, key = "Ab1" * 8, "secret=Qq7Qq7Qq7Qq7"
    rows = [(k, f"x {value} {key}", "same", "en", f"team{k % 2}", f"repo{k}") for k in range(3)] + [(k, f"{key} {value} y", "same", "en", f"team{k}", "r") for k in range(10, 13)]
    rows += [(20, "only here Zz9Zz9Zz9Zz9Zz9Zz9Zz9Zz9", "same", "en", "team0", "repo9")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, team string, repo string")
    by_source = {r.doc_id: r for r in secret_scan.find_secrets(df).collect()}
    assert all(len(r.added) == 1 for r in by_source.values()) and by_source[0].live
    by_team = {r.doc_id: r for r in secret_scan.find_secrets(df, owner_col="team", repository_cols=("repo",)).collect()}
    # five teams carry the value and the key: copied examples; the last value is one team's own
    assert [k for k, r in by_team.items() if r.added] == [20] and not any(r.live for r in by_team.values())
    assert sum(len(r.base) for r in by_team.values()) == 6


def test_benchmarks_travel_as_codes_and_slices_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**9)}" for _ in range(30000)]
    items = pa.table({"item_id": [str(i) for i in range(100)], "text": [" ".join(words[i : i + 300]) for i in range(0, 30000, 300)]})
    tests = decontamination.TestSuffixes(items, 13)
    assert len(pickle.dumps(tests)) < 24 * len(words) and len(tests.windows[0]) == 100 * 288
    docs_ = spark.createDataFrame([(k, " ".join(words[k * 100 : k * 100 + 40] + ["other"] * 20 + words[k : k + 12])) for k in range(60)] + [(99, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, x) for i, x in zip(*items.to_pydict().values())] + [("short", "other other"), ("empty", "")], "item_id string, text string")
    found = lambda: sorted(map(tuple, decontamination.contamination(docs_, bench).collect()))
    want = found()
    monkeypatch.setattr(decontamination, "SEARCHED", 7)
    assert found() == want and sum(r[5] for r in want) == 60


def test_own_rows_of_equal_texts_have_keys_of_their_own(spark):
    hot = spark.sparkContext.broadcast((np.zeros(0, np.uint64), np.zeros(0, np.int32)))
    df = spark.createDataFrame([(k % 3, "the same text" if k % 2 else "") for k in range(1000)], "doc_id long, text string")
    rows = df.mapInArrow(token_counts._document_rows(hot), "doc_id long, version long, n_bytes long, h long, freq long, known long, own boolean").where("own")
    spread = rows.coalesce(1).groupBy("h").count().agg(F.max("count"), F.count("*")).first()
    assert spread[0] <= 8 and spread[1] >= 125  # a batch's rows differ; two batches may agree
    import public_tokenizers

    got = token_counts.count_tokens(df, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(got) == 1000 and len({(r.n_bytes, r.n_tokens) for r in got}) == 2


def test_buckets_follow_the_bytes_of_the_texts(spark, monkeypatch):
    df = spark.createDataFrame([(k, "one two three four five " * 200) for k in range(300)], "doc_id long, text string")
    monkeypatch.setattr(_repeats, "BUCKET_TEXT", 1 << 15)
    ranges = _repeats._ranges(df, recompression_dedup.RecompressionSampler(13), False)
    assert ranges.buckets >= 300 * 4800 / (1 << 15)
