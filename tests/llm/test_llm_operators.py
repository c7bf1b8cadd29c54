"""The operators against brute force on small fixtures, with nulls, ties, repeats, empty tables and clashing names."""

import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorate.llm import chats, components, embeddings, lines, mixing, ngram_join, packing, quality, rules, shards, stats, url_filter
from quorate.llm.common import n_words

DOCS = "doc_id long, text string, source string, size int, stats int, n_dropped int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, 3) for i, t, s in rows], DOCS)


LONG = " ".join(f"w{i % 997} x{i}" for i in range(30_000))
ODD = [(1, "alpha beta gamma", "a"), (2, None, None), (3, "", "a"), (None, "alpha beta gamma", "b"), (4, LONG, "b"), (5, " \t\n", None),
       (1, "alpha beta gamma", "a"), (6, "Ärger größer ☃ tail", "c")]


def union_find(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 3), (200, 201), (201, 200), (7, 7), (None, 1)] + [(500, i) for i in range(600, 700)]
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in [*range(1, 41), 100]}, 200: 200, 201: 200, **{i: 500 for i in [500, *range(600, 700)]}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_differencing_is_tight():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 10_000, 3000)
    load = np.bincount(shards.difference(sizes, 24), sizes, 24)
    assert load.max() - load.min() <= 2
    assert sorted(np.bincount(shards.difference(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])) == [14, 16]  # the known answer of the method
    assert len(shards.difference(np.zeros(0, np.int64), 3)) == 0


def test_shards(spark):
    got = shards.shard_texts(docs_of(spark, ODD), n_shards=3).collect()
    assert len(got) == len(ODD)
    assert sum(r["size"] for r in got) == sum(8 + len((t or "").encode()) for _, t, _ in ODD)
    by_text = defaultdict(set)
    for r in got:
        by_text[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values())
    for s in {r["shard"] for r in got}:
        at = sorted(r["slot"] for r in got if r["shard"] == s)
        assert at == list(range(len(at)))
    assert shards.shard_texts(docs_of(spark, [])).count() == 0


def test_shards_in_levels(spark):
    """More items than one task takes: bundles, and a group larger than a shard alone in its shard."""
    rows = [(i, f"text {i} " * (1 + i % 13), "a") for i in range(600)] + [(1000 + i, "same " * 50, "a") for i in range(900)]
    got = shards.shard_texts(docs_of(spark, rows), n_shards=4, items_per_task=20).groupBy("shard").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    big = max(got, key=lambda r: r["n"])
    rest = [r["size"] for r in got if r is not big]
    assert big["n"] >= 900 and len(got) == 4 and max(rest) <= 1.05 * min(rest)


def test_mix(spark):
    rows = [(i, "w " * (1 + i % 7), "abc"[i % 3] if i % 5 else None) for i in range(300)] + ODD
    got = mixing.mix(docs_of(spark, rows), n_words(F.col("text")), rows_per_bucket=20).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    taken, target = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    again = mixing.mix(docs_of(spark, rows), n_words(F.col("text")), rows_per_bucket=1000)
    assert Counter(tuple(r) for r in again.collect()) == Counter(tuple(r) for r in got)  # cutting into ranges changes nothing
    assert mixing.mix(docs_of(spark, []), n_words(F.col("text"))).count() == 0


def test_targets_by_water_filling(spark):
    sizes = {"a": 1000, "b": 10, "c": 1, "d": 300, None: 0}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [1, 2, 3, 1, 2]))
    open_, left, want = set(sizes), float(sum(sizes.values())), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not over:
            want |= {s: level * weight[s] for s in open_}
            break
        want |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3.0 * sizes[s] for s in over)
        open_ -= over
    assert got == pytest.approx(want)


@pytest.mark.parametrize("per_bucket", [20_000, 11])
def test_repeat_documents(spark, per_bucket):
    """The corpus holds of each document what `mix` takes of it, whatever the partitioning."""
    rows = [(i, f" start {'w ' * (i % 9)}end", "ab"[i % 2]) for i in range(80)] + ODD
    docs = docs_of(spark, rows)
    size = n_words(F.col("text"))
    taken = mixing.mix(docs, size, rows_per_bucket=per_bucket)
    out = mixing.repeat_documents(docs, size, rows_per_bucket=per_bucket)
    assert out.columns == docs.columns
    want = {(r[0], r[1]): r[2] for r in taken.groupBy("doc_id", "source").agg(F.sum("taken")).where("sum(taken) > 0").collect()}
    assert {(r[0], r[1]): r[2] for r in out.groupBy("doc_id", "source").agg(F.sum(size).alias("n")).where("n > 0").collect()} == want
    assert out.where("text is null").count() == 1
    got = sorted(map(str, out.collect()))
    for n in (1, 3, 8):
        assert sorted(map(str, mixing.repeat_documents(docs.repartition(n), size, rows_per_bucket=per_bucket).collect())) == got
    assert mixing.repeat_documents(docs.limit(0), size).count() == 0


def test_repeated_rows_in_other_columns(spark):
    """Rows equal in id and text but not in source or size column: the same ones stay in any partitioning."""
    rows = [(None, "x y z w", s) for s in "aabbbcd"] + [(7, "p q r", s) for s in "ab"] * 3
    docs = docs_of(spark, rows)
    size = n_words(F.col("text"))
    runs = [sorted(map(str, mixing.repeat_documents(docs.repartition(n), size).collect())) for n in (1, 3, 8)]
    assert runs[0] == runs[1] == runs[2] and runs[0]
    kept = [sorted(map(str, ngram_join.keep_one(docs.repartition(n), ngram_join.Join(2, 80, 100)).collect())) for n in (1, 3, 8)]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 2


@pytest.mark.parametrize("join", [ngram_join.Join(), ngram_join.Join(5, 80, 100), ngram_join.Join(1, 80, 100)])
def test_ngram_join(spark, join):
    rng = np.random.default_rng(2)
    base = [[f"v{x}" for x in rng.integers(0, 60, n)] for n in (3, 9, 12, 20, 21, 30, 60, 200)]
    rows = []
    for b, k in itertools.product(base, range(8)):
        w = list(b)
        for _ in range(k % 4):
            w[rng.integers(len(w))] = f"V{rng.integers(60)}"
        rows.append((len(rows) + 10, " ".join(w[: len(w) - (k // 4)]), "a"))
    rows += ODD
    got = ngram_join.jaccard_components(docs_of(spark, rows), join).collect()
    sets = []
    for _, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i: i + join.words]) for i in range(max(1, len(w) - join.words + 1))) if w else frozenset())
    ok = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2)
          if sets[i] and sets[j] and join.den * len(sets[i] & sets[j]) >= join.num * len(sets[i] | sets[j])]
    root = union_find(len(rows), ok)
    least = defaultdict(lambda: math.inf)
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(least[root[i]], d)
    want = Counter((d, len(s), d if not s else least[root[i]]) for i, ((d, _, _), s) in enumerate(zip(rows, sets)))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    kept = ngram_join.keep_one(docs_of(spark, rows), join)
    assert kept.columns == docs_of(spark, rows).columns
    assert kept.count() == sum(not s for s in sets) + len({root[i] for i, s in enumerate(sets) if s})


def test_parity_bits_are_kept_once_per_set(spark, monkeypatch):
    """Not once per list entry, where they made most of the bytes shuffled."""
    columns, write = {}, ngram_join.stage
    monkeypatch.setattr(ngram_join, "stage", lambda df, name: columns.setdefault(name, df.columns) and write(df, name))
    words = " ".join(f"w{i}" for i in range(80))
    rows = [(i, f"{words} x{i % 3}", "a") for i in range(6)] + [(9, "a b c", "a")]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs_of(spark, rows)).collect()}
    assert got == {**dict.fromkeys(range(6), 0), 9: 9}
    assert [name for name, cols in columns.items() if "b0" in cols] == ["classes"]


@pytest.mark.parametrize("boundary", [12, 25])
def test_subsets_find_all_links_of_small_sets(spark, boundary):
    rng = np.random.default_rng(3)
    join = ngram_join.Join(1, 80, 100)
    base = rng.choice(500, 25, replace=False)
    sets = {i: sorted(set(base[: 5 + i % 20].tolist()) - {int(base[i % 5])} | {int(rng.integers(500, 520))}) for i in range(60)}
    sets = {i: s for i, s in sets.items() if len(s) <= boundary}
    links = ngram_join.subset_links(spark.createDataFrame([(i, len(s), s) for i, s in sets.items()], "sid long, n int, tokens array<long>"), join, boundary)
    ids = list(sets)
    want = [(a, b) for a, b in itertools.combinations(range(len(ids)), 2)
            if 100 * len({*sets[ids[a]]} & {*sets[ids[b]]}) >= 80 * len({*sets[ids[a]]} | {*sets[ids[b]]})]
    got = [(ids.index(r["a"]), ids.index(r["b"])) for r in links.collect()]
    assert {frozenset(p) for p in got} <= {frozenset(p) for p in want}
    groups = lambda e: Counter(Counter(union_find(len(ids), e)).values())
    assert groups(got) == groups(want)


def test_boundary_follows_cost():
    join = ngram_join.Join(3, 90, 100)
    assert ngram_join.light_boundary(join, {5: 10}, {5: 0, 400: 10**6}) == 0
    assert ngram_join.light_boundary(join, {5: 10, 30: 10}, {5: 10**5, 30: 100}) == 5


def test_lines(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(300)]
    base = [" ".join(rng.choice(words, 14)) for _ in range(12)]
    rows = []
    for i in range(60):
        picked = [base[j] for j in rng.integers(0, 12, 3)]
        picked[0] = picked[0].replace(picked[0][20], "Z", 1) if i % 2 else picked[0].upper()
        rows.append((i, "\n".join([*picked, "", "hi"]), "a"))
    rows += [(200, None, "a"), (201, "", "a"), (202, " \n\t", "a"), (None, base[0], "b"), (300, LONG, "b")]
    docs = docs_of(spark, rows)
    got = lines.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "_n_dropped"]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    found = [(d, i, x.decode()) for d, t, _ in order for i, x in enumerate(lines.normal_lines(t)) if x]
    sets = [lines.shingle_set(x) for *_, x in found]
    root = union_find(len(found), [(i, j) for i, j in itertools.combinations(range(len(found)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    seen, gone = set(), Counter()
    for i, (d, *_) in enumerate(found):
        gone[d] += root[i] in seen
        seen.add(root[i])
    result = {r["doc_id"]: r for r in got.collect()}
    assert {d: r["_n_dropped"] for d, r in result.items()} == {d: gone[d] for d, *_ in rows}
    assert result[200]["text"] is None and result[201]["text"] == "" and result[300]["text"] == LONG
    assert lines.dedup_lines(docs_of(spark, [])).count() == 0


def test_band_recall():
    """Pairs at the threshold share a band nearly always."""
    rng = np.random.default_rng(5)
    hit = n = 0
    while n < 400:
        a = "".join(rng.choice(list("abcdefghijklmnop "), 200))
        b = list(a)
        for _ in range(3):
            b[rng.integers(200)] = "#"
        s, t = lines.shingle_set(a), lines.shingle_set("".join(b))
        if not 0.8 <= len(s & t) / len(s | t) < 0.86:
            continue
        k = lines.band_keys([a.encode(), "".join(b).encode()])
        hit, n = hit + bool((k[0] == k[1]).any()), n + 1
    assert hit / n >= 0.985


def test_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(20, 12))
    rows = [(i, (base[i % 20] + 0.12 * rng.normal(size=12) * (i % 3)).tolist(), "x") for i in range(260)]
    rows += [(1000, None, "x"), (1001, [0.0] * 12, "x"), (1002, [float("nan")] * 12, "x"), (1003, [None] * 12, "x"), (1004, [], "x"),
             (1005, [1.0, 2.0], "x"), (1006, [2.0, 4.0], "x"), (1007, base[0].tolist(), "x"), (1008, (base[0] * 1e-200).tolist(), "x"), (1009, [float("inf")] * 12, "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string")
    for tile in (16, 2048):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(frame, tile=tile).collect()}
        fine = [(i, np.array(v)) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
        unit = [v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for _, v in fine]
        links = [(p, q) for p, q in itertools.combinations(range(len(fine)), 2) if len(unit[p]) == len(unit[q]) and unit[p] @ unit[q] >= 0.95]
        root, count = union_find(len(fine), links), Counter(x for p in links for x in p)
        low = {r: min(fine[i][0] for i in range(len(fine)) if root[i] == r) for r in set(root)}
        want = {i: (0, i, True) for i, *_ in rows} | {fine[i][0]: (count[i], low[root[i]], low[root[i]] == fine[i][0]) for i in range(len(fine))}
        assert got == want
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(3000).select(F.concat(F.lit("h"), "id").alias("key"))
    listed = spark.range(0, 3000, 7).select(F.concat(F.lit("h"), "id").alias("key")).unionByName(spark.createDataFrame([("elsewhere",), (None,)], "key string"))
    cascade = url_filter.build_cascade(universe, listed, bits_per_key=2)
    assert len(cascade.levels) > 2
    got = {r["key"] for r in universe.where(cascade.holds(F.col("key"))).collect()}
    assert got == {f"h{i}" for i in range(0, 3000, 7)}
    assert url_filter.build_cascade(universe, listed, max_bits=64) is None
    assert universe.where(url_filter.build_cascade(universe, listed.limit(0)).holds(F.col("key"))).count() == 0


def test_urls(spark):
    urls = ["http://A.Example.org/es/x?q", "https://example.org/en/12", "x://org", "x://org/", "no scheme", None, "", "http://spam.com/p#f", "http://m.spam.com/de/", "http://spam.community/"]
    frame = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rule = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("block", "com", "/de/"))
    listed = spark.createDataFrame([("spam.com",)], "key string")
    for bits in (url_filter.MAX_FILTER_BITS, 1):
        got = [tuple(r)[1:] for r in url_filter.judge(frame, rule, listed, max_bits=bits).orderBy("page_id").collect()]
        assert got == [("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("org", "", None, "allow"),
                       ("org", "/", "org/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
                       ("spam.com", "/p", None, "block"), ("m.spam.com", "/de/", "com/de/", "block"), ("spam.community", "/", None, "allow")]
    assert url_filter.judge(frame.limit(0), rule, listed).count() == 0


def test_packing_spreads_equal_rows(spark):
    frame = docs_of(spark, [(None, "one text", "a")] * 300 + [(None, None, None)] * 100)
    got = packing.pack(frame, n_words(F.col("text")), F.col("source"), F.md5("text"), capacity=16, pieces_per_task=50).collect()
    slices = Counter(r["bin_id"].split("-")[0] for r in got)
    assert len(got) == 400 and len(slices) == 8 and max(slices.values()) < 100
    assert Counter(r["size"] for r in got) == {2: 300, 0: 100}
    assert len({r["bin_id"] for r in got if r["size"] == 2}) == 300


def test_empty_host_is_on_no_list(spark):
    """The level 1 filter of these four hosts has all bits of the empty string."""
    hosts = ["www.adult-x.example.net", "m.adult-x.example.net", "blog.adult-x.example.net", "blog.ads-track.example.net"]
    universe = spark.createDataFrame([(h,) for h in hosts], "key string")
    empty = spark.createDataFrame([("",)], "key string")
    assert empty.where(url_filter.build_cascade(universe, universe).holds(F.col("key"))).count() == 1
    urls = [f"http://{h}/p" for h in hosts] + [None, "no scheme", "", "http:///p"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([("adult-x.example.net",), ("ads-track.example.net",)], "key string")
    for bits in (url_filter.MAX_FILTER_BITS, 1):
        got = [r["verdict"] for r in url_filter.judge(pages, (), listed, max_bits=bits).orderBy("page_id").collect()]
        assert got == ["block"] * 4 + ["allow"] * 4


def test_chats(spark):
    say = lambda c, *turns: [(c, i, r, t, "x") for i, (r, t) in enumerate(turns)]
    u, a = ("user", "hi"), ("assistant", "yo")
    rows = say(1, u) + say(2, u, a) + say(3, u, a, u) + say(4, u, a, u) + say(5, a, u) + say(6, u, ("assistant", None)) + say(7, u, ("assistant", "")) + say(None, u)
    rows += [(8, None, None, None, "x"), (8, 0, "user", "hi", "x"), (8, 0, "user", "hi", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos string")
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"], r["rendered"]) for r in chats.format_chats(frame).collect()}
    assert set(got) == {3, 5, 6, 7, 8}
    assert got[3] == (3, 2, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n")
    parts = chats.format_chats(frame, turns_per_part=2).where("conv_id = 3").orderBy("part").collect()
    assert [r["part"] for r in parts] == [0, 1] and "".join(r["rendered"] for r in parts) == got[3][2]
    assert chats.format_chats(frame.limit(0)).count() == 0


def test_packing(spark):
    rng = np.random.default_rng(7)
    rows = [(2000 + i, "w " * int(rng.integers(0, 60)), f"s{i % 7}" if i % 5 else "hot") for i in range(400)] + [(900 + i, "same text", f"s{i}") for i in range(30)] + ODD
    frame = docs_of(spark, rows)
    for per_task in (50, 10_000):
        got = packing.pack(frame, n_words(F.col("text")), F.col("source"), F.md5(F.col("text").cast("binary")), capacity=64, pieces_per_task=per_task)
        assert got.agg(F.sum("size")).first()[0] == sum(len((t or "").encode().split()) for _, t, _ in rows)
        bins = got.groupBy("bin_id").agg(F.sum("size").alias("n"), F.max(F.col("offset") + F.col("size")).alias("end"), F.count("*").alias("pieces"))
        assert bins.where("n > 64 or end > 64").count() == 0
        pieces = got.join(frame.select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("c")).distinct(), "doc_id").where("size < 64")
        for c in ("source", "c"):
            assert pieces.where(f"{c} is not null").groupBy("bin_id", c).count().where("count > 1").count() == 0
    assert packing.pack(docs_of(spark, []), n_words(F.col("text")), F.col("source"), F.col("text")).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = np.random.default_rng(8)
    sizes = np.sort(rng.integers(1, 40, 500))[::-1]
    keys = [[int(rng.integers(0, 4)), 10 + int(rng.integers(0, 200))] for _ in sizes]
    got, offset = packing.best_fit(sizes, keys, 64)
    room, has = [], []
    for i, s in enumerate(sizes):
        fits = [b for b in range(len(room)) if room[b] >= s and not has[b] & set(keys[i])]
        if fits:
            assert room[got[i]] == min(room[b] for b in fits) and not has[got[i]] & set(keys[i])
        else:
            assert got[i] == len(room)
            room.append(64)
            has.append(set())
        assert offset[i] == 64 - room[got[i]]
        room[got[i]] -= s
        has[got[i]] |= set(keys[i])


def test_repeated_words_by_brute_force():
    rng = np.random.default_rng(9)
    for n in (0, 7, 8, 9, 16, 40, 200):
        w = [b"abc"[x: x + 1] for x in rng.integers(0, 2, n)] if n < 100 else [b"%d" % x for x in np.tile(rng.integers(0, 500, 100), 2)]
        windows = Counter(tuple(w[i: i + 8]) for i in range(n - 7))
        inside = {j for i in range(max(0, n - 7)) if windows[tuple(w[i: i + 8])] > 1 for j in range(i, i + 8)}
        assert stats.repeated_words(w) == len(inside)
    assert stats.describe(None)[:5] == (0, 0, 0, 0, 0) == stats.describe("")[:5]
    assert stats.describe("ä b#\nx\nx \nx")[:5] == (5, 6, 1, 1, 0)


def labelled(spark, n=900):
    rng = np.random.default_rng(10)
    rows = []
    for i in range(n):
        words = rng.choice(["the", "river", "runs", "over", "old", "stones", "and", "under", "bridges"], 40)
        text = ". ".join(" ".join(words[j: j + 8]).capitalize() for j in range(0, 40, 8)) + "."
        rows.append((i, text if i % 4 else " ".join(f"{w}{'#$%'[i % 3] * 3}" for w in words), "a"))
    return docs_of(spark, rows + ODD), spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(n)] + [(1, 0, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = labelled(spark)
    got = quality.classify(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    held = got.where("held_out").join(labels.where("doc_id > 10"), "doc_id")
    assert held.count() > 200 and held.where("predicted <> quality").count() <= 0.02 * held.count()
    assert got.where("score is null or score < 0 or score > 1").count() == 0 and got.count() == docs.count()
    kept = quality.keep_accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == got.where("predicted = 1").count()
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_rules(spark):
    docs, labels = labelled(spark)
    got = rules.judge(docs, labels)
    held = got.where(quality.held_out(F.col("doc_id"))).join(labels.where("doc_id > 10"), "doc_id")
    assert held.where("not base_failed and kept <> (quality = 1)").count() <= 0.02 * held.count()
    bare = {r["doc_id"]: (r["n_words"], r["base_failed"], r["kept"]) for r in rules.judge(docs_of(spark, ODD), labels.limit(0)).collect()}
    assert bare[2] == (0, True, False) and bare[4] == (60_000, False, True)
    assert rules.judge(docs.limit(0), labels).count() == 0
