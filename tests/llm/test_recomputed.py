"""op1, op9, op10 and the pipeline recomputed without Spark, on the odd small folder and on small fixtures."""

import re
import shutil
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quorate.llm import ngram_join, quality, rules, shards
from quorate.llm.common import n_words, read
from quorate.llm.queries import QUERIES
from tools.check_oracles import TABLES

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, note string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small tables with copies, null ids, null and blank texts, null sources and a column of their own."""
    out = str(tmp_path_factory.mktemp("recomputed"))
    for t in TABLES:
        if t != "documents":
            shutil.copy(f"{SMALL}/{t}.parquet", out)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("note", F.lit("n"))
    copies = docs.where("doc_id % 7 = 0").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    odd = docs.where("doc_id % 11 = 0").withColumn("doc_id", F.col("doc_id") + 2_000_000).withColumn("source", F.lit(None).cast("string"))
    odd = odd.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.lit(" \n\t")))
    lost = docs.where("doc_id % 13 = 0").withColumn("doc_id", F.lit(None).cast("long"))
    lost = lost.unionByName(lost.withColumn("source", F.lit("other"))).unionByName(lost)
    docs.unionByName(copies).unionByName(odd).unionByName(lost).coalesce(3).write.parquet(f"{out}/documents.parquet")
    return out


def rows_of(spark, folder, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select(*columns).collect()]


# op1

def textbook(sizes, k):
    """k-way differencing with whole partitions in hand: the two with the largest spread are combined, oppositely ordered."""
    parts = [([(s, [i])] + [(0, [])] * (k - 1), i) for i, s in enumerate(sizes)]
    n = len(sizes)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[0][0][0] - p[0][-1][0]), p[1]))
        (a, _), (b, _) = parts[0], parts[1]
        both = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, b[::-1])]
        both.sort(key=lambda x: -x[0])
        parts = parts[2:] + [(both, n)]
        n += 1
    return [x[1] for x in parts[0][0]]


def test_differencing_like_the_textbook():
    rng = np.random.default_rng(4)
    for n, k, top in ((5, 2, 9), (30, 3, 1000), (80, 24, 10_000), (200, 5, 50), (3, 7, 10)):
        sizes = rng.integers(1, top, n)
        got = Counter(np.bincount(shards.difference(sizes, k), sizes, k).astype(int).tolist())
        assert got == Counter(int(sum(sizes[i] for i in part)) for part in textbook(sizes.tolist(), k))


def test_op1_recomputed(spark, folder):
    docs = rows_of(spark, folder, "doc_id", "text")
    got = [r.asDict() for r in QUERIES["op1_shards"](spark, folder).collect()]
    size = lambda t: len((t or "").encode()) + 8
    want = Counter((i, size(t), None if t is None else zlib.crc32(t.encode())) for i, t in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    groups = defaultdict(int)
    for _, t in docs:
        groups[t] += size(t)
    loads = Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    best = textbook(sorted(groups.values(), reverse=True), 24)
    sizes = sorted(groups.values(), reverse=True)
    assert sorted(loads.values()) == sorted(sum(sizes[i] for i in part) for part in best)
    homes = defaultdict(set)
    for r in got:
        homes[(r["size"], r["text_crc32"])].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(len(s) == 1 for s in homes.values())
    for shard in range(24):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))


# op9

def is_held_out(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 3 == 1


def test_op9_recomputed(spark, folder):
    """Means, shrunk covariances and log densities by plain numpy, without Cholesky factors."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r[0], np.array(r[1])) for r in docs.select("doc_id", quality.text_features(F.col("text"))).collect()]
    labels = defaultdict(set)
    for i, q in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").collect():
        labels[i].add(q)
    learn = [(x, next(iter(labels[i]))) for i, x in rows if i is not None and not is_held_out(i) and len(labels[i]) == 1]
    by = {k: np.array([x for x, y in learn if y == k]) for k in (0, 1)}
    n = len(learn)
    scatter = {k: (by[k] - by[k].mean(axis=0)).T @ (by[k] - by[k].mean(axis=0)) for k in by}
    pooled = (scatter[0] + scatter[1]) / n
    density = {}
    for k in by:
        cov = (1 - quality.SHRINK) * scatter[k] / len(by[k]) + quality.SHRINK * pooled + quality.RIDGE * np.diag(np.maximum(np.diag(pooled), 1e-6))
        inverse, (_, log_det) = np.linalg.inv(cov), np.linalg.slogdet(cov)
        density[k] = lambda x, inverse=inverse, log_det=log_det, m=by[k].mean(axis=0), w=len(by[k]) / n: np.log(w) - log_det / 2 - (x - m) @ inverse @ (x - m) / 2
    want = sorted((str(i), is_held_out(i), 1 / (1 + np.exp(-(density[1](x) - density[0](x)) / len(x)))) for i, x in rows)
    got = sorted((str(r["doc_id"]), r["held_out"], r["score"]) for r in QUERIES["op9_quality"](spark, folder).collect())
    assert len(got) == len(want)
    for (i, h, s), (j, g, t) in zip(got, want):
        assert i == j and h == g and abs(s - t) < 1e-6
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in QUERIES["op9_quality"](spark, folder).collect())


# op10

def test_op10_recomputed(spark, folder):
    """Base counts from the text by plain Python; the learned list applied condition by condition, in order."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = read(spark, folder, "labels")
    stats = docs.select("doc_id", rules.text_stats(F.col("text")).alias("stats"))
    learned = rules.fit_rules(stats, labels)
    numbers = Counter()
    for r in stats.collect():
        s = r["stats"].asDict()
        first = next((n for n, rule in enumerate(learned, 1) if all((s[c.name] > c.cut) == c.above for c in rule)), 0)
        numbers[(r["doc_id"], *(s[c] for c in rules.COUNTS), first)] += 1
    got = QUERIES["op10_rules"](spark, folder).collect()
    assert Counter((r["doc_id"], *(r[c] for c in rules.COUNTS), r["rule"]) for r in got) == numbers

    def counts(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[i: i + 8]) for i in range(len(words) - 7)]
        twice = {w for w, k in Counter(windows).items() if k > 1}
        inside = {j for i, w in enumerate(windows) if w in twice for j in range(i, i + 8)}
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)

    texts = defaultdict(set)
    for i, t in rows_of(spark, folder, "doc_id", "text"):
        texts[i].add(counts(t))
    for r in got:
        assert tuple(r[c] for c in rules.COUNTS) in texts[r["doc_id"]]
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["rule"] == 0)


# the pipeline, stage by stage

def shingle_sets(texts, k):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[i: i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    return out


def test_near_copies_stage_recomputed(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    sets = shingle_sets([r[1] for r in rows], 5)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    tried = set()
    for members in holders.values():
        for a in members:
            for b in members:
                if a < b and (a, b) not in tried:
                    tried.add((a, b))
                    if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        parent[find(a)] = find(b)
    groups = {find(i) for i in range(len(rows)) if sets[i]}
    kept = corpus_pipeline.drop_near_copies(spark, docs, folder)
    texts = [r["text"] for r in kept.collect()]
    assert kept.columns == docs.columns and len(texts) == len(groups) + sum(not s for s in sets)
    place = {(r[0], r[1], r[3]): find(i) for i, r in enumerate(rows) if sets[i]}
    found = [place[(r["doc_id"], r["text"], r["source"])] for r in kept.collect() if (r["text"] or "").split()]
    assert len(found) == len(set(found)) == len(groups)


def test_quality_stage_recomputed(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    verdicts = Counter((r["doc_id"], r["predicted"]) for r in quality.classify(docs, read(spark, folder, "labels")).collect())
    kept = Counter(r["doc_id"] for r in corpus_pipeline.accept_quality(spark, docs, folder).collect())
    assert kept == Counter({i: n for (i, p), n in verdicts.items() if p == 1})


def test_pipeline_reruns_agree_and_takes_nothing(spark, folder):
    first = sorted(map(str, corpus_pipeline.run(spark, folder).collect()))
    assert first and first == sorted(map(str, corpus_pipeline.run(spark, folder).collect()))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    empty = docs.limit(0)
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, empty, folder).count() == 0, name
    nameless = docs.where("doc_id is null")
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, nameless, folder)
        assert out.columns == docs.columns, name
    assert ngram_join.keep_one(nameless, ngram_join.Join(5, 80, 100)).where(n_words(F.col("text")) > 0).count() < nameless.count()
