"""Divergence audit, manifest and language identification on small fixtures, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorate.llm import divergence, langid, manifest
from quorate.llm.queries import ORACLES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, term string, idx int, n int, tree string, rank int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x", 1, 2, "y", 3) for i, t, lang, s in rows], DOCS)


# divergence

def brute_audit(rows, min_docs, top):
    terms = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", s or "", [t.translate(lower) for t in terms.findall(text or "")]) for _, text, lang, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in seen.items() if n >= min_docs)

        def shares(words):
            c = Counter(w for w in words if seen[w] >= min_docs)
            total = sum(c.values())
            return c, {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        price = lambda p, q: (p - q) ** 2 // (p + q)
        groups = {s: shares([w for d in mine if d[1] == s for w in d[2]]) for s in {d[1] for d in mine}}
        _, whole = shares([w for d in mine for w in d[2]])
        for s, (c, p) in groups.items():
            parts = {"pair": [(sum(price(p[t], q[t]) for t in kept), o) for o, (_, q) in groups.items() if o != s],
                     "term": [(price(p[t], whole[t]), t) for t in kept if c[t] > 0 and p[t] > whole[t]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, r + 1) for r, (value, item) in enumerate(items) if part == "pair" or r < top]
    return sorted(out)


def test_divergence_like_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)] + ["Straße", "ÉTÉ", "naïve", "日本"]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 60))) + rng.choice(["", "!", " 12,x-Y"]),
             rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "c", None, ""])) for i in range(400)]
    rows += [(None, None, "en", "only null"), (7, "", "xx", "a"), (7, None, "xx", "b"), (8, "the " * 50_000, "en", "a"), (8, "the " * 50_000, "en", "a")]
    for block, tile, cut in ((divergence.BLOCK, divergence.TILE, divergence.SLICE), (16, 2, 3)):
        monkeypatch.setattr(divergence, "BLOCK", block)
        monkeypatch.setattr(divergence, "TILE", tile)
        monkeypatch.setattr(divergence, "SLICE", cut)
        got = sorted(map(tuple, divergence.audit(docs_of(spark, rows), min_docs=3, top=4).collect()))
        assert got == brute_audit(rows, 3, 4)
    assert divergence.audit(docs_of(spark, [])).count() == 0
    none_kept = divergence.audit(docs_of(spark, [(1, "one", "en", "a"), (2, "two", "en", "b")]))
    assert sorted(map(tuple, none_kept.collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_divergence_takes_another_price(spark):
    rows = [(i, "a b c" if i % 2 else "a a d", "en", "xy"[i % 2]) for i in range(20)]
    built_in = divergence.audit(docs_of(spark, rows)).collect()
    same = divergence.audit(docs_of(spark, rows), price=lambda p, q: (p - q) ** 2 // (p + q)).collect()
    assert sorted(built_in) == sorted(same) and len(built_in) > 2


def test_counts_are_flushed(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    rows = [(i, f"a b c{chr(97 + i)} a", "en", "s") for i in range(10)]
    frame = docs_of(spark, rows).select("lang", "source", "text")
    got = divergence.term_counts(frame).groupBy("term").agg(F.sum("n"), F.sum("docs")).where("term in ('a', 'b')").collect()
    assert sorted(map(tuple, got)) == [("a", 20, 10), ("b", 10, 10)]


# manifest

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(leaves):
    """(root, path of siblings per leaf) level by level."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i: i + 16])) for i in range(0, len(below), 16)])
    paths = []
    for i in range(len(leaves)):
        path, at = [], i
        for level in levels[:-1]:
            run = level[at // 16 * 16: at // 16 * 16 + 16]
            path.append(("".join(run[: at % 16]), "".join(run[at % 16 + 1:])))
            at //= 16
        paths.append(path)
    return levels[-1][0], paths, levels


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 33, 255, 256, 257, 4095, 4096, 4097, 5000])
def test_postorder_positions(n):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    root, paths, levels = brute_tree([x.hex() for x in leaves])
    log = manifest.write_log(leaves)
    assert len(log) == manifest.DIGEST * sum(map(len, levels)) == manifest.DIGEST * manifest.log_size(n)
    for level, nodes in enumerate(levels):
        at = manifest.position(level, np.arange(len(nodes)), n)
        assert [log[p * 32: p * 32 + 32].hex() for p in at] == nodes
    assert log[-32:].hex() == root
    for i in {0, n // 2, n - 1}:
        assert manifest.proof_at(log, i, n) == paths[i]
        assert manifest.fold(leaves[i].hex(), paths[i]) == root


def test_manifest_like_brute_force(spark, monkeypatch):
    """Small segments, so that several rounds of builders are needed."""
    monkeypatch.setattr(manifest, "LEVELS", 1)
    monkeypatch.setattr(manifest, "SEGMENT", 16)
    monkeypatch.setattr(manifest, "ROWS_PER_RANGE", 100)
    rng = random.Random(5)
    rows = [(i, rng.choice(["Text A", "größe É", "", None]) if i % 3 else f"T{i}", "en", rng.choice([None, "", "a", "a", "a", "é", "z"])) for i in range(900)]
    rows += [(None, "N", None, "a"), (None, "N", None, "a"), (None, None, None, "lone"), (5, "Same", "en", "z"), (5, "Same", "en", "z"), (5, "x" * 300_000 + "Q", "en", "z")]
    docs = docs_of(spark, rows)
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    lower = {"text": F.lower("text")}
    got = manifest.audit(docs, columns, "source", lower, F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False))).collect()

    def leaf(i, t, lang, s, low=False):
        t2 = t.lower() if low and t is not None else t
        fields = (i, s, lang, None if t is None else len(t), t2)
        return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))

    trees = defaultdict(list)
    for r in rows:
        trees[r[3]].append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    want, subroots, inner = [], [], {}
    for s in order:
        mine = sorted(trees[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        inner[s] = (mine, *brute_tree([leaf(*r) for r in mine])[:2])
        subroots.append(inner[s][1])
    root, above, _ = brute_tree(subroots)
    for k, s in enumerate(order):
        mine, subroot, paths = inner[s]
        for r, path in zip(mine, paths):
            whole = path + above[k]
            folded = manifest.fold(leaf(*r, low=r[0] is not None and r[0] % 5 == 0), whole)
            want.append((r[0], leaf(*r), subroot, root, sha("".join(a + b for a, b in whole)), folded, folded == root))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_little(spark):
    columns = ("doc_id", "text")
    audit = lambda rows: manifest.audit(docs_of(spark, rows), columns, "source", {}, F.lit(False)).collect()
    assert audit([]) == []
    one = audit([(3, "x", None, None)])[0]
    assert one["leaf"] == one["subroot"] == one["root"] == sha("1:31:x") and one["proof_sha256"] == sha("") and one["verified"]


# language identification

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ün", "ger", "ach"], "cc": ["eau", "oi", "ç", "ment"]}


def langid_rows(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(5, 60)))
        out.append((i, text, lang, "s"))
    return out


def test_langid_on_held_out_rows(spark):
    rows = langid_rows(900)
    rows += [(10_001, None, "aa", "s"), (10_002, "", "aa", "s"), (10_003, "12 !? 3", "bb", "s"), (None, "schün", None, "s"), (10_004, "GERACH " * 400_000, "bb", "s"),
             (rows[0][0], rows[0][1], rows[0][2], "t"), (10_005, "Жук идёт домой", None, "s")]
    got = langid.identify(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, r in by_id.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode() if i is not None else b"") % 3 == 1)
        assert 0.0 <= r["score"] <= 1.0
    out = [(by_id[i]["lang_pred"], lang) for i, _, lang, _ in rows[:900] if by_id[i]["held_out"]]
    assert len(out) > 200 and sum(a == b for a, b in out) / len(out) >= 0.99
    assert {by_id[i]["lang_pred"] for i in (10_001, 10_002, 10_003)} == {"und"} and by_id[10_003]["score"] == 0.0 and by_id[10_003]["rejected"]
    assert by_id[10_004]["lang_pred"] == by_id[None]["lang_pred"] == "bb" and by_id[10_005]["lang_pred"] in SYLLABLES
    again = {r["doc_id"]: r for r in langid.identify(docs_of(spark, rows).repartition(5)).collect()}
    assert all(again[i]["lang_pred"] == r["lang_pred"] and abs(again[i]["score"] - r["score"]) < 1e-9 for i, r in by_id.items())


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows = langid_rows(300)
    lies = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, "s") for i, t, lang, s in rows]
    a = sorted(map(tuple, langid.identify(docs_of(spark, rows)).collect()))
    b = sorted(map(tuple, langid.identify(docs_of(spark, lies)).collect()))
    assert a == b


def test_langid_without_labels(spark):
    rows = [(1, "abc", None, "s"), (2, None, "aa", "s")]
    assert {r["lang_pred"] for r in langid.identify(docs_of(spark, rows)).collect()} == {"und"}
    assert langid.identify(docs_of(spark, [])).collect() == []


def test_grams_of_pieces(monkeypatch):
    data = langid.plain("Größe und Länge der Straße " * 40)
    at, counts = langid.gram_counts(data)
    monkeypatch.setattr(langid, "PIECE", 7)
    assert (langid.gram_counts(data)[0] == at).all() and (langid.gram_counts(data)[1] == counts).all()
    assert counts.sum() == sum(len(data) - n + 1 for n in langid.LENGTHS)


def test_sql_twins_are_registered():
    assert {"op11_divergence", "op12_manifest"} <= set(ORACLES)
