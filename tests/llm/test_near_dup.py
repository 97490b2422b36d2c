import random
import re

import numpy as np
import pytest

from quarrylens.llm import near_dup as n
from quarrylens.llm import shingles

RULE = n.JoinRule(n_words=3, threshold=0.6)


def sets_of(texts, k):
    out = {}
    for i, t in texts.items():
        w = re.findall("[a-z0-9]+", t.lower())
        if x := set(zip(*(w[j:] for j in range(k)))):
            out[i] = x
    return out


def brute(texts, k, t):
    s = sets_of(texts, k)
    ids = sorted(s)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(s[a] & s[b]) / len(s[a] | s[b]) >= t}


def corpus(seed, size=250):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    out = {}
    for i in range(size):
        if out and r.random() < 0.5:
            w = out[r.choice(list(out))].split()
            for _ in range(r.randrange(0, 8)):
                j = r.randrange(len(w) + 1)
                w[j : j + r.randrange(2)] = [r.choice(vocab)] * r.randrange(2)
        else:
            w = [r.choice(vocab[: r.choice([3, 40])]) for _ in range(r.choice([2, 3, 4, 6, 30, 80, 400]))]
        out[f"d{i:04d}"] = " ".join(w) or "x"
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], "chunk_id string, parent_chunk string, rep string, h1 int, n int")


@pytest.mark.parametrize(("seed", "rare", "k", "t"), [(1, 512, 3, 0.6), (2, 1, 3, 0.6), (3, 4, 3, 0.6), (4, 4, 5, 0.8), (5, 0, 2, 0.5)])
def test_against_brute_force(spark, seed, rare, k, t):
    texts = corpus(seed)
    got = {(r.id_a, r.id_b) for r in n.similar_pairs(frame(spark, texts.items()), "chunk_id", "parent_chunk", n.JoinRule(k, t, rare=rare)).collect()}
    assert got == brute(texts, k, t)


def test_copies_nulls_repeats_and_star(spark):
    body = " ".join(f"t{i}" for i in range(40))
    rows = [(f"c{i}", body) for i in range(8)] + [("z", body + " more"), ("null", None), (None, body), ("blank", "  "), ("two", "a b"), ("c1", body)]
    pairs = {(r.id_a, r.id_b) for r in n.similar_pairs(frame(spark, rows), "chunk_id", "parent_chunk", RULE).collect()}
    ids = [f"c{i}" for i in range(8)] + ["z"]
    assert pairs == {(a, b) for a in ids for b in ids if a < b}
    star = {(r.id_a, r.id_b) for r in n.similar_pairs(frame(spark, rows), "chunk_id", "parent_chunk", n.JoinRule(3, 0.6, star_beyond=5)).collect()}
    assert star == {("c0", f"c{i}") for i in range(1, 8)} | {("c0", "z")}
    g = {r.id: (r.rep, r.group, r.n_links, r.n_copies) for r in n.similar_groups(frame(spark, rows), "chunk_id", "parent_chunk", RULE).collect()}
    assert g == {**{f"c{i}": ("c0", "c0", 1, 8) for i in range(8)}, "z": ("z", "c0", 1, 1)}
    empty = frame(spark, [])
    assert n.similar_pairs(empty, "chunk_id", "parent_chunk", RULE).count() == 0 and n.similar_groups(empty, "chunk_id", "parent_chunk", RULE).count() == 0


def test_a_text_with_many_candidates_is_spread(spark):
    pairs = spark.range(20_000).selectExpr("'hub' AS rep_a", "concat('x', id) AS rep_b").unionByName(spark.createDataFrame([("a", "hub")], "rep_a string, rep_b string")).cache()
    texts = spark.range(20_000).selectExpr("concat('x', id) AS id", "concat('t', id) AS t").unionByName(spark.createDataFrame([("hub", "h"), ("hub", "h2"), ("a", "ta")], "id string, t string"))
    got = n._with_text(pairs, pairs, texts, "rep_a", "ta")
    assert got.count() == 40_001 and got.filter("rep_a = 'hub'").select("rep_b").distinct().count() == 20_000
    assert n._with_text(got, pairs, texts, "rep_b", "tb").filter("ta = 'h' AND tb = concat('t', substr(rep_b, 2))").count() == 20_000


def test_parts_grow_with_the_data(spark, monkeypatch):
    texts = corpus(7, 300)
    df = frame(spark, texts.items())
    scan = n._scan(df.selectExpr("chunk_id AS id", "parent_chunk AS t"), 16, 3).cache()
    assert n._parts(scan, 0.6) == n._parts(scan.filter("false"), 0.6) == n.LEAST_PARTS
    want = {(r.id_a, r.id_b) for r in n.similar_pairs(df, "chunk_id", "parent_chunk", RULE).collect()}
    monkeypatch.setattr(n, "PART_BYTES", 20_000)
    monkeypatch.setattr(n, "HUB", 2)
    assert n._parts(scan, 0.6) > 20
    assert {(r.id_a, r.id_b) for r in n.similar_pairs(df, "chunk_id", "parent_chunk", RULE).collect()} == want


def test_levels_above_noise():
    c = np.array([0, 1, 2, 3, 100, 600, 5000])
    assert n._level(c).tolist() == [0, 1, 9, 14, 54, 75, 99]
    noisy = n._level(c + 100 * (c > 1), 100.0)
    assert noisy[1] == 1 and (noisy[2:4] == 2).all() and (np.diff(noisy[4:].astype(int)) > 0).all()  # a single token stays one


def test_all_pairs_of_copies_on_demand(spark):
    rows = [(f"c{i:03d}", "one text that is given many times") for i in range(70)]
    assert n.similar_pairs(frame(spark, rows), "chunk_id", "parent_chunk", RULE).count() == 69
    assert n.similar_pairs(frame(spark, rows), "chunk_id", "parent_chunk", n.JoinRule(3, 0.6, star_beyond=None)).count() == 70 * 69 // 2


def test_components_are_never_given_half_done(spark):
    path = spark.createDataFrame([(f"{i:02d}", f"{i + 1:02d}") for i in range(12)], "a string, b string")
    with pytest.raises(RuntimeError):
        n.connected(path, max_rounds=1)
    assert {r.root for r in n.connected(path).collect()} == {"00"}


def test_components(spark):
    chain = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)] + [("x", "y"), ("y", "x"), ("y", "z"), ("s", "s")]
    got = {r.node: r.root for r in n.connected(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert got == {**{f"n{i:02d}": "n00" for i in range(21)}, "x": "x", "y": "x", "z": "x"}


def test_shingles_against_plain_sets():
    texts = ["A b, C d e", "a b c", "", None, "a b", "x " * 9, "İstanbul KELVIN K é1 2 3", "w" * 5000 + " b c d", "a-b-c-a-b-c"]
    plain = sets_of({i: t or "" for i, t in enumerate(texts)}, 3)
    got = shingles.shingle_sets(texts * 200, 3)
    assert [len(s) for s in got[: len(texts)]] == [len(plain.get(i, ())) for i in range(len(texts))]
    assert all(np.array_equal(got[i], got[i + len(texts)]) for i in range(len(texts)))
    assert np.array_equal(got[0], shingles.shingle_sets(["a B c D e"], 3)[0]) and len(np.intersect1d(got[0], got[1])) == 1


def test_bitmap_bound_is_safe():
    r = np.random.default_rng(0)
    for _ in range(50):
        a = np.unique(r.integers(0, 2**63, 200, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: r.integers(0, 200)], r.integers(0, 2**63, r.integers(1, 200), dtype=np.uint64)]))
        w = min(n._width(len(a)), n._width(len(b)))
        x, y = n._bitmap(a, w), n._bitmap(b, w)
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
        big = n._bitmap(a, 2 * w)
        assert np.array_equal(big[:w] ^ big[w:], x)


def _sent(spark, monkeypatch, rows, rule):
    """The pairs found, and what goes to the join: distinct-text rows, and bytes of each part."""
    seen, real = [], n._emit
    monkeypatch.setattr(n, "_emit", lambda *a: seen.append(real(*a)) or seen[-1])
    pairs = {(r.id_a, r.id_b) for r in n.similar_pairs(rows, "chunk_id", "parent_chunk", rule).collect()}
    per = seen[0].selectExpr("pid", "length(dh) AS sets", "length(key) + length(of) + length(dh) + length(dn) + length(bm) AS size").groupBy("pid").sum("sets", "size").collect()
    return pairs, per


def test_copies_in_many_tasks_are_sent_once(spark, monkeypatch):
    texts = {f"d{i:02d}": " ".join(f"w{i}x{j}" for j in range(30)) for i in range(40)}
    texts |= {f"e{i:02d}": t + " more" for i, t in enumerate(texts.values())}
    rows = [(f"{k}~{c}", t) for c in range(8) for k, t in texts.items()]
    rule = n.JoinRule(3, 0.6, star_beyond=4)
    pairs, per = _sent(spark, monkeypatch, frame(spark, rows).repartition(8), rule)
    _, once = _sent(spark, monkeypatch, frame(spark, texts.items()).repartition(8), rule)
    assert sum(r["sum(size)"] for r in per) <= 1.1 * sum(r["sum(size)"] for r in once)
    assert pairs == {(f"{k}~0", f"{k}~{c}") for k in texts for c in range(1, 8)} | {(f"d{i:02d}~0", f"e{i:02d}~0") for i in range(40)}


def test_parts_grow_with_pairs_of_frequent_tokens(spark, monkeypatch):
    texts = corpus(7, 400)
    monkeypatch.setattr(n, "PART_BYTES", 60_000)
    monkeypatch.setattr(n, "SENT", 10**6)
    pairs, per = _sent(spark, monkeypatch, frame(spark, texts.items()), n.JoinRule(3, 0.6, rare=0))
    assert max(r["sum(size)"] for r in per) <= 2 * 60_000 and pairs == brute(texts, 3, 0.6)


def test_frequent_tokens_count_as_rare_where_pairs_are_too_many(spark, monkeypatch):
    texts = corpus(8, 400)
    monkeypatch.setattr(n, "PART_BYTES", 60_000)
    pairs, per = _sent(spark, monkeypatch, frame(spark, texts.items()), n.JoinRule(3, 0.6, rare=0))
    monkeypatch.setattr(n, "SENT", 10**6)
    _, more = _sent(spark, monkeypatch, frame(spark, texts.items()), n.JoinRule(3, 0.6, rare=0))
    assert pairs == brute(texts, 3, 0.6) and 2 * sum(r["sum(size)"] for r in per) < sum(r["sum(size)"] for r in more)
