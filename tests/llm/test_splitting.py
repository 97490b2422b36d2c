import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylens.llm import splitting as s

RULE = s.SplitRule()
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def text_of(seed, n=6000, newline=0.1):
    r = random.Random(seed)
    out = ""
    while len(out) < n:
        out += " ".join(r.choice(WORDS) + str(r.randrange(999)) for _ in range(r.randrange(4, 20))).capitalize() + "." + ("\n\n" if r.random() < newline else " ")
    return out.strip()


def by_hand(text, pieces):
    """The rule's words once more, in another form."""
    if not pieces or any(not p or len(p) > 2000 for p in pieces):
        return False
    spans, prev = [], -1
    for p in pieces:
        at = next((i for i in range(prev + 1, len(text) - len(p) + 1) if text[i : i + len(p)] == p), None)
        if at is None:
            return False
        spans.append((at, at + len(p)))
        prev = at
    if spans[0][0] != 0 or spans[-1][1] != len(text):
        return False
    if any(not 100 <= e - b <= 400 for (_, e), (b, _) in zip(spans, spans[1:])):
        return False
    alnum = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    return not any(e < len(text) and text[e - 1] in alnum and text[e] in alnum and set(" \n") & set(text[e - min(400, e - b) : e]) for b, e in spans[:-1])


@pytest.mark.parametrize("seed", range(12))
def test_own_splits_are_valid(seed):
    t = text_of(seed, 2500 + 1500 * seed)
    pieces = [t[a:b] for a, b in s.split_text(t)]
    assert s.valid_split(t, pieces) and by_hand(t, pieces) and all(p[-1] == "." for p in pieces)


@pytest.mark.parametrize("seed", range(30))
def test_check_against_brute_force(seed):
    r = random.Random(seed)
    t = text_of(seed, 4500)
    spans = s.split_text(t)
    k = r.randrange(len(spans))
    a, b = spans[k]
    spans[k] = (max(0, a + r.choice([0, 0, -350, 90, 250])), min(len(t), b + r.choice([0, 0, -3, 4, 120])))
    pieces = [t[x:y] for x, y in spans]
    if r.random() < 0.2:
        pieces[k] = pieces[k].replace("a", "A", 1)
    if r.random() < 0.1:
        pieces.pop(k)
    assert s.valid_split(t, pieces) == by_hand(t, pieces)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n", min_size=0, max_size=200), st.integers(1, 60))
def test_any_text_comes_back_whole(unit, times):
    t = unit * times
    spans = s.split_text(t)
    covered = 0
    for a, b in spans:
        assert a <= covered and b - a <= 2000 and b > a
        covered = max(covered, b)
    assert covered == len(t)


def test_valley_is_found():
    a, b = ("Crude oil price barrel rose. " * 40).strip(), ("Cloud software revenue grew fast. " * 40).strip()
    cuts, depth = s.gaps_with_depth(f"{a} {b}", 3)
    assert cuts[max(range(len(cuts)), key=lambda i: depth[i])] == len(a)


def test_long_run_without_blanks():
    t = "".join(chr(0x4E00 + i % 5000) for i in range(9000))
    assert s.valid_split(t, [t[a:b] for a, b in s.split_text(t)])


SCHEMA = "chunk_id string, parent_chunk string, child_chunks map<string,string>, is_table boolean, ingested_at timestamp, id string, t int, v int, k int, p int"


def test_tables(spark):
    t0 = dt.datetime(2024, 1, 1)
    t = text_of(1, 5000)
    good = {f"a_{i}": t[x:y] for i, (x, y) in enumerate(s.split_text(t))}
    rows = [
        ("ok", t, good, False, t0), ("gone", t, None, False, t0), ("none", t, {}, False, t0), ("nulls", t, {"a_0": None}, False, t0), ("key", t, {"x": t[:2000]}, False, t0), ("table", t, None, True, t0), ("short", "x", None, False, t0), ("null", None, None, False, t0),
        (None, t, None, False, t0), ("mark", t, None, None, t0), ("twice", t, None, False, t0), ("twice", t, good, False, t0 + dt.timedelta(1)), ("tie", t, good, False, t0), ("tie", t, None, False, t0), ("norev", t, None, False, None),
    ]
    df = spark.createDataFrame([(*r, "clash", 1, 1, 1, 1) for r in rows], SCHEMA)
    got = {r.chunk_id: r.is_valid for r in s.check_splits(df).collect()}
    assert got == {"ok": True, "gone": False, "none": False, "nulls": False, "key": False, "twice": True, "tie": False, "norev": False}
    pieces = s.split_oversized(df).collect()
    assert {r.chunk_id for r in pieces} == set(got)
    mine = sorted((r.piece_no, r.start, r.piece) for r in pieces if r.chunk_id == "ok")
    assert s.valid_split(t, [p for *_, p in mine]) and all(t[a : a + len(p)] == p for _, a, p in mine)
    assert s.check_splits(df.filter("false")).count() == 0 and s.split_oversized(df.filter("false")).count() == 0
