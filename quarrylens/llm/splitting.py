"""Splitting oversized texts at lexical-cohesion valleys, and a check of stored splits."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.versions import latest_texts


@dataclass(frozen=True)
class SplitRule:
    limit: int = 2000  # characters (code points) a piece may have
    min_overlap: int = 100
    max_overlap: int = 400
    block: int = 3  # sentences on either side that a gap compares
    least_fill: float = 0.5  # a cut leaves a piece at least this full, where a natural place allows


_GAP = re.compile(r"(?<=[.!?])[\"')\]]*\s+(?=\S)|\n+(?=[^\n])")
_WORD = re.compile(r"[^\W\d_]{3,}")


def _ascii_alnum(c: str) -> bool:
    return c.isascii() and c.isalnum()


def piece_order(key: str) -> int:
    tail = (key or "").rpartition("_")[2]
    return int(tail) if tail.isascii() and tail.isdigit() else -1


def valid_split(text: str, pieces: list[str | None], rule: SplitRule = SplitRule()) -> bool:
    """Whether pieces, in order, are a valid split of text (the rule is stated in TESTDATA.md under p4_found)."""
    if not pieces:
        return False
    start = end = 0
    for i, p in enumerate(pieces):
        if not p or len(p) > rule.limit:
            return False
        at = text.find(p, start + 1 if i else 0)
        if at < 0 or (i == 0 and at) or (i and not rule.min_overlap <= end - at <= rule.max_overlap):
            return False
        start, end = at, at + len(p)
        if i + 1 < len(pieces) and end < len(text) and _ascii_alnum(text[end - 1]) and _ascii_alnum(text[end]):
            tail = p[-rule.max_overlap :]
            if " " in tail or "\n" in tail:
                return False
    return end == len(text)


def gaps_with_depth(text: str, block: int) -> tuple[list[int], list[float]]:
    """Sentence and line ends (places right before the white space) and how deep a cohesion valley each one is.

    The similarity at a gap is the cosine of the word counts of the `block` sentences before and after it. Its depth is the
    climb to the nearest peak on the left plus that on the right. The counts slide from gap to gap.
    """
    cuts, starts = [], [0]
    for m in _GAP.finditer(text):
        if m.start() > 0:
            cuts.append(m.start())
            starts.append(m.end())
    n = len(cuts)
    if not n:
        return [], []
    ends = [*cuts, len(text)]
    words = [Counter(w.lower() for w in _WORD.findall(text, a, b)) for a, b in zip(starts, ends)]
    left, right = Counter(words[0]), Counter()
    for w in words[1 : 1 + block]:
        right.update(w)
    sims = []
    for g in range(n):
        dot = sum(c * right[w] for w, c in left.items() if w in right)
        norm = (sum(c * c for c in left.values()) * sum(c * c for c in right.values())) ** 0.5
        sims.append(dot / norm if norm else 0.0)
        if g + 1 < n:
            left.update(words[g + 1])
            if g + 1 - block >= 0:
                left.subtract(words[g + 1 - block])
                left += Counter()
            right.subtract(words[g + 1])
            right += Counter()
            if g + 1 + block < len(words):
                right.update(words[g + 1 + block])
    up_l, up_r = list(sims), list(sims)  # nearest peak when climbing away from the gap
    for g in range(1, n):
        up_l[g] = max(sims[g], up_l[g - 1]) if sims[g - 1] >= sims[g] else sims[g]
    for g in range(n - 2, -1, -1):
        up_r[g] = max(sims[g], up_r[g + 1]) if sims[g + 1] >= sims[g] else sims[g]
    return cuts, [up_l[g] + up_r[g] - 2 * sims[g] for g in range(n)]


def _word_cut(text: str, lo: int, hi: int) -> int:
    """The last place in (lo, hi] right before white space, else hi moved off the inside of a word where possible, else hi."""
    for i in range(hi, lo, -1):
        if i < len(text) and text[i].isspace() and not text[i - 1].isspace():
            return i
    for i in range(hi, lo, -1):
        if i >= len(text) or not (_ascii_alnum(text[i - 1]) and _ascii_alnum(text[i])):
            return i
    return hi


def _next_start(text: str, start: int, end: int, starts: list[int], rule: SplitRule) -> int:
    """Where the piece after one that ends at `end` begins: at a sentence or line start within the allowed overlap, else at a
    word start, else anywhere there."""
    lo, hi = max(start + 1, end - rule.max_overlap), end - rule.min_overlap
    natural = [s for s in starts if lo <= s <= hi]
    if natural:
        return natural[-1]
    for i in range(hi, lo - 1, -1):
        if text[i - 1].isspace() and not text[i].isspace():
            return i
    return hi


def split_text(text: str, rule: SplitRule = SplitRule()) -> list[tuple[int, int]]:
    """(start, end) of each piece. A text within the limit is one piece; an empty one has none.

    In each window that the size limit allows, the cut is the deepest valley (ties: the later one); where no sentence or line
    ends in it, a word's end; else the limit itself. A repeating text, whose next piece also occurs earlier, gets the start
    moved so that it is found in its place, as far as some start in the allowed overlap permits.
    """
    n = len(text)
    if n <= rule.limit:
        return [(0, n)] if n else []
    cuts, depth = gaps_with_depth(text, rule.block)
    starts = [re.compile(r"\s*").match(text, c).end() for c in cuts]
    out, start = [], 0
    while n - start > rule.limit:
        hi = start + rule.limit
        least = start + max(rule.max_overlap + 1, int(rule.limit * rule.least_fill))
        window = [i for i, c in enumerate(cuts) if least <= c <= hi] or [i for i, c in enumerate(cuts) if start + rule.max_overlap < c < least]
        end = cuts[max(window, key=lambda i: (depth[i], i))] if window else _word_cut(text, max(start + rule.max_overlap, hi - rule.max_overlap), hi)
        out.append((start, end))
        start = _next_start(text, start, end, starts, rule)
    out.append((start, n))
    return _unambiguous(text, out, rule)


def _unambiguous(text: str, pieces: list[tuple[int, int]], rule: SplitRule) -> list[tuple[int, int]]:
    for k in range(1, len(pieces)):
        (a, b), (s, e) = pieces[k - 1], pieces[k]
        if text.find(text[s:e], a + 1) == s:
            continue
        lo, hi = max(a + 1, b - rule.max_overlap, e - rule.limit), b - rule.min_overlap
        for other in sorted(range(lo, hi + 1), key=lambda x: abs(x - s)):
            if text.find(text[other:e], a + 1) == other:
                pieces[k] = (other, e)
                break
    return pieces



def oversized(df: DataFrame, text_col: str, table_col: str, rule: SplitRule) -> DataFrame:
    return df.filter(~F.col(table_col) & (F.length(text_col) > rule.limit))


def check_splits(df: DataFrame, id_col: str = "chunk_id", text_col: str = "parent_chunk", children_col: str = "child_chunks", table_col: str = "is_table", version_col: str = "ingested_at", rule: SplitRule = SplitRule()) -> DataFrame:
    """chunk_id, is_valid of each oversized non-table text and its stored pieces: the splitter's own check.

    Rows with a null id, text or table mark are left out. A null or empty map, a null piece or a child id without a number is
    no valid split. Of several rows with one id the latest counts; at equal versions an invalid one. Only (id, version, result)
    is shuffled; texts stay where they are read.
    """
    rows = oversized(df, text_col, table_col, rule).filter(F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.col(version_col).alias("v"), F.col(text_col).alias("t"), F.map_keys(children_col).alias("k"), F.map_values(children_col).alias("p"))
    v_type = rows.schema["v"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            bad = []
            for t, keys, pieces in zip(f["t"], f["k"], f["p"]):
                order = [] if keys is None else sorted((piece_order(k), i) for i, k in enumerate(keys))
                bad.append(not order or order[0][0] < 0 or not valid_split(t, [pieces[i] for _, i in order], rule))
            yield pd.DataFrame({"id": f["id"], "v": f["v"], "bad": bad})

    checked = rows.mapInPandas(run, f"id string, v {v_type}, bad boolean")
    last = checked.groupBy("id").agg(F.max(F.struct("v", "bad")).alias("r"))
    return last.select(F.col("id").alias("chunk_id"), (~F.col("r.bad")).alias("is_valid"))


def split_oversized(df: DataFrame, id_col: str = "chunk_id", text_col: str = "parent_chunk", table_col: str = "is_table", version_col: str = "ingested_at", rule: SplitRule = SplitRule()) -> DataFrame:
    """chunk_id, piece_no (from 0), start (from 0), piece: a new split of each oversized non-table text, latest version only.

    Only texts whose id is repeated are moved to find the latest version. Rows with a null id, text or table mark are left out;
    repeated rows count once.
    """
    rows = oversized(df, text_col, table_col, rule).select(F.col(id_col).cast("string").alias("id"), F.col(version_col).alias("v"), F.col(text_col).alias("t")).filter("id IS NOT NULL")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids, nos, at, parts = [], [], [], []
            for i, t in zip(f["id"], f["t"]):
                for k, (a, b) in enumerate(split_text(t, rule)):
                    ids.append(i), nos.append(k), at.append(a), parts.append(t[a:b])
            yield pd.DataFrame({"chunk_id": ids, "piece_no": nos, "start": at, "piece": parts})

    return latest_texts(rows).mapInPandas(run, "chunk_id string, piece_no int, start int, piece string")
