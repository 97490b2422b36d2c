"""Filings to chunks: page furniture, tables of contents, item headings, the heading-stack machine, word windows, child rules."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.scalars import n_words

MIN_WORDS, CHUNK_WORDS, OVERLAP_WORDS = 20, 512, 100
# A page's running foot ("Name | 2024 Form 10-K | 7") and a bare page number.
FOOTER = r"^\n*.*?\s\|\s.*?\d{4}\sForm\s10-[KQ]\s\|\s\d+\n*$"
PAGE_NUMBER = r"^\n*\d+\n*$"


def is_footer(text: Column) -> Column:
    return F.coalesce(text.rlike(FOOTER) | text.rlike(PAGE_NUMBER), F.lit(False))


def is_skipped_header(text: Column, item: Column | None = None) -> Column:
    """Headers that name the item itself, or a part; by substring, so "Department" is one of them."""
    low = F.lower(text)
    return F.contains(low, F.lit("part")) | (F.contains(low, F.lower(item)) if item is not None else F.contains(low, F.lit("item")))


def accepted_table(text: Column, most: int = 6) -> Column:
    """Not a table of contents: fewer than six times "item"."""
    return F.size(F.split(F.lower(text), "item")) - 1 < most


# ---- table of contents --------------------------------------------------------------------------------------------------


def contents_tables(tables: DataFrame, items: DataFrame, share: float = 0.3) -> DataFrame:
    """The first table (doc_id, table_no, text) of each document that holds every one of its first ceil(share * n) items.
    items: doc_id, items ARRAY<STRING> in order."""
    t = tables.join(items, "doc_id")
    head = F.slice("items", 1, F.greatest(F.lit(1), F.ceil(F.size("items") * share).cast("int")))
    ok = F.forall(head, lambda i: F.contains(F.lower("text"), F.lower(i)))
    first = Window.partitionBy("doc_id").orderBy("table_no")
    return t.filter(ok).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "items")


def index_column(cells: DataFrame) -> DataFrame:
    """doc_id, col: the column with most cells that contain "item"; ties go to the left. cells: doc_id, row, col, text."""
    n = cells.groupBy("doc_id", "col").agg(F.sum(F.contains(F.lower("text"), F.lit("item")).cast("int")).alias("n"))
    return n.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("col")).alias("c"))).alias("m")).select("doc_id", (-F.col("m.c")).alias("col"))


def item_headings_10k(items: DataFrame, toc: DataFrame) -> DataFrame:
    """doc_id, item, heading: the first row of the contents (doc_id, row, index_text, heading) whose index is the item and marks
    only; the item itself for documents without contents. Items that no row matches have none."""
    norm = lambda c: F.regexp_replace(F.lower(c), r"\W*$", "")
    rows = toc.select("doc_id", norm("index_text").alias("k"), "row", F.col("heading").alias("h"))
    first = rows.groupBy("doc_id", "k").agg(F.min(F.struct("row", "h")).alias("f")).select("doc_id", "k", F.col("f.h").alias("h"))
    has = toc.select("doc_id").distinct().withColumn("has", F.lit(True))
    r = items.withColumn("k", F.lower("item")).join(first, ["doc_id", "k"], "left").join(has, "doc_id", "left")
    return r.filter("h IS NOT NULL OR has IS NULL").select("doc_id", "item", F.when(F.col("has"), F.concat_ws(": ", "item", "h")).otherwise(F.col("item")).alias("heading"))


def item_headings_10q(toc: DataFrame) -> DataFrame:
    """doc_id, part, item, heading: rows of the contents that name an item, under the part that was named last above them."""
    low = F.lower("index_text")
    part = F.when(low.rlike(r"^part ii[^a-z0-9]*$") | F.contains(low, F.lit("other information")), "Part II").when(low.rlike(r"^part i[^a-z0-9]*$") | F.contains(low, F.lit("financial information")), "Part I")
    w = Window.partitionBy("doc_id").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = toc.withColumn("part", F.last(part, ignorenulls=True).over(w)).filter(F.contains(low, F.lit("item")) & F.col("part").isNotNull())
    label = canonical_item(F.col("index_text"))
    return rows.select("doc_id", "part", label.alias("item"), F.concat(label, F.lit(": "), F.regexp_replace("heading", r"^[:.\s]+|[:.\s]+$", "")).alias("heading"))


def canonical_item(text: Column) -> Column:
    """First two words, the first capitalised, without marks around: "ITEM 1a." to "Item 1a"."""
    w = F.split(F.regexp_replace(text, r"^[.\s]+|[.\s]+$", ""), r"\s+")
    return F.when(F.size(w) >= 2, F.concat(F.initcap(F.lower(w[0])), F.lit(" "), w[1])).otherwise(text)


# ---- the heading-stack machine ------------------------------------------------------------------------------------------


@dataclass
class _State:
    form: str
    item: str
    headings: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    meta: dict = field(default_factory=lambda: {"is_table": False, "sub": {}})
    saw_text: bool = False
    saw_heading: bool = False
    out: list[dict] = field(default_factory=list)

    def emit(self, text: str, meta: dict | None = None) -> None:
        m = meta or self.meta
        self.out.append({"item": self.item, "is_table": m["is_table"], "sub_headings": dict(m["sub"]), "text": text})


def _count(text: str) -> int:
    return len(text.split())


def _start_meta(s: _State, is_table: bool, wanted: bool) -> None:
    s.meta = {"is_table": is_table, "sub": {}}
    if not wanted:
        return
    if len(s.headings) > 3:
        s.emit("".join(h + "\n" for h in s.headings))
    else:
        s.meta["sub"] = {f"level_{i}_heading": h for i, h in enumerate(s.headings, 1)}


def run_machine(elements: list[tuple[str, bool, str]], form: str, item: str, item_headings: dict[str, str] | None = None, min_words: int = MIN_WORDS, compat: bool = False) -> list[dict]:
    """Chunks of one item (10-K) or part (10-Q) from its elements (kind text, table or other; is header; text).

    Headers pile up as levels; text gathers until a header follows it; a table is a chunk of its own, with a short text before
    it as its lead. By default text that led a table is not given again and text after a table is no table; compat keeps both.
    """
    s = _State(form, item)
    switch = {k.lower(): v for k, v in (item_headings or {}).items()}

    def to_item(text: str, flush: bool) -> None:
        for head, name in switch.items():
            if head in text.lower():
                if flush and _count(" ".join(s.texts)) > min_words:
                    s.emit("\n".join(s.texts))
                    s.texts.clear()
                s.item = name
                return

    for kind, is_header, text in elements:
        text = (text or "").strip()
        if not text:
            continue
        if kind == "text" and is_header:
            if re.search(FOOTER, text) or re.search(PAGE_NUMBER, text):
                s.headings.clear()
                continue
            if form == "10-Q":
                to_item(text, True)
            low = text.lower()
            if "part" in low or (s.item.lower() in low if form == "10-K" else "item" in low):
                continue
            if s.saw_text and s.texts:
                whole = " ".join(s.texts)
                if _count(whole) > min_words:
                    s.emit(whole)
                s.texts.clear()
                s.headings.clear()
            s.headings.append(text)
            s.saw_heading, s.saw_text = True, False
        elif kind == "text":
            if s.saw_heading:
                _start_meta(s, False, True)
            elif s.meta["is_table"] and not compat:
                s.meta = {"is_table": False, "sub": s.meta["sub"]}
            s.texts.append(text)
            s.saw_text, s.saw_heading = True, False
        elif kind == "table":
            if form == "10-Q":
                to_item(text, False)
                if text.lower().count("item") >= 6:
                    continue
            before = s.meta
            _start_meta(s, True, s.saw_heading or (form == "10-Q" and s.saw_text))
            lead = "\n".join(s.texts)
            n = _count(lead)
            short = n < min_words and (n > 5 if form == "10-Q" else n > 0)
            s.emit(lead + text if short else text)
            if short and not compat:
                s.texts.clear()
            if not compat:
                s.meta = {"is_table": False, "sub": before["sub"] or s.meta["sub"]}
            s.saw_text, s.saw_heading = True, False
        else:
            s.texts.append(text)
    whole = "\n".join(s.texts)
    if _count(whole) > min_words:
        s.emit(whole)
    return s.out


def item_switch(headings: DataFrame) -> DataFrame:
    """doc_id, switch: for each filing an array of (part, key, heading) from item_headings_10q() rows; key is the heading without
    the item's number. One filing's contents bound it."""
    key = F.trim(F.regexp_replace(F.lower("heading"), r"item\s*\d*\W*:\s*|^item\s+\w+\W*:\s*", ""))
    rows = headings.select("doc_id", F.struct("part", "item", key.alias("key"), "heading").alias("h")).filter("h.key <> ''").distinct()
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("h")).alias("switch"))


def chunk_filings(elements: DataFrame, min_words: int = MIN_WORDS, compat: bool = False, item_headings: DataFrame | None = None) -> DataFrame:
    """doc_id, n, chunk_id (doc#n), form, part, item, is_table, sub_headings, parent_chunk from elements (doc_id, form, item, seq,
    kind, is_header, text, and part where there are 10-Q forms). A group is one filing's elements, which one filing bounds; filings
    run in parallel.

    The machine runs over each item of a 10-K, and over each part of a 10-Q, where a header or table that holds an item's heading
    (item_headings: doc_id, part, item, heading) switches to that item; before the first switch the item is null. A null item of a
    10-K is "Not Found". Without item_headings a 10-Q runs item by item.
    """
    columns = ["doc_id", "n", "chunk_id", "form", "part", "item", "is_table", "sub_headings", "parent_chunk"]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("seq", kind="stable")
        doc, form = f["doc_id"].iloc[0], str(f["form"].iloc[0])
        switch = f["switch"].iloc[0]
        by_part = form == "10-Q" and switch is not None
        rows = []
        for name in dict.fromkeys(f["part" if by_part else "item"]):
            own = f[f["part"].isna()] if name is None else f[f["part" if by_part else "item"] == name]
            to: dict[str, str] = {}
            for h in switch if by_part else ():
                if h["part"] == name:
                    to.setdefault(h["key"], h["heading"])
            for r in run_machine(list(zip(own["kind"], own["is_header"].fillna(False).astype(bool), own["text"])), form, "" if by_part else str(name), to, min_words, compat):
                rows.append((name if by_part else own["part"].iloc[0], r))
        return pd.DataFrame([(doc, i, f"{doc}#{i}", form, p, r["item"] or None, bool(r["is_table"]), r["sub_headings"], r["text"]) for i, (p, r) in enumerate(rows, 1)], columns=columns)

    part = F.col("part").cast("string") if "part" in elements.columns else F.lit(None).cast("string")
    e = elements.filter("doc_id IS NOT NULL").select("doc_id", "form", part.alias("part"), F.coalesce("item", F.lit("Not Found")).alias("item"), "seq", "kind", "is_header", "text")
    if item_headings is not None:
        e = e.join(item_switch(item_headings), "doc_id", "left")
    else:
        e = e.withColumn("switch", F.lit(None).cast("array<struct<part:string,key:string,heading:string>>"))
    return e.groupBy("doc_id").applyInPandas(run, "doc_id string, n int, chunk_id string, form string, part string, item string, is_table boolean, sub_headings map<string,string>, parent_chunk string")


# ---- children -----------------------------------------------------------------------------------------------------------


def windows(df: DataFrame, id_col: str, text_col: str, size: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """id, piece_no, n_words, piece: windows of `size` words, each `overlap` words into the one before; the last ends the text.
    Null and blank texts have none. All in built-in functions."""
    if not 0 <= overlap < size:
        raise ValueError("overlap has to be less than size")
    w = F.filter(F.split(text_col, r"\s+"), lambda x: x != "")
    step = size - overlap
    rows = df.select(F.col(id_col).alias("id"), w.alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - overlap - 1), F.lit(step))
    rows = rows.select("id", "w", F.posexplode(starts).alias("piece_no", "at"))
    piece = F.slice("w", F.col("at") + 1, size)
    return rows.select("id", "piece_no", F.size(piece).alias("n_words"), F.array_join(piece, " ").alias("piece"))


_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def sentences(text: str) -> list[str]:
    """The sentences of a text; any function of this shape may take its place."""
    return [x for x in (p.strip() for p in _SENTENCE.split(text)) if x]


def packed_sentences(parts: list[str], size: int, overlap: int) -> list[str]:
    """Pieces of whole sentences of at most `size` words, each beginning with the last sentences of the one before that together
    have at most `overlap` words. A sentence that is longer alone is cut into windows of words."""
    units = []
    for p in parts:
        w = p.split()
        units += [w] if len(w) <= size else [w[i : i + size] for i in range(0, len(w), size)]
    out, at = [], 0
    while at < len(units):
        end, n = at, 0
        while end < len(units) and (end == at or n + len(units[end]) <= size):
            n += len(units[end])
            end += 1
        out.append(" ".join(x for u in units[at:end] for x in u))
        if end == len(units):
            break
        back, n, room = end, 0, size - len(units[end])
        while back - 1 > at and n + len(units[back - 1]) <= min(overlap, room):
            back -= 1
            n += len(units[back])
        at = back
    return out


def sentence_windows(df: DataFrame, id_col: str, text_col: str, size: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS, split: Callable[[str], list[str]] = sentences) -> DataFrame:
    """id, piece_no, n_words, piece: windows() that begin and end with sentences. Null and blank texts have none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap has to be less than size")
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).filter("t IS NOT NULL")
    id_type = src.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, k, len(p.split()), p) for i, t in zip(f["id"], f["t"]) for k, p in enumerate(packed_sentences(split(t), size, overlap))]
            yield pd.DataFrame(rows, columns=["id", "piece_no", "n_words", "piece"])

    return src.mapInPandas(run, f"id {id_type}, piece_no int, n_words int, piece string")


def fold_children(parent_words: Column, pieces: Column, is_table: Column | None = None) -> Column:
    """ARRAY<STRUCT<key, text>>: which of a parent's pieces become children.

    None for a table or a single piece. The first stays only if it leaves more than 100 words elsewhere, else there are none.
    A later one stays if it has more than 50 words; a shorter one is added to the child right before it, if there is one, else
    it stays alone.
    """
    start = F.array().cast("array<struct<key:int,text:string>>")
    at = F.transform(pieces, lambda t, i: F.struct(i.cast("int").alias("key"), t.alias("text")))

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        joins = (n_words(x["text"]) <= 50) & (x["key"] > 0) & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["key"] == x["key"] - 1)
        glued = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["key"].alias("key"), F.concat(last["text"], x["text"]).alias("text"))))
        return F.when(joins, glued).otherwise(F.concat(acc, F.array(x)))

    some = (F.size(pieces) > 1) & (parent_words - n_words(F.try_element_at(pieces, F.lit(1))) > 100)
    if is_table is not None:
        some = some & ~is_table
    return F.when(some, F.aggregate(at, start, step)).otherwise(start)
