"""Near-duplicate texts: an exact set-similarity join on token-combination prefixes.

Tokens are word shingles, ordered from rare to frequent by a counting sketch over all documents. If two sets have a Jaccard
similarity of t or more, their prefixes, extended by one, share two tokens. So a pair shares a rare token there, which is
indexed by itself, or two frequent ones, which are indexed as a combination. The smaller set of a pair needs a shorter
prefix (the index side) than the larger (the probe side). A token that the sketch has counted once stands in one document
and is no key. Candidates pass a length test and an exact bound on the overlap from parity bitmaps, and are then verified.

Sets, not documents, are joined: documents with the same set form a class and copies are merged before each shuffle.
Were a third of all documents to share a frequent part, that part comes last in their order and enters the index prefix only
where the shared part is so large that the pairs are similar indeed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.shingles import distinct, mix, set_hashes, shingle_sets
from quarrylens.session import staged

BLOCK_BITS = 16
PART_BYTES = 64 << 20  # what a task of the join reads, at most, about
LEAST_PARTS = 12
KEY_BYTES, SET_BYTES = 6, 14  # a key with its set's place; a set in a part without its bitmap
KEYS_AT_ONCE = 1_000_000  # a task makes about so many keys before it sends them
SENT = 6  # for each byte of text at most so many of keys and bitmaps are sent, else frequent tokens count as rare
COPIES = 20  # if more than one in so many rows is a copy, distinct texts are set apart first
FEW_CLASSES = 100_000  # ids that are broadcast, at most; more are joined by a shuffle
HUB = 2000  # a text is joined with at most so many of its candidates in one group


@dataclass(frozen=True)
class JoinRule:
    n_words: int = 5
    threshold: float = 0.8
    rare: int = 512  # tokens that more documents have are indexed in combinations of two; doubled where a large corpus has too many of these
    max_sketch_bits: int = 24  # the sketch has at most 2^24 cells of one byte; more for a larger corpus, as far as workers have memory
    star_beyond: int | None = 64  # copies: classes up to this size give all their pairs, larger ones one pair for each member; None: all give all


def _level(count: np.ndarray, noise: float = 0.0) -> np.ndarray:
    """One byte that grows with the count: 0 for 0, 1 for 1, then eight steps for each doubling. What many tokens share a cell
    add to each other's counts is noise: up to its mean and four deviations nothing is known, and the level is 2."""
    above = np.maximum(count - noise - 4 * np.sqrt(noise), 1)
    return np.where(count > 1, np.clip(1 + np.rint(8 * np.log2(above)), 2, 255), count > 0).astype(np.uint8)


def _sketch_bits(n_texts: int, rule: JoinRule) -> int:
    return int(np.clip(np.ceil(np.log2(max(1, n_texts) * 128)), BLOCK_BITS, rule.max_sketch_bits))


def _scan(docs: DataFrame, bits: int, n_words: int) -> DataFrame:
    """One pass over the texts: a class row for each document, and for each task its part of the sketch, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << bits, np.uint32), set()
        names = ["block", "data", "id", "h1", "h2", "n"]
        types = [pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
        for b in batches:
            sets = shingle_sets(b.column(1).to_pylist(), n_words)
            keep = [i for i, s in enumerate(sets) if len(s)]
            if not keep:
                continue
            h1, h2 = set_hashes([sets[i] for i in keep])
            new = [x for i, h in zip(keep, h1.tolist()) if h not in seen and not seen.add(h) for x in (sets[i],)]  # copies in one task count once
            if new:
                np.add.at(counts, np.concatenate(new) >> np.uint64(64 - bits), 1)
            n = pa.array([len(sets[i]) for i in keep], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(keep), types[0]), pa.nulls(len(keep), types[1]), b.column(0).take(pa.array(keep)), pa.array(h1), pa.array(h2), n], names)
        for k, part in enumerate(counts.reshape(-1, 1 << BLOCK_BITS)):
            if part.any():
                row = [[k], [zlib.compress(part.tobytes(), 1)], [None], [None], [None], [None]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], names)

    return docs.mapInArrow(run, "block int, data binary, id string, h1 bigint, h2 bigint, n int")


def _sketch(scan: DataFrame, bits: int) -> np.ndarray:
    """The sketch of the whole corpus: 2^bits bytes, at most 2^max_sketch_bits, whatever the corpus."""

    def add(f: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << BLOCK_BITS, np.int64)
        for d in f["data"]:
            total += np.frombuffer(zlib.decompress(d), np.uint32)
        return pd.DataFrame({"block": f["block"].iloc[:1], "data": [zlib.compress(_level(total, float(np.median(total))).tobytes(), 1)]})

    out = np.zeros((1 << (bits - BLOCK_BITS), 1 << BLOCK_BITS), np.uint8)
    for r in scan.filter("block IS NOT NULL").select("block", "data").groupBy("block").applyInPandas(add, "block int, data binary").toLocalIterator():
        out[r.block] = np.frombuffer(zlib.decompress(r.data), np.uint8)
    return out.ravel()


def _ceil(x: float) -> int:
    return int(np.ceil(x - 1e-9))


def _prefix(level: np.ndarray, t: float) -> np.ndarray:
    n = len(level)
    return np.argsort(level, kind="stable")[: n - _ceil(t * n) + 2]


def _keys(s: np.ndarray, level: np.ndarray, rare_level: int, t: float) -> tuple[np.ndarray, int]:
    """The probe keys of one sorted set, of which the first so many are its index keys."""
    n = len(s)
    prefix = _prefix(level, t)
    short = n - _ceil(2 * t / (1 + t) * n) + 2
    lv, tok, early = level[prefix], s[prefix], np.arange(len(prefix)) < short
    is_rare, often = (lv > 1) & (lv <= rare_level), np.flatnonzero(lv > rare_level)
    keys, index = [tok[is_rare]], [early[is_rare]]
    if len(often) > 1:
        a, b = np.triu_indices(len(often), 1)
        x, y = tok[often[a]], tok[often[b]]
        keys.append(mix(np.minimum(x, y) * np.uint64(3) + mix(np.maximum(x, y))))
        index.append(early[often[b]])  # places grow, so the second is the later one
    if _ceil(t * n) <= 1:  # so small a set may share a single token with one that is similar
        keys.append(mix(tok[often] + np.uint64(7)))
        index.append(early[often])
    keys, index = np.concatenate(keys), np.concatenate(index)
    return np.concatenate([keys[index], keys[~index]]), int(index.sum())


def _width(n: int) -> int:
    """Words of a bitmap: 256 bits up to 170 tokens, doubled with each doubling of the set."""
    return 4 << max(0, _ceil(np.log2(n / 170)))


def _bitmap(s: np.ndarray, words: int) -> np.ndarray:
    bit = (s & np.uint64(words * 64 - 1)).astype(np.int64)
    odd = (np.bincount(bit, minlength=words * 64) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def _parts(scan: DataFrame, t: float) -> int:
    """How many parts the join has at least: by the bitmaps of all distinct sets, if each had one key for each token of its prefix
    and each key went to another part, as they do where parts are many. _planned() counts the pairs of frequent tokens as well."""
    probes = f"(({1 - t} * n) + 2)"
    bitmap = "32 * pow(2, greatest(0, ceil(log2(n / 170))))"
    sets = scan.filter("block IS NULL").groupBy("h1", "h2").agg(F.min("n").alias("n"))
    total = sets.agg(F.sum(F.expr(f"{probes} * ({KEY_BYTES} + {SET_BYTES} + {bitmap})"))).first()[0] or 0
    return max(LEAST_PARTS, int(np.ceil(total / PART_BYTES)))


def _planned(docs: DataFrame, sketch, bits: int, rule: JoinRule) -> tuple[int, int]:
    """(parts of the join, the rare count to go by), by the keys that every text has, counted in one pass: so many parts that none
    reads much more than PART_BYTES. A set's bitmap goes to each part in which it has a key, so what is sent grows with the parts.

    Pairs of frequent tokens grow with the square of these, and the larger the corpus, the more tokens are frequent. Where more
    than SENT times the texts, and more than LEAST_PARTS full parts, would be sent, the rare count is doubled until it is not: the
    same pairs are found by fewer keys and more comparisons.
    """
    rares = [rule.rare, *(max(rule.rare, 1) << j for j in range(1, 12))]
    parts = LEAST_PARTS << np.arange(16, dtype=np.int64)
    rare_levels = _level(np.array(rares))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen, sent, n_bytes = sketch.value, set(), np.zeros((len(rares), len(parts)), np.int64), 0
        for b in batches:
            texts = b.column(1).to_pylist()
            n_bytes += sum(map(len, texts))
            sets = [s for s in shingle_sets(texts, rule.n_words) if len(s)]
            for s, h in zip(sets, set_hashes(sets)[0].tolist()):
                if h in seen:
                    continue
                seen.add(h)
                level = levels[s >> np.uint64(64 - bits)]
                lv = level[_prefix(level, rule.threshold)]
                at = np.searchsorted(lv, rare_levels, "right")
                often = len(lv) - at
                keys = np.maximum(at - np.searchsorted(lv, 1, "right"), 0) + often * (often - 1) // 2 + often * (_ceil(rule.threshold * len(s)) <= 1)
                sent += keys[:, None] * KEY_BYTES + np.minimum(keys[:, None], parts) * (SET_BYTES + 8 * _width(len(s)))
        yield pa.RecordBatch.from_arrays([pa.array([n_bytes]), pa.array([sent.ravel().tolist()])], ["n_bytes", "sent"])

    total, n_bytes = np.zeros((len(rares), len(parts)), np.int64), 0
    for r in docs.mapInArrow(run, "n_bytes bigint, sent array<bigint>").toLocalIterator():
        total, n_bytes = total + np.array(r.sent, np.int64).reshape(total.shape), n_bytes + r.n_bytes
    enough = total <= parts * PART_BYTES
    of = np.where(enough.any(1), enough.argmax(1), len(parts) - 1)
    sent = total[np.arange(len(rares)), of]
    fits = np.flatnonzero(sent <= max(SENT * n_bytes, LEAST_PARTS * PART_BYTES))
    j = int(fits[0] if len(fits) else sent.argmin())
    return max(int(parts[of[j]] if enough[j].any() else 0), LEAST_PARTS, _ceil(sent[j] / PART_BYTES)), rares[j]


def _emit(docs: DataFrame, sketch, bits: int, rule: JoinRule, parts: int, rare: int) -> DataFrame:
    """Rows (pid, blob columns): of about KEYS_AT_ONCE keys, what part pid needs: keys, and a table of the sets that have one there."""
    rare_level = int(_level(np.array([rare]))[0])
    names = ["pid", "key", "of", "dh", "dn", "bm"]
    types = [pa.int32(), *[pa.binary()] * 5]

    def sent(keys: list, of: list, dh: list, dn: list, bm: list) -> pa.RecordBatch:
        dh, dn = np.array(dh, np.int64), np.array(dn, np.uint32)
        keys, of = mix(np.concatenate(keys)), np.concatenate(of)
        pid = (keys % np.uint64(parts)).astype(np.int64)
        o = np.argsort(pid, kind="stable")
        # 32 bits are enough within a part: keys that fall together cost a candidate, never a link
        pid, keys, of = pid[o], (keys >> np.uint64(32)).astype(np.uint32)[o], of[o]
        cut = np.flatnonzero(np.concatenate([[True], pid[1:] != pid[:-1]]))
        rows = []
        for a, z in zip(cut, [*cut[1:], len(pid)]):
            used, inv = np.unique(of[a:z] >> 1, return_inverse=True)
            place = (2 * inv + (of[a:z] & 1)).astype(np.uint16 if len(used) < 2**15 else np.uint32)
            rows.append((int(pid[a]), keys[a:z].tobytes(), place.tobytes(), dh[used].tobytes(), dn[used].tobytes(), b"".join(bm[u].tobytes() for u in used)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen, held, n_keys = sketch.value, set(), ([], [], [], [], []), 0
        for b in batches:
            sets = [s for s in shingle_sets(b.column(1).to_pylist(), rule.n_words) if len(s)]
            for s, h in zip(sets, set_hashes(sets)[0].tolist()):
                if h in seen:  # copies in one task are sent once
                    continue
                seen.add(h)
                k, n_index = _keys(s, levels[s >> np.uint64(64 - bits)], rare_level, rule.threshold)
                if not len(k):
                    continue
                # the lowest bit marks an index key
                for x, v in zip(held, (k, 2 * len(held[2]) + (np.arange(len(k)) < n_index), h, len(s), _bitmap(s, _width(len(s))))):
                    x.append(v)
                n_keys += len(k)
                if n_keys >= KEYS_AT_ONCE:
                    yield sent(*held)
                    held, n_keys = ([], [], [], [], []), 0
        if n_keys:
            yield sent(*held)

    return docs.mapInArrow(run, "pid int, key binary, of binary, dh binary, dn binary, bm binary")


def _candidates(f: dict[str, list[bytes]], t: float, chunk: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Class hashes of the pairs of one part that share a key and pass the length test and the bound on the overlap."""
    cat = lambda c, d: np.concatenate([np.zeros(0, d), *[np.frombuffer(x, d) for x in f[c]]])
    counts = np.array([len(x) // 8 for x in f["dh"]], np.int64)
    base = np.cumsum(counts) - counts
    dh, first, inv = np.unique(cat("dh", np.int64), return_index=True, return_inverse=True)
    n_all, bm = cat("dn", np.uint32).astype(np.int64), cat("bm", np.uint64)
    words = np.array([_width(x) for x in n_all], np.int64)
    place = (np.cumsum(words) - words)[first]
    n, words = n_all[first], words[first]
    of = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x, np.uint16 if c < 2**15 else np.uint32).astype(np.int64) + 2 * o for x, o, c in zip(f["of"], base, counts)]])
    key, is_index = cat("key", np.uint32), (of & 1).astype(bool)

    def side(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, d = key[keep], inv[of[keep] >> 1]
        o = np.lexsort((d, k))
        k, d = k[o], d[o]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])]) if len(k) else np.zeros(0, bool)
        return k[new], d[new]

    (ik, ix), (pk, px) = side(is_index), side(np.ones(len(key), bool))
    maps = {}
    for w in np.unique(words):
        own, twice = np.flatnonzero(words == w), np.flatnonzero(words == 2 * w)
        m = np.zeros((len(own) + len(twice), w), np.uint64)
        m[: len(own)] = bm[place[own][:, None] + np.arange(w)]
        both = bm[place[twice][:, None] + np.arange(2 * w)]
        m[len(own) :] = both[:, :w] ^ both[:, w:]  # parity bitmaps fold
        row = np.full(len(dh), -1, np.int64)
        row[own], row[twice] = np.arange(len(own)), len(own) + np.arange(len(twice))
        maps[int(w)] = (m, row)
    lo, hi = np.searchsorted(ik, pk, "left"), np.searchsorted(ik, pk, "right")
    ends = np.cumsum(hi - lo)
    out, at, todo = [np.zeros(0, np.int64)], 0, len(pk)
    while at < todo:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + chunk, "right")))
        c = (hi - lo)[at:to]
        a = np.repeat(px[at:to], c)
        within = np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c)
        b = ix[np.repeat(lo[at:to], c) + within]
        na, nb = n[a], n[b]
        ok = ((nb < na) | ((nb == na) & (b < a))) & (nb >= t * na - 1e-9)
        a, b, na, nb = a[ok], b[ok], na[ok], nb[ok]
        spare = na + nb - 2 * np.ceil(t / (1 + t) * (na + nb) - 1e-9).astype(np.int64)
        w = np.minimum(words[a], words[b])
        good = np.zeros(len(a), bool)
        for x in np.unique(w):
            m, row = maps[int(x)]
            s = np.flatnonzero(w == x)
            good[s] = np.bitwise_count(m[row[a[s]]] ^ m[row[b[s]]]).sum(1, dtype=np.int64) <= spare[s]
        out.append(distinct(a[good] * len(dh) + b[good]))
        at = to
    pairs = distinct(np.concatenate(out))
    return dh[pairs // max(len(dh), 1)], dh[pairs % max(len(dh), 1)]


def _once_each(docs: DataFrame, scan: DataFrame, classes: DataFrame) -> DataFrame | None:
    """The texts of the classes' least ids, written; None if so few rows are copies that it is not worth it.

    Copies in different tasks would each be counted in the sketch, which makes all their tokens frequent, and be sent to the join.
    """
    n_rows, n_classes = scan.filter("block IS NULL").count(), classes.count()
    if (n_rows - n_classes) * COPIES <= n_rows:
        return None
    reps = classes.select(F.col("rep").alias("id")).distinct()
    kept = docs.join(F.broadcast(reps) if n_classes <= FEW_CLASSES else reps, "id", "left_semi")
    # rows that repeat an id and its text are merged; an id with several texts may stand for several classes
    return staged(kept.groupBy("id", F.xxhash64("t").alias("x")).agg(F.min("t").alias("t")).select("id", "t"), "near-texts")


def _pair_classes(docs: DataFrame, scan: DataFrame, bits: int, rule: JoinRule, least: int) -> DataFrame:
    """Distinct candidate pairs (ha, hb) of class hashes, not yet verified."""
    sketch = docs.sparkSession.sparkContext.broadcast(_sketch(scan, bits))
    parts, rare = _planned(docs, sketch, bits, rule)
    parts = max(parts, least)
    t = rule.threshold

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.select(["key", "of", "dh", "dn", "bm"]).to_pylist()]
        if rows:
            a, b = _candidates({c: [r[c] for r in rows] for c in rows[0]}, t)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["ha", "hb"])

    sent = _emit(docs, sketch, bits, rule, parts, rare).repartitionById(parts, F.col("pid"))  # a part is a task's
    return sent.mapInArrow(join, "ha bigint, hb bigint").distinct()


def _with_text(rows: DataFrame, pairs: DataFrame, texts: DataFrame, side: str, out: str) -> DataFrame:
    """rows, which are the staged pairs with more columns, joined with the text of one side. A text with more than HUB candidates is given once for every HUB of them, to which
    these are spread by hash, so no key of the join has more."""
    other = "rep_b" if side == "rep_a" else "rep_a"
    hubs = staged(pairs.groupBy(side).agg(F.ceil(F.count("*") / HUB).cast("int").alias("groups")).filter("groups > 1"), "near-hubs")
    few = hubs.count() <= 100_000  # at most one hub for every HUB pairs
    h = F.broadcast(hubs) if few else hubs
    keyed = rows.join(h, side, "left").withColumn("salt", F.expr(f"pmod(xxhash64({other}), coalesce(groups, 1))")).drop("groups")
    t = texts.withColumnRenamed("id", side).join(h, side, "left").withColumn("salt", F.explode(F.expr("sequence(0L, CAST(coalesce(groups, 1) AS BIGINT) - 1)"))).select(side, "salt", F.col("t").alias(out))
    return keyed.join(t, [side, "salt"]).drop("salt")


def similar_sets(df: DataFrame, id_col: str, text_col: str, rule: JoinRule = JoinRule()) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has id, rep (the least id with the same set), size of its class; links has rep_a, rep_b, jaccard.

    Rows with a null id or text, or with fewer words than a shingle has, have no set and are left out. Rows that repeat an id
    count once; an id with several texts belongs to each of their classes. No link between different sets is lost.
    """
    docs = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t")).filter("id IS NOT NULL AND t IS NOT NULL")
    bits = _sketch_bits(df.count(), rule)
    scan = staged(_scan(docs, bits, rule.n_words), "near-scan")
    rows = scan.filter("block IS NULL").select("id", "h1", "h2").distinct()
    classes = rows.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("size"))
    classes = staged(classes, "near-classes")
    members = rows.join(classes, ["h1", "h2"]).select("id", "rep", "size")
    least = _parts(scan, rule.threshold)
    once = _once_each(docs, scan, classes)
    if once is not None:
        docs, bits = once, _sketch_bits(classes.count(), rule)
        scan = _scan(docs, bits, rule.n_words)
    raw = _pair_classes(docs, scan, bits, rule, least)
    a, b = (classes.select(F.col("h1").alias(f"h{x}"), F.col("rep").alias(f"rep_{x}")) for x in "ab")
    pairs = staged(raw.join(a, "ha").join(b, "hb").select("rep_a", "rep_b"), "near-pairs")
    need = pairs.select(F.col("rep_a").alias("id")).union(pairs.select("rep_b")).distinct()
    # one row for each id and text, and partitioned as the joins need it
    texts = docs.join(need, "id", "left_semi").groupBy("id").agg(F.collect_set("t").alias("t")).select("id", F.explode("t").alias("t"))
    both = _with_text(_with_text(pairs, pairs, texts, "rep_a", "ta"), pairs, texts, "rep_b", "tb")
    t, k = rule.threshold, rule.n_words

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sa, sb = (shingle_sets(x.column(c).to_pylist(), k) for c in ("ta", "tb"))
            common = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(sa, sb)], np.int64)
            union = np.array([len(p) + len(q) for p, q in zip(sa, sb)], np.int64) - common
            j = common / np.maximum(union, 1)
            ok = pa.array(j >= t)
            yield pa.RecordBatch.from_arrays([x.column("rep_a").filter(ok), x.column("rep_b").filter(ok), pa.array(j).filter(ok)], ["rep_a", "rep_b", "jaccard"])

    links = both.select("rep_a", "rep_b", "ta", "tb").mapInArrow(verify, "rep_a string, rep_b string, jaccard double").distinct()
    return members, links


def similar_pairs(df: DataFrame, id_col: str, text_col: str, rule: JoinRule = JoinRule()) -> DataFrame:
    """id_a < id_b (byte order) of every two rows with similar texts.

    A class of copies with more than rule.star_beyond members is given by the pairs of its least id with each other member,
    and by that id alone in pairs with other texts; all links between different texts are kept.
    """
    members, links = similar_sets(df, id_col, text_col, rule)
    members = staged(members, "near-members")
    links = staged(links, "near-links")
    many = F.lit(False) if rule.star_beyond is None else F.col("size") > rule.star_beyond
    show = members.filter(~many | (F.col("id") == F.col("rep")))
    a, b = show.select(F.col("id").alias("x"), F.col("rep").alias("rep_a")), show.select(F.col("id").alias("y"), F.col("rep").alias("rep_b"))
    across = links.select("rep_a", "rep_b").join(a, "rep_a").join(b, "rep_b").select("x", "y")
    small = members.filter(~many & (F.col("size") > 1))
    within = small.select("rep", F.col("id").alias("x")).join(small.select("rep", F.col("id").alias("y")), "rep").filter("x < y").select("x", "y")
    star = members.filter(many & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("x"), F.col("id").alias("y"))
    every = across.unionByName(within).unionByName(star)
    return every.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).filter("id_a <> id_b").distinct()


def connected(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """node, root: the least node of its component, for each node of edges (a, b).

    Alternating large-star and small-star steps; each round is a written table. Its groups are neighbourhoods whose minimum is
    taken by partial aggregation, so that no group is collected. Rounds go on until nothing changes; where max_rounds is given
    and doesn't suffice, that is an error.
    """
    e = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "cc")
    for n in count():
        if n == max_rounds:
            raise RuntimeError(f"components not connected after {max_rounds} rounds")
        two = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = two.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: greater neighbours of a node go to its least neighbour
        large = e.select(F.col("a").alias("n"), F.col("b").alias("g")).join(least.withColumnRenamed("a", "n"), "n").select(F.col("g").alias("a"), "m")
        large = large.filter("a <> m").distinct()
        # small star: the node itself and its lesser neighbours go to the least of them
        low = large.groupBy("a").agg(F.min("m").alias("r"))
        small = large.join(low, "a").select(F.col("m").alias("x"), "r").unionByName(low.select(F.col("a").alias("x"), "r"))
        new = staged(small.filter("x <> r").select(F.col("r").alias("a"), F.col("x").alias("b")).distinct(), "cc")
        if new.count() == e.count() and new.exceptAll(e).isEmpty():
            e = new
            break
        e = new
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def similar_groups(df: DataFrame, id_col: str, text_col: str, rule: JoinRule = JoinRule()) -> DataFrame:
    """One row per document with a set: id, rep (its class), group (the least class of its component), n_links (classes it is
    linked to, its own copies not counted), n_copies (members of its class)."""
    members, links = similar_sets(df, id_col, text_col, rule)
    members, links = staged(members, "near-members"), staged(links, "near-links")
    edges = links.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    roots = connected(edges).select(F.col("node").alias("rep"), F.col("root").alias("group"))
    degree = edges.select("a").union(edges.select("b")).groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("n_links"))
    return (
        members.join(roots, "rep", "left")
        .join(degree, "rep", "left")
        .select("id", "rep", F.coalesce("group", "rep").alias("group"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("size").alias("n_copies"))
    )
