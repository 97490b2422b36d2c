"""Reading level from n-gram surprisal.

One interpolated trigram model is trained for each graded level on a bounded sample of labelled texts. Every document gets
its surprisal under each model, token by token over the whole text. Their distribution over its sentences gives a score
that grows with difficulty, and isotonic regression maps the score to the graded scale.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.shingles import distinct

MAX_LABELLED = 4000  # texts that the models are fitted on, at most; taken by hashed id
MAX_CHARS = 64_000_000  # and of so many characters together
MIN_WORDS = 40
LANGUAGE_DOCS = 500  # documents of each language that the language model is fitted on, at most; taken by hashed id
SHARES, SHARPNESSES = np.linspace(0, 1, 11), (5.0, 10.0, 20.0, 30.0, 45.0, 70.0)  # weights of the two readings, tried on unseen labels
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[.!?;\n|]")
_END = {".", "!", "?", "\n", "|"}
_WORD = re.compile(r"(?<!\w)[^\W\d_]+(?:['’\-][^\W\d_]+)*(?!\w)")  # whole words, no letters inside codes

# Frequent function words that tell the four languages apart.
FUNCTION_WORDS = {
    "en": "the of and to in a is was were that for with as by on are be which at or from has have not its our this because after when but so while if than such any their will may under",
    "de": "der die das und den dem des ein eine einer im in von zu mit auf für ist wurde werden nicht sich bei nach aus als auch an durch um bis oder zum zur vor wegen hat sind",
    "fr": "le la les de des du et en un une à est pour par dans sur au aux que qui ne pas se ce cette son sa ses avec plus ou été a sont d l il elle bien",
    "es": "el la los las de del y en un una es por para con que no se su sus al lo como más fue ha son o entre sobre desde hasta pero aunque tras",
}
LANGS = tuple(FUNCTION_WORDS)
_VOTES: dict[str, list[int]] = {}
for _k, _ws in enumerate(FUNCTION_WORDS.values()):
    for _w in _ws.split():
        _VOTES.setdefault(_w, []).append(_k)


def language_votes(words: Counter) -> list[float]:
    """Occurrences of each language's function words; a word of several languages counts in part for each."""
    v = [0.0] * len(LANGS)
    for w, ks in _VOTES.items():
        if c := words.get(w):
            for k in ks:
                v[k] += c / len(ks)
    return v


def is_english(text: str) -> bool:
    v = language_votes(Counter(_WORD.findall(text.lower())))
    return v[0] > max(v[1:])


GRAM_BITS = 18
_PLAIN = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], np.uint8)


def grams(text: str) -> np.ndarray:
    """Hashed distinct runs of three bytes of the lower-cased text, with a blank for all that is no letter."""
    b = _PLAIN[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    g = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    h = ((g * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS))[(b[:-2] != 32) | (b[1:-1] != 32)].astype(np.int64)
    return distinct(h)


def train_languages(texts: list[str], langs: list[str]) -> np.ndarray | None:
    """Log probabilities of letter runs, a column for each of LANGS: a naive Bayes model, fitted twice, the second time without the
    texts that the first fit puts elsewhere than their label. None where English or all other languages lack texts."""
    own = [(grams(t), LANGS.index(y)) for t, y in zip(texts, langs) if y in LANGS]
    table = None
    for _ in range(2):
        counts = np.zeros((1 << GRAM_BITS, len(LANGS)))
        for g, y in own:
            if table is None or not len(g) or table[g].sum(0).argmax() == y:
                counts[:, y] += np.bincount(g, minlength=1 << GRAM_BITS)
        if not counts[:, 0].any() or not counts[:, 1:].any():
            return None
        table = np.log((counts + 0.1) / (counts.sum(0) + 0.1 * len(counts))).astype(np.float32)
        table[:, counts.sum(0) == 0] = -1e3
    return table


def written_in_english(text: str, languages: np.ndarray | None) -> bool:
    """By the trained model; by function words where there is none."""
    if languages is None:
        return is_english(text)
    g = grams(text)
    return bool(len(g)) and int(languages[g].sum(0).argmax()) == 0


@dataclass
class Model:
    """Log probabilities of all levels side by side: a row for each seen trigram, bigram and word."""

    vocab: dict[str, int]
    tri: np.ndarray
    tri_p: np.ndarray
    bi: np.ndarray
    bi_p: np.ndarray
    uni_p: np.ndarray
    knots: np.ndarray | None = None
    values: np.ndarray | None = None
    share: float = 0.5
    sharpness: float = 20.0

    UNK, NUM, END = 0, 1, 2

    def ids(self, text: str) -> list[int]:
        get = self.vocab.get
        return [get(w, 0) for w in _TOKEN.findall(text.lower())]


def _tokens(text: str) -> list[str]:
    return ["<num>" if w[0].isdigit() else "<end>" if w in _END else w for w in _TOKEN.findall(text.lower())]


def _context(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """u, v, w: each token with its two predecessors; before the first stands an end mark."""
    e = np.full(2, Model.END, np.int64)
    p = np.concatenate([e, t])
    return p[:-2], p[1:-1], t


def _key2(v, w):
    return (v << 21) | w


def _key3(u, v, w):
    return (u << 42) | (v << 21) | w


def train(texts: list[str], levels: list[int], scale: tuple[int, ...] = (1, 2, 3, 4, 5), min_docs: int = 3) -> Model:
    """Fit vocabulary, models and the isotonic map. Half of the texts count n-grams while the other half sets the interpolation
    weights (expectation maximisation); then all count. The map is fitted on scores of texts that their models have not seen."""
    toks = [_tokens(t) for t in texts]
    df = Counter(w for t in toks for w in set(t))
    words = sorted(w for w, c in df.items() if c >= min_docs and w not in ("<num>", "<end>"))[: (1 << 20)]
    vocab = {"<unk>": 0, "<num>": 1, "<end>": 2} | {w: i + 3 for i, w in enumerate(words)}
    n_v = len(vocab)
    ids = [np.array([vocab.get(w, 0) for w in t], np.int64) for t in toks]
    lv = np.array(levels)

    def counts(pick) -> list[dict]:
        out = []
        for level in scale:
            ts = [ids[i] for i in pick if lv[i] == level and len(ids[i])]
            u, v, w = (np.concatenate(x) for x in zip(*map(_context, ts))) if ts else (np.zeros(0, np.int64),) * 3
            k3, c3 = np.unique(_key3(u, v, w), return_counts=True)
            h3, d3 = np.unique(_key2(u, v), return_counts=True)
            k2, c2 = np.unique(_key2(v, w), return_counts=True)
            h2, d2 = np.unique(v, return_counts=True)
            uni = np.bincount(w, minlength=n_v).astype(float)
            out.append({"k3": k3, "c3": c3, "h3": h3, "d3": d3, "k2": k2, "c2": c2, "h2": h2, "d2": d2, "p1": (uni + 0.1) / (uni.sum() + 0.1 * n_v)})
        return out

    def look(keys, values, at):
        if not len(keys):
            return np.zeros(len(at))
        i = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
        return np.where(keys[i] == at, values[i], 0).astype(float)

    def parts(c: dict, u, v, w) -> np.ndarray:
        p3 = look(c["k3"], c["c3"], _key3(u, v, w)) / np.maximum(look(c["h3"], c["d3"], _key2(u, v)), 1)
        p2 = look(c["k2"], c["c2"], _key2(v, w)) / np.maximum(look(c["h2"], c["d2"], v), 1)
        return np.stack([p3, p2, c["p1"][w], np.full(len(w), 1 / n_v)])

    def weights(count_on, tune_on) -> list[np.ndarray]:
        lam = []
        for level, c in zip(scale, counts(count_on)):
            ts = [ids[i] for i in tune_on if lv[i] == level and len(ids[i])]
            x = np.array([0.5, 0.3, 0.15, 0.05])
            if ts:
                p = parts(c, *(np.concatenate(z) for z in zip(*map(_context, ts))))
                for _ in range(12):
                    r = x[:, None] * p
                    x = (r / r.sum(0)).mean(1)
            lam.append(np.maximum(x, 1e-3) / np.maximum(x, 1e-3).sum())
        return lam

    def build(pick, lam) -> Model:
        cs = counts(pick)
        tri = np.unique(np.concatenate([c["k3"] for c in cs]))
        bi = np.unique(np.concatenate([c["k2"] for c in cs]))
        m = (1 << 21) - 1

        def table(u, v, w, order):
            cols = []
            for c, x in zip(cs, lam):
                p = parts(c, u, v, w)
                if order < 3:
                    p[0] = 0
                if order < 2:
                    p[1] = 0
                cols.append(np.log(x @ p))
            return np.stack(cols, 1).astype(np.float32)

        z = np.arange(n_v)
        return Model(vocab, tri, table(tri >> 42, (tri >> 21) & m, tri & m, 3), bi, table(bi * 0, bi >> 21, bi & m, 2), table(z * 0, z * 0, z, 1))

    order = np.random.default_rng(5).permutation(len(ids))
    half = [order[::2], order[1::2]]
    lam = weights(half[0], half[1])
    raw, y = [], []
    for a, b in (half, half[::-1]):  # readings of unseen texts
        raw.append(readings(build(a, lam), [texts[i] for i in b], scale))
        y.append(lv[b])
    by_sentence, mean, known = (np.concatenate(x) for x in zip(*raw))
    y = np.concatenate(y).astype(float)
    model = build(order, lam)
    best = None
    for share in SHARES:
        for sharpness in SHARPNESSES:
            model.share, model.sharpness = float(share), sharpness
            x = blend(model, by_sentence, mean, known, scale)
            wrong = np.abs(np.floor(_step(*isotonic(x, y, 60), x) + 0.5) - y).mean()
            if best is None or wrong < best[0] - 1e-9:
                best = (wrong, model.share, sharpness)
    _, model.share, model.sharpness = best
    model.knots, model.values = isotonic(blend(model, by_sentence, mean, known, scale), y)
    return model


def _step(knots: np.ndarray, values: np.ndarray, x: np.ndarray) -> np.ndarray:
    return values[np.clip(np.searchsorted(knots, x, "right") - 1, 0, None)]


def isotonic(x: np.ndarray, y: np.ndarray, most_blocks: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators under absolute error: a non-decreasing step function by block medians, which a few wrong grades do
    not move. Returns the blocks' first x and values."""
    o = np.argsort(x, kind="stable")
    x, y = x[o], y[o]
    blocks: list[list] = []  # first x, values
    step = max(1, len(x) // most_blocks)
    for i in range(0, len(x), step):
        blocks.append([x[i], list(y[i : i + step])])
        while len(blocks) > 1 and np.median(blocks[-2][1]) >= np.median(blocks[-1][1]):
            last = blocks.pop()
            blocks[-1][1] += last[1]
    return np.array([b[0] for b in blocks]), np.array([np.median(b[1]) for b in blocks])


def surprisals(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(s, doc, sentence start flags as sentence numbers): -log p of every token under every level's model."""
    get = model.vocab.get
    lists = []
    for t in texts:
        lists.append([get(w, 0) if w[0].isalpha() else 1 if w[0].isdigit() else 2 for w in _TOKEN.findall(t.lower())])
    n = np.array([len(x) for x in lists], np.int64)
    flat = np.fromiter((i for x in lists for i in x), np.int64, int(n.sum()))
    doc = np.repeat(np.arange(len(lists)), n)
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    v = np.concatenate([[Model.END], flat[:-1]]) if len(flat) else flat
    u = np.concatenate([[Model.END, Model.END], flat[:-2]])[: len(flat)]
    ok = n > 0
    v[first[ok]] = Model.END
    u[first[ok]] = Model.END
    ok2 = n > 1
    u[first[ok2] + 1] = Model.END
    s = -model.uni_p[flat]
    for keys, table, at in ((model.bi, model.bi_p, _key2(v, flat)), (model.tri, model.tri_p, _key3(u, v, flat))):
        i = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
        hit = keys[i] == at
        s[hit] = -table[i[hit]]
    starts = np.concatenate([[True], (flat[:-1] == Model.END) | (doc[1:] != doc[:-1])]) if len(flat) else np.zeros(0, bool)
    return s, doc, np.cumsum(starts) - 1


def readings(model: Model, texts: list[str], scale: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two readings of each text's surprisal, and whether it has tokens. By sentence: each of four tokens or more is divided among
    the levels by its surprisal under their models, and counts by its tokens. By document: the mean surprisal of all its tokens
    under each model, which weighs how levels are mixed in it."""
    s, doc, sent = surprisals(model, texts)
    levels, known = np.array(scale, float), np.bincount(doc, minlength=len(texts)) > 0
    if not len(s):
        return np.zeros(len(texts)), np.zeros((len(texts), len(levels))), known
    first = np.flatnonzero(np.concatenate([[True], sent[1:] != sent[:-1]]))
    n = np.diff(np.concatenate([first, [len(s)]]))
    of, use = doc[first], np.where(n >= 4, n, 0).astype(float)
    by_sentence = _expected(np.add.reduceat(s, first, axis=0).astype(np.float64), levels)
    by_sentence = np.bincount(of, use * by_sentence, len(texts)) / np.maximum(np.bincount(of, use, len(texts)), 1e-9)
    tokens = np.maximum(np.bincount(doc, minlength=len(texts)), 1)
    mean = np.stack([np.bincount(doc, s[:, i], len(texts)) for i in range(s.shape[1])], 1) / tokens[:, None]
    return by_sentence, mean, known


def blend(model: Model, by_sentence: np.ndarray, mean: np.ndarray, known: np.ndarray, scale: tuple[int, ...]) -> np.ndarray:
    """Expected level of each text from its two readings, with the model's weights; 0 for a text without tokens."""
    score = model.share * by_sentence + (1 - model.share) * _expected(model.sharpness * mean, np.array(scale, float))
    return np.where(known, score, 0.0)


def scores(model: Model, texts: list[str], scale: tuple[int, ...]) -> np.ndarray:
    return blend(model, *readings(model, texts, scale), scale)


def _expected(surprisal: np.ndarray, levels: np.ndarray) -> np.ndarray:
    w = np.exp(surprisal.min(1, keepdims=True) - surprisal)
    return w @ levels / w.sum(1)


def graded(model: Model, score: np.ndarray) -> np.ndarray:
    return np.floor(_step(model.knots, model.values, score) + 0.5).astype(np.int32)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int, most_chars: int = MAX_CHARS) -> list:
    """At most `most` labelled texts of together at most most_chars characters, by hashed id. A document with several labels gets
    their median."""
    one = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.percentile(label_col, F.lit(0.5)).alias("y"))
    few = one.orderBy(F.xxhash64("i"), "i").limit(most)  # bounded, so it may be broadcast
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter("t IS NOT NULL")
    # a row for each id, however often it is repeated: its greatest text
    own = texts.join(F.broadcast(few), "i").groupBy("i").agg(F.max("t").alias("t"), F.first("y").alias("y"))
    return _within(own, most_chars).select("i", "t", F.floor(F.col("y") + 0.5).cast("int").alias("y")).collect()


def _within(few: DataFrame, most_chars: int) -> DataFrame:
    """Rows i, t of a bounded table in the order of their hashed ids, as long as their texts together keep to most_chars."""
    size = F.sum(F.length("t")).over(Window.orderBy(F.xxhash64("i"), "i").rowsBetween(Window.unboundedPreceding, 0))
    return few.withColumn("size", size).filter(F.col("size") <= most_chars)


def language_model(docs: DataFrame, id_col: str, text_col: str, lang_col: str, most: int = LANGUAGE_DOCS) -> np.ndarray | None:
    """train_languages() on at most `most` documents of each language and a quarter of MAX_CHARS, by hashed id. What the documents say of their language is
    only believed where most of them agree."""
    if lang_col not in docs.columns:
        return None
    said = docs.select(F.col(id_col).alias("i"), F.lower(F.trim(lang_col)).alias("l")).filter(F.col("i").isNotNull() & F.col("l").isin(*LANGS)).groupBy("i").agg(F.min("l").alias("l"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("i"), "i"))
    few = said.withColumn("r", rank).filter(F.col("r") <= most).select("i", "l")  # bounded, so it may be broadcast
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter("t IS NOT NULL")
    own = _within(texts.join(F.broadcast(few), "i").groupBy("i").agg(F.max("t").alias("t"), F.first("l").alias("l")), MAX_CHARS // 4).collect()
    own.sort(key=lambda r: str(r.i))
    return train_languages([r.t for r in own], [r.l for r in own])


def reading_levels(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "reading_level", lang_col: str = "lang", max_labelled: int = MAX_LABELLED, min_words: int = MIN_WORDS, scale: tuple[int, ...] = (1, 2, 3, 4, 5)
) -> DataFrame:
    """id, reading_level, score of each document written in English, by its own letters, with at least min_words words.

    English is told by a model of letter runs, fitted on at most LANGUAGE_DOCS documents of each language. The models are fitted on at most max_labelled labelled texts of MAX_CHARS characters; everything else reads all documents and whole texts. Labelled
    documents are graded like any other. Rows with a null id or text are left out; a repeated id counts once, with its highest
    level. Without any label every document gets a null level.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).filter("doc_id IS NOT NULL AND t IS NOT NULL")
    languages = language_model(docs, id_col, text_col, lang_col)
    fit_on = sorted((str(r.i), r.y, r.t) for r in labelled_sample(docs, labels, id_col, text_col, label_col, max_labelled) if r.y in scale and written_in_english(r.t, languages))
    model = train([t for *_, t in fit_on], [y for _, y, _ in fit_on], scale) if fit_on else None
    shared = docs.sparkSession.sparkContext.broadcast((model, languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, told = shared.value
        for whole in batches:
            for at in range(0, len(whole), 2000):  # so many texts at once bound the memory for their tokens
                b = whole.slice(at, 2000)
                texts = b.column(1).to_pylist()
                keep = [i for i, t in enumerate(texts) if enough_english(t, min_words, told)]
                if not keep:
                    continue
                if m is None:
                    s, g = pa.nulls(len(keep), pa.float64()), pa.nulls(len(keep), pa.int32())
                else:
                    x = scores(m, [texts[i] for i in keep], scale)
                    s, g = pa.array(x), pa.array(graded(m, x))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), g, s], ["doc_id", "reading_level", "score"])

    found = rows.mapInArrow(run, f"doc_id {id_type}, reading_level int, score double")
    return found.groupBy("doc_id").agg(F.max(F.struct("reading_level", "score")).alias("r")).select("doc_id", "r.*")


def enough_english(text: str, min_words: int, languages: np.ndarray | None = None) -> bool:
    if len(text) < 2 * min_words - 1:
        return False
    words = 0
    for _ in _WORD.finditer(text.lower()):
        words += 1
        if words == min_words:
            break
    if words < min_words and sum(any(c.isalpha() for c in w) for w in text.split()) < min_words:
        return False
    return written_in_english(text, languages)
