"""Corpus encoding by monoid tree reduction over a byte-level BPE vocabulary.

A text is cut in halves until a piece is short enough to encode at once. Two neighbours are joined by re-encoding a window
around their boundary. The window grows until it ends, on both sides, at a place that no tokenization can cross: a white
space character right after an ASCII letter or digit. There the pre-tokenizer's pattern must end one match and begin
another, whatever stands further left or right, so the tokens outside the window are the tokens of the whole text.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
# Fixed value: the pre-tokenizer pattern that the public vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF_CHARS = 4096
_SAFE = re.compile(r"(?<=[A-Za-z0-9])[ \n]")
_encoders: dict[str, MonoidEncoder] = {}


class MonoidEncoder:
    """encode(text) gives the ids of the whole text as int32; decode concatenates the tokens' bytes."""

    def __init__(self, vocabulary: bytes, leaf_chars: int = LEAF_CHARS):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self._bpe = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._bytes = {i: b for b, i in ranks.items()}
        self._n_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for b, i in ranks.items():
            self._n_bytes[i] = len(b)
        self.leaf_chars = leaf_chars

    def _leaf(self, text: str) -> np.ndarray:
        return self._bpe.encode_to_numpy(text, disallowed_special=()).astype(np.int32)

    def encode(self, text: str) -> np.ndarray:
        return self._span(text, 0, len(text)) if text else np.zeros(0, np.int32)

    def _span(self, text: str, lo: int, hi: int) -> np.ndarray:
        if hi - lo <= self.leaf_chars:
            return self._leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._span(text, lo, mid), self._span(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        i, j = self._stable_left(text, lo, mid), self._stable_right(text, mid, hi)
        if i == j:
            return np.concatenate([left, right])
        drop_l = self._tokens_in(left[::-1], len(text[i:mid].encode()))
        drop_r = self._tokens_in(right, len(text[mid:j].encode()))
        window = self._span(text, i, j) if j - i < hi - lo and j - i > self.leaf_chars else self._leaf(text[i:j])
        return np.concatenate([left[: len(left) - drop_l], window, right[drop_r:]])

    def _tokens_in(self, ids: np.ndarray, n_bytes: int) -> int:
        """How many of the first ids make up exactly n_bytes; a stable place is always between two tokens."""
        if not n_bytes:
            return 0
        sums = np.cumsum(self._n_bytes[ids])
        k = int(np.searchsorted(sums, n_bytes)) + 1
        if sums[k - 1] != n_bytes:
            raise AssertionError("a stable place fell inside a token")
        return k

    @staticmethod
    def _stable_left(text: str, lo: int, mid: int) -> int:
        """The stable place nearest to mid on its left (mid itself included), else lo; looked for in a window that doubles."""
        width = 64
        while True:
            start = max(lo, mid - width)
            last = None
            for m in _SAFE.finditer(text, max(start, lo + 1), min(mid + 1, len(text))):
                last = m.start()
            if last is not None:
                return last
            if start == lo:
                return lo
            width *= 2

    @staticmethod
    def _stable_right(text: str, mid: int, hi: int) -> int:
        width = 64
        while True:
            end = min(hi, mid + width)
            m = _SAFE.search(text, mid, end)
            if m:
                return m.start()
            if end == hi:
                return hi
            width *= 2

    def decode(self, ids) -> str:
        def tree(a: int, b: int) -> bytes:
            return b"".join(self._bytes[int(i)] for i in ids[a:b]) if b - a <= 1024 else tree(a, (a + b) // 2) + tree((a + b) // 2, b)

        return tree(0, len(ids)).decode("utf-8", errors="replace")


def vocabulary(tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> bytes:
    with open(os.path.join(tokenizer_dir, f"{tokenizer}.tiktoken"), "rb") as f:
        return f.read()


def encoder(shared, leaf_chars: int = LEAF_CHARS) -> MonoidEncoder:
    """One encoder per worker process and vocabulary. shared: (digest, broadcast file of under 2 MB), so that workers need no file
    of their own."""
    digest, sent = shared
    key = f"{digest}/{leaf_chars}"
    if key not in _encoders:
        _encoders[key] = MonoidEncoder(sent.value, leaf_chars)
    return _encoders[key]


def _shared(df: DataFrame, tokenizer: str, tokenizer_dir: str):
    raw = vocabulary(tokenizer, tokenizer_dir)
    return xxhash.xxh64_hexdigest(raw), df.sparkSession.sparkContext.broadcast(raw)


def encode_corpus(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR
) -> DataFrame:
    """(id, ids): the token ids of each row's text, row by row, without a shuffle.

    Null text gives null, empty text an empty list. Rows are neither merged nor dropped: a repeated row or a null id comes
    out as often as it went in. Strings that look like control tokens are ordinary text. Other columns are not read.
    """
    shared = _shared(df, tokenizer, tokenizer_dir)
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared)
        for b in batches:
            texts = b.column(1).to_pylist()
            parts = [enc.encode(t) if t else None for t in texts]
            offsets = np.zeros(len(texts) + 1, np.int32)
            np.cumsum([0 if p is None else len(p) for p in parts], out=offsets[1:])
            values = np.concatenate([np.zeros(0, np.int32), *[p for p in parts if p is not None]])
            mask = pa.array([t is None for t in texts], pa.bool_())
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=mask)
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc_id", "ids"])

    return src.mapInArrow(run, f"doc_id {id_type}, ids array<int>")


def count_tokens(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR
) -> DataFrame:
    """(id, n_tokens) of each row with a non-null text; empty text counts 0."""
    shared = _shared(df, tokenizer, tokenizer_dir)
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    id_type = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared)
        for b in batches:
            n = pa.array([len(enc.encode(t)) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n], ["doc_id", "n_tokens"])

    return src.mapInArrow(run, f"doc_id {id_type}, n_tokens bigint")
