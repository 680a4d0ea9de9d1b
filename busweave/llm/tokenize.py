"""Encoding with a public byte-level BPE vocabulary.

Texts are cut into words by the vocabulary's pattern; each distinct word of a batch is encoded once. All new words of a batch are
encoded together with a pair occurrence index: a map from each pair of neighbouring symbols to all its positions, worked off in
ascending rank, so that a merge touches only the places where it applies and the pairs next to them.
"""

from __future__ import annotations

import importlib.util
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Words kept between batches of one task; beyond it the cache starts anew.
CACHED_WORDS = 400_000
# Fixed value: the word pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_dir(path: str | None = None) -> str:
    """The folder of the vocabulary files: the parameter, TOKENIZER_DIR, or where they are installed."""
    if path or os.environ.get("TOKENIZER_DIR"):
        return path or os.environ["TOKENIZER_DIR"]
    spec = importlib.util.find_spec("public_tokenizers")
    return os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class PairEncoder:
    """Words (bytes) to ids by merging pairs in ascending rank."""

    def __init__(self, vocabulary_file: str):
        with open(vocabulary_file, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, letters = model["vocab"], _byte_letters()
        self.byte_id = [0] * 256
        for letter, byte in letters.items():
            self.byte_id[byte] = vocab[letter]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge[vocab[a], vocab[b]] = (rank, vocab[a + b])

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word. Symbols of all words lie in one array; -1 between words keeps pairs apart."""
        symbols: list[int] = [-1]
        begins = []
        for w in words:
            begins.append(len(symbols))
            symbols += [self.byte_id[b] for b in w]
            symbols.append(-1)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merge = self.merge
        places: dict[tuple[int, int], list[int]] = {}
        for i in range(1, n - 1):
            pair = (symbols[i], symbols[i + 1])
            if pair in merge:
                places.setdefault(pair, []).append(i)
        active = [(merge[p][0], p) for p in places]
        heapify(active)
        while active:
            rank, pair = heappop(active)
            left, right = pair
            made = merge[pair][1]
            at = places.pop(pair)
            at.sort()
            fresh: set[tuple[int, int]] = set()
            for i in at:
                j = after[i]
                if symbols[i] != left or j >= n or symbols[j] != right:
                    continue  # merged away meanwhile
                symbols[i], symbols[j] = made, -2
                k = after[j]
                after[i], before[k] = k, i
                h = before[i]
                for p, where in (((symbols[h], made), h), ((made, symbols[k]), i)):
                    if p in merge:
                        if p not in places:
                            places[p] = []
                            fresh.add(p)
                        places[p].append(where)
            for p in fresh:
                heappush(active, (merge[p][0], p))
        out = []
        for start, w in zip(begins, words):
            ids, i, end = [], start, start + len(w)
            while i < end:
                ids.append(symbols[i])
                i = after[i]
            out.append(ids)
        return out


@lru_cache(maxsize=4)
def _encoder(vocabulary_file: str) -> PairEncoder:
    return PairEncoder(vocabulary_file)


def _texts_to_ids(texts: list, cut, encoder: PairEncoder, known: dict[str, tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and offsets of a batch of texts; nulls are empty. Lone surrogates can't occur in Arrow strings."""
    words = [cut(t) if t else () for t in texts]
    if len(known) > CACHED_WORDS:
        known.clear()
    new = list({w for ws in words for w in ws if w not in known})
    for w, ids in zip(new, encoder.encode([w.encode("utf-8") for w in new])):
        known[w] = tuple(ids)
    get = known.__getitem__
    per_text = [list(chain.from_iterable(map(get, ws))) for ws in words]
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in per_text], out=offsets[1:])
    return np.fromiter(chain.from_iterable(per_text), dtype=np.int32, count=int(offsets[-1])), offsets


def _encode_batches(batches: Iterator[pa.RecordBatch], vocabulary_file: str, keep: list[str], counts_only: bool) -> Iterator[pa.RecordBatch]:
    import regex

    cut, encoder, known = regex.compile(PATTERN).findall, _encoder(vocabulary_file), {}
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        # A slice at a time, so that a batch of very long texts needs no second copy of all its words at once.
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size < 2_000_000):
                size += len(texts[stop].as_py() or "")
                stop += 1
            flat, offsets = _texts_to_ids(texts.slice(start, stop - start).to_pylist(), cut, encoder, known)
            if counts_only:
                value = pa.array(np.diff(offsets), pa.int64())
            else:
                value = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            kept = [batch.column(c).slice(start, stop - start) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, value], names=[*keep, "n_tokens" if counts_only else "ids"])
            start = stop


def encode_texts(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str = "byte_bpe_50k.json", path: str | None = None, counts_only: bool = False, then: tuple | None = None) -> DataFrame:
    """``keep`` columns and ``ids`` (array of int), or ``n_tokens`` with ``counts_only``; without special tokens, whose strings are ordinary text.

    Null and empty texts have an empty list (0 tokens). Whole texts are encoded, of any length. Every row stays, repeated or not.
    No shuffle: one pass of Arrow batches. ``then`` is a function of the resulting batches that goes on in the same pass, and the schema
    of what it gives.
    """
    made = "n_tokens" if counts_only else "ids"
    if made in keep:
        raise ValueError(f"a kept column has the name of the result, {made}")
    file = os.path.join(tokenizer_dir(path), vocabulary)
    slim = docs.select(*keep, F.col(text).cast("string").alias("_text_to_encode"))
    fields = [f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join([*fields, "n_tokens bigint" if counts_only else "ids array<int>"])
    step, schema = then or ((lambda it: it), schema)
    return slim.mapInArrow(lambda it: step(_encode_batches(it, file, keep, counts_only)), schema)
