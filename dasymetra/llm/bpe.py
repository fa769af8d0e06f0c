"""Encoding of a corpus with a public byte-level BPE vocabulary, by an index of pair occurrences."""

from __future__ import annotations

import heapq
import json
import os
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dasymetra.plans.common import free_name

DEFAULT_FOLDER = "/opt/tokenizers"
#: The public pattern that splits text before the merges of this vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids a task remembers; beyond that it forgets them all and goes on.
REMEMBERED_WORDS = 200_000


@dataclass(frozen=True)
class Vocabulary:
    """first: id of each byte. merged: (left id * 2^20 + right id) -> (rank, id). pattern: how text is split."""

    first: list[int]
    merged: dict[int, tuple[int, int]]
    pattern: str = PATTERN


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes: printable ones for themselves, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


def load_vocabulary(name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER) -> Vocabulary:
    """Read ``folder``/``name``.json; special tokens are left out, so their strings are ordinary text."""
    with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids = model["vocab"]
    first = [0] * 256
    for letter, byte in byte_letters().items():
        first[byte] = ids[letter]
    merged = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merged[ids[left] << 20 | ids[right]] = (rank, ids[left + right])
    return Vocabulary(first, merged)


def encode_words(words: list[bytes], vocabulary: Vocabulary) -> list[list[int]]:
    """Ids of each word, all words together.

    All symbols stand in one linked list, words apart. The index maps each pair that some rank merges to
    the positions where it occurs; ranks with occurrences wait in a heap. The lowest is taken, its
    occurrences are merged from left to right, and the pairs that arise beside them enter the index.
    An occurrence that an earlier merge consumed is recognised and skipped. The time is in proportion to
    the symbols and the logarithm of the active ranks, also for one word of any length.
    """
    merged, first = vocabulary.merged, vocabulary.first
    symbols: list[int] = []
    starts = []
    for word in words:
        starts.append(len(symbols))
        symbols += [first[b] for b in word]
        symbols.append(-1)
    after = list(range(1, len(symbols) + 1))
    before = list(range(-1, len(symbols) - 1))
    places: dict[int, list[int]] = {}
    left = -1
    for at, right in enumerate(symbols):
        if left >= 0 and right >= 0 and (pair := left << 20 | right) in merged:
            places.setdefault(pair, []).append(at - 1)
        left = right
    heap = [(merged[pair], pair) for pair in places]
    heapq.heapify(heap)
    while heap:
        (_, new), pair = heapq.heappop(heap)
        a, b = pair >> 20, pair & 0xFFFFF
        for at in sorted(places.pop(pair)):
            if symbols[at] != a:
                continue
            end = after[at]
            if symbols[end] != b:
                continue
            symbols[at], symbols[end] = new, -2
            follow = after[at] = after[end]
            before[follow] = at
            for p, x, y in ((before[at], symbols[before[at]] if before[at] >= 0 else -1, new), (at, new, symbols[follow])):
                if x >= 0 and y >= 0 and (arisen := x << 20 | y) in merged:
                    known = places.get(arisen)
                    if known is None:
                        places[arisen] = [p]
                        heapq.heappush(heap, (merged[arisen], arisen))
                    else:
                        known.append(p)
    out = []
    for at in starts:
        ids = []
        while symbols[at] >= 0:
            ids.append(symbols[at])
            at = after[at]
        out.append(ids)
    return out


class Encoder:
    """Encodes batches of texts; words met before are remembered up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.split = regex.compile(vocabulary.pattern).findall
        self.known: dict[str, list[int]] = {}

    def batch(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.split(t) if t else [] for t in texts]
        fresh = list({w for words in split for w in words} - self.known.keys())
        if len(self.known) + len(fresh) > REMEMBERED_WORDS:
            self.known.clear()
            fresh = list({w for words in split for w in words})
        self.known.update(zip(fresh, encode_words([w.encode("utf-8", "surrogatepass") for w in fresh], self.vocabulary)))
        known = self.known
        return [[i for w in words for i in known[w]] for words in split]


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: list[str] | None = None, count_only: bool = False) -> DataFrame:
    """The kept columns and ``ids``, the token ids of each text without special tokens, or only ``n_tokens``.

    A null or empty text has no ids: an empty list, never null. Any Unicode text of any length encodes
    whole; repeated rows encode alike and stay. A kept column called ids or n_tokens pushes the new one
    to ids_ or n_tokens_. No shuffle: each partition is encoded where it lies, each distinct word of a batch
    once. The vocabulary (a few MB, whatever the corpus) is sent to the executors once.
    """
    keep = list(docs.columns if keep is None else keep)
    new = free_name(keep, "n_tokens" if count_only else "ids")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(True).alias("_")]).alias("kept"), F.col(f"`{text}`").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            ids = encoder.batch(batch.column(1).to_pylist())
            out = pa.array([len(x) for x in ids], pa.int64()) if count_only else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=["kept", "ids"])

    kind = T.LongType() if count_only else T.ArrayType(T.IntegerType())
    out = packed.mapInArrow(run, T.StructType([packed.schema["kept"], T.StructField("ids", kind)]))
    return out.select(*[F.col(f"kept.`{c}`").alias(c) for c in keep], F.col("ids").alias(new))
