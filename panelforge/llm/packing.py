"""Lexical retrieval packing: windows are filled with a seed document's BM25 neighbours."""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.shared import materialize

WINDOW = 1024
#: Tokens of an index shard, which one task holds: 4 bytes each, and about as much again for its postings.
SHARD_TOKENS = 500_000
#: Bytes of text that are tokenised at a time.
TEXT_BYTES = 12_000_000
#: Neighbours that are sorted at a time.
SORTED = 64
#: A term that one in so many documents has gets a weight for each document instead of postings.
DENSE = 4
K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(2)
def encoder(tokenizer_json: str, ranks_file: str | None = None):
    """A function from texts to the bytes of their ids, little-endian uint16: those of the tokenizer file, through its ranks where given (several times faster, same ids). A worker reads the files once."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer_json)
    if ranks_file is None:
        return lambda texts: [np.array(e.ids, "<u2").tobytes() for e in slow.encode_batch(texts, add_special_tokens=False)]
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = [t.content for t in slow.get_added_tokens_decoder().values()]

    def one(text: str) -> bytes:
        if any(s in text for s in special):
            return np.array(slow.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        return fast.encode_to_numpy(text, disallowed_special=()).astype("<u2").tobytes()

    spaced = np.zeros(1 << 16, bool)
    spaced[[i for b, i in ranks.items() if b[:1] == b" "]] = True

    def many(texts: list[str]) -> list[bytes]:
        """one() of each. The pattern always cuts between a character and a space before another one, so a word with the space before it has the same ids everywhere, and is encoded once."""
        split = pc.split_pattern(pa.array(texts, pa.string()), " ")
        ends = split.offsets.to_numpy()
        coded = split.values.dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy()
        trimmed = pc.utf8_trim_whitespace(words)
        plain = pc.and_(pc.equal(trimmed, words), pc.not_equal(words, "")).to_numpy(zero_copy_only=False)
        kept = words.filter(pa.array(plain))
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(kept)], kept), " ")[0].as_py()
        ids = fast.encode_to_numpy(" " + joined, disallowed_special=()).astype("<u2") if len(kept) else np.zeros(0, "<u2")
        # of these ids, those that begin with a space begin a word
        first, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        first[plain] = np.flatnonzero(spaced[ids])
        size[plain] = np.diff(np.r_[first[plain], len(ids)])
        sizes = size[codes]
        sizes[ends[:-1]] = 0  # a text's first word has no space before it
        after = np.cumsum(sizes)
        ids = ids[np.arange(sizes.sum()) + np.repeat(first[codes] - (after - sizes), sizes)]
        at = np.r_[0, after][ends].tolist()
        odd = np.diff(np.r_[0, np.cumsum(~plain[codes])][ends]).tolist()
        heads = [t.partition(" ")[0] for t in texts]
        return [
            one(t) if bad or any(s in t for s in special) else one(head) + ids[a:b].tobytes() for t, head, bad, a, b in zip(texts, heads, odd, at, at[1:])
        ]

    return many


def routes(n: int = 2, seed: int = 7) -> np.ndarray:
    """n weights of every id: a document is routed by the least ones of its ids.

    The least of exponential draws over weights falls on an id with a chance by its
    weight, and on the same id in two documents by the weight that they share. Ids
    of byte pairs rise as the pairs get rarer, so their logarithm tells rare ids.
    """
    draws = np.random.default_rng(seed).exponential(size=(n, 1 << 16))
    return draws / np.log(2 + np.arange(1 << 16)) ** 3


def tokenised(docs: DataFrame, tokenizer_json: str, ranks_file: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, place, n, route, then, ids): ids as little-endian uint16 with a final 0, place the row's number, route and then the ids that say where it is indexed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, weights = encoder(tokenizer_json, ranks_file), routes()
        part, row = TaskContext.get().partitionId(), 0
        for whole in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // TEXT_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), whole.num_rows]
            for first, end in zip(cuts, cuts[1:]):
                batch = whole.slice(first, end - first)
                raw = [ids + b"\0\0" for ids in encode([t or "" for t in batch.column(1).to_pylist()])]
                coded = [np.frombuffer(ids, "<u2") for ids in raw]
                places = [(part << 33) + row + i for i in range(len(coded))]
                row += len(coded)
                least = np.array([c[w[c].argmin()] for c in coded for w in weights], np.int32).reshape(-1, len(weights))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array(places, pa.int64()), pa.array([len(c) for c in coded], pa.int32()),
                        pa.array(least[:, 0]), pa.array(least[:, 1]), pa.array(raw, pa.binary()),
                    ],
                    ["doc_id", "place", "n", "route", "then", "ids"],
                )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, place long, n int, route int, then int, ids binary")


def document_frequencies(tokens: DataFrame) -> tuple[np.ndarray, int, int]:
    """In how many of all documents each of the 2^16 ids occurs, the documents, and their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, seen = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, bool)
        for batch in batches:
            for ids in batch.column(0):
                seen[np.frombuffer(ids.as_py(), "<u2")] = True
                own = np.flatnonzero(seen)
                df[own] += 1
                seen[own] = False
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"id": pa.array(some, pa.int64()), "df": pa.array(df[some], pa.int64())})

    out = np.zeros(1 << 16, np.int64)
    for r in tokens.select("ids").mapInArrow(run, "id long, df long").groupBy("id").agg(F.sum("df").alias("df")).collect():
        out[r["id"]] = r["df"]
    docs, total = tokens.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return out, docs, total


def give_back() -> None:
    """A worker waits for a minute after its last task, beside the JVM's next stage: the tokenisers and freed memory go."""
    encoder.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


class Shard:
    """An inverted index of some documents, with BM25 weights by the counts of the whole corpus."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        terms, owners, weights, self.queries = [], [], [], []
        for k, ids in enumerate(docs):
            t, f = np.unique(ids[:-1], return_counts=True)
            terms.append(t)
            owners.append(np.full(len(t), k, np.int32))
            weights.append(idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(ids) / mean)))
            self.queries.append(t)
        term = np.concatenate(terms) if terms else np.zeros(0, np.uint16)
        order = np.argsort(term, kind="stable")
        self.owners = np.concatenate(owners)[order] if terms else np.zeros(0, np.int32)
        self.weights = np.concatenate(weights)[order] if terms else np.zeros(0)
        self.starts = np.searchsorted(term[order], np.arange((1 << 16) + 1))
        self.n = len(docs)
        counts = np.diff(self.starts)
        common = np.flatnonzero(counts * DENSE > self.n)
        self.row = np.full(1 << 16, -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.n))
        for k, t in enumerate(common.tolist()):
            a, b = self.starts[t], self.starts[t + 1]
            self.dense[k, self.owners[a:b]] = self.weights[a:b]

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of each document, with all terms of the seed."""
        terms = self.queries[seed]
        rows = self.row[terms]
        rare = terms[rows < 0].astype(np.int64)
        first, size = self.starts[rare], self.starts[rare + 1] - self.starts[rare]
        at = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
        return self.dense[rows[rows >= 0]].sum(0) + np.bincount(self.owners[at], self.weights[at], self.n)


def ranked(scores: np.ndarray) -> Iterator[int]:
    """Every document with a score, the best first (ties: the earlier one); some at a time are sorted."""
    left = np.flatnonzero(scores > 0)
    while len(left):
        own = scores[left]
        last = np.partition(own, -SORTED)[-SORTED] if len(left) > SORTED else 0.0
        best = left[own >= last]
        yield from best[np.lexsort((best, -scores[best]))].tolist()
        left = left[own < last]


def fill_windows(sizes: list[int], index: Shard, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece.

    A window begins with what is left of the last document, or the first unused
    one, as its seed. Unused neighbours follow, the best score first (ties: the
    earlier document; without any, the next unused one); the one that meets the
    end is cut, and its rest is the next seed. Only the last window can be short.
    """
    unused = np.ones(len(sizes), bool)
    first, sequence, offset, rest = 0, 0, 0, None
    queue: Iterator[int] = iter(())
    while True:
        if rest is None:
            doc = next((d for d in queue if unused[d]), None) if offset else None
            if doc is None:
                while first < len(sizes) and not unused[first]:
                    first += 1
                if first == len(sizes):
                    return
                doc = first
            unused[doc], start = False, 0
        else:
            doc, start = rest
        if not offset:  # a new seed, unless it fills the window alone
            queue = iter(())
            if sizes[doc] - start < window:
                queue = ranked(np.where(unused, index.scores(doc), 0))
        length = min(sizes[doc] - start, window - offset)
        yield doc, start, length, sequence, offset
        rest = (doc, start + length) if start + length < sizes[doc] else None
        offset += length
        if offset == window:
            sequence, offset = sequence + 1, 0


def pack(docs: DataFrame, tokenizer_json: str, ranks_file: str | None = None, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """A row for each piece of each document's tokens (its ids and a final 0): PIECES.

    Documents are in index shards of about SHARD_TOKENS tokens, in ranges of
    (route, then, place): those that share rare ids tend to one shard, whatever the
    number of shards, and a group of copies too large for one is split by place.
    Each shard's windows are filled by themselves, so all but one of a shard are
    full. Null and empty texts are the one id 0; repeated rows are documents of
    their own. ids_crc32 is that of the ids as little-endian uint32.
    """
    tokens = materialize(tokenised(docs, tokenizer_json, ranks_file, text, key), "tokens")
    df, n, total = document_frequencies(tokens)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    mean = max(1.0, total / max(1, n))
    shards = max(1, -(-total // SHARD_TOKENS))
    stats = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("place", "doc_id", "ids")))]  # some SHARD_TOKENS of 2 bytes
        rows.sort(key=lambda r: r[0])
        own, doc_ids = [np.frombuffer(r[2], "<u2") for r in rows], [r[1] for r in rows]
        shard = TaskContext.get().partitionId()
        pieces = [
            (doc_ids[d], start, length, zlib.crc32(own[d][start : start + length].astype("<u4").tobytes()), len(own[d]), (shard << 32) + seq, offset)
            for d, start, length, seq, offset in fill_windows([len(x) for x in own], Shard(own, stats.value, mean), window)
        ]
        names = [f.split()[0] for f in PIECES.split(", ")]
        for first in range(0, len(pieces), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(list(v), pa.int64()) for v in zip(*pieces[first : first + 10_000])], names)
        del rows, own, doc_ids, pieces
        give_back()

    return tokens.select("route", "then", "place", "doc_id", "ids").repartitionByRange(shards, "route", "then", "place").mapInArrow(run, PIECES)
