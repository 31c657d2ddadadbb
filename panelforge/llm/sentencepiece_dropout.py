"""SentencePiece BPE encoding with seeded merge-dropout, and decoding."""

from __future__ import annotations

import heapq
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panelforge.llm.shingles import mix

#: A segment starts with its spaces: no piece has a space after another character.
_SEGMENT = re.compile(r" *[^ ]+| +")
_MARK = "▁"
#: Segments whose merges without dropout are kept; beyond that, those of the latest texts stay.
CACHE = 200_000
#: Occurrences merged side by side, and characters of texts that are encoded at a time.
ROWS, TEXTS = 20_000, 1_200_000
_NO_PIECE = 1 << 24
_ODD = 0x9E3779B1, 0x85EBCA6B


class Encoder:
    """Encodes texts with the pieces of a model file.

    With dropout 0 the ids are those of the model, but for a literal U+2581 in a
    text, which becomes bytes, so that every text decodes to itself.
    """

    def __init__(self, model_file: str, dropout: float = 0.0, seed: int = 0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(pieces) if sp.is_byte(i)}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {pieces[i]: i for i in plain}
        scores = sorted({sp.get_score(i) for i in plain}, reverse=True)
        order = {s: k for k, s in enumerate(scores)}
        self.rank = {pieces[i]: order[sp.get_score(i)] for i in plain}
        self.none = len(scores)
        #: The keyed hash's last step: a seeded table that says skip or not.
        self.skip = (np.random.default_rng(seed).random(1 << 16) < dropout).tolist() if dropout > 0 else None
        self.seed = seed
        #: Of a segment: its hash, the merges without dropout as what each adds to a key, and the ids they lead to.
        self.cache: dict[str, tuple[int, bytes, bytes]] = {}

    def _merge(self, symbols: list[str], key: int) -> list[str]:
        """Merge by an agenda of candidates, the best rank first, then the leftmost.

        A candidate that comes up is skipped if the keyed hash of its place and
        piece says so. What a later merge beside it makes is a new candidate. The
        agenda of a short segment is a list, of a long one a heap, with equal results.
        """
        return (self._merge_list if len(symbols) <= 40 else self._merge_heap)(symbols, key)

    def _merge_list(self, symbols: list[str], key: int) -> list[str]:
        rank, none, skip = self.rank.get, self.none, self.skip
        agenda = [rank(a + b, none) for a, b in zip(symbols, symbols[1:])]
        agenda.append(none)
        places = list(range(len(symbols)))
        while (r := min(agenda)) < none:
            i = agenda.index(r)
            if skip is not None and skip[(key + r * _ODD[0] + places[i] * _ODD[1] >> 8) & 0xFFFF]:
                agenda[i] = none
                continue
            symbols[i] += symbols.pop(i + 1)
            del places[i + 1], agenda[i + 1]
            agenda[i] = rank(symbols[i] + symbols[i + 1], none) if i + 1 < len(symbols) else none
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + symbols[i], none)
        return symbols

    def _merge_heap(self, symbols: list[str], key: int) -> list[str]:
        rank, none, skip = self.rank.get, self.none, self.skip
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            r = rank(symbols[i] + symbols[i + 1], none)
            if r < none:
                agenda.append((r, i, i + 1, len(symbols[i]) + len(symbols[i + 1])))
        heapq.heapify(agenda)
        while agenda:
            r, i, j, length = heapq.heappop(agenda)
            a, b = symbols[i], symbols[j]
            if not a or not b or after[i] != j or len(a) + len(b) != length:
                continue
            if skip is not None and skip[(key + r * _ODD[0] + i * _ODD[1] >> 8) & 0xFFFF]:
                continue
            symbols[i], symbols[j] = a + b, ""
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                r = rank(symbols[i] + symbols[k], none)
                if r < none:
                    heapq.heappush(agenda, (r, i, k, length + len(symbols[k])))
            k = before[i]
            if k >= 0:
                r = rank(symbols[k] + symbols[i], none)
                if r < none:
                    heapq.heappush(agenda, (r, k, i, length + len(symbols[k])))
        return [s for s in symbols if s]

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        """A hash of each of some segments of one length, a row of code points each."""
        with np.errstate(over="ignore"):
            key = np.zeros(len(codes), np.uint64)
            for k in range(codes.shape[1]):
                key = (key ^ codes[:, k].astype(np.uint64)) * np.uint64(0x100000001B3)
            return mix(key)

    def _places(self, key: int, n: int) -> np.ndarray:
        """The dropout keys of the places 0 to n - 1 of a document, to be mixed with the hash of the segment there."""
        with np.errstate(over="ignore"):
            start = mix(np.array([key % 2**64], np.uint64) + np.uint64(self.seed * 1_000_003 % 2**63))
            return mix(start + np.arange(n, dtype=np.uint64))

    def _segment(self, segment: str, key: int) -> bytes:
        # a literal mark gets a second character, so that it is in no piece
        symbols = [_MARK if c == " " else "\x00▁" if c == _MARK else c for c in segment]
        out: list[int] = []
        for s in self._merge(symbols, key):
            i = self.ids.get(s)
            if i is None:
                out += [self.byte_ids[x] for x in s.lstrip("\x00").encode()] if s != "\x00" else [self.byte_ids[0]]
            else:
                out.append(i)
        return array("i", out).tobytes()

    def _tables(self) -> None:
        """Arrays for merging many segments at once: ids of characters, and an open-addressed hash of pairs."""
        self.char_ids = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char_ids[ord(" " if p == _MARK else p)] = i
        pairs = [
            (self.ids[a] << 32 | self.ids[b], self.rank[p], self.ids[p])
            for p in self.ids for k in range(1, len(p)) if (a := p[:k]) in self.ids and (b := p[k:]) in self.ids
        ]
        self.bits = max(4, (len(pairs) * 4).bit_length())
        self.pair_keys = np.full(1 << self.bits, -1, np.int64)
        self.pair_ranks = np.full(1 << self.bits, self.none, np.int32)
        self.pair_ids = np.full(1 << self.bits, -1, np.int32)
        keys = np.array([x[0] for x in pairs], np.int64)
        self.probes = 0
        for key, at, (_, r, i) in zip(keys.tolist(), self._slot(keys).tolist(), pairs):
            steps = 1
            while self.pair_keys[at] >= 0:
                at, steps = (at + 1) & ((1 << self.bits) - 1), steps + 1
            self.pair_keys[at], self.pair_ranks[at], self.pair_ids[at] = key, r, i
            self.probes = max(self.probes, steps)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair of ids; the rank `none` if it merges into nothing."""
        keys = a.astype(np.int64) << 32 | b
        at = self._slot(keys)
        ranks, ids = np.full(len(keys), self.none, np.int32), np.full(len(keys), -1, np.int32)
        left = np.arange(len(keys))
        for _ in range(self.probes):
            found = self.pair_keys[at]
            hit = found == keys
            ranks[left[hit]], ids[left[hit]] = self.pair_ranks[at[hit]], self.pair_ids[at[hit]]
            go = ~hit & (found >= 0)
            if not go.any():
                break
            left, keys, at = left[go], keys[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return ranks, ids

    def _many(self, segments: list[str], which: np.ndarray, keys: np.ndarray | None, path: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids, one occurrence after the other, and how many each has, of occurrences of segments of one length: the agendas of all run side by side, a step of each at a time.

        which: the segment of each occurrence. keys: their dropout keys; without, nothing
        is skipped. path gets (occurrences, what the merge adds to a key) of each step.
        """
        n, size = len(which), len(segments[0])
        codes = np.frombuffer("".join(segments).encode("utf-32-le"), "<u4").reshape(len(segments), size)
        ids = self.char_ids[codes]
        odd = ids < 0
        ids[odd] = codes[odd].astype(np.int32) + _NO_PIECE  # a character without a piece is in no pair
        skip = None if keys is None else self.skips

        def adds(r: np.ndarray, i: np.ndarray) -> np.ndarray:
            with np.errstate(over="ignore"):
                return r.astype(np.uint64) * np.uint64(_ODD[0]) + i.astype(np.uint64) * np.uint64(_ODD[1])

        def candidates(row: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
            r, m = self._pairs(ids[row, i], ids[row, j])
            if skip is not None:
                with np.errstate(over="ignore"):
                    r[skip[(keys[row] + adds(r, i) >> np.uint64(8)) & np.uint64(0xFFFF)]] = self.none
            ranks[row, i], merged[row, i] = r, m

        first, into = (x.reshape(len(segments), size - 1)[which] for x in self._pairs(ids[:, :-1].reshape(-1), ids[:, 1:].reshape(-1)))
        if skip is not None:
            with np.errstate(over="ignore"):
                first[skip[(keys[:, None] + adds(first, np.arange(size - 1)) >> np.uint64(8)) & np.uint64(0xFFFF)]] = self.none
        ids = ids[which]
        ranks, merged = np.full((n, size), self.none, np.int32), np.empty((n, size), np.int32)
        ranks[:, :-1], merged[:, :-1] = first, into
        after = np.tile(np.arange(1, size + 1, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, size - 1, dtype=np.int32), (n, 1))
        row = np.arange(n)
        while True:
            i = ranks[row].argmin(1)
            go = ranks[row, i] < self.none
            row, i = row[go], i[go]
            if not len(row):
                break
            if path is not None:
                path.append((row, adds(ranks[row, i], i)))
            j = after[row, i]
            k = after[row, j]
            ids[row, i] = merged[row, i]
            ids[row, j], ranks[row, j] = -1, self.none
            after[row, i] = k
            ranks[row, i] = self.none
            more = k < size
            before[row[more], k[more]] = i[more]
            candidates(row[more], i[more], k[more])
            h = before[row, i]
            more = h >= 0
            candidates(row[more], h[more], i[more])
        alive = ids >= 0
        flat, sizes = ids[alive], alive.sum(1)
        odd = flat >= _NO_PIECE
        if odd.any():  # characters without a piece become bytes
            raw = [chr(i - _NO_PIECE).encode() for i in flat[odd].tolist()]
            width = np.ones(len(flat), np.int64)
            width[odd] = [len(x) for x in raw]
            owner = np.repeat(np.arange(n), sizes)
            flat, odd = np.repeat(flat, width), np.repeat(odd, width)
            flat[odd] = [self.byte_ids[b] for x in raw for b in x]
            sizes = np.bincount(owner, weights=width, minlength=n).astype(np.int64)
        return flat.astype("<i4"), sizes

    def _learn(self, wanted: list[str]) -> None:
        """Put segments of 2 to 32 characters into the cache."""
        by_size: dict[int, list[str]] = {}
        for x in wanted:
            by_size.setdefault(len(x), []).append(x)
        for size, some in by_size.items():
            for first in range(0, len(some), ROWS):
                part = some[first : first + ROWS]
                hashes = self._hash(np.frombuffer("".join(part).encode("utf-32-le"), "<u4").reshape(len(part), size)).tolist()
                path: list[tuple[np.ndarray, np.ndarray]] = []
                flat, sizes = self._many(part, np.arange(len(part)), None, path)
                plain, own = flat.tobytes(), [0, *np.cumsum(sizes * 4).tolist()]
                row = np.concatenate([x[0] for x in path]) if path else np.zeros(0, np.int64)
                order = np.argsort(row, kind="stable")
                steps = (np.concatenate([x[1] for x in path])[order] if path else np.zeros(0, np.uint64)).tobytes()
                ends = [0, *np.cumsum(np.bincount(row, minlength=len(part)) * 8).tolist()]
                for s, h, a, b, c, d in zip(part, hashes, ends, ends[1:], own, own[1:]):
                    self.cache[s] = h, steps[a:b], plain[c:d]

    def encode(self, text: str, key: int = 0) -> bytes:
        """The ids as little-endian int32. key: of the document, for the dropout."""
        return self.encode_many([text], [key])[0]

    def encode_many(self, texts: list[str], keys: list[int]) -> list[bytes]:
        """encode() of each text."""
        flat, ends = self.encode_flat(texts, keys)
        return [flat[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def encode_flat(self, texts: list[str], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's end.

        Every occurrence of a segment has draws of its own, by seed, document, place
        and segment. If none of them skips a merge of the segment's way without
        dropout, that way's ids are right; the other occurrences are merged anew.
        """
        if not hasattr(self, "char_ids"):
            self._tables()
            self.skips = None if self.skip is None else np.array(self.skip)
        cache = self.cache
        split = [_SEGMENT.findall(" " + t) if t else [] for t in texts]
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__
        which = np.array([number[s] for segments in split for s in segments], np.int64)
        distinct = list(number)
        if len(cache) > CACHE:
            cache = self.cache = {s: cache[s] for s in distinct if s in cache}
        # with dropout, a segment that is here once is merged once, with its draws, and not kept
        often = (np.bincount(which, minlength=len(distinct)) > (0 if self.skips is None else 1)).tolist()
        self._learn([s for s, more in zip(distinct, often) if more and s not in cache and 2 <= len(s) <= 32])
        own = [cache.get(s) for s in distinct]
        plain = [x[2] if x else self._segment(s, 0) if self.skips is None else b"" for x, s in zip(own, distinct)]
        anew: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if self.skips is not None:
            anew = self._dropped(distinct, own, which, np.concatenate([self._places(k, len(s)) for k, s in zip(keys, split)] or [np.zeros(0, np.uint64)]))
        sizes = np.array([len(x) // 4 for x in plain], np.int64)
        first = np.cumsum(sizes) - sizes
        count, old = sizes[which], np.ones(len(which), bool)
        for which_ones, _, lengths in anew:
            count[which_ones], old[which_ones] = lengths, False
        to = np.cumsum(count)
        out = np.empty(int(to[-1]) if len(to) else 0, "<i4")

        def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
            """The places start, start + 1, ... of each, one after the other."""
            return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)

        kept = count[old]
        out[spread((to - count)[old], kept)] = np.frombuffer(b"".join(plain), "<i4")[spread(first[which[old]], kept)]
        for which_ones, flat, lengths in anew:
            out[spread((to - count)[which_ones], lengths)] = flat
        last = np.cumsum([len(s) for s in split])
        return out, np.concatenate([[0], to])[last] if len(split) else np.zeros(0, np.int64)

    def _dropped(self, distinct: list[str], own: list[tuple[int, bytes, bytes] | None], which: np.ndarray, keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(occurrences, ids, how many each has) of those that are not as without dropout. which: of the distinct segments; keys: of the places."""
        hashes = np.array([0 if x is None else x[0] for x in own], np.uint64)
        lengths = np.array([len(s) for s in distinct], np.int64)
        fresh = np.array([x is None for x in own], bool)
        for size in np.unique(lengths[fresh]).tolist():
            some = np.flatnonzero(fresh & (lengths == size))
            hashes[some] = self._hash(np.frombuffer("".join([distinct[k] for k in some.tolist()]).encode("utf-32-le"), "<u4").reshape(-1, size))
        keys = mix(keys ^ hashes[which])
        short = (lengths >= 2) & (lengths <= 32)
        adds = np.frombuffer(b"".join(b"" if x is None else x[1] for x in own), np.uint64)
        steps = np.array([0 if x is None else len(x[1]) // 8 for x in own], np.int64)
        starts = np.cumsum(steps) - steps
        again = [np.flatnonzero((fresh & short)[which])]
        for first in range(0, len(which), 8 * ROWS):
            k, key = which[first : first + 8 * ROWS], keys[first : first + 8 * ROWS]
            ends = np.cumsum(steps[k])
            at = np.arange(ends[-1]) + np.repeat(starts[k] - ends + steps[k], steps[k])
            with np.errstate(over="ignore"):
                hit = self.skips[(np.repeat(key, steps[k]) + adds[at] >> np.uint64(8)) & np.uint64(0xFFFF)]
            so_far = np.concatenate([[0], np.cumsum(hit)])
            again.append(first + np.flatnonzero(so_far[ends] > so_far[ends - steps[k]]))
        touched = np.concatenate(again)
        size_of = lengths[which[touched]]
        out = []
        for size in np.unique(size_of).tolist():
            some = touched[size_of == size]
            for first in range(0, len(some), ROWS):
                part = some[first : first + ROWS]
                named, at = np.unique(which[part], return_inverse=True)
                out.append((part, *self._many([distinct[k] for k in named.tolist()], at, keys[part])))
        rare = np.flatnonzero((fresh & ~short)[which])
        if len(rare):
            coded = [np.frombuffer(self._segment(distinct[which[i]], int(keys[i])), "<i4") for i in rare.tolist()]
            out.append((rare, np.concatenate(coded), np.array([len(c) for c in coded])))
        return out


class Decoder:
    """Turns ids back into text; the space put before a text goes. Control pieces give nothing."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.parts = []
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            self.parts.append(bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else p.replace(_MARK, " ").encode())

    def decode(self, ids: list[int]) -> str:
        """Bytes that are no UTF-8 become U+FFFD."""
        parts = self.parts
        return b"".join([parts[i] for i in ids]).decode("utf-8", "replace")[1:]


@lru_cache(2)
def _encoder(model_file: str, dropout: float, seed: int) -> Encoder:
    return Encoder(model_file, dropout, seed)


@lru_cache(2)
def _decoder(model_file: str) -> Decoder:
    return Decoder(model_file)


def _with(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    names = {f.name for f in fields}
    return T.StructType([f for f in schema if f.name not in names] + list(fields))


def sp_encode(
    df: DataFrame, model_file: str, dropout: float = 0.1, seed: int = 0, text: str = "text", key: str = "doc_id", ids: str = "ids", keep: list[str] | None = None, lossless: str | None = None
) -> DataFrame:
    """df with an array<int> column of piece ids.

    Equal (seed, key, text) give equal ids, on whatever machine and partition; a
    null key counts as 0, a null text has null ids, an empty one none. Rows and
    other columns stay (those of `keep`, if given); a column with the name of `ids`
    is replaced. lossless: a column that says whether the ids decode to the text.
    """
    own = df.schema if keep is None else T.StructType([df.schema[c] for c in keep])
    schema = _with(own, T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(lossless, T.BooleanType())] if lossless else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _encoder(model_file, dropout, seed), _decoder(model_file)
        for batch in batches:
            chars = np.concatenate([[0], np.cumsum(pc.utf8_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))])
            first = 0
            while first < batch.num_rows:  # some texts at a time, by their length
                last = max(first + 1, int(np.searchsorted(chars, chars[first] + TEXTS, "right")) - 1)
                part = batch.slice(first, last - first)
                texts, keys = part.column(text).to_pylist(), [int(k or 0) for k in part.column(key).to_pylist()]
                flat, ends = encoder.encode_flat([t or "" for t in texts], keys)
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                found = {ids: pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([t is None for t in texts], pa.bool_()))}
                if lossless:
                    found[lossless] = pa.array([None if t is None else decoder.decode(flat[a:b].tolist()) == t for t, a, b in zip(texts, offsets.tolist(), offsets[1:].tolist())], pa.bool_())
                yield pa.RecordBatch.from_arrays([found[n] if n in found else part.column(n) for n in schema.names], schema.names)
                first = last

    return df.mapInArrow(run, schema)


def sp_decode(df: DataFrame, model_file: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of a column of piece ids; null ids give null. A column with the name of `text` is replaced."""
    schema = _with(df.schema, T.StructField(text, T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(model_file)
        for batch in batches:
            column = batch.column(ids)
            column = pa.array([None if x is None else decoder.decode(x) for x in _lists(column)], pa.string())
            yield pa.RecordBatch.from_arrays([column if n == text else batch.column(n) for n in schema.names], schema.names)

    return df.mapInArrow(run, schema)


def _lists(column: pa.Array) -> Iterator[list[int] | None]:
    """The lists of a list column, a row at a time."""
    valid = column.is_valid().to_pylist()
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    for i, ok in enumerate(valid):
        yield values[offsets[i] : offsets[i + 1]].tolist() if ok else None
