"""Exact n-gram Jaccard join: rare-first prefix, length, positional and suffix filters, each pair verified once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.llm.groups import linked_groups
from panelforge.llm.shared import drop, free_name, materialize
from panelforge.llm.shingles import shingle_hashes, text_pieces, word_hashes

WIDTH, PERCENT = 5, 80
#: Cells of the frequency sketch: 4 MB on every machine, whatever the number of documents.
CELL_BITS = 20
FAN_IN = 64


def _shingles(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The shingle fingerprints of each text, with repeats."""
    for _, data, offsets in text_pieces(column):
        words, at = word_hashes(data, offsets)
        for i in range(len(offsets) - 1):
            yield shingle_hashes(words[at[i] : at[i + 1]], width)


def frequency_classes(docs: DataFrame, text: str, width: int = WIDTH, bits: int = CELL_BITS) -> np.ndarray:
    """How frequent the shingles of each sketch cell are over all documents, as a class of 0 to 255.

    Each task counts its shingles by cell, and the counts are added FAN_IN at a
    time, so no task and not the driver gets more than that many sketches.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for h in _shingles(batch.column(0), width):
                np.add.at(cells, (h >> np.uint64(64 - bits)).astype(np.int64), 1)
        blob = zlib.compress(np.minimum(cells, 2**32 - 1).astype("<u4").tobytes(), 1)
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "cells": pa.array([blob], pa.binary())})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << bits, np.int64)
        for blob in rows["cells"]:
            total += np.frombuffer(zlib.decompress(blob), "<u4")
        return pd.DataFrame({"part": [int(rows["part"].iloc[0]) // FAN_IN], "cells": [zlib.compress(np.minimum(total, 2**32 - 1).astype("<u4").tobytes(), 1)]})

    source = docs.select(text)
    parts = source.rdd.getNumPartitions()
    sketch = source.mapInArrow(count, "part long, cells binary")
    while True:
        sketch = sketch.groupBy(F.floor(F.col("part") / FAN_IN).alias("_group")).applyInPandas(add, "part long, cells binary")
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            break
    row = sketch.first()
    cells = np.frombuffer(zlib.decompress(row["cells"]), "<u4") if row else np.zeros(1 << bits, np.uint32)
    return np.minimum(255, 8 * np.log2(1.0 + cells)).astype(np.uint8)


def tokens_of(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A text's set in the global order, the rarest class first: class in the top 8 bits, 56 bits of the fingerprint below."""
    cell = (hashes >> np.uint64(64 - (len(classes).bit_length() - 1))).astype(np.int64)
    return np.unique(classes[cell].astype(np.uint64) << np.uint64(56) | hashes & np.uint64((1 << 56) - 1))


def node_of(tokens: np.ndarray) -> int:
    """A 64-bit fingerprint of a set; 0 for the empty one."""
    n = len(tokens)
    with np.errstate(over="ignore"):
        return int((np.bitwise_xor.reduce(tokens * np.uint64(0x9E3779B97F4A7C15) ^ tokens >> np.uint64(29)) + np.uint64(n) * np.uint64(0xD6E8FEB86659FD93)).astype(np.int64)) if n else 0


#: The fewest bits of a parity sketch; a set has two bits for three tokens at least, rounded up to a power of two.
PARITY_BITS = 1024


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's tokens falls on each bit, as longs: the sketches of two sets differ in no more bits than the sets in tokens. Folded in halves by xor, it is the one of half the bits."""
    bits = max(PARITY_BITS, 1 << (len(tokens) * 2 // 3).bit_length())
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketches_differ(x: str, y: str) -> str:
    """SQL: in how many bits two sketches differ; one of twice the other's bits is folded, one of more is not compared (0)."""

    def fold(c: str) -> str:
        return f"zip_with(slice({c}, 1, size({c}) div 2), slice({c}, size({c}) div 2 + 1, size({c}) div 2), (p, q) -> p ^ q)"

    def differ(a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)"

    return (
        f"case when size({x}) = size({y}) then {differ(x, y)} when size({x}) = 2 * size({y}) then {differ(fold(x), y)}"
        f" when 2 * size({x}) = size({y}) then {differ(x, fold(y))} else 0 end"
    )


def prefix_length(n: int, percent: int) -> int:
    """Sets of n that reach the threshold together share one of so many first tokens."""
    return n - -(-n * percent // 100) + 1


def survives_suffix(x: np.ndarray, y: np.ndarray, most: int, depth: int = 2) -> bool:
    """Whether the parts on either side of a probe leave room for a symmetric difference of `most` at most."""
    if abs(len(x) - len(y)) > most:
        return False
    if not depth or not len(x) or not len(y):
        return True
    probe = y[len(y) // 2]
    i, j = int(np.searchsorted(x, probe)), len(y) // 2
    left, right = abs(i - j), abs(len(x) - i - (len(y) - j))
    return left + right <= most and survives_suffix(x[:i], y[:j], most - right, depth - 1) and survives_suffix(x[i:], y[j:], most - left, depth - 1)


#: Bits of the filter by doc_id: 2 MB on every machine. It only spares work, an exact join follows.
FILTER_BITS = 24


def _filter_of(wanted: DataFrame) -> np.ndarray:
    """A bit for each hash of a wanted doc_id, as bytes."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)) + 1  # the bitmap functions count from 1
    rows = wanted.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in rows.collect():  # 512 rows of 4 KB at most
        start = (r["k"] - 1) * 4096
        out[start : start + 4096] = np.frombuffer(r["bits"], np.uint8)
    return np.unpackbits(out, bitorder="little")


def _sets(docs: DataFrame, classes, width: int, some) -> DataFrame:
    """(node, tokens) of rows (doc_id, text) whose doc_id is in the filter, each node once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(1).to_numpy()
            batch = batch.filter(pa.array(some.value[place] > 0))
            sets = [tokens_of(h, classes.value) for h in _shingles(batch.column(0), width)]
            offsets = np.zeros(len(sets) + 1, np.int32)
            np.cumsum([len(s) for s in sets], out=offsets[1:])
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            nodes = pa.array([node_of(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([nodes, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["node", "tokens"])

    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    return docs.where("doc_id is not null").select("text", place.alias("place")).mapInArrow(run, "node long, tokens array<long>").dropDuplicates(["node"])


def jaccard_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row.

    Two documents link if 100 * |intersection| >= percent * |union| of their
    shingle sets; component_id is the smallest doc_id that links reach. Null and
    empty texts have no shingles and link with nothing; a text of fewer words
    than `width` is one shingle. Equal sets are one node, known by a 64-bit
    fingerprint. Rows with a null doc_id lend theirs to no group.
    """
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    classes = docs.sparkSession.sparkContext.broadcast(frequency_classes(source, "text", width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple[np.ndarray, int, int]] = []
            sketches: list[np.ndarray] = []
            for h in _shingles(batch.column(1), width):
                t = tokens_of(h, classes.value)
                n = len(t)
                parts.append((t[: prefix_length(n, percent)].view(np.int64) if n else np.zeros(0, np.int64), n, node_of(t)))
                sketches.append(parity_sketch(t))
            sizes = [len(p) for p, _, _ in parts]
            ids = batch.column(0)
            # a document's own row has no token, and is followed by those of its prefix
            rows = np.repeat(np.arange(len(parts)), sizes)
            pos = np.arange(len(rows)) - np.repeat(np.cumsum([0, *sizes[:-1]]) if sizes else np.zeros(0, int), sizes)
            every = np.r_[np.arange(len(parts)), rows].astype(np.int64)
            n, node = (np.array([p[k] for p in parts], np.int64)[every] for k in (1, 2))
            tokens = pa.concat_arrays([pa.nulls(len(parts), pa.int64()), pa.array(np.concatenate([p for p, _, _ in parts]) if parts else np.zeros(0, np.int64))])
            longs = np.cumsum([0, *map(len, sketches)]).astype(np.int32)
            sketch = pa.ListArray.from_arrays(pa.array(longs), pa.array(np.concatenate([np.zeros(0, np.int64), *sketches])))
            yield pa.RecordBatch.from_arrays(
                [
                    tokens, pa.array(node), pa.array(n.astype(np.int32)), pa.array(np.r_[np.full(len(parts), -1), pos].astype(np.int32)), ids.take(pa.array(every)),
                    pa.concat_arrays([sketch, pa.nulls(len(rows), sketch.type)]),
                ],
                ["token", "node", "n", "pos", "doc_id", "sketch"],
            )

    rows = materialize(source.mapInArrow(run, "token long, node long, n int, pos int, doc_id long, sketch array<long>"), "prefixes")
    own = materialize(rows.where("token is null").select("doc_id", "node", "n", "sketch"), "documents")
    same = W.partitionBy("token").orderBy("node")
    members = rows.where("token is not null").select("token", "node", "n", "pos").withColumn("_last", F.lag("node").over(same)).where("_last is null or _last <> node")
    reps = own.where("n > 0 and doc_id is not null").select("node", F.struct("doc_id", "n", "sketch").alias("rep")).groupBy("node").agg(F.min("rep").alias("rep")).select("node", "rep.*")

    def may_link(a, b):
        shared = F.least(a("pos"), b("pos")) + 1 + F.least(a("n") - a("pos"), b("n") - b("pos")) - 1
        return (
            (100 * F.least(a("n"), b("n")) >= percent * F.greatest(a("n"), b("n")))
            & ((100 + percent) * shared >= percent * (a("n") + b("n")))
        )

    def first_shared(a, b):
        """What pos and n say of a pair whose first common token this is: nothing before it is shared."""
        return (100 * F.least(a("n"), b("n")) >= percent * F.greatest(a("n"), b("n"))) & (
            (100 + percent) * F.least(a("n") - a("pos"), b("n") - b("pos")) >= percent * (a("n") + b("n"))
        )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for c in (2, 3):
                column = batch.column(c)
                sides.append((column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)))
            keep = []
            for i in range(batch.num_rows):
                x, y = (v[o[i] : o[i + 1]] for o, v in sides)
                need = -(-percent * (len(x) + len(y)) // (100 + percent))
                keep.append(survives_suffix(x, y, len(x) + len(y) - 2 * need) and len(np.intersect1d(x, y, assume_unique=True)) >= need)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    def sketches_near(x: str, y: str) -> str:
        total = f"({x}.n + {y}.n)"
        return f"{sketches_differ(f'{x}.sketch', f'{y}.sketch')} <= {total} - 2 * (({percent} * {total} + {99 + percent}) div {100 + percent})"

    def nodes_of(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    def verify(pairs: DataFrame) -> DataFrame:
        """By parity sketches first: whole sets are only made, and sent, of the pairs that they leave. None of those is kept for a later call, which would send them all again."""
        faces = materialize(nodes_of(pairs).join(reps, "node"), "wanted")
        x, y = (faces.select(F.col("node").alias(c), F.struct("n", "sketch").alias(s)) for c, s in ("ax", "by"))
        near = materialize(pairs.join(x, "a").join(y, "b").where(sketches_near("x", "y")).select("a", "b"), "near")
        wanted = materialize(nodes_of(near).join(faces.select("node", "doc_id"), "node"), "wanted")
        drop(faces)
        some = docs.sparkSession.sparkContext.broadcast(_filter_of(wanted))
        drop(wanted)
        sets = _sets(source, classes, width, some)
        both = near.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")

    found = linked_groups(members, "token", "node", verify, may_link, ["n", "pos"], release=rows, first_shared=first_shared, look=lambda nodes: reps.select("node", "sketch").join(nodes, "node"), near=sketches_near)
    labelled = own.select("doc_id", "node", "n").join(found, "node", "left").withColumn("component", F.when(F.col("n") > 0, F.coalesce("component", "node")))
    labelled = materialize(labelled, "labelled")
    # written, so that the join has an exchange on both sides, and a component with many rows can be split
    lowest = materialize(labelled.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("low")), "lowest")
    return labelled.join(lowest, "component", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("low", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Of each group the row of the smallest doc_id; rows without shingles or without a doc_id stay.

    Rows that share a doc_id are told apart by their texts, and are in groups of
    their own; rows that share both are not, and stay or go together.
    """
    row = F.xxhash64(F.col(key).cast("long"), F.coalesce(F.col(text).cast("string"), F.lit("")))
    own = materialize(docs.where(F.col(key).isNotNull()).select(row.alias("row"), F.col(key).cast("long").alias("id")).distinct(), "rows")
    texts = docs.where(F.col(key).isNotNull()).select(row.alias("doc_id"), F.col(text).alias("text"))
    groups = jaccard_groups(texts).where("n_shingles > 0").select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")).distinct()
    groups = materialize(groups.join(own, "row"), "groups")
    first = materialize(groups.groupBy("component").agg(F.min(F.struct("id", "row")).alias("first"), F.count("*").alias("n")).where("n > 1").select("component", F.col("first.row").alias("first")), "first")
    gone = free_name("row", docs.columns)
    later = materialize(groups.join(first, "component").where("row <> first").select(F.col("row").alias(gone)), "later")
    return docs.join(later, row == F.col(gone), "left_anti")
