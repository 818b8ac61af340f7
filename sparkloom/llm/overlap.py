"""Problem 1: same or near-same records across splits.

Method: pigeonhole over blocks. Each record becomes a row of word hashes. A training record of n words is cut into one
block more than the edits that a pair above the wanted similarity may have (n/4 blocks of four words, the first up to three
of them shorter, at 0.8), so at least one block stands unchanged in the other record. Held-out records give all runs of
such lengths. Runs are joined, hits must fit in length and position, and pairs with as many blocks as must be left
unchanged are verified: by counts of hashed words first, then by the word edit distance of the whole records.

* Records with the same words are collapsed first, on each side, and written out as records at the end.
* Of the blocks of a record, as many as a pair may have edits, and one, suffice to find it. Blocks that very many records
  hold (the hot list) are put last, so that they are needed for partners of fitting length only, and joined by that length.
  Which blocks are listed never changes the result.

Defined results: null contents are skipped; records without any word match nothing; null ids and sources without a split
are left out; split values are compared without case and surrounding spaces; repeated rows count once.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.canonical import salted_join
from sparkloom.llm.grouping import assigned_splits
from sparkloom.llm.words import WordHashes, mix, shingles, split_words
from sparkloom.operators.lineage import cut

#: (words of a run, neighbours of a window, longest record in words or None) of the seeds that ``covered`` is measured by
TIERS = ((8, 4, None), (5, 3, 192), (3, 2, 48))
#: Entries of the hot list, 8 bytes each; so many rows may reach the driver and are sent to the executors.
HOT_LIST = 100_000
#: Up to so many distinct sources the split table is sent to the executors; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 200_000
#: Up to so many ids (of collapsed copies, of candidates) are sent to the executors; beyond, they are joined by shuffle.
BROADCAST_IDS = 500_000
#: Counters of hashed words in the sketch of a record, a byte each.
SKETCH = 32
#: Up to so many pairs of equal seeds of two records are all chained; beyond, the nth of one with the nth of the other.
ALL_SEEDS = 1 << 20


def small(df: DataFrame) -> DataFrame:
    """``df``, marked to be sent to the executors if it is counted to be small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def record_text(messages: str = "messages") -> F.Column:
    """Contents of the messages other than role system, in order; null contents are skipped."""
    kept = F.filter(F.col(messages), lambda m: ~F.coalesce(F.lower(F.trim(m["role"])) == "system", F.lit(False)))
    return F.array_join(F.transform(kept, lambda m: m["content"]), "\n")


def sided(records: DataFrame, resolved: DataFrame) -> DataFrame:
    """``records`` (record_id, source_id, text) of the sources that have a split, with split and train (boolean)."""
    splits = assigned_splits(resolved).where("split IN ('train', 'validation', 'test')")
    if splits.select(F.count("*")).first()[0] <= BROADCAST_SOURCES:
        splits = F.broadcast(splits)
    return records.join(splits, "source_id").withColumn("train", F.col("split") == "train")


def hashed_words(records: DataFrame) -> DataFrame:
    """record_id, source_id, split, train, key (digest of the words), n (words), words (32-bit hashes as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            rows = [cache.of(split_words(t)).astype(np.uint32) for t in b.column(4).to_pylist()]
            blobs = [r.tobytes() for r in rows]
            keys = [hashlib.blake2b(x, digest_size=16).digest() for x in blobs]
            out = [*b.columns[:4], pa.array(keys, pa.binary()), pa.array([len(r) for r in rows], pa.int32()), pa.array(blobs, pa.binary())]
            batch = pa.RecordBatch.from_arrays(out, ["record_id", "source_id", "split", "train", "key", "n", "words"])
            yield batch.filter(pa.array([len(r) > 0 for r in rows], pa.bool_()))

    src = records.select("record_id", "source_id", "split", "train", F.coalesce("text", F.lit("")).alias("text"))
    return src.mapInArrow(run, "record_id BIGINT, source_id STRING, split STRING, train BOOLEAN, key BINARY, n INT, words BINARY")


def winnow(marks: np.ndarray, w: int) -> np.ndarray:
    """Positions of the least of every ``w`` neighbouring marks, or of all if they are fewer."""
    if len(marks) <= w:
        return np.array([int(marks.argmin())]) if len(marks) else np.empty(0, np.int64)
    return np.unique(np.lib.stride_tricks.sliding_window_view(marks, w).argmin(1) + np.arange(len(marks) - w + 1))


def seeds_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, position, run length) of one record."""
    n, h = len(words), mix(words.astype(np.uint64))
    got = []
    for k, w, longest in TIERS:
        if (longest is None or n <= longest) and n >= k:
            marks = shingles(h, k)
            pos = np.arange(len(marks)) if n <= 15 and k == 3 else winnow(marks, w)
            got.append((marks[pos], pos, np.full(len(pos), k)))
    if not got:  # fewer words than any run
        return mix(np.array([(h * np.arange(1, n + 1, dtype=np.uint64)).sum()])), np.zeros(1, np.int64), np.full(1, n)
    return tuple(np.concatenate(x) for x in zip(*got))


def common_seeds(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int, int]]:
    """(position in u, position in v, length) of the seeds that two records share."""
    (su, pu, ku), (sv, pv, _) = seeds_of(u), seeds_of(v)
    i, j = np.argsort(su, kind="stable"), np.argsort(sv, kind="stable")
    lo, hi = np.searchsorted(sv[j], su[i], "left"), np.searchsorted(sv[j], su[i], "right")
    size = hi - lo
    if size.sum() > ALL_SEEDS:
        lo = lo + np.arange(len(i)) - np.searchsorted(su[i], su[i], "left")
        size = (lo < hi).astype(np.int64)
    x = np.repeat(i, size)
    y = j[np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)]
    return list(zip(pu[x].tolist(), pv[y].tolist(), ku[x].tolist()))


class Bounds:
    """How far two records may differ: edits must be fewer than ``p/q`` of the longer one's words."""

    def __init__(self, least: float):
        if not 0.5 <= least < 1:
            raise ValueError("least must be from 0.5 to below 1")
        part = 1 - Fraction(str(least))
        self.p, self.q = part.numerator, part.denominator
        self.probes = lru_cache(1 << 14)(self._probes)

    def __reduce__(self):
        return Bounds, (float(1 - Fraction(self.p, self.q)),)

    def edits(self, longer):
        """Most edits of a pair whose longer record has so many words."""
        return (self.p * longer - 1) // self.q

    def most(self, n):
        """Most edits of a pair that a record of ``n`` words is in, whatever the other's length."""
        return (self.p * n - 1) // (self.q - self.p)

    def blocks(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, length) of the blocks of ``n`` words, one more than ``most``; shorter ones come first."""
        m = self.most(n) + 1
        size = np.full(m, n // m)
        size[m - n % m :] += 1
        return np.cumsum(size) - size, size

    def _probes(self, n: int) -> list[tuple[int, int]]:
        """(length, last position) of the runs of a record of ``n`` words where a block of some other may stand."""
        other = np.arange(max(1, n - self.edits(n)), n + self.most(n) + 1)
        m = self.most(other) + 1
        k, longer, edits = other // m, other % m, self.edits(np.maximum(other, n))
        short = np.stack([k, (m - longer - 1) * k + edits])
        long = np.stack([k + 1, other - k - 1 + edits])[:, longer > 0]
        both = np.concatenate([short, long], 1)
        return [(int(x), min(n - int(x), int(both[1][both[0] == x].max()))) for x in np.unique(both[0]) if x <= n]


def length_class(n):
    """Number of a class of lengths, about 3 % wide."""
    return np.floor(np.log(n) * 32).astype(np.int64)


def runs(h: np.ndarray, size: int) -> np.ndarray:
    return shingles(h, size) + np.uint64(size)


def runs_of(h: np.ndarray, pos: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of the run of ``size`` words at each position; positions of one size stand together."""
    return np.concatenate([runs(h, int(k))[pos[size == k]] for k in np.unique(size)])


def block_rows(words: np.ndarray, bounds: Bounds, hot: np.ndarray, heat: np.ndarray) -> tuple[np.ndarray, ...]:
    """(seed, first position, last position, blocks, rank, blocks not hot) of the blocks of one training record. Equal
    blocks are one row, hot ones a row each for every class of length of the partners that need them."""
    n, h = len(words), mix(words.astype(np.uint64))
    pos, size = bounds.blocks(n)
    seed = runs_of(h, pos, size)
    at = np.minimum(np.searchsorted(hot, seed), max(0, len(hot) - 1))
    is_hot = hot[at] == seed if len(hot) else np.zeros(len(seed), bool)
    cold = int((~is_hot).sum())
    u, first, back, count = np.unique(seed[~is_hot], return_index=True, return_inverse=True, return_counts=True)
    last = np.zeros(len(u), np.int64)
    np.maximum.at(last, back, pos[~is_hot])
    rows = [(u, pos[~is_hot][first], last, count, np.zeros(len(u), np.int64))]
    if cold < len(seed):
        order = np.flatnonzero(is_hot)
        order = order[np.argsort(heat[at[order]], kind="stable")]
        rank = cold + np.arange(len(order))
        low = np.where(rank <= bounds.edits(n), max(1, n - bounds.edits(n)), -(-(bounds.q * rank + 1) // bounds.p))
        begin = length_class(low)
        times = length_class(n + bounds.most(n)) - begin + 1
        row = np.repeat(np.arange(len(order)), times)
        cls = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + begin[row]
        where = pos[order][row]
        rows.append((by_length(seed[order][row], cls), where, where, np.ones(len(row), np.int64), rank[row]))
    out = [np.concatenate(x) for x in zip(*rows)]
    return *out, np.full(len(out[0]), cold)


def by_length(seed: np.ndarray, cls) -> np.ndarray:
    return mix(seed + np.asarray(cls + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def probe_rows(words: np.ndarray, bounds: Bounds, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(seed, first position, last position, runs) of the runs of one held-out record; equal runs are one row."""
    n, h = len(words), mix(words.astype(np.uint64))
    parts = [(runs(h, k)[: last + 1], np.arange(last + 1)) for k, last in bounds.probes(n)]
    seed, pos = (np.concatenate(x) for x in zip(*parts))
    u, first, back, count = np.unique(seed, return_index=True, return_inverse=True, return_counts=True)
    last = np.zeros(len(u), np.int64)
    np.maximum.at(last, back, pos)
    if len(hot):
        is_hot = hot[np.minimum(np.searchsorted(hot, u), len(hot) - 1)] == u
        u = np.where(is_hot, by_length(u, length_class(n)), u)
    return u, pos[first], last, count


def hot_blocks(docs: DataFrame, bounds: Bounds) -> tuple[np.ndarray, np.ndarray]:
    """Blocks that many records hold, sorted, and how many; at most ``HOT_LIST``. A block that so many records hold overall
    is held by as large a part of the records of some task, so tasks report only those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, records = [], 0
        for b in batches:
            for blob in b.column(0).to_pylist():
                records += 1
                words = np.frombuffer(blob, np.uint32)
                parts.append(np.unique(runs_of(mix(words.astype(np.uint64)), *bounds.blocks(len(words)))))
        if parts:
            seed, n = np.unique(np.concatenate(parts), return_counts=True)
            keep = n >= max(32, records // 500)
            yield pa.RecordBatch.from_arrays([pa.array(seed[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], ["seed", "n"])

    rows = docs.select("words").mapInArrow(run, "seed BIGINT, n BIGINT").groupBy("seed").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "seed").limit(HOT_LIST).collect()
    seed, n = np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows], np.int64)
    order = np.argsort(seed)
    return seed[order], n[order]


def seed_table(docs: DataFrame, train: bool, bounds: Bounds, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(seed, id, at, more) of every record, and part for blocks: at holds its words and the first position, more the number
    of equal runs and how far the last is from the first, part the rank and the blocks that are not hot."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, heat = sent.value
        for b in batches:
            rows = [np.frombuffer(x, np.uint32) for x in b.column(1).to_pylist()]
            if not rows:
                continue
            all_of = [block_rows(w, bounds, seeds, heat) if train else probe_rows(w, bounds, seeds) for w in rows]
            size = np.array([len(r[0]) for r in all_of])
            row = np.repeat(np.arange(len(size)), size)
            seed, first, last, count, *rest = (np.concatenate(x) for x in zip(*all_of))
            n = np.array([len(w) for w in rows], np.int64)
            cols = [pa.array(seed.view(np.int64)), b.column(0).take(pa.array(row)), pa.array(n[row] << 32 | first), pa.array(count << 32 | last - first)]
            if train:
                cols.append(pa.array(rest[0] << 32 | rest[1]))
            yield pa.RecordBatch.from_arrays(cols, ["seed", "id", "at", "more", "part"][: len(cols)])

    return docs.select("record_id", "words").mapInArrow(run, "seed BIGINT, id BIGINT, at BIGINT, more BIGINT" + ", part BIGINT" * train)


def sketches(docs: DataFrame) -> DataFrame:
    """(id, sketch): how many words of each record fall to each counter; 255 stands for all numbers above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.minimum(np.bincount(np.frombuffer(x, np.uint32) % SKETCH, minlength=SKETCH), 255).astype(np.uint8).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "sketch"])

    return docs.select("record_id", "words").mapInArrow(run, "id BIGINT, sketch BINARY")


def word_bound(a: np.ndarray, b: np.ndarray) -> int:
    """Least edits of two rows of words, by how often each word occurs."""
    x, n = np.unique(np.concatenate([a, b]), return_inverse=True)
    more = np.bincount(n[: len(a)], minlength=len(x)) - np.bincount(n[len(a) :], minlength=len(x))
    return max(int(more[more > 0].sum()), int(-more[more < 0].sum()))


def chain(seeds: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Longest run of seeds (position in a, position in b, length) that rises in both, by patience sorting."""
    seeds = sorted(set(seeds), key=lambda s: (s[0], -s[1]))
    tails, at, back = [], [], [-1] * len(seeds)
    for i, (_, b, _) in enumerate(seeds):
        j = bisect_left(tails, b)
        back[i] = at[j - 1] if j else -1
        if j == len(tails):
            tails.append(b)
            at.append(i)
        else:
            tails[j], at[j] = b, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(seeds[i])
        i = back[i]
    return out[::-1]


def covered(seeds: list[tuple[int, int, int]]) -> int:
    """Words of a that the chained seeds cover."""
    total = end = 0
    for a, _, k in seeds:
        total += max(0, a + k - max(end, a))
        end = max(end, a + k)
    return total


def word_distance(a: list, b: list, limit: int) -> int:
    """Edit distance of two word lists, or some number above ``limit`` where it is above (bit-parallel, by columns)."""
    least, i = min(len(a), len(b)), 0
    while i < least and a[i] == b[i]:
        i += 1
    j = 0
    while j < least - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return len(a) + len(b)
    if len(a) > len(b):
        a, b = b, a
    places: dict = {}
    for p, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << p
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, score, left = full, 0, len(a), len(b)
    for word in b:
        same = places.get(word, 0)
        vert = same | minus
        hori = (((same & plus) + plus) ^ plus) | same
        up = minus | (full & ~(hori | plus))
        down = plus & hori
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        left -= 1
        if score - left > limit:
            return score - left
        up = (up << 1 | 1) & full
        plus = (down << 1 & full) | (full & ~(vert | up))
        minus = up & vert
    return score


def near_pairs(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(train_rep, held_rep, similarity, covered) of all pairs of representatives whose similarity is above ``least``."""
    bounds, docs_t, docs_h = Bounds(least), docs.where("train"), docs.where("NOT train")
    hot = hot_blocks(docs_t, bounds)
    t = seed_table(docs_t, True, bounds, hot).select("seed", F.col("id").alias("a"), F.col("at").alias("x"), F.col("more").alias("xm"), "part")
    e = seed_table(docs_h, False, bounds, hot).select("seed", F.col("id").alias("b"), F.col("at").alias("y"), F.col("more").alias("ym"))
    high, low = (lambda c: f"shiftright({c}, 32)"), (lambda c: f"({c} & 4294967295)")
    edits = f"((greatest({high('x')}, {high('y')}) * {bounds.p}L - 1) div {bounds.q}L)"
    # an unchanged run moves by no more than the edits before it, and by no more than those behind it
    shift = lambda v: f"greatest({low('x')} - {v} - {low('y')} - {low('ym')}, {low('y')} + {v} - {low('x')} - {low('xm')}, 0L)"
    fits = f"abs({high('x')} - {high('y')}) <= {edits} AND {high('part')} <= {edits} AND {shift('0L')} + {shift(f'({high("x")} - {high("y")})')} <= {edits}"
    hits = t.join(e, "seed").where(fits)
    blocks = f"({bounds.p}L * {high('x')} - 1) div {bounds.q - bounds.p}L + 1"
    needed = f"greatest({low('part')}, least({blocks}, {edits} + 1)) - {edits}"
    pairs = hits.groupBy("a", "b").agg(F.expr(f"sum(least({high('xm')}, {high('ym')}))").alias("have"), F.expr(f"max({needed})").alias("needed"), F.expr(f"max({edits})").alias("edits")).where("have >= needed")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int32) for c in (3, 4))
            apart = np.maximum(np.maximum(u - v, 0).sum(1), np.maximum(v - u, 0).sum(1))
            yield b.select(["a", "b"]).filter(pa.array(apart <= b.column(2).to_numpy()))

    candidates = pairs.select("a", "b", "edits")
    candidates = candidates.join(sketches(docs_t).withColumnsRenamed({"id": "a", "sketch": "u"}), "a")
    candidates = candidates.join(sketches(docs_h).withColumnsRenamed({"id": "b", "sketch": "v"}), "b")
    candidates = candidates.select("a", "b", "edits", "u", "v").mapInArrow(sketched, "a BIGINT, b BIGINT")
    left = docs.where("train").select(F.col("record_id").alias("a"), F.col("words").alias("wa"))
    right = docs.where("NOT train").select(F.col("record_id").alias("b"), F.col("words").alias("wb"))
    candidates = cut(candidates)
    # only the words of candidates are moved
    left = left.join(small(candidates.select("a").distinct()), "a", "left_semi")
    right = right.join(small(candidates.select("b").distinct()), "b", "left_semi")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x, y, wa, wb in zip(*(c.to_pylist() for c in b.columns)):
                u, v = np.frombuffer(wa, np.uint32), np.frombuffer(wb, np.uint32)
                n = max(len(u), len(v))
                limit = bounds.edits(n)
                if word_bound(u, v) > limit:
                    continue
                d = word_distance(u.tolist(), v.tolist(), limit)
                if d <= limit:
                    rows.append((x, y, 1 - d / n, covered(chain(common_seeds(u, v))) / n))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["train_rep", "held_rep", "similarity", "covered"])

    both = candidates.join(left, "a").join(right, "b").select("a", "b", "wa", "wb")
    return both.mapInArrow(aligned, "train_rep BIGINT, held_rep BIGINT, similarity DOUBLE, covered DOUBLE")


def representatives(records: DataFrame, resolved: DataFrame, *, id_col: str = "traj_id", source_col: str = "source_id", messages_col: str = "messages", least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(pairs of representatives, members): near pairs between the least ids of records with the same words on each side, and
    record_id, train, source_id, split and rep of every record."""
    src = records.select(F.col(f"`{id_col}`").cast("bigint").alias("record_id"), F.col(f"`{source_col}`").alias("source_id"), record_text(messages_col).alias("text")).where("record_id IS NOT NULL AND source_id IS NOT NULL")
    words = cut(hashed_words(sided(src, resolved)))
    members = words.select("key", "train", "record_id", "source_id", "split").distinct()
    reps = members.groupBy("key", "train").agg(F.min("record_id").alias("rep"))
    of_rep = cut(salted_join(members, reps, ["key", "train"], "record_id").select("record_id", "train", "source_id", "split", "rep"))
    copies = of_rep.where("record_id <> rep").select("record_id", "train").distinct()
    docs = words.select("record_id", "train", "n", "words").join(small(copies), ["record_id", "train"], "left_anti")
    return near_pairs(docs, least), of_rep


def overlaps(records: DataFrame, resolved: DataFrame, **columns) -> DataFrame:
    """One row for each training record and held-out record of similarity above ``least`` (for ``columns`` see
    ``representatives``).

    Columns: train_id, train_source, held_id, held_source, held_split, similarity, covered (part of the words that chained
    seeds cover).
    """
    pairs, of_rep = representatives(records, resolved, **columns)
    t = of_rep.where("train").select(F.col("rep").alias("train_rep"), F.col("record_id").alias("train_id"), F.col("source_id").alias("train_source"))
    h = of_rep.where("NOT train").select(F.col("rep").alias("held_rep"), F.col("record_id").alias("held_id"), F.col("source_id").alias("held_source"), F.col("split").alias("held_split"))
    out = pairs.join(t, "train_rep").join(h, "held_rep").where("train_id <> held_id")
    return out.groupBy("train_id", "train_source", "held_id", "held_source", "held_split").agg(F.max("similarity").alias("similarity"), F.max("covered").alias("covered"))


def held_coverage(records: DataFrame, resolved: DataFrame, **columns) -> DataFrame:
    """One row for each held-out record that occurs in training: held_id, held_source, held_split, partners (training records),
    similarity (the mean over them), best_similarity, covered (the largest part of its words that chained seeds cover).

    Counted at representatives: pairs of copies are never written out. A record that is on both sides is no partner of its own.
    """
    pairs, of_rep = representatives(records, resolved, **columns)
    t, h = of_rep.where("train"), of_rep.where("NOT train")
    size = t.groupBy(F.col("rep").alias("train_rep")).agg(F.countDistinct("record_id").alias("n"))
    best = pairs.join(size, "train_rep").groupBy("held_rep").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("similarity")).alias("s"), F.max("similarity").alias("best_similarity"), F.max("covered").alias("covered"))
    own = t.select("record_id").distinct().withColumn("own", F.lit(1))
    rows = salted_join(h.withColumnRenamed("rep", "held_rep"), best, "held_rep", "record_id").join(own, "record_id", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    partners = F.col("n") - F.col("own")
    out = rows.where(partners > 0)
    return out.select(F.col("record_id").alias("held_id"), F.col("source_id").alias("held_source"), F.col("split").alias("held_split"), partners.alias("partners"), ((F.col("s") - F.col("own")) / partners).alias("similarity"), "best_similarity", "covered").distinct()
