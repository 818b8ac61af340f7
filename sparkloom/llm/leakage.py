"""Problem 5: passages of held-out items inside training documents.

Method: every window of ``window`` words of an item and of a document gets a SimHash over its word shingles. Fingerprints
are cut into ``radius + 1`` blocks; two fingerprints within the radius agree in at least one block, so looking each block
up finds all of them. Candidates are verified by the weighted Jaccard similarity of the windows' shingle multisets.

Windows of an item's own size, whatever that is, are found apart (``NearIndex``): an item of n words that a document holds
with up to a fifth of n word edits leaves one of its n/5 + 1 blocks unchanged. The blocks are looked up in all runs of the
document, and the places are verified by the least word edit distance of the item to any part of them.

The items are the stated query set: they are sent to the executors in passes of at most ``windows_per_pass`` windows
(whatever the number of items), and every pass reads all documents once. Document texts and fingerprints stay in their
tasks; only hits are shuffled.

Defined results: null and blank texts and items have no hits, those under ``window`` words only by the items' own size; repeated rows
of one id count once; documents are processed whole, in chunks that overlap by a window.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.canonical import canonical_form, forms_for
from sparkloom.llm.words import WordHashes, shingles, split_words

SCHEMA = "doc_id BIGINT, case_id STRING, windows BIGINT, exact_windows BIGINT, similarity DOUBLE"


def fingerprints(marks: np.ndarray, per_window: int) -> np.ndarray:
    """SimHash of each run of ``per_window`` shingle hashes; a bit is set when at least half of the shingles have it."""
    n = len(marks) - per_window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    bits = np.unpackbits(marks.view(np.uint8).reshape(-1, 8), axis=1)
    votes, have, left, at = None, bits, per_window, 0
    step = 1
    while left:
        if left & 1:
            part = have[at : at + n]
            votes = part.copy() if votes is None else votes + part
            at += step
        left >>= 1
        if left:
            have = have[:-step] + have[step:]
            step *= 2
    return np.packbits(votes >= (per_window + 1) // 2, axis=1).view(np.uint64).ravel()


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weighted Jaccard of the shingle multisets in the rows of ``a`` and ``b``: sum of least counts over sum of largest."""
    in_a = (a[:, :, None] == a[:, None, :]).sum(2)
    in_b = (a[:, :, None] == b[:, None, :]).sum(2)
    common = (np.minimum(in_a, in_b) / in_a).sum(1)
    return common / (a.shape[1] + b.shape[1] - common)


class ItemIndex:
    """Windows of the items of one pass, with a bucket table for each block of the fingerprint."""

    def __init__(self, items: list[tuple[str, str]], window: int, shingle: int, radius: int, form=canonical_form):
        self.window, self.shingle, self.radius = window, shingle, radius
        cache, words, marks, owner, prints = WordHashes(), [], [], [], []
        for i, (_, text) in enumerate(items):
            h = cache.of(split_words(form(text)))
            s = shingles(h, shingle)
            p = fingerprints(s, window - shingle + 1)
            if len(p):
                words.append(np.lib.stride_tricks.sliding_window_view(h, window))
                marks.append(np.lib.stride_tricks.sliding_window_view(s, window - shingle + 1))
                owner.append(np.full(len(p), i))
                prints.append(p)
        self.ids = [i for i, _ in items]
        self.size = sum(map(len, prints))
        if not self.size:
            return
        self.words, self.marks, owner, self.prints = map(np.concatenate, (words, marks, owner, prints))
        # windows that several items hold are looked up once; their items stand one after the other
        _, first, back = np.unique(self.words, axis=0, return_index=True, return_inverse=True)
        back = back.ravel()
        order = np.lexsort((owner, back))
        pairs = np.unique(np.stack([back[order], owner[order]], 1), axis=0)
        self.words, self.marks, self.prints = self.words[first], self.marks[first], self.prints[first]
        self.owner, self.owners = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
        self.size = len(first)
        edges = [64 * k // (radius + 1) for k in range(radius + 2)]
        self.blocks = []
        for lo, hi in zip(edges, edges[1:]):
            key = self.block(self.prints, lo, hi)
            order = np.argsort(key, kind="stable")
            self.blocks.append((lo, hi, order, np.searchsorted(key[order], np.arange((1 << (hi - lo)) + 1))))

    @staticmethod
    def block(prints: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return ((prints >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)).astype(np.int64)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``prints``, item window) of all pairs within the radius, each once."""
        at, to = [], []
        for lo, hi, order, offset in self.blocks:
            key = self.block(prints, lo, hi)
            begin = offset[key]
            n = offset[key + 1] - begin
            some = np.flatnonzero(n)
            n, begin = n[some], begin[some]
            pos = np.repeat(some, n)
            k = order[np.arange(len(pos)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)]
            hit = np.bitwise_count(prints[pos] ^ self.prints[k]) <= self.radius
            at.append(pos[hit])
            to.append(k[hit])
        at, to = np.concatenate(at), np.concatenate(to)
        both = np.unique(at * self.size + to)
        return both // self.size, both % self.size


def part_distance(item: list, text: list) -> int:
    """Least word edit distance of ``item`` to any part of ``text`` (bit-parallel, by columns)."""
    places: dict = {}
    for p, word in enumerate(item):
        places[word] = places.get(word, 0) | 1 << p
    full, top = (1 << len(item)) - 1, 1 << len(item) - 1
    plus, minus, score = full, 0, len(item)
    best = score
    for word in text:
        same = places.get(word, 0)
        vert = same | minus
        hori = (((same & plus) + plus) ^ plus) | same
        up = minus | (full & ~(hori | plus))
        down = plus & hori
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            best = min(best, score)
        up = up << 1 & full
        plus = (down << 1 & full) | (full & ~(vert | up))
        minus = up & vert
    return best


class NearIndex:
    """Blocks of the items of one pass: of an item of n words, one more than the edits that ``least`` allows."""

    def __init__(self, items: list[tuple[str, str]], least: float, form=canonical_form):
        self.ids, self.words, self.edits, rows = [i for i, _ in items], [], [], []
        part, cache = 1 - Fraction(str(least)), WordHashes()
        for i, (_, text) in enumerate(items):
            h = cache.of(split_words(form(text)))
            d = int(part * len(h))
            self.words.append(h)
            self.edits.append(d)
            if len(h):
                ends = np.arange(d + 2) * len(h) // (d + 1)
                for begin, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
                    rows.append((end - begin, shingles(h[begin:end], end - begin)[0], i, begin))
        self.sorted = [np.sort(w) for w in self.words]
        self.tables = {}
        for k in {r[0] for r in rows}:
            seed, item, begin = (np.array(x, t) for x, t in zip(zip(*(r[1:] for r in rows if r[0] == k)), (np.uint64, np.int64, np.int64)))
            order = np.argsort(seed, kind="stable")
            self.tables[k] = seed[order], item[order], begin[order]

    def places(self, h: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(item, places, best similarity) of the items that the words ``h`` hold."""
        at, to = [], []
        for k, (seed, item, begin) in self.tables.items():
            marks = shingles(h, k)
            lo = np.searchsorted(seed, marks)
            some = np.flatnonzero(seed[np.minimum(lo, len(seed) - 1)] == marks)
            lo = lo[some]
            n = np.searchsorted(seed, marks[some], "right") - lo
            row = np.repeat(some, n)
            j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            at.append(row - begin[j])
            to.append(item[j])
        if not at:
            return
        at, to = np.concatenate(at), np.concatenate(to)
        order = np.lexsort((at, to))
        at, to = at[order], to[order]
        edges = np.flatnonzero(np.diff(to, prepend=-1))
        for i, starts in zip(to[edges].tolist(), np.split(at, edges[1:])):
            words, d = self.words[i], self.edits[i]
            reach = len(words) + 2 * d
            # only where enough words of the item stand
            lo, hi = np.maximum(starts - d, 0), np.minimum(starts - d + reach, len(h))
            have, near = self.sorted[i], h[lo[0] : hi[-1]]
            known = np.zeros(len(near) + 1, np.int64)
            np.cumsum(have[np.minimum(np.searchsorted(have, near), len(have) - 1)] == near, out=known[1:])
            keep = known[hi - lo[0]] - known[lo - lo[0]] >= len(words) - d
            lo, hi = lo[keep], hi[keep]
            if not len(lo):
                continue
            cuts = np.flatnonzero(lo[1:] > hi[:-1]) + 1
            found = [part_distance(words.tolist(), h[x[0] : y[-1]].tolist()) for x, y in zip(np.split(lo, cuts), np.split(hi, cuts))]
            found = [x for x in found if x <= d]
            if found:
                yield i, len(found), 1 - min(found) / len(words)


def near_scan(index: NearIndex, ids: list, rows: list) -> Iterator[tuple]:
    """Hits of one batch of documents by the items' own size, in the form of ``scan``."""
    for doc, h in zip(ids, rows):
        for i, n, x in index.places(h):
            yield doc, index.ids[i], n, 0, x


def scan(index: ItemIndex, least: float, ids: list, rows: list, chunk: int = 1 << 14) -> Iterator[tuple]:
    """Hits of one batch of documents: (doc_id, case_id, windows, exact windows, best similarity), per chunk of words."""
    per = index.window - index.shingle + 1
    flat, doc, total = [], [], 0

    def flush() -> Iterator[tuple]:
        h, d = np.concatenate(flat), np.concatenate(doc)
        s = shingles(h, index.shingle)
        p = fingerprints(s, per)
        if not len(p):
            return
        at, to = index.near(p)
        keep = d[at] == d[at + index.window - 1]  # not over the end of a document
        at, to = at[keep], to[keep]
        if not len(at):
            return
        sim = similarity(s[at[:, None] + np.arange(per)], index.marks[to])
        keep = sim >= least
        at, to, sim = at[keep], to[keep], sim[keep]
        same = (h[at[:, None] + np.arange(index.window)] == index.words[to]).all(1)
        n = index.owners[to + 1] - index.owners[to]
        row = np.repeat(np.arange(len(to)), n)
        owner = index.owner[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(index.owners[to], n)]
        groups: dict = {}
        for a, k, x, e in zip(d[at][row].tolist(), owner.tolist(), sim[row].tolist(), same[row].tolist()):
            g = groups.setdefault((a, k), [0, 0, 0.0])
            g[0] += 1
            g[1] += e
            g[2] = max(g[2], x)
        for (a, k), g in groups.items():
            yield ids[a], index.ids[k], g[0], g[1], g[2]

    for i, h in enumerate(rows):
        for start in range(0, max(1, len(h) - index.window + 1), chunk):
            part = h[start : start + chunk + index.window - 1]
            if len(part) < index.window:
                continue
            flat.append(part)
            doc.append(np.full(len(part), i))
            total += len(part)
            if total >= chunk:
                yield from flush()
                flat.clear()
                doc.clear()
                total = 0
    if flat:
        yield from flush()


def leaked_items(documents: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "case_id", item_text: str = "task", window: int = 12, shingle: int = 5, radius: int = 3, least: float = 0.8, windows_per_pass: int = 1 << 17, near: bool = True) -> DataFrame:
    """One row for each document and item that share a window within the radius and of similarity ``least`` or more, or, with
    ``near``, where the document holds the whole item with at most ``1 - least`` of its words edited.

    Columns: doc_id, case_id, windows (matching pairs of windows, and places of the whole item), exact_windows (of these, word for word),
    similarity (the best).
    """
    spark = documents.sparkSession
    forms = forms_for(spark)
    wanted = items.select(F.col(f"`{item_id}`").cast("string").alias("case_id"), F.col(f"`{item_text}`").alias("task")).where("case_id IS NOT NULL AND task IS NOT NULL").distinct()
    size = wanted.agg(F.sum(F.size(F.split("task", r"\s+")) + F.length("task") / 8)).first()[0] or 0
    passes = max(1, -(-int(size) // windows_per_pass))
    docs = documents.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = None
    for n in range(passes):
        part = wanted if passes == 1 else wanted.where(F.pmod(F.xxhash64("case_id"), F.lit(passes)) == n)
        index = spark.sparkContext.broadcast((ItemIndex(rows := [(r[0], r[1]) for r in part.toLocalIterator()], window, shingle, radius, forms.canonical), NearIndex(rows if near else [], least, forms.canonical)))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            cache = WordHashes()
            windows, whole = index.value
            for b in batches:
                ids, words = b.column(0).to_pylist(), [cache.of(split_words(forms.canonical(t))) for t in b.column(1).to_pylist()]
                rows = list(scan(windows, least, ids, words)) if windows.size else []
                rows += near_scan(whole, ids, words) if whole.tables else []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["doc_id", "case_id", "windows", "exact_windows", "similarity"])

        hits = docs.mapInArrow(run, SCHEMA)
        found = hits if found is None else found.unionByName(hits)
    return found.groupBy("doc_id", "case_id").agg(F.sum("windows").alias("windows"), F.sum("exact_windows").alias("exact_windows"), F.max("similarity").alias("similarity"))
