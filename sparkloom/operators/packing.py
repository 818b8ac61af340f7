"""Token streams: global prefix sums, fixed-size shards, sampled windows, labels and padded batches."""

from __future__ import annotations

import json
import os
import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from sparkloom.operators.lineage import cut, sized
from sparkloom.operators.trajectories import BOS, EOS, plain_segments

IGNORE = -100
# Fixed value: how byte-level BPE files split texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def with_offsets(rows: DataFrame, order: str, size: str, parts: int | None = None) -> DataFrame:
    """``rows`` with ``start``: sum of ``size`` over all rows before, by the numeric column ``order``.

    Two levels instead of one window over everything: rows are cut into chunks of about equal numbers at quantiles of
    ``order``, each chunk is summed on its own, and the chunks' totals (a few rows) are summed and joined back.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = rows.select(F.col(order).cast("double").alias("_p"))
    marks = sorted(set(place.approxQuantile("_p", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    bucketizer = Bucketizer(splits=[float("-inf"), *marks, float("inf")] if marks else [float("-inf"), 0.0, float("inf")], inputCol="_p", outputCol="_chunk", handleInvalid="keep")
    chunked = bucketizer.transform(rows.withColumn("_p", F.col(order).cast("double")))
    totals = chunked.groupBy("_chunk").agg(F.sum(size).alias("_n"))
    before = totals.withColumn("_before", F.sum("_n").over(Window.orderBy("_chunk")) - F.col("_n")).select("_chunk", "_before")  # at most n rows
    inner = F.sum(size).over(Window.partitionBy("_chunk").orderBy(order)) - F.col(size)
    return chunked.withColumn("_inner", inner).join(F.broadcast(before), "_chunk").withColumn("start", (F.col("_before") + F.col("_inner")).cast("bigint")).drop("_chunk", "_inner", "_before", "_p")


def shard_slices(rows: DataFrame, order: str, size: str, shard_tokens: int) -> DataFrame:
    """One row for each record and shard it lies in: shard, from_token and to_token within the record, and start of the slice.

    Records of fewer than two tokens are left out before the prefix sum. Records may straddle shards. ``order`` is unique;
    the prefix sum sees sizes only, and the rows themselves are joined with their starts once.
    """
    narrow = cut(rows.where(F.col(size) >= 2).select(order, size))
    placed = rows.join(sized(with_offsets(narrow, order, size).select(order, "start")), order)
    first, last = F.floor(F.col("start") / shard_tokens), F.floor((F.col("start") + F.col(size) - 1) / shard_tokens)
    each = placed.withColumn("shard", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("start"), F.col("shard") * shard_tokens)
    end = F.least(F.col("start") + F.col(size), (F.col("shard") + 1) * shard_tokens)
    return each.withColumn("from_token", (begin - F.col("start")).cast("int")).withColumn("to_token", (end - F.col("start")).cast("int")).withColumn("slice_start", begin)


def pack(rows: DataFrame, order: str, tokens: str, mask: str, shard_tokens: int) -> DataFrame:
    """(shard, tokens, mask) of exactly ``shard_tokens`` tokens each, the last one shorter. A shard has a fixed size, so
    what is gathered for it is bounded."""
    sized = rows.withColumn("_size", F.size(tokens).cast("bigint"))
    part = lambda c: F.slice(c, F.col("from_token") + 1, F.col("to_token") - F.col("from_token"))
    pieces = shard_slices(sized, order, "_size", shard_tokens).select("shard", F.struct("slice_start", part(tokens).alias("t"), part(mask).alias("m")).alias("p"))
    whole = pieces.groupBy("shard").agg(F.array_sort(F.collect_list("p")).alias("p"))
    flat = lambda f: F.flatten(F.transform("p", lambda x: x[f]))
    return whole.select("shard", flat("t").alias("tokens"), flat("m").alias("mask"))


def window_starts(total: int, seed: int, samples: DataFrame) -> DataFrame:
    """``samples`` (index) with ``choice``: for each index a uniform number below ``total`` from its own seeded generator."""
    if total <= 0:
        raise ValueError("no shard is longer than a window")

    @F.pandas_udf(LongType())
    def choose(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda i: random.Random(seed + int(i)).randrange(total))

    return samples.withColumn("choice", choose("index"))


def sample_windows(shards: DataFrame, length: int, samples: int | DataFrame, seed: int = 0, consumed: int = 0) -> DataFrame:
    """(index, shard, input_ids, labels) of ``samples`` windows of ``length`` tokens, without the first ``consumed``.

    ``samples`` is their number, each choice then drawn from the sample's own generator, or a frame (index, choice) of
    choices to take as they are. A window never crosses shards; a shard is chosen in proportion to its usable starts.
    The shards' ranges of starts come from a prefix sum in two levels; the interval join matches each choice to the one
    range that holds it by cells, as many as there are shards.
    """
    spark = shards.sparkSession
    usable = cut(shards.select("shard", F.greatest(F.lit(0), F.size("tokens") - length).cast("bigint").alias("usable")).where("usable > 0"))
    total, count = usable.agg(F.sum("usable"), F.count("*")).first()
    if not total:
        raise ValueError("no shard is longer than a window")
    ranges = with_offsets(usable, "shard", "usable").select("shard", F.col("start").alias("lo"), (F.col("start") + F.col("usable")).alias("hi"))
    if isinstance(samples, int):
        wanted = window_starts(total, seed, spark.range(samples).withColumnRenamed("id", "index").where(F.col("index") >= consumed))
    else:
        wanted = samples.where(F.col("index") >= consumed).select("index", "choice")
    step = max(1, total // max(1, count))
    cells = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / step), F.floor((F.col("hi") - 1) / step))))
    hit = wanted.withColumn("cell", F.floor(F.col("choice") / step)).join(cells, "cell").where((F.col("choice") >= F.col("lo")) & (F.col("choice") < F.col("hi")))
    window = hit.join(shards, "shard").select("index", "shard", F.slice("tokens", (F.col("choice") - F.col("lo") + 1).cast("int"), F.lit(length + 1)).alias("t"), F.slice("mask", (F.col("choice") - F.col("lo") + 1).cast("int"), F.lit(length + 1)).alias("m"))
    return window.select("index", "shard", F.slice("t", 1, length).alias("input_ids"), shifted_labels(F.col("t"), F.col("m")).alias("labels"))


def shifted_labels(tokens: Column, mask: Column) -> Column:
    """Labels of all but the first token; those outside the mask are ignored."""
    tail = lambda c: F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))
    return F.zip_with(tail(tokens), tail(mask), lambda t, m: F.when(m.cast("int") != 0, t).otherwise(F.lit(IGNORE)))


def masked_labels(tokens: Column, mask: Column) -> Column:
    """Labels at the tokens' own places."""
    return F.zip_with(tokens, mask, lambda t, m: F.when(m.cast("int") != 0, t).otherwise(F.lit(IGNORE)))


def span_mask(lengths: Column, learns: Column, scope: str = "all") -> Column:
    """Mask of the concatenated turns: 1 for tokens of learnt turns, or of the last learnt turn only."""
    last = F.array_max(F.filter(F.transform(learns, lambda x, i: F.when(x, i)), lambda i: i.isNotNull()))
    on = (lambda x, i: x) if scope == "all" else (lambda x, i: F.coalesce(i == last, F.lit(False)))
    flags = F.transform(learns, lambda x, i: F.when(on(x, i), 1).otherwise(0))
    return F.flatten(F.zip_with(lengths, flags, lambda n, f: F.array_repeat(f, n)))


def prefix_mask(before: Column, through: Column, size: Column) -> Column:
    """Mask of a sequence of ``size`` tokens from the lengths of its prefixes: 1 from ``before[i]`` to ``through[i]``, the
    tokens that precede and that end the learnt turn ``i``, for templates that do not mark learnt tokens themselves."""
    spans = F.arrays_zip(before.alias("b"), through.alias("t"))
    place = lambda i: F.exists(spans, lambda s: (s["b"] <= i) & (i < s["t"]))
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when(place(i), 1).otherwise(0))).otherwise(F.array().cast("array<int>"))


def padded(df: DataFrame, index: str, batch: int, columns: dict[str, int]) -> DataFrame:
    """``df`` with ``batch`` (index div size), ``attention_mask`` and every array of ``columns`` padded on the right, with
    its value, to the longest of its batch. A batch has a fixed number of rows."""
    first = next(iter(columns))
    numbered = df.withColumn("batch", F.floor(F.col(index) / batch).cast("bigint"))
    width = F.max(F.size(first)).over(Window.partitionBy("batch"))
    out = numbered.withColumn("_w", width).withColumn("attention_mask", F.concat(F.transform(first, lambda x: F.lit(1)), F.array_repeat(F.lit(0), F.col("_w") - F.size(first))))
    for c, v in columns.items():
        out = out.withColumn(c, F.concat(c, F.array_repeat(F.lit(v).cast("int"), F.col("_w") - F.size(c))))
    return out.drop("_w")


def token_totals(shards_or_rows: DataFrame, tokens: str = "tokens", mask: str = "mask") -> DataFrame:
    """One row: records, tokens, supervised tokens."""
    return shards_or_rows.agg(F.count("*").alias("records"), F.sum(F.size(tokens)).alias("tokens"), F.sum(F.aggregate(mask, F.lit(0), lambda s, m: s + m.cast("int"))).alias("supervised_tokens"))


def _tokenizer(vocabulary: str, most_id: int):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    if tokenizer.get_vocab_size() - 1 > most_id:
        raise ValueError("the vocabulary does not fit 16-bit shards")
    return tokenizer


#: What a byte-level BPE file must not set for its ids to follow from its merges alone.
_OPTIONS = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
#: Longer texts are left to the file's own tokenizer (long runs of blanks overflow the other one's expressions).
SHORT = 1 << 16


def _plain(tokenizer):
    """The ids of a short ASCII text by ``tiktoken`` if ``tokenizer`` is a byte-level BPE for which it gives the same ones, else None.

    It merges by ids and may put any two neighbours together that make a token. That is the same if ids follow the order of the
    merges and every token, encoded by its merges, is itself: else some token could be made in a way that no merge allows.
    """
    f = json.loads(tokenizer.to_str())
    m, before, added = f["model"], f["pre_tokenizer"] or {}, f["added_tokens"]
    if m["type"] != "BPE" or any(m.get(k) for k in _OPTIONS) or f["normalizer"] or f["truncation"] or f["padding"]:
        return None
    if before.get("type") != "ByteLevel" or before["add_prefix_space"] or not before.get("use_regex", True) or len(added) > 1 or any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip")):
        return None
    special = {x["content"]: x["id"] for x in added}
    words = {w: i for w, i in m["vocab"].items() if w not in special}
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*seen}))}
    made = [m["vocab"][a + b] for a, b in (x if isinstance(x, list) else x.split(" ") for x in m["merges"])]
    if made != sorted({*made}) or {*byte} - {*words} or len(words) != len(made) + 256 or not {*"".join(words)} <= {*byte}:
        return None
    if any([t.id for t in tokenizer.model.tokenize(w)] != [i] for w, i in words.items()):
        return None
    try:
        import tiktoken
    except ImportError:
        return None
    fast = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks={bytes(map(byte.__getitem__, w)): i for w, i in words.items()}, special_tokens=special)
    return lambda t: fast.encode_to_numpy(t, allowed_special="all")


@lru_cache(maxsize=2)
def encoder(vocabulary: str, most_id: int):
    """A function from texts to their ids by a tokenizer file. Short ASCII texts take a faster way to the same ids, where there is one."""
    tokenizer = _tokenizer(vocabulary, most_id)
    own = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    if (fast := _plain(tokenizer)) is None:
        return own

    def encode(texts: list[str]) -> list:
        short = [len(t) <= SHORT and t.isascii() for t in texts]
        rest = iter(own([t for t, s in zip(texts, short) if not s]))
        return [fast(t) if s else next(rest) for t, s in zip(texts, short)]

    return encode


#: Bytes of text that are encoded at a time.
CHUNK = 1 << 18


def _bytes(c: pa.Array) -> np.ndarray:
    """Bytes of text in each row of a column of texts, or of arrays of structs that hold texts."""
    if not pa.types.is_nested(c.type):
        return pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    items = c.flatten()
    each = sum((_bytes(x) for x in items.flatten() if pa.types.is_string(x.type)), np.zeros(len(items), np.int64))
    ends = np.cumsum(pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False))
    return np.diff(np.append(0, np.cumsum(each))[np.append(0, ends)])


def chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of ``batches`` (key, then columns as ``_bytes`` takes) whose texts have no more than ``most`` bytes, or of one row."""
    for b in batches:
        upto = np.cumsum(sum(_bytes(c) for c in b.columns[1:]))
        first = 0
        while first < b.num_rows:
            before = upto[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(upto, before + most, "right")))
            yield b.slice(first, last - first)
            first = last
        del b


def _parts(b: pa.RecordBatch) -> list[list[tuple[str, bool]]]:
    """Texts of each row (key, text, segments), and whether they are learnt."""
    return [[(f"{BOS}\n{t}\n{EOS}", True)] if t is not None else [(x["text"] or "", bool(x["learns"])) for x in s or ()] for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]


def _conversations(b: pa.RecordBatch) -> list[list[tuple[str, bool]]]:
    """As ``_parts``, of rows (key, messages)."""
    return [plain_segments(m) or [] for m in b.column(1).to_pylist()]


def encoded(batches: Iterator[pa.RecordBatch], encode, texts=_parts, kinds=(np.int32, np.int32)) -> Iterator[pa.RecordBatch]:
    """Batches (key, tokens, mask) for ``batches`` whose rows ``texts`` reads; ``encode`` gives the ids of texts, see ``encode_records``.
    ``kinds``: of tokens and mask."""
    for b in chunks(batches):
        key, parts, name = pa.array(b.column(0).to_pylist(), b.schema.types[0]), texts(b), b.schema.names[0]
        del b  # its batch is then free when the next one is read
        ids = [np.array(x, np.int32) for x in encode([t for p in parts for t, _ in p])]
        ends = np.cumsum([0, *map(len, ids)])
        starts = pa.array(ends[np.cumsum([0, *map(len, parts)])], pa.int32())
        mask = np.repeat(np.array([learns for p in parts for _, learns in p], np.int32), np.diff(ends))
        tokens = np.concatenate([np.empty(0, np.int32), *ids])
        yield pa.RecordBatch.from_arrays([key, *(pa.ListArray.from_arrays(starts, pa.array(a.astype(k))) for a, k in zip((tokens, mask), kinds))], [name, "tokens", "mask"])


def encode_with(df: DataFrame, vocabulary: str, text: str = "text", out: str = "tokens", most_id: int = 65_535) -> DataFrame:
    """``df`` with the ids of ``text`` by a tokenizer file, refused if an id does not fit 16 bits. The tokenizer is loaded
    once in each Python worker."""
    names = [c for c in df.columns if c != out]
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(vocabulary, most_id)
        for b in batches:
            ids = [e.ids for e in tokenizer.encode_batch([t or "" for t in b.column(names.index(text)).to_pylist()], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], [*names, out])

    return df.select(*names).mapInArrow(run, schema)


def encode_records(df: DataFrame, vocabulary: str, key: str, text: str | None = None, segments: str | None = "segments", most_id: int = 65_535) -> DataFrame:
    """(key, tokens, mask) of training records by a tokenizer file.

    A record with a text is that text between begin and end marks, all of it learnt. Else its segments (an array of text and
    learns) are encoded one by one, so no token crosses their bounds, and a segment's flag holds for all its tokens.
    Records with neither have no tokens. Only ``CHUNK`` bytes of text, or one record, are encoded at a time, however large a
    batch is: while it is made, an encoding takes many times the memory of its ids.
    """
    none = F.lit(None)
    src = df.select(key, (F.col(text) if text else none.cast("string")).alias("text"), (F.col(segments) if segments else none.cast("array<struct<text:string,learns:boolean>>")).alias("segments"))
    return _encode(src, vocabulary, most_id, _parts)


def encode_conversations(df: DataFrame, vocabulary: str, key: str, messages: str = "messages", most_id: int = 65_535, narrow: bool = False) -> DataFrame:
    """As ``encode_records`` of ``trajectories.serialize``, in one Python worker a task: each worker holds a tokenizer and a whole
    batch, and stays with its memory after its task. Records with an error have no tokens.

    ``narrow``: tokens of 16 bits and a mask of 8, which take two thirds of the disk where they are written or shuffled; ids
    from 32,768 on are negative then (``token & 65535`` is the id).
    """
    if narrow and most_id > 65_535:
        raise ValueError("ids of more than 16 bits can't be narrow")
    return _encode(df.select(key, messages), vocabulary, most_id, _conversations, narrow)


def _encode(src: DataFrame, vocabulary: str, most_id: int, texts, narrow: bool = False) -> DataFrame:
    token, flag, *kinds = (T.ShortType(), T.ByteType(), np.int16, np.int8) if narrow else (T.IntegerType(), T.IntegerType(), np.int32, np.int32)
    schema = T.StructType([src.schema.fields[0], T.StructField("tokens", T.ArrayType(token)), T.StructField("mask", T.ArrayType(flag))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        yield from encoded(batches, encoder(vocabulary, most_id), texts, kinds)
        pa.default_memory_pool().release_unused()  # the worker stays for later tasks

    return src.mapInArrow(run, schema)
