"""Problem 6: mixing feeds to target shares of the total size, with a cap on repetitions.

Sizes are tokens of a public tokenizer. The allocation is capped water-filling: every feed gets its weight's part of the
total; feeds that would need more than ``max_repeats`` passes over their documents are clamped there, and what they leave
is spread over the others in proportion to their weights, until nothing is clamped any more. Drawing gives each document
the whole number of passes of its feed and, for the fraction, one more where a seeded hash of its id falls under it.

Defined results: feeds are compared without case and surrounding spaces; null, blank texts have no tokens; documents of
feeds that are not listed or null are left out; a target that is null, not a number or below zero counts as zero; a null cap is one
pass, a negative one zero; repeated target rows count once, as the one with the largest share; extra columns are ignored.
"""

from __future__ import annotations

import base64
import math
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabulary files; a parameter of every function below.
TOKENIZER_DIR = os.environ.get("SPARKLOOM_TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The allocation runs on the driver over the target table, one row a feed; more rows than this are refused.
MAX_FEEDS = 100_000


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: A place where every tokenization by ``PATTERN`` has a boundary: one blank or line end between two visible characters.
_BOUNDARY = re.compile(r"(?<=\S)[ \n](?=\S)")


def count_tokens(encode, text: str, piece: int = 1 << 16) -> int:
    """Tokens of the whole ``text``. Long texts are encoded in pieces of at least ``piece`` characters that end where the
    splitting pattern has a boundary, so the count is that of the text in one piece."""
    total = start = 0
    while len(text) - start > piece and (m := _BOUNDARY.search(text, start + piece)):
        total += len(encode(text[start : m.start()]))
        start = m.start()
    return total + len(encode(text[start:]))


def feed_key(column: str) -> F.Column:
    return F.nullif(F.lower(F.trim(F.regexp_replace(F.col(f"`{column}`"), r"(?U)^\s+|\s+$", ""))), F.lit(""))


def token_sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", feed_col: str = "source", tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, feed, tokens of every document; texts stay in their tasks."""
    path = os.path.join(tokenizer_dir, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for b in batches:
            n = [count_tokens(encode, t) if t and not t.isspace() else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "feed", "tokens"])

    src = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), feed_key(feed_col).alias("feed"), F.col(f"`{text_col}`").alias("text"))
    return src.mapInArrow(run, "doc_id BIGINT, feed STRING, tokens BIGINT")


def water_fill(weights: list[float], caps: list[float], total: float) -> list[float]:
    """Sizes that add up to ``total`` or, if less, to the sum of ``caps``: proportional to weights, none above its cap."""
    got, open_, left = [0.0] * len(weights), [i for i, w in enumerate(weights) if w > 0], total
    while open_ and left > 0:
        whole = math.fsum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * left / whole >= caps[i]]
        if not full:
            for i in open_:
                got[i] = weights[i] * left / whole
            break
        for i in full:
            got[i] = caps[i]
        shut = set(full)
        open_ = [i for i in open_ if i not in shut]
        left -= math.fsum(caps[i] for i in full)
    return got


def targets_of(targets: DataFrame, source_col: str = "source", share_col: str = "target_share", cap_col: str = "max_repeats") -> DataFrame:
    share = F.col(f"`{share_col}`").cast("double")
    share = F.when(share.isNull() | F.isnan(share) | (share < 0), 0.0).otherwise(share)
    cap = F.greatest(F.coalesce(F.col(f"`{cap_col}`").cast("int"), F.lit(1)), F.lit(0))
    rows = targets.select(F.col(f"`{source_col}`").alias("source"), feed_key(source_col).alias("feed"), share.alias("share"), cap.alias("cap")).where("feed IS NOT NULL")
    return rows.groupBy("feed").agg(F.max_by(F.struct("source", "share", "cap"), F.struct("share", "cap", "source")).alias("r")).select("feed", "r.*")


def mix_plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each feed of ``targets``: tokens, the share it can and does reach, and the passes over its documents.

    ``sizes`` has feed and tokens (see ``token_sizes``); the total is the tokens of all listed feeds. Only sums by feed
    reach the driver, one row for each target. A feed is reachable if the allocation gives it its share of the total, that is
    unless it was clamped below (shares that add up to more than one are taken in proportion).

    Columns: feed, source, target_share, max_repeats, tokens, target_tokens, cap_tokens, reachable, mixed_tokens,
    repeats (passes, a fraction), actual_share.
    """
    spark = sizes.sparkSession
    wanted = targets_of(targets)
    sums = sizes.where("feed IS NOT NULL").groupBy("feed").agg(F.sum("tokens").alias("tokens"))
    rows = wanted.join(sums, "feed", "left").select("feed", "source", "share", "cap", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens")).limit(MAX_FEEDS + 1).collect()
    if len(rows) > MAX_FEEDS:
        raise ValueError(f"more than {MAX_FEEDS} feeds in the target table")
    rows.sort(key=lambda r: r.feed)
    total = sum(r.tokens for r in rows)
    caps = [float(r.tokens * r.cap) for r in rows]
    mixed = water_fill([r.share for r in rows], caps, float(total))
    whole = math.fsum(mixed)
    shares = math.fsum(r.share for r in rows)
    wanted_of = lambda r: r.share * total / max(shares, 1.0)
    out = [
        (r.feed, r.source, r.share, r.cap, r.tokens, r.share * total, cap, m >= wanted_of(r) * (1 - 1e-9) and (m > 0 or r.share == 0), m, m / r.tokens if r.tokens else 0.0, m / whole if whole else 0.0)
        for r, cap, m in zip(rows, caps, mixed)
    ]
    return spark.createDataFrame(out, "feed STRING, source STRING, target_share DOUBLE, max_repeats INT, tokens BIGINT, target_tokens DOUBLE, cap_tokens DOUBLE, reachable BOOLEAN, mixed_tokens DOUBLE, repeats DOUBLE, actual_share DOUBLE")


def draw(sizes: DataFrame, plan: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, feed, tokens, copies of every document that is drawn at least once.

    A document's copies are the whole passes of its feed, plus one where the seeded hash of its id, as a number in [0, 1),
    lies under the fraction. No feed is ordered or gathered, so a feed with a third of all rows costs nothing extra.
    """
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    whole = F.floor("repeats")
    copies = (whole + F.when(chance < F.col("repeats") - whole, 1).otherwise(0)).cast("int")
    return sizes.join(F.broadcast(plan.select("feed", "repeats")), "feed").select("doc_id", "feed", "tokens", copies.alias("copies")).where("copies > 0")
