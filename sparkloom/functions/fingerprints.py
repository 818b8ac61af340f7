"""64-bit SimHash over token shingles, its bands and distances."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from sparkloom.functions import text as tx

BANDS, BAND_BITS = 4, 16
_TOKEN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|\d+|[^\s]")


def _blake64(shingle: str) -> bytes:
    return hashlib.blake2b(shingle.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def simhash_of(text: str, size: int = 5, most: int = 20_000) -> int:
    """Signed 64-bit fingerprint: each bit by majority over the shingles' 64-bit BLAKE2 digests, set on a tie; 0 without tokens."""
    words = [tx.NUMBER_MARK if w.isdigit() else w for w in _TOKEN.findall(text)]
    if not words:
        return 0
    stride = max(1, len(words) // most)
    digests = b"".join(_blake64("\x00".join(words[i : i + size])) for i in range(0, min(len(words), stride * most), stride))
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    votes = bits.sum(axis=0, dtype=np.int64) * 2 >= len(bits)
    return int(np.packbits(votes).view(">i8")[0])


@F.pandas_udf(LongType())
def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Fingerprint column by Arrow batches."""
    for s in batches:
        yield s.map(lambda t: None if t is None else simhash_of(t)).astype("Int64")


#: Votes of the 64 bits are counted three to a number, 22 bits apart, which holds up to so many shingles of a document.
LANES, LANE_MOST = 22, (1 << 20) - 1
_LANES = 1 | 1 << LANES | 1 << 2 * LANES
_VOTES = f"(a, x) -> transform(a, (v, i) -> v + (shiftrightunsigned(x, i) & {_LANES}L))"
_COUNT = f"(shiftrightunsigned(a[b % {LANES}], {LANES} * (b div {LANES})) & {(1 << LANES) - 1}L)"
_BITS = f"a -> aggregate(sequence(0, 63), 0L, (t, b) -> t | if(size(q) > 0 AND {_COUNT} * 2 >= size(q), shiftleft(1L, b), 0L))"


def with_simhash(df: DataFrame, text: str, out: str = "simhash", most: int = 20_000) -> DataFrame:
    """``df`` with the fingerprint of ``text`` by built-in functions only; the shingle hash is the first 64 bits of SHA-256.
    0 without tokens, null for null.

    A document's shingles are hashed and its votes counted within its row, 22 counters of three lanes each (bits i, i + 22 and
    i + 44), so nothing is exploded or shuffled. ``most`` bounds the shingles as in ``text.token_shingles``.
    """
    if not 0 < most <= LANE_MOST:
        raise ValueError(f"most must be from 1 to {LANE_MOST}")
    hashes = F.transform(tx.token_shingles(tx.masked_tokens(text), most=most), lambda s: F.conv(F.substring(F.sha2(s, 256), 1, 16), 16, -10).cast("bigint"))
    keep = [c for c in df.columns if c != out]
    hashed = df.select(*[F.col(f"`{c}`") for c in keep], hashes.alias("_hashes"))
    return hashed.select(*[F.col(f"`{c}`") for c in keep], F.expr(f"get(transform(array(_hashes), q -> aggregate(q, array_repeat(0L, {LANES}), {_VOTES}, {_BITS})), 0)").alias(out))


def simhash_native(df: DataFrame, id_col: str, text_col: str, most: int = 20_000) -> DataFrame:
    """(id, simhash) of every row, see ``with_simhash``."""
    return with_simhash(df.select(F.col(id_col), F.col(text_col)), text_col, "simhash", most).select(id_col, "simhash")


def bands(h: Column | str) -> Column:
    """Array of the four 16-bit bands of a fingerprint, lowest first."""
    return F.array(*(F.shiftrightunsigned(h, BAND_BITS * b).bitwiseAND(F.lit((1 << BAND_BITS) - 1).cast("bigint")) for b in range(BANDS)))


def hamming(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.bit_count(a.bitwiseXOR(b))
