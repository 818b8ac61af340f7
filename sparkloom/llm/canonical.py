"""Problem 7: visually identical text stored with different characters.

``Forms.canonical`` is compatibility normalisation (composed), full case folding, one kind of space and of line end and no
default-ignorable characters, with look-alike letters of other scripts replaced by Latin ones: a fixed table for Greek and
Cyrillic, the published confusables data that Spark's Unicode library carries for all others. ``Forms.look`` is the finer
form in which two texts are equal exactly when they look the same: it keeps case, superscripts and ligature-free letters
apart. Both are pure functions of one text; ``with_canonical`` applies them to a column, once for each distinct value of
an Arrow batch, without a shuffle. Quotation marks and dashes of different shapes look different and stay.

Defined results: null text gives null; empty, blank or ignorable-only text gives an empty form after stripping and belongs
to no class; line ends are kept as they are; texts of any length are processed whole.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import warnings
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators.lineage import cut

# Ranges of the Unicode property Default_Ignorable_Code_Point.
IGNORABLE_RANGES = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
# Letters of other scripts that are drawn like a Latin letter, and hyphens drawn like the ASCII one.
LOOKALIKES = {
    # Cyrillic and Latin, small
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v", "ү": "y", "ɡ": "g", "ᴏ": "o", "ı": "i",
    # Cyrillic, capital
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y",
    "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ԍ": "G", "Ӏ": "I",
    # Greek
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "Ϳ": "J", "υ": "u", "Α": "A", "Β": "B", "Ε": "E",
    "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    # hyphens
    "‐": "-", "‑": "-", "˗": "-",
}


@lru_cache(maxsize=1)
def _ignorable() -> dict[int, None]:
    return {c: None for lo, hi in IGNORABLE_RANGES for c in range(lo, hi + 1)}


@lru_cache(maxsize=1)
def _spaces() -> dict[int, str]:
    """All kinds of single space, by their general category, drawn as an ordinary one."""
    return {c: " " for c in range(0x3001) if unicodedata.category(chr(c)) == "Zs"}


@lru_cache(maxsize=1)
def _drops_and_spaces() -> dict[int, str | None]:
    return _ignorable() | _spaces()


@lru_cache(maxsize=1)
def _look() -> dict[int, str]:
    """Full-width, half-width and Latin ligature forms, drawn as the ordinary characters; no other compatibility mapping."""
    found = {}
    for c in (*range(0xFB00, 0xFB07), *range(0xFF01, 0xFFEF)):
        kind = unicodedata.decomposition(chr(c)).partition(" ")[0]
        if kind in ("<wide>", "<narrow>", "<compat>"):
            found[c] = unicodedata.normalize("NFKC", chr(c))
    return found


#: A run of other than ASCII characters with the ASCII one before it: marks compose with what stands before them, never
#: with what follows, so runs can be mapped one by one and remembered.
_RUN = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+")
#: In the canonical form other line separators are line ends, and a tab is a space; in the look form they stay.
_LINES = {0x85: "\n", 0x2028: "\n", 0x2029: "\n"}
_ASCII_SPACES = (("\t", " "), ("\x0b", "\n"), ("\x0c", "\n"))


class _Remembered(dict):
    """run -> its form, up to ``limit`` runs of ordinary length."""

    def __init__(self, fn, limit: int = 1 << 18):
        super().__init__()
        self.fn, self.limit = fn, limit

    def __missing__(self, run: str) -> str:
        form = self.fn(run)
        if len(run) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[run] = form
        return form


class Forms:
    """The two forms of texts, with ``more`` look-alike letters (letter -> the one it is drawn like) besides the fixed ones."""

    def __init__(self, more: dict[str, str] | None = None):
        self.more = dict(more or {})
        self.latin = {ord(k): v for k, v in {**self.more, **LOOKALIKES}.items()}
        self._canonical_runs, self._look_runs = _Remembered(self._canonical_run), _Remembered(self._look_run)

    def __reduce__(self):
        return _forms, (tuple(sorted(self.more.items())),)

    def _one_script(self, text: str) -> str:
        return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(self.latin))

    def _canonical_run(self, run: str) -> str:
        run = unicodedata.normalize("NFKC", run.translate(_drops_and_spaces()).translate(_LINES).translate(self.latin))
        run = self._one_script(run.translate(_drops_and_spaces())).casefold()
        return unicodedata.normalize("NFKC", run).translate(_drops_and_spaces())

    def _look_run(self, run: str) -> str:
        return self._one_script(run.translate(_drops_and_spaces()).translate(_look()).translate(_drops_and_spaces()))

    def canonical(self, text: str) -> str:
        """The form in which texts that look the same are equal (texts that differ only by case or superscripts are, too)."""
        if not text.isascii():
            text = _RUN.sub(lambda m: self._canonical_runs[m[0]], text)
        for kind, plain in _ASCII_SPACES:
            if kind in text:
                text = text.replace(kind, plain)
        return text.lower()

    def look(self, text: str) -> str:
        """The form in which two texts are equal exactly when they are drawn alike: case, accents, digits and line ends count."""
        if text.isascii():
            return text
        return _RUN.sub(lambda m: self._look_runs[m[0]], text)


@lru_cache(maxsize=4)
def _forms(more: tuple[tuple[str, str], ...]) -> Forms:
    return Forms(dict(more))


#: The forms by the fixed letters alone, for use without a session.
canonical_form, look_form = _forms(()).canonical, _forms(()).look


@lru_cache(maxsize=1)
def confusable_letters(spark: SparkSession) -> tuple[tuple[str, str], ...]:
    """(letter, ASCII letter) of the published confusables data that Spark's own Unicode library carries: letters outside the
    Greek and Cyrillic blocks, which the fixed table covers letter by letter, and without a compatibility decomposition
    (bold or script letters do not look the same). One string of some 60,000 letters goes through the JVM once."""
    letters = [c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c)[0] == "L" and not 0x370 <= ord(c) < 0x530 and not unicodedata.decomposition(c)]
    try:
        skeleton = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(letters)).split("\n")
    except Exception as e:  # a session without a JVM of its own
        warnings.warn(f"no confusables data, only the fixed letters are used: {e}", stacklevel=2)
        return ()
    return tuple((c, s) for c, s in zip(letters, skeleton) if len(s) == 1 and s.isascii() and s.isalpha())


def forms_for(spark: SparkSession) -> Forms:
    return _forms(tuple(sorted(confusable_letters(spark))))


def is_blank(form: str) -> bool:
    return not form.strip()


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _per_value(column: pa.Array, fn, kind: pa.DataType) -> pa.Array:
    """``fn`` of each distinct value of the batch, spread to its rows."""
    coded = column.dictionary_encode()
    values = [None if v is None else fn(v) for v in coded.dictionary.to_pylist()]
    return pa.array(values, kind).take(coded.indices)


def with_canonical(df: DataFrame, text_col: str = "text", out_col: str = "canonical_text") -> DataFrame:
    """``df`` with the canonical form of ``text_col`` in ``out_col`` (an existing column of that name is replaced)."""
    keep = [c for c in df.columns if c != out_col]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out_col, T.StringType())])
    forms = forms_for(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            form = _per_value(b.column(keep.index(text_col)), forms.canonical, pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, form], [*keep, out_col])

    return df.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def canonical_keys(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each non-blank text: id, canonical_key, look_key, raw_key (128-bit digests), changed.

    Only the digests leave the task, so whatever follows shuffles 56 bytes a document, not texts.
    """
    schema = "id BIGINT, canonical_key BINARY, look_key BINARY, raw_key BINARY, changed BOOLEAN"
    forms = forms_for(df.sparkSession)

    def keys(text: str) -> dict | None:
        look = forms.look(text)
        if is_blank(look):
            return None
        form, raw = forms.canonical(text), _digest(text)
        return {"c": _digest(form), "l": raw if look == text else _digest(look), "r": raw, "x": form != text}

    kind = pa.struct([("c", pa.binary()), ("l", pa.binary()), ("r", pa.binary()), ("x", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = _per_value(b.column(1), keys, kind)
            out = pa.RecordBatch.from_arrays([b.column(0), *got.flatten()], ["id", "canonical_key", "look_key", "raw_key", "changed"])
            yield out.filter(got.is_valid())

    src = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL AND id IS NOT NULL")
    return src.mapInArrow(run, schema)


def salted_join(big: DataFrame, small: DataFrame, on: str | list[str], spread_by: str, buckets: int = 32) -> DataFrame:
    """Inner join on columns that may be hot in ``big``: its rows are spread over buckets by ``spread_by``, and the rows
    of ``small`` are there in each."""
    keys = [on] if isinstance(on, str) else list(on)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(buckets)).cast("int"))
    return left.join(small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))), [*keys, "_salt"]).drop("_salt")


def canonical_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document of a class with more than one stored text: id, class_id (smallest id of the class), texts, documents.

    A class holds the documents of equal canonical form. Classes are aggregated with map-side combine; members are
    joined back by the class key, never gathered into one task.
    """
    keys = cut(canonical_keys(df, id_col, text_col).select("id", "canonical_key", "raw_key"))
    texts = keys.groupBy("canonical_key", "raw_key").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    classes = texts.groupBy("canonical_key").agg(F.min("id").alias("class_id"), F.count("*").alias("texts"), F.sum("n").alias("documents")).where("texts > 1")
    return salted_join(keys, classes, "canonical_key", "id").select("id", "class_id", "texts", "documents")


def lookalike_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (doc_a < doc_b) of documents whose texts look the same but are not stored with the same characters.

    Classes come from the canonical form; the exact check compares look forms. Texts are paired first, each stored text
    once; then the documents of the more frequent text of a pair, and of the other, are joined in with salted keys. So the
    work follows the number of pairs, and copies of one text are never paired with each other. The keys are written to
    the checkpoint folder: texts are read and mapped once.
    """
    keys = cut(canonical_keys(df, id_col, text_col).select("id", "canonical_key", "look_key", "raw_key"))
    texts = keys.groupBy("canonical_key", "look_key", "raw_key").agg(F.count("*").alias("n"))
    several = texts.groupBy("canonical_key", "look_key").agg(F.count("*").alias("t")).where("t > 1").drop("t")
    shared = texts.join(several, ["canonical_key", "look_key"], "left_semi")
    many = shared.withColumnsRenamed({"raw_key": "raw_a", "n": "n_a"})
    few = shared.withColumnsRenamed({"raw_key": "raw_b", "n": "n_b"})
    pairs = cut(many.join(few, ["canonical_key", "look_key"]).where("n_a > n_b OR (n_a = n_b AND raw_a < raw_b)").select("raw_a", "raw_b"))
    members = keys.select("id", "raw_key")
    left = salted_join(members.select(F.col("id").alias("a"), F.col("raw_key").alias("raw_a")), pairs, "raw_a", "a").select("a", "raw_b")
    both = salted_join(left, members.select(F.col("id").alias("b"), F.col("raw_key").alias("raw_b")).join(pairs.select("raw_b").distinct(), "raw_b", "left_semi"), "raw_b", "a")
    return both.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b")).where("doc_a < doc_b").distinct()
