"""Column expressions on text: trimming, line ends, tokens, shingles, masking and redaction. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as white space at the ends of a text.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

# The lexical classes of source text (identifier, number, any other visible character).
TOKEN = r"(?U)[A-Za-z_][A-Za-z0-9_]*|\d+|[^\s]"
NUMBER_MARK = "<NUM>"

# Named patterns of content that must not enter a corpus, in order of precedence.
SENSITIVE = {
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "aws_access_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9_]{30,255}\b",
    "github_fine_grained_token": r"\bgithub_pat_[A-Za-z0-9_]{40,255}\b",
    "hugging_face_token": r"\bhf_[A-Za-z0-9]{30,}\b",
    "openai_key": r"\bsk-[A-Za-z0-9_-]{40,}\b",
    "slack_token": r"\bxox[baprs]-[A-Za-z0-9-]{20,}\b",
    "stripe_secret": r"\bsk_(?:live|test)_[A-Za-z0-9]{16,}\b",
    "jwt": r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b",
    "email_address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![A-Za-z])",
}

#: What a text must contain for a pattern to be worth trying; plain searches are far cheaper than expressions.
SENSITIVE_HINTS = {
    "private_key": ("PRIVATE KEY-----",),
    "aws_access_key": ("AKIA", "ASIA"),
    "github_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "github_fine_grained_token": ("github_pat_",),
    "hugging_face_token": ("hf_",),
    "openai_key": ("sk-",),
    "slack_token": ("xox",),
    "stripe_secret": ("sk_live_", "sk_test_"),
    "jwt": ("eyJ",),
    "email_address": ("@",),
}

# What a recorded conversation must not keep.
RECORDED_SECRETS = (
    r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----[\s\S]*?-----END[^-]+-----",
    r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    r"\b(?:gh[pousr]_|github_pat_)[A-Za-z0-9_]{30,255}\b",
    r"\b(?:hf_|sk-)[A-Za-z0-9_-]{30,}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{20,}\b",
)


def strip(text: Column | str) -> Column:
    """Without white space of any kind at both ends (``trim`` takes blanks only)."""
    return F.btrim(text, F.lit(SPACES))


def unix_lines(text: Column | str) -> Column:
    return F.replace(F.replace(F.col(text) if isinstance(text, str) else text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def content_sha256(text: Column | str) -> Column:
    return F.sha2(text, 256)


def sensitive_reason(text: Column | str) -> Column:
    """Name of the first pattern that the text holds, else null."""
    c = F.col(text) if isinstance(text, str) else text
    hinted = lambda n: reduce(or_, (F.contains(c, F.lit(h)) for h in SENSITIVE_HINTS[n]))
    return F.coalesce(*(F.when(hinted(n) & c.rlike("(?U)" + p), F.lit(n)) for n, p in SENSITIVE.items()))


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def masked_tokens(text: Column | str) -> Column:
    """Tokens with every number replaced by one mark."""
    return F.transform(tokens(text), lambda t: F.when(t.rlike(r"^\p{Nd}+\z"), F.lit(NUMBER_MARK)).otherwise(t))


def let(value: Column | str, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it inside further lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def token_shingles(words: Column, size: int = 5, most: int = 20_000) -> Column:
    """Runs of ``size`` tokens, joined by NUL; the last ones are shorter. Beyond ``most`` tokens, evenly spaced starts."""

    def runs(w: Column) -> Column:
        n = F.size(w)
        stride = F.greatest(F.lit(1), F.floor(n / most)).cast("int")
        starts = F.when(n > 0, F.sequence(F.lit(1), n, stride)).otherwise(F.array().cast("array<int>"))
        return F.slice(F.transform(starts, lambda i: F.array_join(F.slice(w, i, size), "\x00")), 1, most)

    return let(words, runs)


def redact(text: Column | str, mark: str = "<REDACTED>", most: int | None = 50_000) -> Column:
    """The first ``most`` characters (all, if it is None), with secrets replaced; cutting comes first, so a cut secret may
    stay."""
    c = F.col(text) if isinstance(text, str) else text
    c = c if most is None else F.substring(c, 1, most)
    for p in RECORDED_SECRETS:
        c = F.regexp_replace(c, p, mark)
    return c


def redact_address(text: Column | str) -> Column:
    """User and password of web addresses replaced."""
    return F.regexp_replace(text, r"(https?://)[^/@\s]+@", "$1<REDACTED>@")


def replace_counted(text: Column, old: Column, new: Column, expected: Column) -> Column:
    """struct(ok, count, text): literal replacement, done only where ``old`` occurs exactly ``expected`` times."""
    count = F.when(F.length(old) > 0, ((F.length(text) - F.length(F.replace(text, old, F.lit("")))) / F.length(old)).cast("int")).otherwise(0)
    ok = (count == expected) & (F.length(old) > 0)
    return F.struct(ok.alias("ok"), count.alias("count"), F.when(ok, F.replace(text, old, new)).otherwise(text).alias("text"))


def api_root(url: Column | str) -> Column:
    """Address of the version 1 interface: no final slashes, ``/api/v1`` at the end."""
    bare = F.regexp_replace(url, r"/+$", "")
    return F.when(bare.endswith("/api/v1"), bare).otherwise(F.concat(bare, F.lit("/api/v1")))


def clipped(text: Column | str, most: int, suffix: str = "") -> Column:
    """The first ``most`` characters, with ``suffix`` where something was cut."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(suffix))).otherwise(c)
