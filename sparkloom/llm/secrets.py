"""Problem 3: credentials embedded in source code, configuration and conversations.

Method: a line that hints at credentials is read lexically - names, separators, string literals with their delimiters and
escapes, literals that are put together, bare words, block values, flags, headers, commands, addresses - and a literal is
flagged when it is assigned or passed to a name of a credential (or has the shape of an issued key) and is no placeholder,
reference, digest or hash. Redaction replaces only the content of the literal, so delimiters and line ends stay and the code,
configuration or JSON around it remains valid.

Escaped text (a JSON string that holds code) is read through a view of the same length in which escaped quotes and line
ends are blanks and plain ones; offsets therefore hold in the stored text, and lines are those of the stored text. Where a
literal ends is decided in the stored text: a quote closes it if it has the backslashes of its own level of nesting.

Defined results: null and empty texts hold nothing; bytes that are no UTF-8 are kept as they are, also by redaction; repeated
rows count once; a private key counts at the line of its BEGIN mark only, all of its body is masked; a value on a line after
its name counts at its own line; texts of any length are read whole.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASK = "REDACTED"

# Words that end the name of a credential.
CREDENTIAL_ENDS = (
    "password", "passwd", "passwort", "passphrase", "pwd", "pass", "contrasena", "mot_de_passe", "motdepasse", "kennwort",
    "secret", "token", "api_key", "apikey", "secret_key", "secretkey", "access_key", "accesskey", "private_key", "signing_key",
    "service_key", "encryption_key", "encryptionkey", "auth_key", "master_key", "account_key", "access_key_id", "key_id",
    "keyid", "credential", "credentials", "authorization", "smtppass", "dbpass", "storepass", "keypass", "sshpass",
)
#: Words before "token" that make it a token of a text or a page.
_OTHER_TOKENS = {"next", "page", "cls", "eos", "bos", "pad", "unk", "sep", "special", "stop", "max", "num", "mask", "continuation", "n"}
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

# Shapes of issued keys.
ISSUED = re.compile(
    r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_-]{20,}|hf_[A-Za-z0-9]{30,}"
    r"|sk-[A-Za-z0-9_-]{32,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|xox[abeprs]-[A-Za-z0-9-]{20,}|npm_[A-Za-z0-9]{36}|AIza[A-Za-z0-9_-]{35}"
    r"|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{6,})(?![A-Za-z0-9])"
)
KEY_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
KEY_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
KEY_BODY = re.compile(r"[A-Za-z0-9+/]{16,}={0,2}")

# What a line holds, in small letters, that is worth reading; plain searches are far cheaper than expressions.
HINTS = (
    "pass", "pwd", "contrase", "kennwort", "secret", "token", "key", "credential", "authori", "authent", "bearer", "//hook", "login", "log_in", "signin", "sign_in", "@",
    "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat", "glpat-", "hf_", "sk-", "sk_live", "sk_test", "rk_live", "rk_test", "xox", "npm_", "aiza", "eyj",
    "identified by", "curl", "wget", "mysql", "redis-cli", "smbclient", "ldap", "sqlcmd", "sudo -s",
)
_NO_TOKEN = ("iz", " mask", "s mask")

# Calls that hand their literal on as it is.
_WRAPPED = r"(?:(?:new\s+)?[A-Za-z_][\w.:]*?(?:str|string|bytes|from|decode|unhexlify|fromhex|secret|secretstr|b64|base64|trim|strip|some|ok)(?:::new)?\(\s*)*"
_BARE = r"(?:(?:bearer|basic|token|apikey|digest)[^\S\n]+)?[^\s\"'`,;(){}\[\]<>]*[^\s\"'`,;(){}\[\]<>.:]"
PAIR = re.compile(
    r"(?<![\w$.-])(?P<name>[A-Za-z_][\w-]*)(?P<close>(?:[^\S\n]{0,3}[\"'`])?[^\S\n]*\]?)[^\S\n]*(?P<sep>:=|=>|=(?![=~>])|:(?![:/])|,(?=\s*[bBrRfFuU]{0,2}\s{0,3}[\"'`]))"
    rf"(?:\s*(?P<open>\(\s*)?\\?\s*{_WRAPPED}(?:[bBrRfFuU]{{1,2}}\s{{0,3}})?(?P<q>\"\"\"|'''|\" \" \"(?! *\S)|\" \" \"(?=\n)|[\"'`])|[^\S\n]*(?P<bare>{_BARE}))",
    re.I,
)
#: What may stand between the parts of one value: nothing but blanks inside brackets, an operator elsewhere.
_JOINED = re.compile(r"[^\S\n]*(?:\+|\.|&)?[^\S\n]*(?:[bBrRfFuU]{1,2})?(?=[\"'`])|\s*(?:\+|\.|\\|&)\s*(?:[bBrRfFuU]{1,2})?(?=[\"'`])")
_JOINED_INSIDE = re.compile(r"\s*(?:\+|\.|\\|&)?\s*(?:[bBrRfFuU]{1,2})?(?=[\"'`])")
_OPEN_END = re.compile(r"(?:[=:(,\\|>+]|\"\"\"|'''|\" \" \"|[|>][+-]?\d?)[^\S\n]*$")
_BLOCK = re.compile(r"[|>][+-]?\d?[+-]?[^\S\n]*(?:#[^\n]*)?\n(?P<body>(?P<in>[^\S\n]+)\S[^\n]*(?:\n(?:(?P=in)[^\n]*|[^\S\n]*(?=\n)))*)")
DEFINE = re.compile(r"#\s*define\s+(?P<name>\w+)\s+[\"'](?P<val>[^\"']*)[\"']")
FLAG = re.compile(r"(?<![\w-])--?(?P<name>[A-Za-z][\w-]*)(?:\s*=\s*|\s+)(?P<q>[\"']?)(?P<val>[^\s\"'`;|&]+)")
USERINFO = re.compile(r"(?<![^\s/\"'`=<>(\[,])(?P<user>[\w.+%~${}-]*):(?P<val>\$\{[^}]*\}|[^\s:/@\"'`<>]+)@(?=[\w-]+[.:/]|localhost|\[|\$)")
QUERY = re.compile(r"[?&#;/](?P<name>[A-Za-z_][\w-]*)=(?P<val>[^\s&#\"'`<>;/)]+)")
SPOKEN = re.compile(r"\b(?:password|passwd|passphrase|passwort)\s+(?P<q>[\"'`]?)(?P<val>[^\s\"'`,;]+)", re.I)
STATED = re.compile(r"\b(?P<name>(?:[A-Za-z_]+ ){0,3}[A-Za-z_]+) (?:is|was)[ :]+(?P<q>[\"'`]?)(?P<val>[^\s\"'`,;]+)")
GIVEN = re.compile(r"\bset (?:the )?(?P<name>[\w ]{2,60}?) to (?P<q>[\"'`]?)(?P<val>[^\s\"'`,;]+)", re.I)
USED = re.compile(r"[\"'`](?P<val>[^\s\"'`]+)[\"'`] as (?:the |my |our |your )?(?P<name>[\w ]{2,60}?)(?= (?:until|for|to|in|on|and|when|while)\b|[.,;!?]|$)")
ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.-]*)>(?P<val>[^<>]+)</(?P=name)>")
ATTRIBUTES = re.compile(r"\b(?:key|name|id)\s*=\s*[\"'](?P<name>[^\"'<>]+)[\"'][^<>]*?\bvalue\s*=\s*[\"'](?P<val>[^\"'<>]*)", re.I)
HOOK = re.compile(r"\bhttps?://hooks?\.[\w.-]+/(?:services|workflows|api/webhooks)/(?:[A-Z0-9]{6,}/)*(?P<val>[A-Za-z0-9_-]{16,})")
CALL = re.compile(r"\b(?:authenticate|authorize|log_?in|sign_?in)\w*\s*\((?P<args>[^()]*)\)", re.I)
_ARG = re.compile(r"[\"'`]([^\"'`]*)[\"'`]")
_QUOTED = r"[^\S\n]*(?:(?P<q>[\"'])(?P<lit>[^\"'\n]+)(?P=q)|(?P<bare>[^\s\"'`;|&<>()]+))"
_ARGS = r"\b[^|;\n]*?[^\S\n]"
# Commands and statements that take a secret by position or by a flag without a telling name.
COMMANDS = tuple(
    re.compile(p + _QUOTED, re.I)
    for p in (
        r"\bidentified[^\S\n]+by(?:[^\S\n]+password)?(?=[^\S\n]+[\"'])", rf"\bsshpass{_ARGS}-p", rf"\bmysql\w*{_ARGS}-p(?! )", rf"\bredis-cli{_ARGS}-a(?= )", rf"\b(?:docker|podman|helm)\b[^|;\n]*?\blogin{_ARGS}-p(?= )",
        rf"\bldap\w+{_ARGS}-w(?= )", rf"\bsqlcmd{_ARGS}-P", r"-pass(?:in|out)?[^\S\n]+pass:(?! )", r"\bhtpasswd[^\S\n]+-\w*b\w*[^\S\n]+\S+[^\S\n]+\S+", rf"\bsmbclient{_ARGS}-U[^\S\n]*[\"']?\w+%(?! )",
    )
)
LOGIN = re.compile(r"\b(?:curl|wget|https?)\b[^|;\n]*?[^\S\n](?:-u|--user|--proxy-user)(?:=|[^\S\n]*)(?P<q>[\"']?)[^\s:\"']+:(?P<val>[^\s\"']+)", re.I)

_SCHEME = re.compile(r"(?:bearer|basic|token|apikey|digest)\s+", re.I)
_REFERENCE = re.compile(r"\$\{|\$\(|\{\{|^[<\[{]|^\$[A-Za-z_]\w*$|^%\w+%$|^![a-z-]+$|process\.env|os\.environ|getenv|^env[.:(]|^vault[:/]|^secrets?[:/.]|^arn:|^(?:config|settings|self|this|args|options|params)\.", re.I)
_PLACEHOLDER = re.compile(r"your[-_ ]|change[-_ ]?(?:me|it)|replace[-_ ]?(?:me|with|this)|example|placeholder|redact|dummy|mask(?:ed)?\b|x{4,}|\*{3,}|\.{3,}|^<.*>$|^\[.*\]$|^(?:none|null|nil|true|false|undefined|string|str|bytes|bearer|basic|todo|tbd|test|changeit)$|-here\b", re.I)
_PATH = re.compile(r"^(?:~|\.{0,2})/(?:[\w.-]+/)*[\w.-]+/?$")
_HASHED = re.compile(r"^(?:\$(?:2[abxy]|argon2\w*|pbkdf2[\w-]*|scrypt|[156y])\$|\{?(?:s?sha\d*|md5|crypt)\b[}:-]|ssh-|ecdsa-|sha(?:1|256|384|512)[-:]|pbkdf2)", re.I)
_PLAIN = re.compile(r"^(?:v?\d+(?:[._]\d+)+|\d{4}-\d\d-\d\d\S*|\d+(?:\.\d+)?(?:px|ms|s|m|h|d|kb|mb|gb|%)?|[\w./-]+\.(?:py|js|ts|go|rs|java|c|h|rb|sh|md|txt|json|ya?ml|toml|html|sql|pem|key|crt)(?::\d+)?)$", re.I)


@lru_cache(maxsize=1 << 14)
def is_credential(name: str) -> bool:
    words = [w.lower() for w in _WORDS.findall(name.replace("ñ", "n"))]
    whole = "_" + "_".join(words)
    if not words or not any(whole.endswith("_" + e) for e in CREDENTIAL_ENDS):
        return False
    return not (words[-1] == "token" and len(words) > 1 and words[-2] in _OTHER_TOKENS)


def is_usable(value: str, bare: bool = False) -> bool:
    """Is ``value`` a working secret, by its looks: no placeholder, reference, hash, number, plain word or file name."""
    if len(value) < 6 or _REFERENCE.search(value) or _PLACEHOLDER.search(value) or _HASHED.search(value) or _PLAIN.match(value):
        return False
    if any(c.isspace() for c in value) or len(set(value)) < 4:
        return False
    digits = sum(c.isdigit() for c in value)
    letters = sum(c.isalpha() for c in value)
    upper, lower = any(c.isupper() for c in value), any(c.islower() for c in value)
    if _PATH.match(value) and not (digits and upper and lower):
        return False
    if digits and letters:
        if not bare:
            return True
        return len(value) >= 8 and not re.fullmatch(r"[a-z]+(?:_[a-z]+)*_?\d{1,3}", value)
    if any(c in "!#$%*~^&+=@?" for c in value) and upper + lower + bool(digits) >= 2:
        return True
    turns = sum(a.isupper() and b.islower() for a, b in zip(value, value[1:])) + sum(a.islower() and b.isupper() for a, b in zip(value, value[1:]))
    if len(value) < 10 or turns < 5:
        return False
    words = _WORDS.findall(value)
    return value.isalpha() or (len(words) > 5 and re.fullmatch(r"[A-Za-z_-]+", value) is not None and sum(map(len, words)) <= 4 * len(words))


#: Words of texts for readers, which no pass phrase is made of.
_ASKING = re.compile(r"\b(?:enter|your|please|password|passphrase|secret|token|key|the|is|must|required|invalid|wrong|type|forgot|new|confirm|repeat|old|current|for|not|see|from|set)\b", re.I)


def is_phrase(value: str, name: str) -> bool:
    """Is ``value`` four or more ordinary words given as the secret itself, not a text about one?"""
    words = value.split()
    return len(words) >= 4 and name.lower().replace("_", "").endswith(("password", "passphrase", "passwd", "pwd")) and all(w.isalpha() and w.islower() and 3 <= len(w) <= 12 for w in words) and not _ASKING.search(value)


def _basic(value: str) -> bool:
    """Is ``value`` user and password in base64?"""
    try:
        user, colon, word = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8").partition(":")
    except ValueError:
        return False
    return bool(colon) and bool(word) and not _PLACEHOLDER.search(word)


_ESCAPED = re.compile(r"\\+([\"'nrt/])")


def readable(text: str) -> str:
    """``text`` at the same length, with escaped quotes and line ends as plain ones."""
    if "\\" not in text:
        return text
    return _ESCAPED.sub(lambda m: " " * (len(m[0]) - 1) + {"n": "\n", "r": " ", "t": " "}.get(m[1], m[1]), text)


def _unescaped(value: str) -> str:
    return re.sub(r"\\+(.)", r"\1", value) if "\\" in value else value


def _value(start: int, value: str, bare: bool, name: str = "") -> tuple[int, int] | None:
    """Span of the secret in a literal or bare word that begins at ``start``, None if there is none."""
    lead = len(value) - len(value.lstrip())
    start, value = start + lead, value.strip()
    scheme = _SCHEME.match(value)
    if scheme:
        start, value = start + scheme.end(), value[scheme.end() :].strip()
        if scheme[0].lower().startswith("basic"):
            return (start, start + len(value)) if _basic(value) else None
    plain = _unescaped(value)
    return (start, start + len(value)) if is_usable(plain, bare) or (not bare and is_phrase(plain, name)) else None


_DELIMITERS = {q: re.compile(r"(\\*)" + q) for q in "\"'`"}


def literal_end(text: str, view: str, at: int, quote: str, nested: bool) -> tuple[int, int]:
    """(end of the content, end of the closing delimiter) of the literal whose content begins at ``at``, after ``quote``.

    A quote of a literal at nesting level L stands behind 2^L - 1 backslashes; with more of them it belongs to the content,
    with fewer it ends a literal around this one. One that is not closed ends with its line, or with the text if it may
    hold several lines.
    """
    mark = quote[0]
    first = at - len(quote)
    k = 0
    while first - k > 0 and text[first - k - 1] == "\\":
        k += 1
    if len(quote) > 1:
        whole = text[first - k : at]
        end = text.find(whole, at)
        return (len(text), len(text)) if end < 0 else (end, end + len(whole))
    level = (1 if nested and mark != '"' else 0) if k == 0 else (k + 1).bit_length() - 1
    step = 2 << level
    want = 0 if k == 0 else (1 << level) - 1
    line_end = len(text) if mark == "`" else view.find("\n", at)
    line_end = len(text) if line_end < 0 else line_end
    for m in _DELIMITERS[mark].finditer(text, at, line_end):
        n = len(m[1])
        if n < k or n % step == want:
            return m.end() - 1 - min(n, k), m.end()
    return line_end, line_end


def _literal_parts(text: str, view: str, at: int, quote: str, nested: bool, inside: bool, stop: int) -> tuple[list[tuple[int, int]], int]:
    """Contents of a literal and of those put together with it, and where the last one ends."""
    end, after = literal_end(text, view, at, quote, nested)
    parts = [(at, end)]
    while after < stop and (more := (_JOINED_INSIDE if inside else _JOINED).match(view, after, stop)):
        begin = more.end() + 1
        if view[more.end()] not in "\"'`":
            break
        end, after = literal_end(text, view, begin, view[more.end()], nested)
        parts.append((begin, end))
    return parts, after


def _pair_spans(text: str, view: str, begin: int, end: int, nested: bool) -> Iterator[tuple[int, int]]:
    """Literals and bare words that are assigned or passed to names of credentials between ``begin`` and ``end``."""
    at = begin
    while m := PAIR.search(view, at, end):
        value = "q" if m["bare"] is None else "bare"
        if not is_credential(m["name"]) or (m["sep"] == "," and not m["close"].strip(" ]")):
            at = max(m.start(value), m.start() + 1)  # the value may hold pairs of its own
            continue
        at = max(m.end(), m.start() + 1)
        if value == "bare":
            block = _BLOCK.match(view, m.start("bare")) if m["sep"] == ":" else None
            if block and KEY_BEGIN.search(block["body"]):
                continue  # found by its marks
            if block:
                for line in re.finditer(r"[^\n]*\S", block["body"]):
                    span = _value(block.start("body") + line.start(), line[0], True)
                    if span:
                        yield span
                continue
            following = view[m.end() : min(end, m.end() + 1)]
            span = None if following in ("(", "[", "{") and following else _value(m.start("bare"), m["bare"], True)
            if span:
                yield span
            else:
                at = max(m.start("bare"), m.start() + 1)
            continue
        inside = m["open"] is not None
        parts, after = _literal_parts(text, view, m.end("q"), m["q"], nested, inside, end if not inside else min(len(view), end + 4096))
        whole = "".join(view[a:b].rstrip() if len(m["q"]) == 1 else view[a:b] for a, b in parts)
        if len(parts) > 1:
            if _value(0, whole, False) or _value(parts[0][0], text[slice(*parts[0])], False):
                yield from ((a, a + len(text[a:b].rstrip())) for a, b in parts)
                at = max(at, after)
            continue
        a, b = parts[0]
        if len(m["q"]) > 1 and KEY_BEGIN.search(view, a, b):
            continue
        if len(m["q"]) > 1 and "\n" in view[a:b].strip():  # lines of a long literal, each on its own
            for line in re.finditer(r"[^\n]*\S", view[a:b]):
                span = _value(a + line.start(), line[0], True)
                if span:
                    yield span
            continue
        span = _value(a, text[a:b], False, m["name"])
        if span:
            yield span
            at = max(at, min(after, end))
        else:
            at = m.end("q")


def _line_spans(line: str) -> Iterator[tuple[int, int]]:
    """Secrets of a line outside of assignments: issued keys, addresses, flags, commands, headers, sentences."""
    for m in ISSUED.finditer(line):
        if not _PLACEHOLDER.search(m[0]):
            yield m.span()
    if "@" in line:
        for m in USERINFO.finditer(line):
            if is_usable(m["val"]) or (len(m["val"]) >= 6 and "://" in line[: m.start()] and not _REFERENCE.search(m["val"]) and not _PLACEHOLDER.search(m["val"])):
                yield m.span("val")
    for pattern in (DEFINE, FLAG, QUERY, ELEMENT, ATTRIBUTES):
        for m in pattern.finditer(line):
            if is_credential(m["name"]):
                span = _value(m.start("val"), m["val"].rstrip(".,"), pattern is FLAG)
                if span:
                    yield span
    for pattern in (SPOKEN, STATED, GIVEN, USED):
        for m in pattern.finditer(line):
            if pattern is SPOKEN or is_credential(m["name"].rpartition(" ")[2]) or is_credential(m["name"]):
                span = _value(m.start("val"), m["val"].rstrip(".,:!?"), pattern is not USED)
                if span:
                    yield span
    for pattern in COMMANDS:
        for m in pattern.finditer(line):
            group = "lit" if m["lit"] else "bare"
            span = _value(m.start(group), m[group], False)
            if span:
                yield span
    for m in LOGIN.finditer(line):
        span = _value(m.start("val"), m["val"], False)
        if span:
            yield span
    for m in HOOK.finditer(line):
        yield m.span("val")
    for m in CALL.finditer(line):
        args = list(_ARG.finditer(m["args"]))
        if len(args) > 1:
            span = _value(m.start("args") + args[-1].start(1), args[-1][1], False)
            if span:
                yield span


def _small(text: str) -> str:
    """``text`` in small letters, at the same length."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate({c: c + 32 for c in range(65, 91)})


def hinted_lines(view: str) -> list[tuple[int, int]]:
    """(begin, end) of the lines that hold a hint, in order."""
    low = _small(view)
    starts: dict[int, int] = {}
    for hint in HINTS:
        at = low.find(hint)
        while at >= 0:
            if hint == "token" and low.startswith(_NO_TOKEN, at + 5) or hint == "@" and (at == 0 or low[at - 1].isspace()):
                at = low.find(hint, at + 1)
                continue
            begin = low.rfind("\n", 0, at) + 1
            if begin not in starts:
                end = low.find("\n", at)
                starts[begin] = len(low) if end < 0 else end
            at = low.find(hint, starts[begin])
    return sorted(starts.items())


def _key_spans(view: str, begin: int, end: int) -> list[tuple[int, int]]:
    """The whole body of a private key between its marks, if there is one; of a text about keys only what looks like one."""
    body = [m.span() for m in KEY_BODY.finditer(view, begin, end)]
    if not body or 2 * sum(b - a for a, b in body) < len("".join(view[begin:end].split())):
        return body
    return [m.span() for m in _KEY_PARTS.finditer(view, begin, end)]


_KEY_PARTS = re.compile(r"[A-Za-z0-9+/=]+")


def secret_spans(text: str) -> list[tuple[int, int, int]]:
    """(offset of the line's mark, start, end) of every secret in ``text``, sorted; overlapping ones are merged.

    For a private key the mark is its BEGIN, and the spans are those of its body.
    """
    view = readable(text)
    nested = "\\" in text and text.lstrip()[:1] in ("{", "[", '"') and text.lstrip()[:1] != ""
    spans: list[tuple[int, int, int]] = []
    at = 0
    for begin, end in hinted_lines(view):
        if end <= at and begin < at:
            continue
        base = max(begin, at)
        line = view[base:end]
        key = KEY_BEGIN.search(line) if "PRIVATE KEY" in line else None
        stop = base + key.start() if key else end
        spans += [(base + a, base + a, base + b) for a, b in _line_spans(view[base:stop])]
        reach = stop
        if not key and _OPEN_END.search(line):
            for _ in range(3):  # a value may begin on one of the next lines
                following = view.find("\n", reach + 1)
                reach = len(view) if following < 0 else following
        spans += [(a, a, b) for a, b in _pair_spans(text, view, base, reach, nested) if a < b]
        if key:
            mark = base + key.start()
            close = KEY_END.search(view, base + key.end())
            stop = close.start() if close else end
            body = [(mark, a, b) for a, b in _key_spans(view, base + key.end(), stop)]
            if not close:  # no end: the body goes on while lines look like one
                stop = base + key.end()
                while m := _FOLLOWING.match(view, stop):
                    body += [(mark, x.start(), x.end()) for x in KEY_BODY.finditer(view, m.start(), m.end())]
                    stop = m.end()
            spans += body
            at = max(stop, base + key.end())
    merged: list[list[int]] = []
    for mark, a, b in sorted(set(spans), key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([mark, a, b])
    return [tuple(m) for m in merged]


_FOLLOWING = re.compile(r"\s*(?:[^\w\s+/=]{0,3}\s*)?[A-Za-z0-9+/]{16,}={0,2}\s*")


def secret_lines(text: str, spans: list[tuple[int, int, int]]) -> list[int]:
    """Numbers, from 1, of the lines of ``text`` that hold the marks of ``spans``."""
    if not spans:
        return []
    ends, i = [], text.find("\n")
    last = max(m for m, _, _ in spans)
    while 0 <= i < last:
        ends.append(i)
        i = text.find("\n", i + 1)
    return sorted({bisect_right(ends, m) + 1 for m, _, _ in spans})


def redact(text: str, spans: list[tuple[int, int, int]], mask: str = MASK) -> str:
    """``text`` with the content of every span replaced; what stands around it, escapes and line ends stay."""
    out, at = [], 0
    for _, a, b in spans:
        out += (text[at:a], mask)
        at = b
    return "".join((*out, text[at:]))


SCHEMA = "origin STRING, record_key STRING, pos INT, lines ARRAY<INT>, secrets INT, redacted BINARY"


def scan_texts(texts: DataFrame, keep_text: bool = True) -> DataFrame:
    """One row for each text (origin, record_key, pos, content BINARY) with a secret: lines, secrets, redacted bytes (equal to
    those stored but for the masks, in whatever encoding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits, lines, n, redacted = [], [], [], []
            for i, content in enumerate(b.column(3)):
                text = content.as_buffer().to_pybytes().decode("utf-8", "surrogateescape") if content.is_valid else ""
                spans = secret_spans(text) if text else []
                if spans:
                    hits.append(i)
                    lines.append(secret_lines(text, spans))
                    n.append(len(spans))
                    redacted.append(redact(text, spans).encode("utf-8", "surrogateescape") if keep_text else None)
            if hits:
                at = pa.array(hits)
                cols = [*(b.column(c).take(at) for c in range(3)), pa.array(lines, pa.list_(pa.int32())), pa.array(n, pa.int32()), pa.array(redacted, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["origin", "record_key", "pos", "lines", "secrets", "redacted"])

    return texts.select("origin", "record_key", F.col("pos").cast("int").alias("pos"), F.col("content").cast("binary").alias("content")).mapInArrow(run, SCHEMA)


def all_texts(files: DataFrame, trajectories: DataFrame, sources: DataFrame) -> DataFrame:
    """(origin, record_key, pos, content) of all file contents, message contents and checkout paths."""
    f = files.select(F.lit("file").alias("origin"), F.concat("source_id", F.lit(":"), "path").alias("record_key"), F.lit(-1).alias("pos"), F.col("content").cast("binary").alias("content"))
    messages = trajectories.select("traj_id", F.posexplode("messages").alias("pos", "m"))
    t = messages.select(F.lit("trajectory").alias("origin"), F.col("traj_id").cast("string").alias("record_key"), "pos", F.col("m.content").cast("binary").alias("content"))
    s = sources.select(F.lit("source").alias("origin"), F.col("source_id").alias("record_key"), F.lit(-1).alias("pos"), F.col("path").cast("binary").alias("content"))
    return f.union(t).union(s).where("record_key IS NOT NULL AND content IS NOT NULL")
