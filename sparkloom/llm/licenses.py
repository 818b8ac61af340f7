"""Problem 4: the license of each code file and repository.

Method: standard identifier tags, boolean expressions and plain statements are parsed in headers, manifests and license
files; a file without a statement of its own inherits from the nearest license file above it, else from its repository;
contradictions and unknowns are flagged.

``parse_expression`` reads AND, OR, WITH and brackets into a tree, whose operands are names in any spelling or identifiers
of the standard's shape, known here or not. ``stated_licenses`` finds what a file states for itself: after a tag
(``SPDX-License-Identifier:``, where any word counts, ``@license``, ``License:``), a key of a package manifest (JSON, TOML, XML,
setup files, gem specifications), or a sentence that speaks of the file ("this file is released under", "licensed as", "you
may share this file under"). Names in lists, data and other sentences are no statement. A license file counts as a whole, by
the bodies of licenses in it or, if there are none, by the names.

Defined results: null or undecodable contents state nothing (undecodable bytes are replaced); stand-ins such as NONE name no
license; repeated rows count once; a file whose source is not listed belongs to a repository without license; null ids and paths
are left out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16
#: Up to so many sources the repository table is sent to the executors; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 200_000

# Families of licenses whose identifier is a prefix and a version: abbreviation (needs a version beside it),
# full names, version where a full name has none (or None: then it is no match).
VERSIONED = {
    "Apache": (r"apache", r"apache(?: software)? license", "2.0"),
    "MPL": (r"mpl", r"mozilla public license", "2.0"),
    "EPL": (r"epl", r"eclipse public license", "2.0"),
    "EUPL": (r"eupl", r"european union public license", "1.2"),
    "CDDL": (r"cddl", r"common development and distribution license", "1.0"),
    "CPL": (r"cpl", r"common public license", "1.0"),
    "OFL": (r"ofl", r"(?:sil )?open font license", "1.1"),
    "BSL": (r"bsl|boost", r"boost software license|boost license", "1.0"),
    "BUSL": (r"busl", r"business source license", "1.1"),
    "SSPL": (r"sspl", r"server side public license", "1"),
    "Artistic": (r"artistic", r"artistic license", "2.0"),
    "AFL": (r"afl", r"academic free license", "3.0"),
    "OSL": (r"osl", r"open software license", "3.0"),
    "UPL": (r"upl", r"universal permissive license", "1.0"),
    "ECL": (r"ecl", r"educational community license", "2.0"),
    "LPPL": (r"lppl", r"latex project public license", "1.3c"),
    "ZPL": (r"zpl", r"zope public license", "2.1"),
    "CECILL": (r"cecill", r"cecill license", "2.1"),
    "PSF": (r"psf", r"python software foundation license", "2.0"),
}
# Licenses without a version, as they are spelled. Punctuation is a space by then, and licence is license.
UNVERSIONED = {
    "Apache-2.0": r"(?:asl|al2?)(?: software)?(?: (?:license|foundation))?(?: version)? ?v? ?2(?:\.0)?|apache foundation(?: version)? ?v? ?2(?:\.0)?",
    "MIT-0": r"mit (?:0|no attribution)",
    "MIT": r"mit license|mit|expat license",
    "0BSD": r"0bsd|bsd 0(?: clause)?|(?:0|zero) clause bsd",
    "BSD-1-Clause": r"bsd (?:license )?1(?: clause)?|(?:1|one) clause bsd",
    "BSD-2-Clause": r"bsd (?:license )?2(?: clause)?|(?:2|two) clause bsd|simplified bsd|freebsd license",
    "BSD-3-Clause": r"bsd (?:license )?3(?: clause)?|(?:3|three) clause bsd|(?:new|modified|revised) bsd",
    "BSD-4-Clause": r"bsd (?:license )?4(?: clause)?|(?:4|four) clause bsd|original bsd",
    "ISC": r"isc license|isc",
    "CC0-1.0": r"cc0(?: 1\.0)?|creative commons zero",
    "Unlicense": r"(?:the )?unlicense",
    "Zlib": r"zlib license",
    "WTFPL": r"wtfpl",
    "NCSA": r"ncsa license|university of illinois ncsa open source license",
    "PostgreSQL": r"postgresql license",
    "X11": r"x11 license",
    "MS-PL": r"ms pl|microsoft public license",
    "MS-RL": r"ms rl|microsoft reciprocal license",
}
# Identifiers that are ordinary words, so they count only where an identifier is expected.
WORDS = ("Zlib", "X11", "NCSA", "PostgreSQL", "Ruby", "Vim", "curl", "JSON", "Libpng", "NTP", "OpenSSL", "Beerware", "W3C", "ICU", "TCL", "Unicode-TOU", "Info-ZIP", "libtiff", "xpp", "Sleepycat")
#: What stands where a license is not known.
STAND_INS = {"none", "noassertion", "unknown", "unlicensed", "n/a", "na", "other", "custom", "tbd", "todo", "null", "undefined", "proprietary", "see-license", "-", "?"}

_VERSION = r"(?:[ ,]*(?:version|ver|v))? ?v?"
_GNU = r"(?:gnu )?(?P<gnu>agpl|affero (?:general public license|gpl)|lgpl|(?:lesser|library) (?:general public license|gpl)|gpl|general public license)" + _VERSION + r"(?P<gnu_v>\d(?:\.\d)?)"
_CC = r"(?:cc|creative commons) (?P<cc>by(?: nc)?(?: sa| nd)?)(?: (?P<cc_v>\d\.\d))"
_FAMILY = [(n, f"(?P<L{i}>(?:{x[1]}|{x[0]}){_VERSION}(?P<V{i}>\\d+(?:\\.\\d+)*[a-z]?)|{x[1]})") for i, (n, x) in enumerate(VERSIONED.items())]
_PLAIN = [(n, f"(?P<P{i}>{x})") for i, (n, x) in enumerate(UNVERSIONED.items())]
_NAMES = re.compile(r"\b(?:" + "|".join((_GNU, _CC, *(x for _, x in _FAMILY), *(x for _, x in _PLAIN))) + r")(?![a-z0-9])")
#: Words that are no license unless they are written like one.
_UPPER = {"MIT": re.compile(r"\bMIT\b|\bmit[\s-]+licen[cs]e|\bexpat\b", re.I), "ISC": re.compile(r"\bISC\b|\bisc[\s-]+licen[cs]e", re.I)}
_EXACT = {"MIT": re.compile(r"\bMIT\b|\b[Mm]it[\s-]+[Ll]icen[cs]e|\b[Ee]xpat\b"), "ISC": re.compile(r"\bISC\b|\b[Ii]sc[\s-]+[Ll]icen[cs]e")}
_PUNCTUATION = re.compile(r"[^a-z0-9.+]+|\.(?!\d)")
_LATER = re.compile(r"^ ?(?:\+| (?:or )?(?:any )?(?:later|newer))")

# What only the body of a license says, flattened as above.
BODIES = {
    "MIT": r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "BSL-1.0": r"permission is hereby granted free of charge to any person or organization obtaining a copy",
    "ISC": r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that",
    "0BSD": r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?! provided)",
    "Apache-2.0": r"apache license version 2\.0 january 2004",
    "MPL-2.0": r"mozilla public license version 2\.0 (?:=+ )?1(?:\.| )",
    "GPL-3.0-only": r"(?<!affero )(?<!lesser )general public license version 3 29 june 2007",
    "GPL-2.0-only": r"(?<!affero )(?<!lesser )(?<!library )general public license version 2 june 1991",
    "LGPL-2.0-only": r"library general public license version 2 june 1991",
    "LGPL-2.1-only": r"lesser general public license version 2\.1 february 1999",
    "LGPL-3.0-only": r"lesser general public license version 3 29 june 2007",
    "AGPL-3.0-only": r"affero general public license version 3 19 november 2007",
    "Unlicense": r"this is free and unencumbered software released into the public domain",
    "Zlib": r"in no event will the authors be held liable for any damages arising from the use of this software",
    "CC0-1.0": r"cc0 1\.0 universal (?:creative commons|statement of purpose)",
    "EPL-2.0": r"eclipse public license v ?2\.0 the accompanying program",
}
_BSD_BODY = "redistribution and use in source and binary forms with or without modification are permitted"
_BODIES = {n: re.compile(p) for n, p in BODIES.items()}
_BODY_HINT = re.compile(r"permission (?:is hereby|to use)|redistribution and use|(?:january|february|june|november) \d{4}|unencumbered|held liable|universal|accompanying program|public license version 2\.0")

LICENSE_FILE = re.compile(r"(?i)^(?:.*[._-])?(?:un)?(?:licen[cs]es?|copying|notice)(?:[._-].*)?$")
_LINE = r"(?:^[ \t]*(?:(?:\#|//|/\*+|\*+|--|;+|<!--|%|'''|\"\"\"|rem\b|dnl\b|!)[ \t]*)*)"
_SELF = r"this (?:file|work|software|program|project|code|module|package|library|source|repository) (?:is|was|may be) (?:\w+ )?"
_CUE = re.compile(
    rf"(?P<tag>{_LINE}(?:(?P<spdx>spdx-license-identifier[ \t]*:)|@licen[cs]e\b[ \t]*:?|(?P<plain>licen[cs]e[ \t]*:)))"
    rf"|(?P<key>^(?P<indent>[ \t]*)(?:[\"']licen[cs]es?[\"'][ \t]*:|licen[cs]e[ \t]*=|__licen[cs]e__[ \t]*=))"
    rf"|(?P<prose>(?:{_LINE}|\b{_SELF})(?:(?:dual[- ])?licen[cs]ed (?:as|under)|(?:released|distributed|available|published|offered) under)\b|\bshare this file under\b|{_LINE}your choice[ \t]*:)",
    re.I | re.M,
)
_HINT = re.compile(r"licen[cs]e|under the |your choice", re.I)
_COMMENT = re.compile(r"\n[ \t]*(?:#+|//+|/\*+|\*+/?|--|;+|%+)?[ \t]*")
_CLOSERS = re.compile(r"[ \t]*(?:\*+/|-->|\"\"\"|'''|#\}|\*\)|\]\]|%>)?[ \t]*[\"',;]*[ \t]*$")


def _flat(text: str) -> str:
    return _PUNCTUATION.sub(" ", text.lower()).replace("licence", "license")


def _identifier(m: re.Match, flat: str) -> str:
    """Identifier of one match of ``_NAMES`` in ``flat``."""
    if m["gnu"]:
        kind = "AGPL" if m["gnu"][0] == "a" else "LGPL" if m["gnu"][0] == "l" else "GPL"
        version = m["gnu_v"] if "." in m["gnu_v"] else m["gnu_v"] + ".0"
        return f"{kind}-{version}-{'or-later' if _LATER.match(flat[m.end() : m.end() + 20]) else 'only'}"
    if m["cc"]:
        return f"CC-{m['cc'].upper().replace(' ', '-')}-{m['cc_v']}"
    group = next(g for g, v in m.groupdict().items() if v is not None and g[0] in "LP")
    if group[0] == "P":
        return _PLAIN[int(group[1:])][0]
    name, _ = _FAMILY[int(group[1:])]
    version = m[f"V{group[1:]}"] or VERSIONED[name][2]
    return f"{name}-{version if '.' in version or VERSIONED[name][2].isdigit() else version + '.0'}"


def named_licenses(text: str | None, exact: bool = False) -> set[str]:
    """Identifiers of the licenses that ``text`` names, on either side of any operator. ``exact``: words that are also
    ordinary words (mit) count only where written as a name, for running text."""
    if not text:
        return set()
    flat = _flat(text)
    found = set()
    for m in _NAMES.finditer(flat):
        name = _identifier(m, flat)
        if name in _UPPER and not (_EXACT if exact else _UPPER)[name].search(text):
            continue
        found.add(name)
    return found


def body_licenses(text: str) -> set[str]:
    """Identifiers of the licenses whose body ``text`` holds. Bodies mention other licenses, which do not count then."""
    flat = re.sub(r" +", " ", _flat(text))
    if not _BODY_HINT.search(flat):
        return set()
    found = {n for n, p in _BODIES.items() if p.search(flat)}
    if _BSD_BODY in flat:
        found.add("BSD-4-Clause" if "all advertising materials mentioning" in flat else "BSD-3-Clause" if "neither the name" in flat else "BSD-2-Clause")
    return found


def license_text(text: str) -> set[str]:
    """Licenses of a license file: those of its bodies, else those it names."""
    return body_licenses(text) or named_licenses(text, exact=True)


# --- expressions -----------------------------------------------------------------------------------------------------

_LATER_WORDS = re.compile(r"(?i)[,;]?\s+or\s+(?:\(?at your option\)?\s+)?(?:any\s+)?(?:later|newer)(?:\s+versions?)?\b")
_TOKENS = re.compile(r"\s*([()]|[^\s()]+)")
_OPERATORS = {"and": "and", "&": "and", "&&": "and", "or": "or", "|": "or", "||": "or", "/": "or", "with": "with"}
_ID_SHAPE = re.compile(r"(?:[A-Za-z][A-Za-z0-9]*(?:[-.][A-Za-z0-9]+)*-v?\d[\w.+-]*|(?:DocumentRef-[\w.-]+:)?LicenseRef-[\w.-]+)$")
_ONE_WORD = re.compile(r"[A-Za-z0-9][\w.+:-]*$")
_KNOWN_WORDS = {w.lower(): w for w in WORDS}


def operand_licenses(text: str, any_word: bool = False) -> frozenset[str]:
    """Licenses that one operand of an expression names: a known name in any spelling, a word that has the shape of an
    identifier as it stands, or, with ``any_word``, any single word that is no stand-in."""
    text = text.strip(" \t,;\"'`")
    if text.lower() in STAND_INS:
        return frozenset()
    found = named_licenses(text)
    if not found and text.lower() in _KNOWN_WORDS:
        found = {_KNOWN_WORDS[text.lower()]}
    if not found and (_ID_SHAPE.match(text) or (any_word and _ONE_WORD.match(text))):
        found = {text}
    return frozenset(found)


def parse_expression(text: str, any_word: bool = False) -> tuple | None:
    """Tree of a license expression, None where ``text`` is none: ``("id", licenses)``, ``("with", tree, exception)``,
    ``("and", trees)`` or ``("or", trees)``. WITH binds closest, then AND, then OR; operators may be spelled in any case."""
    words = _TOKENS.findall(_LATER_WORDS.sub("+", text))
    if not any(w not in "()" for w in words):
        return None
    at = 0

    def peek() -> str | None:
        if at >= len(words):
            return None
        return _OPERATORS.get(words[at].lower(), words[at] if words[at] in "()" else "word")

    def primary() -> tuple | None:
        nonlocal at
        if peek() == "(":
            at += 1
            inner = chain("or")
            if inner is None or peek() != ")":
                return None
            at += 1
            return inner
        begin = at
        while peek() == "word":
            at += 1
        if at == begin:
            return None
        operand = " ".join(words[begin:at])
        if "/" in operand and len(parts := operand.split("/")) > 1 and all(operand_licenses(p) for p in parts):
            return ("or", tuple(("id", operand_licenses(p)) for p in parts))
        return ("id", operand_licenses(operand, any_word))

    def excepted() -> tuple | None:
        nonlocal at
        tree = primary()
        if tree is not None and peek() == "with":
            at += 1
            begin = at
            while peek() == "word":
                at += 1
            return ("with", tree, " ".join(words[begin:at])) if at > begin else None
        return tree

    def chain(kind: str) -> tuple | None:
        nonlocal at
        below = (lambda: chain("and")) if kind == "or" else excepted
        trees = [below()]
        while trees[-1] is not None and peek() == kind:
            at += 1
            trees.append(below())
        return None if trees[-1] is None else trees[0] if len(trees) == 1 else (kind, tuple(trees))

    try:
        tree = chain("or")
    except RecursionError:
        return None
    return tree if tree is not None and at == len(words) else None


def tree_licenses(tree: tuple | None) -> set[str]:
    """All licenses of an expression, on whatever side of an operator."""
    if tree is None:
        return set()
    if tree[0] == "id":
        return set(tree[1])
    return tree_licenses(tree[1]) if tree[0] == "with" else set().union(*map(tree_licenses, tree[1]))


def render(tree: tuple | None) -> str:
    """An expression with identifiers in their standard form, operators in capitals and no needless brackets."""
    if tree is None:
        return ""
    if tree[0] == "id":
        return " AND ".join(sorted(tree[1])) if len(tree[1]) < 2 else f"({' AND '.join(sorted(tree[1]))})"
    if tree[0] == "with":
        return f"{render(tree[1])} WITH {tree[2]}"
    parts = [render(t) for t in tree[1]]
    parts = [f"({p})" if tree[0] == "and" and t[0] == "or" else p for t, p in zip(tree[1], parts) if p]
    return f" {tree[0].upper()} ".join(parts)


def expression_licenses(text: str | None, any_word: bool = False) -> set[str]:
    """Licenses of an expression; of text that is no expression, those it names."""
    if not text:
        return set()
    tree = parse_expression(text, any_word)
    return tree_licenses(tree) if tree is not None else named_licenses(text)


def expression_form(text: str | None) -> str | None:
    """Standard form of an expression, null where nothing is named."""
    tree = parse_expression(text) if text else None
    if tree is not None:
        return render(tree) or None
    return " AND ".join(sorted(named_licenses(text))) or None


# --- statements ------------------------------------------------------------------------------------------------------

_XML_LICENSE = re.compile(r"<licen[cs]es?>\s*(?:<licen[cs]e>)?(.*?)</licen[cs]es?>|<licen[cs]e\b[^>]*>([^<]*)</licen[cs]e>", re.I | re.S)
_XML_NAME = re.compile(r"<name>([^<]*)</name>", re.I)
_XML_NESTED = re.compile(r"<(dependenc(?:y|ies)|plugins?|parent|build|profiles?)>.*?</\1>", re.I | re.S)
_CLASSIFIER = re.compile(r"License\s*::\s*(?:OSI Approved\s*::\s*)?([^\"'\n,]+)")
_SETUP_KEY = re.compile(r"^[ \t]*licen[cs]e[ \t]*=[ \t]*[rub]?([\"'])(.*?)\1", re.M)
_GEM_KEY = re.compile(r"^[ \t]*\w+\.licenses?[ \t]*=[ \t]*(.*)$", re.M)
_TOML_SECTION = re.compile(r"^[ \t]*\[+[ \t]*([^\]\n]+?)[ \t]*\]+", re.M)
_TOML_KEY = re.compile(r"^licen[cs]e[ \t]*=[ \t]*(?:\{[^}\n]*?text[ \t]*=[ \t]*)?([\"'])(.*?)\1", re.M)


def manifest_licenses(name: str, text: str) -> set[str] | None:
    """Licenses that a package manifest states for its package, None for files that are no manifest."""
    if name == "pom.xml" or name.endswith(".nuspec"):
        own = _XML_NESTED.sub("", text)
        found: set[str] = set()
        for m in _XML_LICENSE.finditer(own):
            inner = m[1] if m[1] is not None else m[2]
            for part in _XML_NAME.findall(inner) or [re.sub(r"<[^>]*>", " ", inner)]:
                found |= expression_licenses(part)
        return found
    if name in ("setup.py", "setup.cfg"):
        found = set().union(*(expression_licenses(m[2]) for m in _SETUP_KEY.finditer(text)), *(named_licenses(m[1]) for m in _CLASSIFIER.finditer(text)))
        if name == "setup.cfg":
            found |= set().union(*(expression_licenses(m[1]) for m in re.finditer(r"^licen[cs]e[ \t]*=[ \t]*([^\n\"']+)$", text, re.M)))
        return found
    if name.endswith(".gemspec"):
        return set().union(*(expression_licenses(x) for m in _GEM_KEY.finditer(text) for x in re.findall(r"[\"']([^\"']*)[\"']", m[1])))
    if name in ("pyproject.toml", "cargo.toml"):
        found, marks = set(), [(m.start(), m[1]) for m in _TOML_SECTION.finditer(text)]
        for m in _TOML_KEY.finditer(text):
            section = next((s for at, s in reversed(marks) if at < m.start()), "")
            if section in ("", "project", "package", "workspace.package", "tool.poetry"):
                found |= expression_licenses(m[2])
        if name == "pyproject.toml":
            found |= set().union(*(named_licenses(m[1]) for m in _CLASSIFIER.finditer(text)))
        return found
    return None


def _strings(value) -> Iterator[str]:
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        yield from _strings(value.get("type") or value.get("name"))
    elif isinstance(value, list):
        for x in value:
            yield from _strings(x)


def stated_licenses(path: str, text: str) -> set[str]:
    """Identifiers of the licenses that the file states for itself."""
    name = path.rsplit("/", 1)[-1].lower()
    if LICENSE_FILE.match(name):
        return license_text(text)
    if not _HINT.search(text):
        return set()
    is_json, is_yaml = name.endswith(".json"), name.endswith((".yaml", ".yml"))
    manifest = manifest_licenses(name, text)
    found: set[str] = set(manifest or ())
    if is_json:
        try:
            top = json.loads(text)
            if isinstance(top, dict):
                return set().union(*(expression_licenses(s) for k in top if k.lower() in ("license", "licence", "licenses") for s in _strings(top[k])))
        except (ValueError, RecursionError):
            pass
    for m in _CUE.finditer(text):
        end = text.find("\n", m.end())
        end = len(text) if end < 0 else end
        if m["tag"]:
            if m["plain"] and is_yaml and m[0][0] in " \t-" and "#" not in m[0]:
                continue  # a key of nested data
            line = text[m.end() : end]
            found |= expression_licenses(_CLOSERS.sub("", line), bool(m["spdx"]))
        elif m["key"]:
            if (manifest is None or "__" in m[0]) and len(m["indent"]) <= (4 if is_json else 0):
                found |= expression_licenses(text[m.end() : end].strip(" \t,;\"'"))
        else:
            for _ in range(2):  # sentences run on over at most two more lines
                following = text.find("\n", end + 1)
                end = len(text) if following < 0 else following
                if end == len(text):
                    break
            sentence = _COMMENT.sub(" ", text[m.end() : end])
            stop = re.search(r"\.(?=\s|$)|\bsee the\b", sentence)
            found |= named_licenses(sentence[: stop.start()] if stop else sentence)
    return found


def file_statements(files: DataFrame) -> DataFrame:
    """One row for each (source_id, path): is_regular, is_license_file, stated and, for license files, named (sorted arrays
    of identifiers).

    Contents are read once and stay in their tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.string())
        for b in batches:
            stated, named, license_file = [], [], []
            for path, content in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                text = (content or b"").decode("utf-8", "replace").replace("\r\n", "\n")
                own = bool(LICENSE_FILE.match(path.rsplit("/", 1)[-1].lower()))
                stated.append(sorted(stated_licenses(path, text)))
                named.append(stated[-1] if own else [])
                license_file.append(own)
            cols = [b.column(0), b.column(1), b.column(3), pa.array(license_file, pa.bool_()), pa.array(stated, kind), pa.array(named, kind)]
            yield pa.RecordBatch.from_arrays(cols, ["source_id", "path", "is_regular", "is_license_file", "stated", "named"])

    src = files.select("source_id", "path", F.col("content").cast("binary").alias("content"), F.coalesce("is_regular", F.lit(False)).alias("is_regular")).where("source_id IS NOT NULL AND path IS NOT NULL")
    rows = src.mapInArrow(run, "source_id STRING, path STRING, is_regular BOOLEAN, is_license_file BOOLEAN, stated ARRAY<STRING>, named ARRAY<STRING>")
    best = F.struct("is_regular", "stated", "named", "is_license_file")
    return rows.groupBy("source_id", "path").agg(F.max(best).alias("r")).select("source_id", "path", "r.*")


def texts_named_elsewhere(files: DataFrame, sources: DataFrame) -> DataFrame | None:
    """(source_id, license_file, named) of license files that are not called like one; None if there are none."""
    odd = sources.select("source_id", F.col("license_file").alias("path")).where(F.regexp_replace("path", "^.*/", "").rlike(LICENSE_FILE.pattern) == F.lit(False)).where("source_id IS NOT NULL").distinct()
    n = odd.count()
    if not n:
        return None

    @F.pandas_udf("array<string>")
    def names(content):
        return content.map(lambda c: sorted(license_text((c or b"").decode("utf-8", "replace"))))

    found = files.select("source_id", "path", "content").join(F.broadcast(odd) if n <= BROADCAST_SOURCES else odd, ["source_id", "path"])
    return found.select("source_id", F.col("path").alias("license_file"), names("content").alias("named")).groupBy("source_id", "license_file").agg(F.max("named").alias("named"))


def repository_licenses(sources: DataFrame, statements: DataFrame, elsewhere: DataFrame | None = None) -> DataFrame:
    """One row for each source: authorized, declared (by license_spdx), expression (its standard form), in_file (by its license
    file), licenses, verdict.

    verdict: known, conflict (both name licenses and have none in common) or unknown (neither names one).
    """

    @F.pandas_udf("array<string>")
    def names(spdx):
        return spdx.map(lambda s: sorted(expression_licenses(s)))

    @F.pandas_udf("string")
    def standard(spdx):
        return spdx.map(expression_form)

    one = sources.where("source_id IS NOT NULL").groupBy("source_id").agg(F.max_by(F.struct("license_spdx", "license_file", "authorized"), F.struct("listed_at", "license_spdx", "license_file")).alias("r")).select("source_id", "r.*")
    text = statements.where("is_license_file").select("source_id", F.col("path").alias("license_file"), F.col("named").alias("in_file"))
    if elsewhere is not None:
        text = text.union(elsewhere.select("source_id", "license_file", "named"))
    none = F.array().cast("array<string>")
    both = one.join(text, ["source_id", "license_file"], "left").select("source_id", F.coalesce("authorized", F.lit(False)).alias("authorized"), names("license_spdx").alias("declared"), standard("license_spdx").alias("expression"), F.coalesce("in_file", none).alias("in_file"))
    verdict = (
        F.when((F.size("declared") == 0) & (F.size("in_file") == 0), "unknown")
        .when((F.size("declared") > 0) & (F.size("in_file") > 0) & ~F.arrays_overlap("declared", "in_file"), "conflict")
        .otherwise("known")
    )
    return both.select("source_id", "authorized", "declared", "expression", "in_file", F.array_sort(F.array_union("declared", "in_file")).alias("licenses"), verdict.alias("verdict"))


def _with_repository(files: DataFrame, repositories: DataFrame) -> DataFrame:
    repo = repositories.select("source_id", F.col("licenses").alias("repository_licenses"), "authorized")
    if repo.count() <= BROADCAST_SOURCES:
        return files.join(F.broadcast(repo), "source_id", "left")
    salted = repo.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return files.withColumn("_salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")).join(salted, ["source_id", "_salt"], "left").drop("_salt")


def file_verdicts(statements: DataFrame, repositories: DataFrame) -> DataFrame:
    """One row for each regular file: stated, repository_licenses, authorized, verdict (known, conflict or unknown)."""
    rows = _with_repository(statements.where("is_regular").select("source_id", "path", "stated"), repositories)
    theirs = F.coalesce("repository_licenses", F.array().cast("array<string>"))
    verdict = (
        F.when((F.size("stated") == 0) & (F.size(theirs) == 0), "unknown")
        .when((F.size("stated") > 0) & (F.size(theirs) > 0) & ~F.arrays_overlap("stated", theirs), "conflict")
        .otherwise("known")
    )
    return rows.select("source_id", "path", "stated", theirs.alias("repository_licenses"), F.coalesce("authorized", F.lit(False)).alias("authorized"), verdict.alias("verdict"))


def effective_licenses(statements: DataFrame, repositories: DataFrame) -> DataFrame:
    """One row for each regular file: licenses, origin (own, the nearest license file above it, repository or none), from_path,
    verdict (of ``file_verdicts``: its own statement against its repository) and nearest_verdict (known, conflict or unknown
    of the licenses that apply, so also for files that inherit from a license file that contradicts their repository).

    Files without a statement are joined with the license files of their own and higher directories, by directory. Both
    sides are salted, as one repository may hold a third of all files.
    """
    verdicts = file_verdicts(statements, repositories)
    above = F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))
    silent = verdicts.where("size(stated) = 0").select("source_id", "path", F.explode(above).alias("dir"), F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int").alias("_salt"))
    holders = statements.where("is_license_file AND is_regular AND size(named) > 0").select("source_id", F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"), F.col("path").alias("from_path"), "named")
    one = holders.groupBy("source_id", "dir").agg(F.min_by(F.struct("from_path", "named"), "from_path").alias("h")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    nearest = silent.join(one, ["source_id", "dir", "_salt"]).groupBy("source_id", "path").agg(F.max_by("h", F.length("dir")).alias("h"))
    rows = verdicts.join(nearest, ["source_id", "path"], "left")
    origin = F.when(F.size("stated") > 0, "own").when(F.col("h").isNotNull(), "ancestor").when(F.size("repository_licenses") > 0, "repository").otherwise("none")
    licenses = F.when(F.size("stated") > 0, F.col("stated")).when(F.col("h").isNotNull(), F.col("h.named")).otherwise(F.col("repository_licenses"))
    nearest_verdict = F.when(F.size("licenses") == 0, "unknown").when((F.size("repository_licenses") > 0) & ~F.arrays_overlap("licenses", "repository_licenses"), "conflict").otherwise("known")
    out = rows.select("source_id", "path", licenses.alias("licenses"), origin.alias("origin"), F.when(F.size("stated") == 0, F.col("h.from_path")).alias("from_path"), "verdict", "authorized", "repository_licenses")
    return out.withColumn("nearest_verdict", nearest_verdict).drop("repository_licenses")
