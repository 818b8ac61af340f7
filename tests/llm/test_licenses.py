import pytest

from sparkloom.llm import licenses as L

NAMES = {
    "MIT": {"MIT"}, "the mit licence": {"MIT"}, "MIT License (MIT)": {"MIT"}, "Apache 2": {"Apache-2.0"}, "Apache License, Version 2.0": {"Apache-2.0"}, "ASL 2.0": {"Apache-2.0"}, "apache-2.0": {"Apache-2.0"},
    "New BSD License": {"BSD-3-Clause"}, "BSD 3-Clause": {"BSD-3-Clause"}, "three-clause BSD license": {"BSD-3-Clause"}, "Simplified BSD License": {"BSD-2-Clause"}, "2-clause bsd": {"BSD-2-Clause"}, "BSD-2": {"BSD-2-Clause"},
    "ISC licence": {"ISC"}, "Mozilla Public License 2.0": {"MPL-2.0"}, "MPL 2.0": {"MPL-2.0"}, "GPLv3 only": {"GPL-3.0-only"}, "GNU General Public License, version 3 only": {"GPL-3.0-only"},
    "LGPL 2.1 only": {"LGPL-2.1-only"}, "GNU Lesser General Public License, version 2.1 only": {"LGPL-2.1-only"}, "(MIT OR Apache-2.0)": {"MIT", "Apache-2.0"}, "GPL-3.0-or-later": {"GPL-3.0-or-later"},
    "NONE": set(), "NOASSERTION": set(), "see license file": set(), "": set(), None: set(), "submit commit": set(),
}


def test_names():
    for text, want in NAMES.items():
        assert L.named_licenses(text) == want, text
    assert L.named_licenses("Wir gehen mit dem Hund; GPL is discussed", exact=True) == set()


EXPRESSIONS = {
    "AGPL-3.0-only": ({"AGPL-3.0-only"}, "AGPL-3.0-only"), "GPL-2.0-only": ({"GPL-2.0-only"}, "GPL-2.0-only"), "EUPL-1.2": ({"EUPL-1.2"}, "EUPL-1.2"), "BSL-1.0": ({"BSL-1.0"}, "BSL-1.0"), "Unlicense": ({"Unlicense"}, "Unlicense"),
    "LGPL-3.0-or-later": ({"LGPL-3.0-or-later"}, "LGPL-3.0-or-later"), "GNU Affero General Public License v3.0": ({"AGPL-3.0-only"}, "AGPL-3.0-only"), "GPLv2 or later": ({"GPL-2.0-or-later"}, "GPL-2.0-or-later"),
    "(MIT AND GPL-2.0-only) OR CC0-1.0": ({"MIT", "GPL-2.0-only", "CC0-1.0"}, "MIT AND GPL-2.0-only OR CC0-1.0"), "bsd-3-clause and (mit or isc)": ({"BSD-3-Clause", "MIT", "ISC"}, "BSD-3-Clause AND (MIT OR ISC)"),
    "GPL-2.0+ WITH Classpath-exception-2.0": ({"GPL-2.0-or-later"}, "GPL-2.0-or-later WITH Classpath-exception-2.0"), "MIT/Apache-2.0": ({"MIT", "Apache-2.0"}, "MIT OR Apache-2.0"), "LicenseRef-own": ({"LicenseRef-own"}, "LicenseRef-own"),
    "Some-New-1.3": ({"Some-New-1.3"}, "Some-New-1.3"), "NONE": (set(), None), "Proprietary": (set(), None), "MIT OR": ({"MIT"}, "MIT"), ")(": (set(), None), "(" * 50_000 + "MIT": ({"MIT"}, "MIT"), "": (set(), None), None: (set(), None),
}


def test_expressions():
    for text, (names, form) in EXPRESSIONS.items():
        assert (L.expression_licenses(text), L.expression_form(text)) == (names, form), str(text)[:50]


POM = "<project><dependencies><license><name>GPL v2</name></license></dependencies><licenses>\n<license>\n<name>The Apache License 2.0</name>\n</license></licenses></project>"
GPL = "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\nUse with the GNU Affero General Public License, version 3, or see the GNU Lesser General Public License version 2.1."
STATED = [
    ("a.c", "/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */", {"GPL-2.0-only"}),
    ("a.c", "// SPDX-License-Identifier: FooBar\n", {"FooBar"}),
    ("pom.xml", POM, {"Apache-2.0"}),
    ("setup.py", "setup(\n    name='x',\n    license='MIT',\n    classifiers=['License :: OSI Approved :: BSD 3-Clause'])", {"MIT", "BSD-3-Clause"}),
    ("setup.cfg", "[metadata]\nlicense = EPL-2.0\n", {"EPL-2.0"}),
    ("x.gemspec", "  s.licenses = ['MIT', 'Ruby']\n", {"MIT", "Ruby"}),
    ("pyproject.toml", "[project]\nlicense = {text = 'MIT'}\n[tool.x]\nlicense = 'ISC'\n", {"MIT"}),
    ("LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the 'Software')", {"MIT"}),
    ("LICENSE", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted ... Neither the name of x", {"BSD-3-Clause"}),
    ("COPYING", GPL, {"GPL-3.0-only"}),
    ("a.py", "#!/usr/bin/env python\n# SPDX-License-Identifier: MIT\n", {"MIT"}),
    ("a.c", "/*\n * spdx-license-identifier:(MIT OR Apache-2.0)\n */\n", {"MIT", "Apache-2.0"}),
    ("a.md", "<!-- SPDX-License-Identifier: ISC -->\n", {"ISC"}),
    ("a.js", "/**\n * @license BSD-3-Clause\n */", {"BSD-3-Clause"}),
    ("a.go", "// Part of x. You may share this file under the Apache\n// License 2.0, see the license file.\n", {"Apache-2.0"}),
    ("a.py", '"""\nPart of x. You may share this file under the GNU General Public License,\nversion 3 only, see the license file.\n"""\n', {"GPL-3.0-only"}),
    ("a.sql", "-- License: Apache Licence v2.0\n", {"Apache-2.0"}),
    ("a.rs", "// Licensed as MIT by the x group, 2011.\n", {"MIT"}),
    ("r.md", "# x\n\n## License\n\nReleased under the New BSD License.\n", {"BSD-3-Clause"}),
    ("r.md", "# x\n\n## License\n\nYour choice: (MIT OR MPL-2.0).\n", {"MIT", "MPL-2.0"}),
    ("p.json", '{\n  "name": "x",\n  "license": "MIT OR ISC",\n  "deps": {"license": "GPL-3.0-only"}\n}', {"MIT", "ISC"}),
    ("p.json", '{\n  "accepted": ["MIT"],\n  "nested": {"license": "MIT"}\n}', set()),
    ("p.toml", 'license = "MPL-2.0"\naccepted = ["MIT"]\n', {"MPL-2.0"}),
    ("p.py", '__license__ = "MIT"\nACCEPTED = ["GPL-3.0-only"]\n', {"MIT"}),
    ("p.py", 'TEXT = "SPDX-License-Identifier: MIT"\n', set()),
    ("p.yaml", "deps:\n  - name: x\n    license: MIT\n", set()),
    ("d.md", "The formatter refuses plugins under BSD-2-Clause and warns about MIT.\n", set()),
    ("d.md", "That other tool is released under MIT.\n", set()),
    ("LICENSE", "Some words.\nWhat follows are the conditions (MIT License).\n", {"MIT"}),
    ("docs/LICENCE.txt", "ISC licence\n", {"ISC"}),
    ("NOTICE", "Terms are being drafted; nothing is granted yet.\n", set()),
    ("x.py", "", set()),
]


@pytest.mark.parametrize(("path", "text", "want"), STATED)
def test_statements(path, text, want):
    assert L.stated_licenses(path, text) == want


SRC = "source_id STRING, license_spdx STRING, license_file STRING, authorized BOOLEAN, listed_at TIMESTAMP_NTZ"
FILES = "source_id STRING, path STRING, content BINARY, is_regular BOOLEAN"


def tables(spark):
    s = [("a", "MIT", "LICENSE", True), ("b", "MIT", "LICENSE", None), ("c", None, "docs/terms.txt", True), ("d", "UNKNOWN", None, True), ("e", "MIT OR ISC", "GONE", True), (None, "MIT", "x", True), ("a", "MIT", "LICENSE", True)]
    f = [
        ("a", "LICENSE", b"MIT License", True), ("a", "x.py", b"# License: ISC", True), ("a", "y.py", b"pass", True), ("a", "third/LICENSE", b"ISC licence", True), ("a", "third/deep/z.py", b"pass", True), ("a", "l", None, False),
        ("b", "LICENSE", b"Apache License 2.0", True), ("b", "x.py", b"\xff\xfe", True), ("c", "docs/terms.txt", b"Offered under the MPL 2.0.", True), ("d", "x.py", b"", True), ("d", "y.py", b"# License: MIT", True), ("d", "z.py", None, True),
        ("gone", "x.py", b"pass", True), (None, "x", b"", True), ("e", None, b"", True), ("a", "x.py", b"# License: ISC", True),
    ]
    return spark.createDataFrame([(*r, None) for r in s], SRC), spark.createDataFrame(f, FILES)


def test_verdicts_and_inheritance(spark):
    s, f = tables(spark)
    for extra in (False, True):
        if extra:
            s, f = s.selectExpr("*", "1 AS verdict", "2 AS named"), f.selectExpr("*", "3 AS stated", "'q' AS licenses")
        st = L.file_statements(f)
        repo = L.repository_licenses(s, st, L.texts_named_elsewhere(f, s))
        assert {r.source_id: (r.verdict, r.licenses, r.authorized) for r in repo.collect()} == {"a": ("known", ["MIT"], True), "b": ("conflict", ["Apache-2.0", "MIT"], False), "c": ("known", ["MPL-2.0"], True), "d": ("unknown", [], True), "e": ("known", ["ISC", "MIT"], True)}
        got = {(r.source_id, r.path): r.verdict for r in L.file_verdicts(st, repo).collect()}
        assert {k: v for k, v in got.items() if v != "known"} == {("a", "x.py"): "conflict", ("a", "third/LICENSE"): "conflict", ("d", "x.py"): "unknown", ("d", "z.py"): "unknown", ("gone", "x.py"): "unknown"} and ("a", "l") not in got
        eff = {(r.source_id, r.path): (r.licenses, r.origin, r.from_path) for r in L.effective_licenses(st, repo).collect()}
        assert eff["a", "third/deep/z.py"] == (["ISC"], "ancestor", "third/LICENSE") and eff["a", "y.py"] == (["MIT"], "ancestor", "LICENSE") and eff["a", "x.py"] == (["ISC"], "own", None) and eff["d", "x.py"] == ([], "none", None) and len(eff) == len(got)
        near = {(r.source_id, r.path): r.nearest_verdict for r in L.effective_licenses(st, repo).collect()}
        assert near["a", "third/deep/z.py"] == "conflict" and near["a", "y.py"] == "known" and near["d", "x.py"] == "unknown"


def test_other_license_contradicts(spark):
    s, f = tables(spark)
    tagged = spark.createDataFrame([("a", "t.c", b"// SPDX-License-Identifier: GPL-2.0-only\n", True)], FILES)
    st = L.file_statements(f.union(tagged))
    got = {(r.source_id, r.path): r.verdict for r in L.file_verdicts(st, L.repository_licenses(s, st)).collect()}
    assert got["a", "t.c"] == "conflict"


def test_empty(spark):
    s, f = (x.limit(0) for x in tables(spark))
    st = L.file_statements(f)
    repo = L.repository_licenses(s, st, L.texts_named_elsewhere(f, s))
    assert repo.count() == 0 and L.file_verdicts(st, repo).count() == 0 and L.effective_licenses(st, repo).count() == 0


def test_joins_by_shuffle_give_the_same(spark, monkeypatch):
    s, f = tables(spark)
    st = L.file_statements(f)
    repo = L.repository_licenses(s, st, L.texts_named_elsewhere(f, s))
    want = sorted(map(str, L.effective_licenses(st, repo).collect()))
    monkeypatch.setattr(L, "BROADCAST_SOURCES", -1)
    again = L.repository_licenses(s, st, L.texts_named_elsewhere(f, s))
    assert sorted(map(str, L.effective_licenses(st, again).collect())) == want
