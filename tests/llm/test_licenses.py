"""Copies of notices side by side, and relatives told apart."""

import time

import pytest

from millrace.llm import op7_license_scan as op7

INDEX = op7.Index.of(op7.TEMPLATES)


def names(text):
    return [m[0] for m in INDEX.scan(text)]


@pytest.mark.parametrize("name", sorted(op7.TEMPLATES))
def test_copies_side_by_side_are_all_found(name):
    text = op7.TEMPLATES[name]
    for between in (0, 1, 3, 12, 20):
        for n in (1, 2, 3, 8):
            got = INDEX.scan((text + " " + "zzq " * between) * n)
            assert [m[0] for m in got] == [name] * n, (between, n)
            assert all(m[2] == 1 for m in got) and all(a[4] <= b[3] for a, b in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("name", ["MIT", "Apache-2.0", "GPL-3.0-or-later", "ISC", "BSD-3-Clause"])
def test_damaged_copies_side_by_side_are_all_found(name):
    words = op7.TEMPLATES[name].split()
    plain = [i for i, w in enumerate(words) if not op7.marks(op7.words_of(" ".join(words[max(0, i - 1) : i + 2])))]
    for n in (2, 3, 5):
        text = ""
        for k in range(n):
            own = list(words)
            for i in plain[k + 3 :: 17]:
                own[i] = f"odd{k}"
            text += " ".join(own) + " "
        assert names(text) == [name] * n


def test_many_copies_in_time():
    for text, n in (("Released under the MIT License. ", 1), (op7.TEMPLATES["Apache-2.0"] + "\n", 1)):
        copies, start = 1_000_000 // len(text), time.time()
        got = names(text * copies)
        assert len(got) == n * copies and time.time() - start < 10


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]), ("Licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
        ("Licensed under the GNU Lesser General Public License, version 2.1.", ["LGPL-2.1"]), ("Released under the GNU Lesser General Public License, version 3", ["LGPL-3.0"]),
        ("Released under the GNU Affero General Public License, version 3", ["AGPL-3.0"]), ("Licensed under GPL, version 2", []),
        (op7._gnu("program", "", "2"), ["GPL-2.0-or-later"]), (op7._gnu("program", "Affero ", "3"), ["AGPL-3.0-or-later"]), (op7._gnu("program", "Lesser ", "3"), ["LGPL-3.0-or-later"]), (op7._gnu("library", "Lesser ", "2.1"), ["LGPL-2.1-or-later"]),
        ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]), ("Licensed under CC BY-ND 4.0.", ["CC-BY-ND-4.0"]), ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), ("Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0"]), ("Licensed under CC BY-SA 3.0.", []),
        ("Licensed under the BSD License", ["BSD"]), ("Released under the Apache License", []), ("Released under the MIT License", ["MIT"]), ("Released under the Apache License, Version 2.0", ["Apache-2.0"]), ("Released under the Apache License, Version 1.1", []),
    ],
)
def test_relatives_are_told_apart(text, want):
    got = names(f"Some words before it. {text} And words after it, of which there are some.")
    assert [n.split(" ")[0] for n in got] == want
