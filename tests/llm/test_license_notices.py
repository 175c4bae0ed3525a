"""Notices of other licences aren't taken for those that they resemble."""

import pytest

from gridloom.llm import licenses


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("Released under the BSD License.", "BSD-notice"),
        ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0-notice"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0-notice"),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0-notice"),
        ("Released under the MIT License.", "MIT-notice"),
        ("Released under the Foo License.", None),
        (licenses.TEMPLATES["GPL-3.0-or-later"].replace("version 3", "version 2"), "GPL-2.0-or-later"),
        (licenses.TEMPLATES["BSD-3-Clause"], "BSD-3-Clause"),
    ],
)
def test_notices(text, name):
    found = licenses.Index.of(licenses.TEMPLATES).matches(f"Some words before. {text} Some words after.")
    assert [m["license"] for m in found] == ([name] if name else [])
