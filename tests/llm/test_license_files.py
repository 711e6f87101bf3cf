"""Whole licence files and source headers, wrapped, unwrapped and amid other text."""

import re
import textwrap

import pytest

from spoor.llm import licenses

TEXTS = [(name, licenses.pkgutil.get_data("spoor.llm", f"license_texts/{name}.txt").decode()) for name in licenses.FILES]


def best(text):
    return max(licenses.matches(text), key=lambda m: m[3])[2]


@pytest.mark.parametrize("name, text", [*TEXTS, *licenses.HEADERS])
def test_files_and_headers(name, text):
    paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n", text)]
    wrapped = "\n\n".join(textwrap.fill(p, 60) for p in paragraphs)
    for t in (text, "\n".join(paragraphs), wrapped, f"Copyright (c) 2020 Some One\n\n{wrapped}\n\nint main(void);\n"):
        assert best(t) == name


def test_apache_without_appendix():
    text = dict(TEXTS)["Apache-2.0"]
    assert best(text[: text.index("END OF TERMS")]) == "Apache-2.0"
