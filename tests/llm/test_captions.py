"""Captions of figures, in any order, are kept."""

import pytest

from gridloom.llm import media


@pytest.mark.parametrize(
    ("page", "items"),
    [
        ("<figure><img src=u><figcaption>c</figcaption></figure>", [("u", "c")]),
        ("<figure><figcaption>c</figcaption><img src=u><img src=v></figure>t", [("u", "c"), ("v", "c"), ("t", None)]),
        ("a<figure><table><tr><td>x</td></tr></table><figcaption>c</figcaption></figure>b", [("a", None), ("x", None), ("c", None), ("b", None)]),
        ("<figure><figcaption>c</figcaption><p>x</p></figure>", [("c", None), ("x", None)]),
        ("<figure><figcaption>c", [("c", None)]),
        ("<figcaption>c</figcaption>t", [("c", None), ("t", None)]),
        ("<figure><figcaption>c</figcaption><figure><img src=u></figure></figure>", [("c", None), ("u", None)]),
    ],
)
def test_captions(page, items):
    assert [(x["text"] or x["src"], x["caption"]) for x in media.parse(page)] == items
