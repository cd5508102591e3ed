"""Letters of one shape in several scripts have one written form; others stay apart."""

from __future__ import annotations

import pytest

from gleanwright.llm import forms

WRITTEN = forms.representatives({chr(c): 10 for c in range(32, 127)})


@pytest.mark.parametrize("a, b", [("l", "ӏ"), ("Æ", "Ӕ"), ("æ", "ӕ"), ("Ə", "Ә"), ("ə", "ә"), ("KHMNOPCTX", "ⲔⲎⲘⲚⲞⲢⲤⲦⲬ"), ("ABCDEFGHIJKLMNOPRSTUVWXYZ", "ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ"), ("ΓΔΠΨ", "ⲄⲆⲠⲮ"), ("opc", "ⲟⲣⲥ"), ("zvws", "ꮓꮩꮃꮪ"), ("IVXLCDM", "ⅠⅤⅩⅬⅭⅮⅯ"), ("lvxcdm", "ⅼⅴⅹⅽⅾⅿ"), ("μ", "µ"), ("g", "ɡ"), ("‐", "‑"), ("ᴀᴛᴍ", "ꭺтм"), ("И", "Ͷ")])
def test_one_shape_one_form(a, b):
    one = forms.rewriter(WRITTEN)
    assert one(a) == one(b)


@pytest.mark.parametrize("a, b", [("I", "l"), ("I", "ӏ"), ("a", "α"), ("Y", "У"), ("r", "г"), ("Ʒ", "З"), ("e", "ə"), ("O", "0"), ("s", "ſ"), ("2", "²"), ("-", "‐"), ("β", "ϐ"), ("A", "ꭺ")])
def test_other_shapes_stay_apart(a, b):
    one = forms.rewriter(WRITTEN)
    assert one(a) != one(b)


def test_each_letter_is_in_one_class():
    letters = [c for x, others in forms.SAME_SHAPE.items() for c in x + others]
    assert len(letters) == len(set(letters))
