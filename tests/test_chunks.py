"""Chunkers and rewriting on small texts, without Spark."""

import random

import pytest

from corvane.operators import chunks as C
from corvane.operators import series as S


def test_markdown_chunks_overlap_by_three_lines():
    assert C.markdown_chunks("short") == ["short"] and C.markdown_chunks(None) == [""]
    text = "\n\n".join(f"{n}a\n{n}b\n{n}c\n{n}d" for n in range(4))
    got = C.markdown_chunks(text, 30)
    assert got[0].startswith("0a") and all(x.split("\n")[:3] == y.split("\n")[-3:] for y, x in zip(got, got[1:], strict=False))
    assert C.markdown_chunks("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]


def test_packed_paragraphs_lose_nothing():
    rnd = random.Random(1)
    for _ in range(50):
        text = "\n\n".join("w" * rnd.randint(1, 60) for _ in range(rnd.randint(1, 12)))
        got = C.packed_paragraphs(text, 50)
        assert all(len(x) <= 50 for x in got) and "".join(got).replace("\n", "") == text.replace("\n", "")
    assert C.packed_paragraphs("") == [] and C.packed_paragraphs("abc", 10) == ["abc"]


def test_budget_falls_back_to_sentences_and_hard_cuts():
    got = C.budget_chunks("One two. Three four! " + "x" * 50, 8)
    assert all(len(x) // 2 <= 8 for x in got) and got[0] == "One two."
    assert C.budget_chunks("", 5) == [] and C.budget_chunks("abcd", 5) == ["abcd"]


def test_packed_blocks_count_separators():
    assert C.packed_blocks([4, 4, 4], 10) == [0, 0, 1]
    assert C.packed_blocks([4, 4, 4], 16) == [0, 0, 0]
    with pytest.raises(ValueError):
        C.packed_blocks([11], 10)


def test_slugs():
    assert C.slug("Hello, World!") == "hello-world" and C.slug(None) == "" and C.slug("  ") == ""
    assert C.slug("日本 Tokyo語") == "日本-tokyo-語" and C.slug("café") == "café"


def test_tables_and_images():
    page = '<table class="x"><tr><th>A</th><th><b>B</b></th></tr><tr><td>1</td><td>2</td></tr></table><table></table>'
    assert C.tables_to_markdown(page) == "| A | B |\n| --- | --- |\n| 1 | 2 |<table></table>"
    assert C.images_to_markdown('<img src="/a.png" alt="x">', "http://h") == "![x](http://h/a.png)"


def test_citations_out_of_range_are_dropped():
    assert C.without_bad_citations("a [1] b [7] c [03]", 5) == "a [1] b  c [03]"


def test_similarity_of_titles():
    assert C.title_similarity("Abc ", "abc") == 1.0 and C.title_similarity("", "abc") == 0.0


def test_source_chunks_keep_headings_together():
    assert S.source_chunks("x" * 12_000) == ["x" * 12_000]
    text = "".join(f"\n# Part {n}\n" + "word " * 900 for n in range(5))
    got = S.source_chunks(text)
    assert len(got) > 1 and all(len(x) <= 6000 + 500 for x in got) and got[0].startswith("# Part 0")
    assert [len(x) for x in S.source_chunks("y" * 13_000)] == [6000, 6000, 1000]
    assert all(len(x) <= 6000 for x in S.source_chunks("A sentence of words. " * 700))


def test_misread_chinese_is_repaired():
    text = "知识库需要可靠的来源和可以追溯的证据才能被信任"
    assert S.repaired(text.encode("gbk").decode("latin-1")) == text
    assert S.repaired("Les sources doivent être vérifiées à chaque étape.") is None and S.repaired(text) is None and S.repaired(None) is None


def test_decoding_prefers_utf8():
    assert S.decoded("é plain".encode()) == "é plain" and S.decoded(None) == ""
    assert S.decoded("知识库的来源".encode("gbk")) == "知识库的来源"


@pytest.mark.parametrize("text", ["é", "été", "où", "Ö", "È éé éê.", "Привет мир", "Ελληνικά", "שלום", "茅t茅", "知", ""])
def test_valid_utf8_is_not_given_up(text):
    """Read as GBK, the bytes of most of these are mainly Chinese."""
    assert S.decoded(text.encode()) == text


def test_other_bytes_are_decoded_by_a_fallback():
    assert S.decoded("繁體中文內容測試".encode("big5")) == "繁體中文內容測試" and S.decoded(b"\xff\xfe") == "\ufffd\ufffd"


def test_answers_are_mended():
    from corvane.operators.identity import mended

    assert mended('```json\n{"b": 1, "a": [1, 2]}\n```') == ("valid", False, '{"a":[1,2],"b":1}')
    assert mended('{"a": 1,}') == ("repaired", False, '{"a":1}')
    assert mended('x {"a": "line\nbreak", "b": [1, {"c": "d') == ("repaired", True, '{"a":"line\\nbreak","b":[1,{"c":"d"}]}')
    assert mended('{"a": 1, "b": ')[0::2] == ("repaired", '{"a":1}')
    assert mended("no answer") == ("no_json", False, None) and mended(None)[0] == "no_json" and mended("")[0] == "no_json"


def test_chunks_of_all_sizes_keep_every_paragraph():
    rnd = random.Random(6)
    for _ in range(60):
        words = ["w" * rnd.randint(1, 9) + str(k) for k in range(rnd.randint(1, 20))]
        text = "\n\n".join(words)
        assert [w for w in words if not any(w in c for c in C.markdown_chunks(text, 40))] == []
        fine = C.budget_chunks(text, 10)
        assert "".join(fine).replace("\n", "") == "".join(words) and all(len(c) // 2 <= 10 for c in fine)


def test_large_pages_are_chapters_of_their_own():
    assert C.packed_blocks([5, 50, 5, 5], 12, alone=True) == [0, 1, 2, 2]
