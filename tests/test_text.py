import html
import itertools
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from answerloom import fixed_values as fv
from answerloom.functions import naming as nm, text as tx

TEXTS = [
    "a. first<br />b. second, e.g. this<br />c. third</p>",
    "A.  upper\nlines b. B text c.<br/> C",
    "no letters at all",
    "xa. not free b. free",
    "éa. é is a letter b. stop",
    "a. one e. five f. six g. seven h. eight <br /> ",
    "a.b.c.d.e.f.g.h.",
    "f. the last runs on a. even here</p> ",
    "a. trailing paragraph </p>  b. <p>x</p><br/>",
    "",
]


def plain(found):
    """What is left of an extracted text, in Python."""
    found = re.sub(fv.TRAILING_PARAGRAPH, "", found.strip())
    found = re.sub(fv.TRAILING_LINE_BREAK, "", found)
    return found


@pytest.mark.parametrize("section", list(fv.QUIZ_LETTERS))
def test_subtask_against_python(values, section):
    letters = fv.QUIZ_LETTERS[section]
    for n, x in enumerate(letters):
        stop = rf"(?=\b{letters[n + 1]}\.(?!\w)|\Z)" if n + 1 < len(letters) else r"\Z"
        expected = []
        for text in TEXTS:
            hit = re.search(rf"(?is)\b{x}\.\s*(.*?){stop}", text)
            found = plain(hit[1]) if hit else ""
            found = re.sub(fv.LINE_BREAK_PATTERN, " ", found.replace("</span>", ""))
            expected.append(re.sub(r"\s+", " ", found).strip())
        assert values(lambda c: tx.subtask(c, x, section), TEXTS) == expected, x


def test_loose_subtask_against_python(values):
    for x in "abcdefgh":
        expected = []
        for text in TEXTS:
            hit = re.search(rf"(?is){x}\.\s*(.*?)(?=\b[a-h]\.|\Z)", text)
            expected.append(plain(hit[1]).strip() if hit else "")
        assert values(lambda c: tx.subtask_loose(c, x), TEXTS) == expected, x


def test_subtask_keeps_abbreviations_and_ignores_unknown_letters(values):
    assert values(lambda c: tx.subtask(c, "b"), TEXTS[:1]) == ["second, e.g. this"]
    assert values(lambda c: tx.subtask(c, "g"), TEXTS[:1]) == [""]
    assert values(lambda c: tx.subtask(c, "a"), [None]) == [""]


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab.c <br/>\né_", max_size=30), min_size=1, max_size=20))
def test_subtask_random_texts(values, texts):
    expected = []
    for text in texts:
        hit = re.search(r"(?is)\ba\.\s*(.*?)(?=\bb\.(?!\w)|\Z)", text)
        found = plain(hit[1]) if hit else ""
        found = re.sub(fv.LINE_BREAK_PATTERN, " ", found)
        expected.append(re.sub(r"\s+", " ", found).strip())
    assert values(lambda c: tx.subtask(c, "a"), texts) == expected


def test_entities_are_decoded_to_the_end(values):
    texts = ["&amp;amp;lt;", "a &lt; b", None, "&copy;&nbsp;&notanentity; &#65;", "plain"]

    def settled(text):
        while text is not None and html.unescape(text) != text:
            text = html.unescape(text)
        return text

    assert values(tx.decode_entities, texts) == [settled(t) for t in texts]
    assert values(tx.clean_remark, ["&lt;/p&gt;&lt;p&gt;x"]) == ["<br />x"]


def test_styled_spans(values):
    assert values(
        tx.drop_styled_spans,
        [
            '<span style="x;background-color:rgb(1,22,255);y">a</span>',
            '<span style="background-color:transparent;color:#000000;">b</span>',
            "<span style=color:rgb(0,0,0);>c",
            '<span style="color:rgb(1,0,0);">d',
        ],
    ) == ["a</span>", "b</span>", "c", '<span style="color:rgb(1,0,0);">d']


def test_clean_html_halves_breaks_once(values):
    assert values(tx.clean_html, ["a<br /><br /><br />b", "<!--HTML-->x</p><p>y</span>", None]) == [
        "a<br /><br />b", "x<br />y", "",
    ]
    assert values(tx.unify_breaks, ["x</span>", None]) == ["x</span>", None]


def test_boilerplate(values):
    assert values(
        tx.strip_boilerplate,
        ["True/False, because ...<br />it is", "YES/NO,because...<br>no", "a<br/>b \n c", None,
         "True/False, because ... it is"],
    ) == ["it is", "no", "a b c", "", "True/False, because ... it is"]


def test_numbers(values):
    assert values(tx.decimal_comma, ["1,5", "2.0", "-", None, "1,5,0"]) == [1.5, 2.0, None, None, None]
    assert values(
        tx.dirty_number, ['"0.5"', "'0.7", "\"'0.9\"", ' 1e-3 ', '"0.5', "nan", "", None, '"']
    ) == [0.5, 0.7, 0.9, 0.001, None, None, None, None, None]


def test_dirty_numbers_of_all_short_texts(values):
    """The one pattern against its steps: white space off, quotes around all off, one apostrophe off, a number left."""

    def stepwise(text):
        bare = text.strip()
        if len(bare) > 1 and bare[0] == bare[-1] == '"':
            bare = bare[1:-1]
        bare = bare.removeprefix("'").strip()
        return float(bare) if re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", bare) else None

    texts = ["".join(x) for n in range(6) for x in itertools.product("\"' 1.", repeat=n)]
    texts += [f'\u2003"{x}\xa0"\n' for x in ("'-1e5", "1 2", "+.5E-3", "' 7.", "1e", "''1")]
    assert values(tx.dirty_number, texts) == [stepwise(x) for x in texts]


def test_prompt(spark):
    df = spark.createDataFrame(
        [("q", "a", "r"), ("q", "a", " \t"), (None, None, None)], "q string, a string, r string"
    )
    with_reference = [r[0] for r in df.select(tx.prompt(df.q, df.a, df.r)).collect()]
    assert with_reference == [
        "Question: q\nAnswer: a\nReference answer: r", "Question: q\nAnswer: a", "Question: \nAnswer: ",
    ]
    assert df.select(tx.prompt(df.q, df.a)).first()[0] == "Question: q\nAnswer: a"


def test_reference_option(spark):
    df = spark.createDataFrame(
        [([("x", None), ("y", True), ("z", True)],), ([("x", False), ("y", None)],), ([],), (None,),
         ([(None, True)],)],
        "o array<struct<answer:string,is_correct:boolean>>",
    )
    assert [r[0] for r in df.select(tx.reference_option(df.o)).collect()] == ["y", "x", "", "", ""]


def test_names(values):
    paths = [
        "data/one/test.csv", "data/two.csv", "/srv/data/x/three.v1.csv", "four", "./data/five/a.csv",
        "data", "other/.hidden",
    ]
    assert values(nm.dataset_name, paths) == ["one", "two", "three.v1", "four", "five", "data", ".hidden"]
    assert values(nm.short_model_name, ["org/model-1", "plain"]) == ["model-1", "plain"]


@given(st.text(alphabet="abC é1-/.'", max_size=20))
@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_title_case_against_python(values, text):
    assert values(nm.title_case, [text]) == [text.title()]


def test_model_groups(values):
    runs = ["gpt-4o_x", "lora_gpt2-large", "qwen/other-7b"]
    assert values(lambda x: nm.model_display(nm.model_group(x)), runs) == [
        "GPT-4o", "GPT-2 Large", "Qwen Other-7B",
    ]
    assert values(lambda x: nm.model_order(nm.model_group(x)), runs) == [1, 4, 999]


@given(st.floats(allow_nan=False, allow_infinity=False, min_value=1e-12, max_value=1e9))
@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_plain_number_against_python(values, number):
    number = float(f"{number:.3g}")
    assert values(nm.plain_number, [number, -number], "double") == [repr(number), repr(-number)]
