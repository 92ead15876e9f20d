"""Odd input for every operator and stage: NULLs, empty and long texts, ties, repeats, clashing names, no rows."""

import pytest
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from answerloom.llm import (
    byte_bpe, decontaminate, license_scan, line_dedup, near_copies, passages, quality_rules, secret_scan, url_rules, warc,
)

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
PROSE = " ".join(f"word{k} of{k * 7 % 31} the{k * 3 % 17} sea{k}" for k in range(60))
LONG = " ".join(f"w{k * 7919 % 10007}" for k in range(60_000))
ROWS = [
    (1, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 2), (2, PROSE, "en", "a", 2), (2, "other text", "en", "b", 3),
    (3, None, "de", None, None), (4, "", None, None, 0), (None, PROSE, "en", "a", 5), (None, None, None, None, None),
    (None, None, None, None, None), (5, LONG, "fr", "c", 6), (6, " \n\t \n", "fr", "c", 7), (7, "x" * 50_000, "fr", "c", 8),
    (8, "Ünïcode é 🙂 \u2028 words\r\nline", "de", "b", 9), (9, PROSE + " tail", "en", "a", 10),
]
CLASHING = ("mark", "pos", "row", "key", "node", "bucket", "dropped", "rest", "component", "item_id", "_doc", "hits", "head")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return docs.withColumns({name: F.lit(f"own {name}") for name in CLASHING})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    passage = " ".join(PROSE.split()[20:50])
    rows = [(1, passage), (1, passage), (2, None), (3, "too short"), (None, " ".join(PROSE.split()[60:90]))]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", F.lit("own"))


PER_ROW = {
    "licenses": license_scan.scan_licenses,
    "lines": line_dedup.line_report,
    "secrets": secret_scan.scan_secrets,
    "copies": near_copies.near_copies,
    "bpe": lambda docs: byte_bpe.round_trip(docs, RANKS, PATTERN),
    "quality": quality_rules.quality_report,
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_per_row(odd, empty, name):
    ids = [r.doc_id for r in PER_ROW[name](odd).select("doc_id").collect()]
    assert sorted(ids, key=str) == sorted([r[0] for r in ROWS], key=str)
    assert PER_ROW[name](empty).count() == 0


def test_copies_of_odd_rows(odd):
    rows = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_copies.near_copies(odd).collect()}
    n = len(set(PROSE.split())) and 236
    assert rows[1, n] == (1, True) and rows[2, n] == (1, False) and rows[9, n + 1] == (1, False)
    assert rows[None, n] == (1, True) or rows[None, n] == (1, False)
    assert rows[3, 0] == (3, True) and rows[4, 0] == (4, True) and rows[6, 0] == (6, True) and rows[7, 1] == (7, True)


STAGES = {name: stage for name, stage in corpus_pipeline.STAGES[:-1]}


@pytest.fixture(scope="module")
def folder(spark, items, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    items.write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(spark, odd, empty, folder, name):
    out = STAGES[name](spark, odd, folder)
    assert out.columns == odd.columns and out.schema.simpleString() == odd.schema.simpleString()
    kept = out.collect()
    assert all(r[c] == f"own {c}" for r in kept for c in CLASHING)
    none = STAGES[name](spark, empty, folder)
    assert none.columns == empty.columns and none.count() == 0


def test_lines_stage_keeps_nulls(spark, odd, folder):
    rows = STAGES["line_dedup"](spark, odd, folder).collect()
    assert len(rows) == len(ROWS) and sum(r.text is None for r in rows) == 3


def test_decontamination_of_odd_rows(spark, odd, empty, items, folder):
    rows = decontaminate.contaminated(odd, items).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(d, i) for d in (1, 2, 9, None) for i in (1, None)}
    assert all(r.similarity == 1.0 and r.n_words == 30 for r in rows)
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.contaminated(odd, items.limit(0)).count() == 0
    left = STAGES["benchmark_decontamination"](spark, odd, folder).collect()
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == [2, 3, 4, 5, 6, 7, 8]
    assert sum(r.doc_id is None for r in left) == 2


def test_passages_of_odd_rows(odd, empty):
    rows = passages.passage_spans(odd).collect()
    assert {(r.doc_id, r.removed) for r in rows} == {(1, False), (2, True), (9, True)}
    assert passages.passage_spans(empty).count() == 0
    assert passages.without_repeats(empty).count() == 0
    cut = passages.without_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == len(ROWS)
    texts = {r.doc_id: r.text for r in cut.filter("doc_id in (1, 9)").collect()}
    assert texts[1] == PROSE and len(texts[9]) < len(PROSE) / 4


def test_urls_of_odd_rows(spark):
    pages = spark.createDataFrame(
        [(1, None), (2, "no scheme"), (3, "http://"), (3, "http://"), (None, "HTTP://A.NET/x?y#z"), (4, "x://net"), (5, "://EXAMPLE.net/en/")],
        "page_id long, url string",
    ).withColumns({"host": F.lit(1), "path": F.lit(2), "rule": F.lit(3), "tokens": F.lit(4)})
    rows = url_rules.judge(pages, url_rules.listed_labels(pages)).collect()
    assert len(rows) == 7
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[None] == ("a.net", "/x", "net/", "block") and got[5] == ("example.net", "/en/", "example.net/en/", "allow")
    assert got[4][:3] == ("net", "", None)
    assert url_rules.judge(pages.limit(0), url_rules.listed_labels(pages.limit(0))).count() == 0
    assert url_rules.judge(pages, spark.createDataFrame([], "url string, verdict string")).count() == 7


def test_archives_of_odd_rows(spark):
    rows = [
        (1, "http://a", "same"), (2, "http://b\r\nX: y", "same"), (3, None, None), (4, "u", ""), (None, "n", "same"),
        (5, "long", "y" * 3_000_000), (5, "long", "y" * 3_000_000), (6, "crlf", "a\r\n\r\nb\r\n"), (None, "m", "alone"), (None, "m", "alone"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "first": F.lit(2)})
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    by = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got), key=str)
    assert by == sorted([
        (1, "response", None, 4), (2, "revisit", 1, 4), (3, "response", None, 0), (4, "revisit", 3, 0), (None, "revisit", 1, 4),
        (5, "response", None, 3_000_000), (5, "response", None, 3_000_000), (6, "response", None, 8), (None, "response", None, 5),
        (None, "response", None, 5),
    ], key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_latin_pattern_matches_as_the_given_one():
    """Every character up to U+024F in every place of a match, random mixtures, and texts that leave the range."""
    import itertools
    import random

    import regex

    whole, split = regex.compile(public_tokenizers.PATTERN).findall, byte_bpe.splitter(public_tokenizers.PATTERN)
    assert public_tokenizers.PATTERN in byte_bpe.LATIN_PATTERNS
    latin, rng = [chr(k) for k in range(0x250)], random.Random(5)
    texts = [form.format(c) for c in latin for form in ("{0}", "a{0}b", "1{0}{0}.", " {0} ", "  {0}\n{0}", "'{0}")]
    mixed = latin + list(" '\n\tstrevmld ") * 20
    texts += ["".join(rng.choices(mixed, k=rng.randint(0, 30))) for _ in range(5000)]
    texts += [a + b for a, b in itertools.product(("é's  ", "x ", "\x1c 1"), ("ɐ", "中²", "  ", "🙂"))]
    assert [split(x) for x in texts] == [whole(x) for x in texts]


def test_merges_are_those_of_the_lowest_neighbours():
    """Short words, whose pair ranks are kept between joins, against the heap of the long ones."""
    import random

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(7)
    words = ["".join(rng.choices("abeinrst áé🙂0.", k=rng.randint(1, 20))).encode() for _ in range(3000)] + [b"a" * k for k in range(1, 64)]
    assert [byte_bpe.merged(x, ranks) for x in words] == [
        [ranks[x]] if x in ranks else byte_bpe._merged_long(x, ranks) for x in words
    ]
