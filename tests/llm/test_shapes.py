"""Nulls, empty and long texts, repeated rows, empty tables and clashing extra columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfcast.llm import ctw, decontaminate, packing, private, quality, simhash, suffix, urlfilter, warc

LONG = "The long text says word after word " * 6000
ROWS = [
    (1, "A short text, with words.", "en", "s", 25),
    (2, None, None, None, None),
    (3, "", "en", None, 0),
    (None, "No number here but words enough for one or two windows of the benchmark item text", "de", "s", 1),
    (5, "Repeated row of words that are all the same in both of the rows, ten and more of them.", "en", "s", 3),
    (5, "Repeated row of words that are all the same in both of the rows, ten and more of them.", "en", "s", 3),
    (6, LONG, "fr", "s", len(LONG)),
    (7, " \t\n ", "en", "s", 4),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "fp row chunk at key w kept n_words part length word gram size body left around component low node rank".split()


def documents(spark, rows=ROWS):
    docs = spark.createDataFrame(rows, SCHEMA)
    return docs.withColumns({c: F.lit(1) for c in EXTRA})


def benchmark(spark):
    return spark.createDataFrame([(1, "words enough for one or two windows of the benchmark item text"), (2, None), (3, "")], "item_id long, text string")


PER_DOCUMENT = {
    "op1": lambda spark, d: suffix.repeated_bytes(d),
    "op4": lambda spark, d: private.personal_data(d),
    "op5": lambda spark, d: ctw.scored(d),
    "op6": lambda spark, d: simhash.near_duplicates(d),
    "op7": lambda spark, d: decontaminate.contamination(d, benchmark(spark)),
    "op8": lambda spark, d: quality.quality(d),
}


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_one_row_for_each_document(spark, name):
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    rows = sorted(PER_DOCUMENT[name](spark, documents(spark)).collect(), key=key)
    assert [r["doc_id"] for r in rows] == [1, 2, 3, 5, 5, 6, 7, None]
    assert rows[3] == rows[4]
    assert PER_DOCUMENT[name](spark, documents(spark, [])).count() == 0


def test_an_empty_benchmark_hits_nothing(spark):
    none = benchmark(spark).where("false")
    rows = decontaminate.contamination(documents(spark), none).collect()
    assert len(rows) == 8 and not any(r.contaminated or r.n_hit or r.n_items for r in rows)
    assert decontaminate.clean(documents(spark), none).count() == 8


def test_packing_of_odd_rows(spark):
    rows = packing.pack(documents(spark)).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, None, 5, 6, 7}
    assert sum(r.doc_id == 5 for r in rows) == 2
    assert all(r.length == 1 for r in rows if r.doc_id in (2, 3))
    assert packing.pack(documents(spark, [])).count() == 0


def test_stages_keep_the_columns(spark):
    docs = documents(spark)
    for kept, ids in (
        (quality.keep_good(docs), {None, 5, 6}),
        (simhash.keep_one(docs), {1, 2, None, 5, 6}),
        (decontaminate.clean(docs, benchmark(spark)), {1, 2, 3, 5, 6, 7}),
        (private.redacted(docs), {1, 2, 3, None, 5, 6, 7}),
    ):
        assert kept.columns == docs.columns
        found = kept.collect()
        assert {r.doc_id for r in found} <= ids
    assert sum(r.doc_id == 5 for r in simhash.keep_one(docs).collect()) == 1
    for stage in (quality.keep_good, simhash.keep_one, private.redacted, lambda d: decontaminate.clean(d, benchmark(spark))):
        assert stage(documents(spark, [])).count() == 0


def test_pages_of_odd_rows(spark):
    schema = "page_id long, url string, html string, host int, row int, sha int, key int, first int"
    rows = [(1, "http://a.org/x", "<p>", 1, 1, 1, 1, 1), (2, None, None, 1, 1, 1, 1, 1), (3, "no mark", "", 1, 1, 1, 1, 1), (None, "http://a.net/", "<p>", 1, 1, 1, 1, 1)]
    rows += [(4, "http://b.org/y", "<p>", 1, 1, 1, 1, 1)] * 2
    pages = spark.createDataFrame(rows, schema)
    judged = {r.page_id: r for r in urlfilter.judged(pages, urlfilter.rule_table(spark)).collect()}
    assert (judged[2].host, judged[2].path, judged[2].rule, judged[2].verdict) == ("", "", None, "allow")
    assert (judged[3].host, judged[3].path) == ("", "")
    assert (judged[None].rule, judged[None].verdict) == ("net/", "block")
    back = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived(pages).collect()), key=str)
    assert back == sorted([(1, 3, "response", None), (2, 0, "response", None), (3, 0, "revisit", 2), (4, 3, "revisit", 1), (4, 3, "revisit", 1), (None, 3, "response", None)], key=str)
    empty = spark.createDataFrame([], schema)
    assert warc.archived(empty).count() == 0 and urlfilter.judged(empty, urlfilter.rule_table(spark)).count() == 0


def test_stage_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "pii", "best_fit_packing"]
