"""Queries with SQL against DuckDB on whole tables, and the pipeline against its stages done plainly."""

import pytest
from compare import connect, difference

import corpus_pipeline
from shelfcast.llm import catalog, packing, private, quality, simhash

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", catalog.statements())
def test_against_duckdb(spark, name):
    assert difference(catalog.registered()[name](spark, SF), connect(SF), catalog.statements()[name]) is None


def test_pipeline_against_a_plain_version(spark):
    """Decisions per document from the per-document results, groups by all pairs."""
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = {r.doc_id for r in quality.op8_quality_rules(spark, sf).collect() if r.kept}
    prints = {i: simhash.fingerprint(docs[i].text, simhash.SimHashParams()) for i in good}
    ids, group = sorted(good), {i: i for i in good}
    moved = True
    while moved:
        moved = False
        for a in ids:
            low = min(group[b] for b in ids if (prints[a] ^ prints[b]).bit_count() <= 4 or ((prints[a] ^ prints[b]) % (1 << 64)).bit_count() <= 4)
            moved, group[a] = moved or low != group[a], low
    first = {i for i in ids if group[i] == i}
    from shelfcast.llm import decontaminate

    hit = {r.doc_id for r in decontaminate.op7_benchmark_decontamination(spark, sf).collect() if r.contaminated}
    texts = [(i, private.redact(docs[i].text)) for i in sorted(first - hit)]
    want = {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in packing.pieces(spark.createDataFrame(texts, "doc_id long, text string"), packing.PackingParams()).collect()}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
