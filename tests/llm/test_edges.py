"""Every operator over odd rows and over no rows: the documented result, and no crash."""

import pytest

import corpus_pipeline
from pagemill.llm import exact_dedup, fingerprints, jaccard_join, language, mixing, packing, pii, quality, toxicity
from pagemill.llm.common import read_back

LABELS = "doc_id long, quality int, toxic int"


def label_table(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 1), (5, 0, 0), (9, None, None), (None, 1, 1)], LABELS)


OPERATORS = {
    "language": lambda s, d: language.identify(d),
    "pii": lambda s, d: pii.personal_data(d),
    "quality": lambda s, d: quality.quality(d),
    "exact": lambda s, d: exact_dedup.exact_duplicates(d),
    "jaccard": lambda s, d: jaccard_join.near_duplicates(d),
    "toxicity": lambda s, d: toxicity.toxicity(d, label_table(s)),
    "fingerprints": lambda s, d: fingerprints.compare_edited(d),
    "mixing": lambda s, d: mixing.mixing_rates(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_per_row(spark, odd, none, name):
    out = OPERATORS[name](spark, odd)
    rows = out.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in odd.select("doc_id").collect())
    assert OPERATORS[name](spark, none).count() == 0


def test_packing_rows(spark, odd, none):
    rows = packing.pack(odd).collect()
    assert sum(r.start == 0 for r in rows) == odd.count()
    assert packing.pack(none).count() == 0


def test_values_of_odd_rows(spark, odd):
    lang = {r.doc_id: r for r in language.identify(odd).collect()}
    assert lang[3].lang_pred == lang[4].lang_pred == "und" and lang[3].score == 0 and lang[5].lang_pred == "en"
    near = jaccard_join.near_duplicates(odd).collect()
    copies = [r for r in near if r.doc_id in (1, 8)]
    assert {r.class_id for r in copies} == {1} and sum(r.kept for r in copies) == 1
    assert all(r.n_links == 0 and r.kept for r in near if r.doc_id in (3, 4))
    exact = [r for r in exact_dedup.exact_duplicates(odd).collect() if r.keep_id == 8]
    assert len(exact) == 4 and sum(r.kept for r in exact) == 1 and {r.group_size for r in exact} == {4}
    prints = {r.doc_id: r for r in fingerprints.compare_edited(odd).collect()}
    assert prints[3].fingerprint == "" and prints[3].n_chars == 0


def test_helper_names_in_use(odd):
    extra = ["_uid", "_copy", "_copies", "copies", "_row", "_UID_"]
    docs = odd.selectExpr("*", *[f"doc_id AS {c}" for c in extra])
    for keeps in (exact_dedup.without_duplicates, jaccard_join.one_of_each, mixing.mixed, quality.good_documents):
        out = keeps(docs)
        assert out.columns == docs.columns
        assert all(r[c] == r.doc_id for r in out.collect() for c in extra)


def test_stages(spark, odd, none):
    docs = odd.select(*corpus_pipeline.COLUMNS)
    for table, some in ((docs, True), (none.select(*corpus_pipeline.COLUMNS), False)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = read_back(stage(spark, table, ""), name)
            assert out.columns == list(corpus_pipeline.COLUMNS)
            table = out
        last = corpus_pipeline.STAGES[-1][1](spark, table, "")
        assert (last.count() > 0) == some
