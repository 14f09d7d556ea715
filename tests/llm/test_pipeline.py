import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    from docmesa.llm.common import materialise

    for name, f in corpus_pipeline.STAGES:
        result = materialise(f(spark, docs, SF), "test-" + name.replace(" ", "-"))
        out.append((docs, result))
        docs = result
    return out


def test_columns_and_order(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "PII", "packing"]
    assert all(r.columns == columns for _, r in stages[:-1])


def test_classifier_keeps_clean(spark, stages):
    kept = {r.doc_id for r in stages[0][1].collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good, bad = [r.doc_id for r in labels if r.quality == 1], [r.doc_id for r in labels if r.quality == 0]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i in bad) <= 0.1 * len(bad)


def test_groups_keep_one(stages):
    from test_corpus_operators import sets_by_hand

    before, after = {r.doc_id: r.text for r in stages[1][0].collect()}, {r.doc_id: r.text for r in stages[1][1].collect()}
    sets, parent = {i: sets_by_hand(t, 5) for i, t in before.items()}, {i: i for i in before}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert set(after) == {find(i) for i in before} and all(before[i] == t for i, t in after.items())


def test_passages_are_cut(stages):
    from test_corpus_operators import removed_by_hand

    before, after = [(r.doc_id, r.text) for r in stages[2][0].collect()], {r.doc_id: r for r in stages[2][1].collect()}
    for i, (size, removed, _, _) in removed_by_hand(before).items():
        assert after[i].n_chars == len(after[i].text) and 0 <= size - removed - len(after[i].text.encode()) < 8 + 8 * (removed > 0)


def test_personal_data_are_masked(stages):
    from test_corpus_operators import base_by_hand

    for r in stages[3][1].collect():
        assert not base_by_hand(r.text)


def test_packing_has_every_document(stages):
    assert {r.doc_id for r in stages[4][1].collect()} == {r.doc_id for r in stages[4][0].collect()}


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[4][1].count()


def test_clashing_columns(spark):
    """Columns with names that stages use inside come through as they were."""
    extra = ["row", "row_", "stays", "_row", "root", "node", "id", "kept", "bucket", "Row__"]
    rows = [(k, f"text {k // 2} of some words that go on and on for a while {k // 2} " * 3, "en", "s", 1, *[f"{c}{k}" for c in extra]) for k in range(12)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in extra))
    for name, f in corpus_pipeline.STAGES[1:4]:
        out = f(spark, d, SF)
        assert out.columns == d.columns, name
        got = out.collect()
        assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in extra), name
