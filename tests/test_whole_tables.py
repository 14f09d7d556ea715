"""Queries that answer for every document, on texts that a filter before the operator would leave out."""

import random
from itertools import combinations

import pytest

from docmesa.plans.registry import QUERIES


def answers(spark, tmp_path, name, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r)[1:] for r in sorted(QUERIES[name](spark, str(tmp_path)).collect())]


@pytest.mark.parametrize(
    ("name", "texts", "want"),
    [
        ("identifiers_of_all", ["Pump P-1001 and valve V-20345", "see HX-204", "none here"], [("P-1001,V-20345",), ("HX-204",), ("",)]),
        ("revisions_of_all", ["Issued as Rev. B", "Revision 3 of 2024-01-05", "none here"], [("B", 0), ("3", 1), ("", 0)]),
        ("formulas_of_all", ["x = y + z", "none here"], [(1,), (0,)]),
        ("tables_of_all", ["a | b\n1 | 2\n3 | 4", "|---|", "none here"], [(2, 2), (0, 0), (0, 0)]),
    ],
)
def test_every_document_is_asked(spark, tmp_path, name, texts, want):
    assert answers(spark, tmp_path, name, texts) == want


def test_long_texts_are_cut(spark, tmp_path):
    """88 characters stay, 89 are cut to 85 and an ellipsis, without a blank before it."""
    texts = ["a" * 88, "a" * 89, "short  one\n", "b" * 84 + " " + "c" * 20]
    assert answers(spark, tmp_path, "document_previews", texts) == [("a" * 88,), ("a" * 85 + "...",), ("short one",), ("b" * 84 + "...",)]


def test_near_pairs_of_a_large_group(spark, tmp_path):
    """130 copies with a word changed in some: every word and shingle of the group is in more than 100 documents, or in few pairs."""
    r = random.Random(3)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    texts = []
    for k in range(130):
        t = words[:40]
        if k % 4 == 1:
            t = t[:-1] + [r.choice(words[40:])]
        texts.append(" ".join(t))
    texts += [" ".join(r.sample(words, 20)) for _ in range(10)]
    want = []
    sets = [(set(t.split()), {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}) for t in texts]
    for a, b in combinations(range(len(texts)), 2):
        (v, s), (w, u) = sets[a], sets[b]
        jaccard, contained, shingle = len(v & w) / len(v | w), len(v & w) / min(len(v), len(w)), len(s & u) / len(s | u)
        if jaccard >= 0.9 or (contained >= 0.92 and shingle >= 0.72) or shingle >= 0.86:
            want.append((a, b, round(jaccard * 1e6), round(shingle * 1e6)))
    assert len(want) >= 130 * 129 // 2
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["near_duplicate_pairs"](spark, str(tmp_path)).select("a", "b", "jaccard", "shingle").collect()
    assert sorted(map(tuple, got)) == want
