"""Ids that are whole numbers as texts, and ids that are no numbers."""

import pytest

from ostinato.llm import chosen_path, ego_join, lines, packing, quality, recompress
from ostinato.llm.queries import RANKS, RANKS_END, tokenizer_path


def calls(docs, vectors):
    import public_tokenizers

    return {
        "packing": lambda: packing.pack(docs, tokenizer_path(RANKS), public_tokenizers.PATTERN, RANKS_END, 64),
        "substrings": lambda: recompress.deduplicate(docs),
        "lines": lambda: lines.deduplicate(docs),
        "near": lambda: chosen_path.deduplicate(docs),
        "vectors": lambda: ego_join.near_duplicates(vectors),
    }


def test_numbers_as_texts(spark):
    docs = spark.createDataFrame([("1", "one two three four five six"), ("2", "one two three four five six"), ("03", "other words")], "doc_id string, text string")
    vectors = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [1.0, 0.0])], "vec_id string, embedding array<double>")
    f = calls(docs, vectors)
    assert sorted(r.doc_id for r in f["near"]().collect()) == ["03", "1"] and {r.doc_id: r.n_removed for r in f["lines"]().collect()} == {"1": 0, "2": 1, "03": 0}
    assert sorted((r.vec_id, r.kept) for r in f["vectors"]().collect()) == [(1, True), (2, False)] and f["packing"]().count() > 0 and f["substrings"]().count() == 3


@pytest.mark.parametrize("name", ["packing", "substrings", "lines", "near", "vectors"])
def test_texts_that_are_no_numbers_are_an_error(spark, name):
    docs = spark.createDataFrame([("a", "x y"), ("b", "x y")], "doc_id string, text string")
    vectors = spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        calls(docs, vectors)[name]().collect()


def test_labels_of_ids_that_are_no_numbers(spark):
    docs = spark.createDataFrame([("a", "x y")], "doc_id string, text string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        quality.fit(docs, spark.createDataFrame([("a", 1), ("b", 0), ("c", 1), ("d", 0)], "doc_id string, quality int"))
