"""Rare n-grams count whatever the size of the corpus."""

import numpy as np

from tallymix.llm import language


def test_no_ngram_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(language, "RARE", 1, raising=False)  # a rule by the corpus' size would leave out nearly all
    docs = spark.createDataFrame([("x", "abab cd"), ("y", "zz")], "lang string, text string")
    got = language.gram_counts(docs)
    for name, text in (("x", "abab cd"), ("y", "zz")):
        values, n = np.unique(language.gram_codes([text])[0], return_counts=True)
        assert np.array_equal(got[name][0], values) and np.array_equal(got[name][1], n)
