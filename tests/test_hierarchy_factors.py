"""Words of merges by the factors that the weights hold."""

from themeloom.operators import describe, display
from themeloom.session import store


def test_merge_words_take_the_factors_of_the_weights(spark):
    counts = store(spark.createDataFrame([(0, "a", 5), (0, "b", 2), (1, "a", 1), (1, "c", 7), (2, "c", 1), (2, "d", 4), (2, "b", 1)], "topic int, term string, n long"))
    weights = store(describe.class_tfidf(counts))
    merges = store(display.hierarchy(weights))
    listed = lambda df: sorted(map(tuple, df.collect()))
    known = listed(display.merge_words(merges, counts, describe.term_factors(counts), places=9))
    assert listed(display.merge_words(merges, weights, places=9)) == known and len(known) == 8
