"""Terms in texts against a nested loop."""

import pytest

from tessera.operators import terms
from tessera.sources.folders import cut

TEXTS = ["abcabc", "", None, "he said she", "𝒳 日本語 text", "aaaa", "ab\ncd", "abcabc", "x"]
TERMS = ["abc", "a", "he", "she", "本語", "b\nc", "", None, "aaaaa", "abc", "zz", "𝒳"]


@pytest.mark.parametrize("most", [terms.MOST_BYTES, 6])
def test_terms_equal_a_nested_loop(spark, most):
    texts, known = (spark.createDataFrame([(x,) for x in v], "t string") for v in (TEXTS, TERMS))
    got = [tuple(r) for r in terms.found(texts, "t", known, "t", cut, most).collect()]
    want = {(x, t) for x in TEXTS if x is not None for t in TERMS if t and t in x}
    assert sorted(got) == sorted(want) and terms.found(texts, "t", known.where("false"), "t", cut).count() == 0


def test_overlap_goes_both_ways(spark):
    left, right = (spark.createDataFrame([(x,) for x in v], "tag string") for v in (["ocean", "sea view", "cat"], ["sea", "oceans", "cat", "dog"]))
    assert sorted(tuple(r) for r in terms.overlapping(left, right, "tag", cut).collect()) == [("cat", "cat"), ("ocean", "oceans"), ("sea view", "sea")]
