"""Names in running text: possessives, words that no name goes on with, and one surrogate for one person."""

import re

import pytest

from tessera.llm import pii

CASES = [
    ("Dr Smith's report was late. Smith wrote it. Mr Smith agreed.", "Smith", 3, r"Dr (\w+)'s report was late\. (\w+) wrote it\. Mr (\w+) agreed\."),
    ("Mr. Jones' team; Jones left.", "Jones", 2, r"Mr\. (\w+)' team; (\w+) left\."),
    ("Mr Kumar Monday came. Later Kumar went, on Monday.", "Kumar", 2, r"Mr (\w+) Monday came\. Later (\w+) went, on Monday\."),
    ("Mrs Smith’s house, and Smith’s garden", "Smith", 2, r"Mrs (\w+)’s house, and (\w+)’s garden"),
    ("Mr O'Brien's car. O'Brien drove.", "O'Brien", 2, r"Mr ([\w']+?)'s car\. ([\w']+) drove\."),
    ("Ms Lee-Park's. Lee-Park again", "Lee-Park", 2, r"Ms ([\w-]+)'s\. ([\w-]+) again"),
    ("We met Mr Novak The next day Novak left", "Novak", 2, r"We met Mr (\w+) The next day (\w+) left"),
]


@pytest.mark.parametrize("text, surname, times, shape", CASES)
def test_a_person_has_one_surrogate_and_no_surname_stays(spark, text, surname, times, shape):
    got = pii.surrogates(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").collect()[0]
    assert got["n_name"] == times and surname not in got["text"]
    found = re.fullmatch(shape, got["text"])
    assert found and len(set(found.groups())) == 1


def test_first_parts_may_be_words_of_the_calendar(spark):
    """"May" after a title is a name."""
    got = pii.surrogates(spark.createDataFrame([(1, "Mrs May spoke. May left.")], "doc_id long, text string"), "k").collect()[0]
    assert "May" not in got["text"] and got["n_name"] == 2
