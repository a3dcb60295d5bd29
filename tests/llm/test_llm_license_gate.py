"""Keywords of license rules never hide a match."""

from tidymill.llm import licenses


def test_keywords_are_in_every_match():
    assert licenses.required_words("(?:gnu )?gpl(?: version| v)? (?:2|v2)(?: 0)?") == {"gpl"}
    assert licenses.required_words("non ?commercial use only") == {"use", "only"}
    for rule in licenses.GATED:
        assert set(rule.needs) <= licenses.required_words(rule.pattern)


def test_matches_without_the_former_keywords(spark):
    texts = {
        1: ("a commercial licence", "commercial"), 2: ("noncommercial use only", "non-commercial"),
        3: ("see the GNU General Public License for more details", "gpl"), 4: ("Apache2", "apache-2"),
        5: ("you may not use this file except in compliance with the license", "apache-2"),
        6: ("redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "lgpl"),
        7: ("redistribute it and/or modify it under the terms of the GNU Affero General Public License", "agpl-3"),
        8: ("the two clause license", "bsd-2"), 9: ("use only apache and commercial goods", ""),
    }
    docs = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in licenses.detect(docs).collect()} == {i: want for i, (_, want) in texts.items()}
