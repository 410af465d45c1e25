"""The path rules of op8, word for word as its contract lists them."""

import pytest

from quillgraph.llm import url_filter

CONTRACT = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"


def test_rules_are_those_of_the_contract():
    assert ", ".join(f"{says} {host}{path}" for says, host, path in url_filter.RULES) == CONTRACT


@pytest.mark.parametrize(("url", "rule", "verdict"), [
    ("http://x.net/de/1", "net/de/", "allow"), ("http://m.free-bets.example.net/de/1", "net/de/", "allow"), ("http://a.example.net/de/8x", "example.net/de/8", "block"),
    ("http://example.net/de/7", "net/de/", "allow"), ("http://x.com/en/7", "com/en/", "block"), ("http://x.example.com/en/7", "example.com/en/7", "allow"), ("http://x.org/es/", "org/es/", "block"),
])
def test_the_longest_rule_gives_its_word(stored, url, rule, verdict):
    found = url_filter.judge(stored([(1, url)], "page_id long, url string"), url_filter.LISTED, url_filter.RULES).collect()
    assert [(r["rule"], r["verdict"]) for r in found] == [(rule, verdict)]
