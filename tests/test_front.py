"""Front matter: what is read, what is refused, and rewriting that keeps every other byte."""

import random

import pytest

from graphloom.sources import front

GOOD = {
    "": {},
    "a: 1\nb: two words # said\n'c d': 'it''s'\n\"e\": \"x\\ty # no\"\nf:\ng: ~\nh: 2026-01-02": {"a": "1", "b": "two words", "c d": "it's", "e": "x\ty # no", "f": None, "g": None, "h": "2026-01-02"},
    "list:\n- a\n- b: 1\n  c: 2\n-\n  d: x\n- - 1\n  - 2\nnext: 1": {"list": ["a", {"b": "1", "c": "2"}, {"d": "x"}, ["1", "2"]], "next": "1"},
    "edges:\n  - target: x.md\n    condition: \"when: a\"\n  # between\n\n  - target: 'y.md'": {"edges": [{"target": "x.md", "condition": "when: a"}, {"target": "y.md"}]},
    "a: [1, 'x, y', [2, {b: c, d: \"e}\"}], ]\nm: {k: v, q: [1], e: }": {"a": ["1", "x, y", ["2", {"b": "c", "d": "e}"}]], "m": {"k": "v", "q": ["1"], "e": None}},
    "a: [1,\n  2, # two\n  3]\nb: x": {"a": ["1", "2", "3"], "b": "x"},
    "a: |\n  one\n   two\n\n  three\nb: >-\n  folded\n  text\n\n  more\nc: 1": {"a": "one\n two\n\nthree\n", "b": "folded text\nmore", "c": "1"},
    "a: plain that\n  goes on\nurl: http://x.y/z#part\nt: 10:30": {"a": "plain that goes on", "url": "http://x.y/z#part", "t": "10:30"},
    "# only a comment\n\n  a: 1\n  b:\n    c:\n      d: deep": {"a": "1", "b": {"c": {"d": "deep"}}},
    "a:\r\n  - x\r\n  - y\r\nb: z\r": {"a": ["x", "y"], "b": "z"},
}
BAD = ["a: 1\na: 2", "just text", "- a list", "a: b: c", "a: [1, 2", "a: {b", "a: \"open", "a: 'open", "a: *alias", "a: !tag x", "a: 1\n  b: 2", "a:\n\t- x", "a: 1\n - b", "a:\n  - x\n y: 1", "a: [1] 2", "a: [1 {b}]", "[a]: 1"]


@pytest.mark.parametrize("text", GOOD)
def test_well_formed(text):
    assert front.parse(text) == GOOD[text]


@pytest.mark.parametrize("text", BAD)
def test_malformed(text):
    assert front.parse(text) is None


def test_documents():
    assert front.read("---\na: 1\n---\nbody\n---\n") == {"a": "1"} and front.read("--- \r\na: 1\r\n---\r\nbody") == {"a": "1"}
    assert front.read("---\n---\nx") == {} and front.read("no front") is None and front.read("---\na: 1\nno end") is None and front.read(None) is None and front.read("\n---\na: 1\n---\n") is None


def test_entries_are_refused_together():
    read = lambda text: front.entries(front.parse(text)["g"], ("node", "fingerprint"), ("node", "fingerprint"))
    assert read("g:\n  - node: a\n    fingerprint: b\n  - {node: c, fingerprint: d, more: e}") == [("a", "b"), ("c", "d")]
    assert read("g: []") == []
    for bad in ("g: a", "g:\n  - node: a", "g:\n  - node: a\n    fingerprint: b\n  - c", "g:\n  - node: a\n    fingerprint: [b]", "g:\n  - node: a\n    fingerprint: ''", "g:"):
        assert read(bad) is None


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_rewriting_keeps_every_other_byte(end):
    before = ["# head", "title:   'Odd  spacing' # kept", "grounds_to: # old", "  - node: a", "", "    fingerprint: mh:1", "  - {node: b, fingerprint: x}", "# after", "edges:", "- target: q.md"]
    rows = [{"node": "function:1", "fingerprint": "mh:64:00"}, {"node": 'odd "name": #', "fingerprint": "x"}]
    made = ["grounds_to:", "  - node: function:1", "    fingerprint: mh:64:00", '  - node: "odd \\"name\\": #"', "    fingerprint: x"]
    doc = lambda lines: end.join(["---", *lines, "---", "body ", "", "---", "\ttail"])
    assert front.with_list(doc(before), "grounds_to", rows) == doc(before[:2] + made + before[7:])
    assert front.with_list(doc(before[:2]), "grounds_to", rows) == doc(before[:2] + made)
    assert front.with_list(doc([]), "grounds_to", rows) == doc(made)
    again = front.with_list(doc(before), "grounds_to", rows)
    assert front.with_list(again, "grounds_to", rows) == again and front.entries(front.read(again)["grounds_to"], ("node",), ("node",)) == [(r["node"],) for r in rows]
    for text in ("no front matter", doc(["a: [1"]), ""):
        assert front.with_list(text, "grounds_to", rows) == text
    assert front.read(front.with_list(doc(before), "grounds_to", []))["grounds_to"] == []


def test_any_text_is_read_or_refused():
    rng = random.Random(4)
    for _ in range(4000):
        front.read("---\n" + "".join(rng.choice("ab:- \n#[]{}'\",|>\t1") for _ in range(rng.randrange(40))) + "\n---\n")
