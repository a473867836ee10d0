"""What normalise() leaves alone is what its transducers would leave alone."""

import random

import pytest

pii = pytest.importorskip("vicinity.llm.pii")

AT = ["jane [ at ] example.com", "jane ( at ) example.com", "jane(At)example.com", "jane (arroba) example.com", "jane {@} example.com", "jane _AT_ example.com", "jane -AT- example.com"]
DOT = ["jane@example (point) com", "jane@example (punto) es", "jane@example [.] com", "jane@example DOT com", "jane@example dOt com"]


@pytest.mark.parametrize("text", AT + DOT)
def test_disguised_addresses(text):
    base, every = pii.all_spans(text)
    assert every["email"] and every["email"] != base["email"]


def test_digits_in_words_and_figures():
    assert pii.normalise("acht 2 drei 4").text == "8234"
    assert pii.normalise("one dash 2 dash three dash 4").text == "1-2-3-4"


def test_gate_agrees_with_the_transducers():
    rng = random.Random(8)
    parts = ["at", "At", "AT", "dot", "DOT", "dOt", "arroba", "point", "Punto", "punkt", "@", ".", "jane", "example", "com", "x", "7", "42", "dash", "hyphen", "plus", "+", *pii._SPELLED, "Acht", "ONE"]
    joins = [" ", " ", " ", "", "  ", "-", "_", ",", "\t", " (", ") ", "[", "]", "{", "}", "<", " > ", "( ", " )"]
    for _ in range(30_000):
        text = "".join(rng.choice(parts) + rng.choice(joins) for _ in range(rng.randint(2, 9)))
        if pii.normalise(text) is None:
            assert pii._rewritten(text, False).text == text, text


def test_time_in_proportion():
    import time

    shapes = {
        "blanks": lambda n: "john (at)" + " " * n + "x", "dashes": lambda n: "a (at) b" + "-" * n, "dots": lambda n: "a" + "." * n + " at b dot c", "chain": lambda n: "a dot " * (n // 6) + " at b",
        "ats": lambda n: "a at " * (n // 5), "words": lambda n: "one " * (n // 4), "brackets": lambda n: "( " * (n // 2), "phone": lambda n: "+1" + "-" * n, "signs": lambda n: "(at)" * (n // 4),
        "addresses": lambda n: "jane (at) example (dot) com " * (n // 28),
    }
    for name, f in shapes.items():
        began = time.process_time()
        pii.all_spans(f(1_000_000))
        assert time.process_time() - began < 8, name


def test_spelled_out_addresses():
    want = {
        "write to john dot doe at mail dot example dot com now": ["john dot doe at mail dot example dot com"],
        "look at example dot compact": [],
        "a.b at c dot org and d at e dot net.": ["a.b at c dot org", "d at e dot net"],
        "x@site dot co": ["x@site dot co"],
        "é at a dot com": [],
        "meet at noon": [],
    }
    for text, spans in want.items():
        assert [text[a:b] for a, b in pii.all_spans(text)[1]["email"]] == spans, text


def test_added_spans_never_touch_base_spans():
    rng = random.Random(3)
    parts = ["a@b.com", "c (at) d.org", "1.2.3.4", "one two three four", "+49 (0) 123 456 78", "４１１１ 1111 1111 1111", "x@y (dot) de", ",", "."]
    for _ in range(3000):
        text = " ".join(rng.choices(parts, k=rng.randint(1, 7)))
        base, every = pii.all_spans(text)
        for kind in pii.KINDS:
            added = sorted(set(every[kind]) - set(base[kind]))
            assert set(base[kind]) <= set(every[kind])
            assert not any(a < y and x < b for a, b in added for x, y in base[kind]), text
