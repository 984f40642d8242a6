"""Wider candidates reach the labelers whatever else a text holds, and overlaps are resolved after the classifier."""

import pytest

from frond.llm import pii


def spans(text):
    return {(kind, text[a:b]) for _, (a, kind, b) in pii.candidates(text)[1]}


@pytest.mark.parametrize("at", ["(at)", "(AT)", "[At]", "[aT]"])
def test_spelled_addresses_in_any_case(at):
    assert spans(f"write john {at} example (DOT) com now") == {("spelled_email", f"john {at} example (DOT) com")}


def test_secrets_without_digits_and_of_any_length():
    for secret in ("abcdefghijklmnopqrst", "aB3" * 200, "x" * 128, "x" * 129):
        for more in ("", " 7"):
            assert ("secret", secret) in spans(f"token={secret}{more}")
    assert spans("token=abcdefghijklmno") == set()


def test_overlaps_are_resolved_by_probability():
    text = "2024-01-02 212-555-0199"
    more = pii.candidates(text)[1]
    assert {kind for _, (_, kind, _) in more} == {"number", "local_phone"}
    phone, number = len(pii.KINDS) + pii.MORE.index("local_phone"), len(pii.KINDS) + pii.MORE.index("number")
    for p, want in (({phone: 0.95, number: 0.2}, ["local_phone"]), ({phone: 0.95, number: 0.99}, ["number"]), ({phone: 0.5, number: 0.5}, [])):
        assert [kind for _, kind, _ in pii.chosen(more, lambda key: p[key[0]])] == want
