"""Secrets and logins of any length, JSON keys and cues of any case."""

import pytest

from kinweave.llm import pii


def mask(text):
    return pii.masked(text, pii.scan(text, pii.automaton()))


@pytest.mark.parametrize("n", [512, 513, 5000])
def test_secrets_of_any_length(n):
    assert mask(f"token = {'a' * n} end") == "token = <SECRET> end"
    assert mask(f'token = "{"a" * n}" end') == 'token = "<SECRET>" end'
    assert mask(f"ftp://{'u' * n}:{'p' * n}@host/x") == "ftp://<LOGIN>@host/x"


def test_cues_of_any_case_and_json_keys():
    assert mask('{"token": "abcdefgh12345", "iban": "DE89 3704 0044 0532 0130 00"}') == '{"token": "<SECRET>", "iban": "<ACCOUNT>"}'
    for cue in ("apiKey", "X-Api-Key", "Api_Key", "PassWord"):
        assert mask(f"İ {cue}: abcdefghij0123456789 x") == f"İ {cue}: <SECRET> x"
