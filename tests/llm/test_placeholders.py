"""Operator 1: secrets that only begin like a placeholder, and placeholders."""

import pytest

from kinweave.llm import secrets


@pytest.mark.parametrize(
    ("text", "secret"),
    [('password = "MySup3rS3cret99"', "MySup3rS3cret99"), ('db_password = "x9$Kq2!vT7pW"', "x9$Kq2!vT7pW"), ('auth_token = "test9fK2xLq8Zw"', "test9fK2xLq8Zw"), ('client_secret = "a<b9K>q{Z2}%7w"', "a<b9K>q{Z2}%7w")],
)
def test_pairs_that_look_like_placeholders(text, secret):
    assert secret in {text[a:b] for _, a, b in secrets.find_pairs(text)}
    assert secret not in secrets.redact(text)


@pytest.mark.parametrize("value", ["Truest0rm77", "test9fK2xLq8", "qzvkwjxp", "83920174", "my-Xk29fQ"])
def test_base_assignments_are_redacted(value):
    assert value not in secrets.redact(f"secret={value} and more")


@pytest.mark.parametrize("text", ['password = "${DB_PASSWORD}"', 'password = "<your password>"', 'password = "{{ vault.db }}"', "password = your_password_here", "secret: nobody", "token = xxxxxxxx", 'auth_token = "Bearer ${TOKEN}"'])
def test_placeholders_stay(text):
    assert secrets.find_pairs(text) == []
    assert secrets.redact(text) == text
