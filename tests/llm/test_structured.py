"""Operator 1: names and literals that calls, elements, block scalars, lists, defaults and f-strings tie together."""

import time

import pytest

from kinweave.llm import secrets

KEY = "x9Kq2vT7pWz4Lm8R"


def found(text):
    return {text[a:b] for _, a, b in secrets.find_pairs(text)}


@pytest.mark.parametrize(
    "text",
    [
        f'setenv("DB_PASSWORD", "{KEY}")',
        f"os.environ.setdefault('API_TOKEN', '{KEY}')",
        f"<clientSecret>{KEY}</clientSecret>",
        f'<password kind="a">\n  {KEY}\n</password>',
        f"api_token:\n  - {KEY}\n  - none\n",
        f'api_tokens:\n  - name: x\nauth_token:\n  - "{KEY}"\n',
        f'auth_tokens = ["{KEY}", "changeme"]',
        f'password = os.getenv("P") or "{KEY}"',
        f"const apiSecret = env.SECRET ?? '{KEY}';",
        f"db_password: |\n  {KEY}\nother: 1\n",
        f"a = 1\n  client_secret: >-\n    {KEY}",
    ],
)
def test_found(text):
    assert KEY in found(text)


def test_parts_of_one_value():
    half = (KEY[:8], KEY[8:])
    assert set(half) <= found(f"private_key: |\n  {half[0]}\n  {half[1]}\n")
    assert KEY in found(f'part = "{KEY}"\npassword = f"pre-{{part}}"')


@pytest.mark.parametrize(
    "text",
    ['setenv("PATH_NAME", "' + KEY + '")', "<title>" + KEY + "</title>", "words:\n  - " + KEY, "password or \"none\"", "(\"password\", \"changeme\")", "<password>your password</password>", "secret:\n  - nobody\n  - knows"],
)
def test_left_alone(text):
    assert not found(text)


@pytest.mark.parametrize("text", ["x" * 100_000, "a=" * 30_000, "<a>" * 20_000, "(" * 50_000, "k: [" * 20_000, '("a",' * 20_000, "a:\n" * 30_000, " " * 50_000 + "a: |\n", "- " * 50_000, "a = b " * 20_000])
def test_long_texts_take_time_in_proportion(text):
    began = time.time()
    secrets.find_pairs(text)
    assert time.time() - began < 10
