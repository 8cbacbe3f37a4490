"""Secret scans on texts that ended or hung them, and on keys that stood behind an address."""

import base64
import random
import string
import time

import pytest

from tidelake.llm import secrets

RANDOM = random.Random(5)
KEY = "".join(RANDOM.choice(string.ascii_letters + string.digits) for _ in range(40))


def found(text):
    return [(s, e) for s, k, e in secrets.spans_of(text) if k >= secrets.N_BASE]


@pytest.mark.parametrize("n", [19, 20, 21, 22, 24, 10_000])
def test_equal_characters(n):
    assert found("a" * n + "Q7") in ([], [(n - 18, n + 2)])
    assert found("A" * n) == []


@pytest.mark.parametrize("n", [16, 40, 5_000])
def test_ruled_lines_before_a_word(n):
    started = time.time()
    assert found("-" * n + "Title9x7") == []
    assert time.time() - started < 2


def test_base64_image():
    image = base64.b64encode(bytes(300) + RANDOM.randbytes(30_000)).decode()
    spans = found(f"data:image/png;base64,{image} end")
    assert spans and spans[0][0] >= 22 + 400 - 20 and sum(e - s for s, e in spans) > 39_000


@pytest.mark.parametrize(
    "text",
    [
        '{"url":"https://a.b/c","key":"%s"}',
        "https://a.b/c,%s",
        "example_service_key=%s",
        "https://user:%s@host/x",
        "https://user:word@host/x;%s",
        "https://a.b/c?sig=%s&x=1",
        "<a href='https://a.b/c'>%s</a>",
    ],
)
def test_keys_that_are_found(text):
    assert found(text % KEY) == [(text.index("%s"), text.index("%s") + len(KEY))]


@pytest.mark.parametrize(
    "text",
    [
        "https://docs.site/a/long-path/with-many-words-in-it/and/Some/Parts",
        "123456789012345678901234567890",
        "12345678-9abc-def0-1234-56789abcdef0",
        "SomeLongClassNameWithManyWords",
        "one_two_three_four_five_six_seven",
        "example" + KEY,
        "https://host.site/x/" + KEY,
        "ftp://user:word@host.site/x/" + KEY,
    ],
)
def test_allowed_candidates(text):
    assert found(text) == []


def test_many_spans_take_linear_time():
    def seconds(n):
        text = " ".join(f"token={KEY} {KEY[::-1]}" for _ in range(n))
        started = time.process_time()
        assert len(secrets.spans_of(text)) == 2 * n
        return time.process_time() - started

    assert seconds(16_000) < 12 * seconds(4_000) + 0.5


def test_a_span_within_base_spans_is_not_repeated():
    text = f"token={KEY} {KEY}"
    assert secrets.spans_of(text) == [(0, 0, 46), (47, 4, 87)]
