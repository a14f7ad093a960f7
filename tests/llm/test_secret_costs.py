"""Guess costs: the least over all segmentations, in linear time, with a real dictionary."""

import itertools
import math
import random
import re
import time

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chatlens.llm import secret_scan as sc

PATH = public_tokenizers.path("word_bpe_49k.json")
RANKS = dict(sc.RANK) | {"abc": 40, "war": 50, "sun": 60, "shine": 70, "one": 80}


def span(part, ranks):
    """Least cost of ``part`` as a single span, from the definitions."""
    out = [sum(map(sc._brute, part)), sc.word_cost(part, ranks) if sc.SHORT <= len(part) <= sc.LONG else math.inf]
    if re.fullmatch(r"(19|20)\d\d", part):
        out.append(sc.YEAR)
    day, month = r"(0[1-9]|[12]\d|3[01])", r"(0[1-9]|1[0-2])"
    if any(re.fullmatch(f, part) for s in ("", "-", "/", r"\.") for f in (rf"(19|20)\d\d{s}{month}{s}{day}", rf"{day}{s}{month}{s}(19|20)\d\d")):
        out.append(sc.DAY)
    for size in range(1, sc.BLOCK + 1):
        if len(part) >= max(3, 2 * size) and len(part) % size == 0 and part == part[:size] * (len(part) // size):
            out.append(sum(map(sc._brute, part[:size])) + (len(part) - size) * sc.AGAIN)
    if len(part) >= 3 and all(sc._next(a, b) for a, b in zip(part, part[1:])):
        out.append(sc.START + sc.STEP * (len(part) - 1))
    return min(out) + sc.SPAN


def least(value, ranks):
    best = [0.0]
    for j in range(1, len(value) + 1):
        best.append(min(best[i] + span(value[i:j], ranks) for i in range(j)))
    return min(best[-1], sc.ENOUGH)


pieces = st.sampled_from(["sun", "shine", "Sunshine", "abc", "war", "wert", "y", "2019", "20190512", "12-11-1999", "q", "aa", "xyx", "0ne", "!", "9", "ssss", "123"])


@settings(deadline=None, max_examples=400)
@given(st.one_of(st.lists(pieces, max_size=6).map("".join), st.text("aab1q2w!20é", max_size=14)))
def test_cost_is_the_least_of_all_segmentations(value):
    assert sc.guess_cost(value, RANKS) == pytest.approx(least(value, RANKS))


@settings(deadline=None, max_examples=200)
@given(st.lists(pieces, max_size=4).map("".join), st.lists(pieces, max_size=4).map("".join))
def test_a_whole_costs_no_more_than_its_parts(a, b):
    assert sc.guess_cost(a + b, RANKS) <= sc.guess_cost(a, RANKS) + sc.guess_cost(b, RANKS) + 1e-9


def test_cut_repeats_cost_the_same(monkeypatch):
    values = ("ab" * 300 + "c", "x" * 700, "sun" + "s" * 500 + "unshine", "q" + "123" * 100 + "4", "aab" * 90 + "aa", "qw" * 200 + "wert2019")
    cut = []
    for value in values:
        short, gone = sc._shortened(value)
        assert gone and len(short) + gone == len(value)
        cut.append(sc.guess_cost(value, RANKS))
    monkeypatch.setattr(sc, "_shortened", lambda value: (value, 0))
    assert cut == pytest.approx([sc.guess_cost(v, RANKS) for v in values])


def test_time_follows_the_length():
    rng = random.Random(1)
    for value in ("x" * 10 ** 6, "ab" * 500_000, "".join(rng.choices("abcdefghijklmnop0123456789", k=10 ** 6)), "qwertyuiop" * 100_000, "sunshine" * 125_000,
                  "".join(f"{c}" * 50 for c in rng.choices("abcdefgh", k=20_000))):
        began = time.process_time()
        cost = sc.guess_cost(value, sc.dictionary(PATH))
        assert time.process_time() - began < 1.5 and 0 < cost <= sc.ENOUGH, value[:20]
    assert sc.guess_cost("x" * 30) < 4 and sc.guess_cost("".join(rng.choices("abcdefgh", k=200))) == sc.ENOUGH


def test_ordinary_words_are_no_secrets(spark):
    plain = ["the password is required", "token is optional", "password: elephant", "auth: disabled", "login is unavailable", "token is returned",
             "secret: chocolate2019", "password = 12345678", "api key: qwertyuiop", "passwd=aaaaaaaaaaaa", "pwd: ab", "token: x"]
    secret = {"password: Xk9!vTq2#z": "guess:10:20", "DB_PASSWORD=xK9#mP2$vL!qR7": "guess:12:26", "pwd: " + "Zq7!" + "kW3$" * 1 + "vB9#mN": "guess:5:19"}
    df = spark.createDataFrame([*enumerate([*plain, *secret])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in sc.secret_spans(df, words_path=PATH).collect()}
    for i, text in enumerate(plain):
        assert "guess" not in got[i]["spans"], text
    for i, (text, want) in enumerate(secret.items(), len(plain)):
        assert want in got[i]["spans"].split(","), (text, got[i])
    assert got[plain.index("pwd: ab")]["guess_costs"].startswith("5:7:")  # short values are costed too


def test_a_long_value_in_a_credential_context(spark):
    text = "key before. password: " + "z9" * 300_000 + " and secret=" + "".join(random.Random(2).choices("abcXYZ019!#", k=400_000))
    (row,) = sc.secret_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), words_path=PATH).collect()
    assert len(row["guess_costs"].split(",")) == 2 and row["guess_costs"].endswith(":50.00")


def test_dictionary_ranks():
    ranks = sc.dictionary(PATH)
    assert len(ranks) > 20_000 and ranks["password"] == 1 and ranks["the"] < ranks["elephant"] < 40_000
    assert all(a == b or ranks[a] != ranks[b] for a, b in itertools.combinations(list(ranks)[:200], 2))
