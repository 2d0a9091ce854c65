import base64
import random

import pytest

from radiolake.llm.tokens import PIECES, Transducer, Utf8Machine, count_tokens, decode, encode, load_ranks

tiktoken = pytest.importorskip("tiktoken")
TEXTS = ["", "hello world", "  two  blanks \n\n", "don't we'll", "漢字かな交じり文", "emoji 👩‍🚀🛰️ and é ü ß", "<|endoftext|> is text", "a" * 3000, "ab" * 9000, "=" * 20000, "\x00\x01 odd", "12345678901234567890", "​ zero", "ไม่มีสัญญาณ"]


@pytest.fixture(scope="module")
def transducer():
    return Transducer(load_ranks())


@pytest.fixture(scope="module")
def other():
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in load_ranks().splitlines())}
    return tiktoken.Encoding("other", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_another_library(transducer, other):
    rng = random.Random(3)
    alphabet = "aabcdeeghinorst  \n\t.,'-_0123éñ漢字кот👩‍🚀="
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120))) for _ in range(2000)]
    texts.append("".join(rng.choice("abcdefghij") for _ in range(30_000)))
    for t in texts:
        assert transducer.encode(t) == other.encode_ordinary(t)


def test_null_is_empty(transducer):
    assert transducer.encode(None) == [] == transducer.encode("")


def test_few_states_kept(other):
    t = Transducer(load_ranks())
    t.MOST_STATES, t.MOST_PIECES, t.SETTLE = 50, 20, 64
    rng = random.Random(5)
    for _ in range(50):
        s = "".join(rng.choice("abcdefgh é漢 ") for _ in range(rng.randint(1, 900)))
        assert t.encode(s) == other.encode_ordinary(s)


def test_utf8_machine_in_any_portions():
    rng = random.Random(4)
    odd = [0x41, 0x80, 0xBF, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xFF, 0xF4, 0x90, 0xC0]
    for _ in range(3000):
        data = bytes(rng.choice(odd) for _ in range(rng.randint(0, 12)))
        cut = rng.randint(0, len(data))
        m = Utf8Machine()
        assert m.feed(data[:cut]) + m.feed(data[cut:]) + m.end() == data.decode(errors="replace")


def test_round_trip_and_counts(spark, other):
    rows = [(i, t, "s", 5) for i, t in enumerate(TEXTS)] + [(99, None, None, None), (0, "", "s", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    ids = encode(spark, df)
    assert sorted((r["doc_id"], list(r["ids"])) for r in ids.collect()) == sorted((i, other.encode_ordinary(t or "")) for i, t, *_ in rows)
    assert sorted((r["doc_id"], r["text"]) for r in decode(spark, ids).collect()) == sorted((i, t or "") for i, t, *_ in rows)
    counted = count_tokens(spark, df.select("doc_id", "text"))
    assert sorted(map(tuple, counted.collect())) == sorted((i, len(other.encode_ordinary(t or ""))) for i, t, *_ in rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert encode(spark, df).collect() == [] and encode(spark, df).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
