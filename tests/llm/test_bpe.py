import random

import pytest
from tokenizers import Tokenizer

from tilewright.llm.bpe import Bpe, encode_documents
from tilewright.llm.queries import VOCABULARY

PIECES = ["a", "e", "the", "ing", " ", "  ", "\n", "\t", "\r\n", "'s", "'S", "é", "é", " ", " ", "　", "​", "\x1c", "\x85", "٣", "²", "½", "一", "の"]
PIECES += ["👨‍🔬", "-", "--", "==", "1", "23", "<|endoftext|>", "_", "Ж", "ß", "\x00", "᠎", "ǅ", "ः", "\U0001d400", "ａ"]


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def bpe():
    with open(VOCABULARY, "rb") as f:
        return Bpe(f.read())


def test_random_texts(bpe, public):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 25))) for _ in range(4000)]
    texts += ["a" * 3000, "=" * 1000, " " * 700, "ab" * 800, "日本" * 900, "".join(rnd.choice("abcdefgh") for _ in range(5000))]
    assert [x.tolist() for x in bpe.encode_batch(texts)] == public(texts)


def test_pair_check_is_exact(bpe):
    import numpy as np

    rnd = random.Random(2)
    ids = list(bpe.ids.items())
    pairs = [(rnd.choice(ids), rnd.choice(ids)) for _ in range(3000)]
    ok = bpe.stable(np.array([a[1] for a, _ in pairs]), np.array([b[1] for _, b in pairs]))
    assert ok.tolist() == [bpe.merged(a[0] + b[0]) == [a[1], b[1]] for a, b in pairs]


def test_defined_results_for_null_and_empty(spark, public):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello world", "x"), (3, "Hello world", "x"), (None, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r["doc_id"], r["ids"]) for r in encode_documents(df, VOCABULARY, batch_chars=3).collect()), key=repr)
    hello, a = public(["Hello world", "a"])
    assert got == sorted([(1, []), (2, []), (3, hello), (3, hello), (None, a)], key=repr)
    assert encode_documents(df.where("false"), VOCABULARY).collect() == []
