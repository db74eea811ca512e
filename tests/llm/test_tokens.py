import random

import pytest

tiktoken = pytest.importorskip("tiktoken")
pytestmark = pytest.mark.skipif(not __import__("os").path.exists("/opt/tokenizers"), reason="no vocabulary files")

from codeloom.llm import tokens as T  # noqa: E402

ALPHABET = "ab 'x1.,\n\té日本語 　\U0001f600\x1c\x85 s"


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{T.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def in_chunks(text):
    encoding, data, start, parts = T.tokenizer(), text.encode(), 0, []
    for end, sure in T.cuts(data):
        parts.append((T.encode(data[start:end].decode(), encoding), sure))
        start = end
    return T.join(parts, encoding), len(parts)


@pytest.mark.parametrize("seed", range(6))
def test_random_texts(whole, seed):
    rng = random.Random(seed)
    for _ in range(25):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 6000)))
        assert in_chunks(text)[0] == whole(text)


def test_texts_without_word_ends(whole):
    rng = random.Random(9)
    for letters in ("abcdefgh", "日本語能力", "+-*/=", "\n\t 　", "0123456789"):
        text = "".join(rng.choice(letters) for _ in range(20_000))
        got, chunks = in_chunks(text)
        assert got == whole(text) and chunks > 1


def test_special_tokens_and_long_white_space(whole):
    for text in ("<|endoftext|> and <|endoftext|>", " " * 50_000, ("\n " * 9000 + "x") * 2, "", " ", "'s", "don't  stop\n\n"):
        assert in_chunks(text)[0] == whole(text)


def test_every_document_once(spark, whole):
    shared = "The same passage stands in many texts, word for word, over and over. " * 20
    rows = [(1, shared + "one"), (2, shared + "two"), (3, None), (4, ""), (5, "x"), (5, "x"), (None, "y"), (6, "語" * 9000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as uid", "'a' as key", "2 as seq")
    got = sorted(((r.doc_id, list(r.ids)) for r in T.encode_corpus(frame).collect()), key=str)
    assert got == sorted(((i, whole(t or "")) for i, t in rows), key=str)
    sizes = sorted(((r.doc_id, r.n_tokens) for r in T.token_counts(frame).collect()), key=str)
    assert sizes == sorted(((i, len(whole(t or ""))) for i, t in rows), key=str)
    assert T.encode_corpus(spark.createDataFrame([], "doc_id long, text string")).collect() == []
