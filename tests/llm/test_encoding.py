import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def ids(text):
    return bpe.encoder(bpe.vocabulary()).encode([text])[0].tolist()


CASES = ["", " ", "a", "<|endoftext|>", "don't  stop\n\n\n now \t x ", "été naïve ١٢٣", "a\r\n\r\nb c\r\n", "x" * 5000, "ab" * 3000 + "!" * 999, "\n\nx", "a\n\n", " \n", " x　y", "\r\ny", "\x00\x01", "😀😀 a😀"]


@pytest.mark.parametrize("text", CASES)
def test_ids_equal_the_public_tokenizer(public, text):
    assert ids(text) == public.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab '\n\r\t .,0é"), st.characters(codec="utf-8")), max_size=60))
def test_any_text(text):
    public = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json")) if not hasattr(test_any_text, "t") else test_any_text.t
    test_any_text.t = public
    public.encode_special_tokens = True
    assert ids(text) == public.encode(text, add_special_tokens=False).ids
    assert bpe.decode(ids(text)) == text


def test_tables(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello world"), (3, "hello world"), (None, "x")], "doc_id long, text string").withColumns({"ids": F.lit("clash"), "key": F.lit(1)})
    got = sorted(((r.doc_id or 0, r.ids) for r in bpe.encode_corpus(df).collect()), key=str)
    assert got == sorted([(1, []), (2, []), (3, [31373, 995]), (3, [31373, 995]), (0, [87])], key=str)
    assert bpe.encode_corpus(df.limit(0)).count() == 0
