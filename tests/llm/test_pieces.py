import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from listwright.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
HARD = ["", " ", "  ", "\n", "a\n\n b", " lead", "trail ", "▁a ▁", "a▁b\n▁", "\ttab\r\nx", "é\u0301 ÜÖ", "日本語 テキスト", "\x00a b",
        "<s> </s> <unk> <0x0A>", "x" * 30_000, "a  b   c" + " " * 40, "🙂🙃 \u200d", "\u00a0a\u3000b", "ﬁ ½ İ"]


def same(text):
    own = pieces.encoder(MODEL)
    ids = own.encode(text)
    assert ids == LIBRARY.encode(text) and own.decode(ids) == LIBRARY.decode(LIBRARY.encode(text))
    assert own.joined(ids) == ",".join(map(str, ids))


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n▁ab.,Éß\r\t"), st.characters(codec="utf-8")), max_size=60))
def test_any_text(text):
    same(text)


def test_a_full_table_is_emptied_and_goes_on():
    own = pieces.ChunkEncoder(MODEL, table_size=3)
    text = "one two three four five one two\nthree"
    assert own.encode(text) == LIBRARY.encode(text) and len(own) <= 3


def test_columns(spark):
    docs = spark.createDataFrame([(1, "Hello there"), (2, None), (3, ""), (1, "Hello there")], "doc_id long, text string")
    rows = docs.select("doc_id", pieces.encoded(docs["text"], MODEL).alias("ids"))
    back = rows.select("doc_id", "ids", pieces.decoded(rows["ids"], MODEL).alias("text")).collect()
    ids = LIBRARY.encode("Hello there")
    assert sorted((r["doc_id"], r["ids"], r["text"]) for r in back) == [
        (1, ids, "Hello there"), (1, ids, "Hello there"), (2, [], ""), (3, [], "")]
    assert docs.limit(0).select(pieces.digests(docs["text"], MODEL).alias("x")).select("x.*").count() == 0
