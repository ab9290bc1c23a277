import os

import pyarrow.parquet as pq
import pytest

from trolley.llm import vocab

TABLE = "/root/testdata/sf0.001/documents.parquet"


@pytest.mark.parametrize("memo", [100, 500_000])
def test_pieces_give_the_ids_of_whole_texts(memo, monkeypatch):
    monkeypatch.setattr(vocab, "MEMO", memo)
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    plain = Tokenizer.from_file(vocab.vocabulary_path("word_bpe_49k.json"))
    texts = pq.read_table(TABLE)["text"].to_pylist()[:60]
    texts += ["", " \n", "It's a Test's end' 'til we'LL 've", "<|endoftext|>x <|startoftext|>", "É́te é İstanbul ΣΑΣ", "a\x1cb\x85c d e", "日本語 text漢字", "x" * 500, "3.14 v2 #a_b !!! (ok) ß STRASSE Ÿ", "word\x0b\x0cnext"]
    memo = vocab.word_bpe.__wrapped__()
    got = memo.ids([t.encode() for t in texts])
    for text, own, ids in zip(texts, plain.encode_batch(texts, add_special_tokens=False), got, strict=True):
        assert list(memoryview(ids).cast("I")) == own.ids, text
