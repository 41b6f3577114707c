"""SentencePiece ids and decoded texts against the library on whole texts."""

import hashlib
import random

import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from eventpulse.llm.queries import SENTENCE_PIECES, op12_sentencepiece_encoding
from eventpulse.llm.sentence_pieces import PieceModel, _encoded, sentence_pieces

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=SENTENCE_PIECES)
ODD = [
    "", " ", "  ", "a", " a", "a ", "a  ", "  a  b ", "a\nb", "\n", "\t\t", "a\0b\0", "▁a▁▁b▁", "</s> <s> <unk> <0x0A> <0xE2>", "　x  y", "日本語🙂 ퟿￿ �", "é é ﬁ",
    " " * 40 + "x" + " " * 33, "x" * 3000, ("ab " * 500).strip(), "1234567890 12.5e-3", "\r\n {\r\n }\r\n", "a b\u0085c", "🏳️‍🌈👩‍👩‍👧‍👦" * 20,
]


def expected(text, end=True):
    ids = LIBRARY.encode(text, add_eos=end)
    return ids, LIBRARY.decode(ids)


def found(texts, end=True):
    out = []
    for _, _, ids, decoded in _encoded(pa.array(texts, pa.string()), SENTENCE_PIECES, end):
        out += list(zip(ids.to_pylist(), decoded.to_pylist(), strict=True))
    return out


@pytest.mark.parametrize("end", [True, False])
def test_odd_texts(end):
    assert found(ODD, end) == [expected(t, end) for t in ODD]
    assert found([None, "a", None]) == [expected(""), expected("a"), expected("")]
    assert found([]) == []


def test_random_texts_and_all_code_points():
    rng = random.Random(5)
    letters = "ab c  d\n\t .,;é漢🙂▁　\0<>/s0x" + "etaoin " * 4
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(5000)]
    assert found(texts) == [expected(t) for t in texts]
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(points[i : i + 97]) for i in range(0, len(points), 97)] + [f"x{c} {c}" for c in points[:20000]]
    assert found(texts) == [expected(t) for t in texts]


def test_very_long_texts():
    texts = [" " * 1_200_000, "\n" * 300_000, "w" * 200_000, "word " * 300_000, "a" + " \n" * 200_000 + "b"]
    assert found(texts) == [expected(t) for t in texts]


def test_query_on_documents(spark, small, odd_documents):
    want = {}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        ids, text = expected(r.text)
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op12_sentencepiece_encoding(spark, small).collect()} == want
    rows = sentence_pieces(odd_documents, ["doc_id", "text", "n_words"], SENTENCE_PIECES).collect()
    assert len(rows) == odd_documents.count() and all((r.ids, r.decoded) == expected(r.text or "") for r in rows)
    assert sentence_pieces(odd_documents.limit(0), ["doc_id"], SENTENCE_PIECES).count() == 0
    with pytest.raises(ValueError, match="clash"):
        sentence_pieces(odd_documents.withColumn("ids", F.lit(1)), ["ids"], SENTENCE_PIECES)


def test_models_whose_words_do_not_stand_apart_are_refused(monkeypatch):
    class Crossing(sentencepiece.SentencePieceProcessor):
        def id_to_piece(self, i):
            return "a▁b" if i == 500 else super().id_to_piece(i)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Crossing)
    with pytest.raises(ValueError, match="apart"):
        PieceModel(SENTENCE_PIECES)
