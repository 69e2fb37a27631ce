import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from labspark.llm.sentencepiece_codec import decode, encode, encoded_documents, vocabulary
from labspark.llm.storage import new_folder
from labspark.llm.token_files import EliasFano, TokenFile, WordEncoder, token_files_of, write_token_files

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "",
    " ",
    "  two  spaces \n lines\r\n\ttabs ",
    "don't stop!! (ok), x=1; http://a.b/c?d=e&f#g <tag/>",
    "日本語 テスト 🎉🎉 é é ﬁ ß İ Σίσυφος ΑΣ",
    "<s> </s> <unk> <0x41> <|endoftext|>",
    "a\x1cb\x1fc\x85d\xa0e　f",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    "unbelievable unbelievably unbeliever unbelief",
]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(9)
    syllables = ["th", "er", "on", "an", "ing", "é", "ß", ",", ".", "!", "9", "_", "Q"]
    made = [" ".join("".join(r.choices(syllables, k=r.randint(1, 9))) for _ in range(r.randint(1, 200))) for _ in range(60)]
    return [*ODD, *made, "long " * 40_000, "z" * 3_000]


def test_encoding_equals_the_library(texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    words = vocabulary(PIECES)
    for held in ({}, {}):
        got = [np.frombuffer(x, "<u4").tolist() for x in words.encode(texts, held)]
        assert got == library.encode(texts)
    assert [words.decode(np.array(ids)) for ids in got] == [library.decode(ids) if ids else "" for ids in got] == texts


def test_states_of_a_shared_prefix_are_reused():
    words = vocabulary(PIECES)
    group = sorted({" un" + x for x in ("able", "ab", "abled", "b", "", "der", "derstand", "derstanding")})
    assert list(words.encode_sorted(group)) == [words.merge(w) for w in group]


def test_columns_in_and_out(spark, docs, texts):
    rows = [*enumerate(texts), (900, None), (None, "x"), (1, texts[1])]
    table = docs(rows).withColumnRenamed("key", "ids")
    back = decode(encode(table, PIECES), PIECES)
    assert set(back.columns) == set(table.columns) - {"ids"}
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted(rows, key=str)
    out = encoded_documents(table, PIECES).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.ids is None and r.n_tokens == 0 and r.exact is None) if r.doc_id == 900 else (r.exact and len(r.ids) == r.n_tokens)
    assert encoded_documents(table.where("false"), PIECES).count() == 0


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], list(range(1000)), [0, 2**62], sorted(random.Random(1).choices(range(10**9), k=5000))])
def test_elias_fano(values):
    data = EliasFano.of(np.array(values, np.uint64)).tobytes()
    found = EliasFano.frombytes(data)
    assert found.values().tolist() == values
    assert [found.select(i) for i in range(0, len(values), 37)] == values[::37]
    if len(values) == 5000:
        assert 8 * len(data) / len(values) < 2.1 + np.log2(10**9 / 5000)


def test_words_encode_like_whole_texts(texts):
    model = Tokenizer.from_file(WORDS)
    encoder = WordEncoder(WORDS)
    got = [np.frombuffer(x, f"<u{encoder.width}").tolist() for x in encoder.encode([*texts, None])]
    assert got == [e.ids for e in model.encode_batch([*texts, ""], add_special_tokens=False)]


def test_case_and_signs_make_no_new_words():
    model = Tokenizer.from_file(WORDS)
    encoder = WordEncoder(WORDS)
    text = "Stone stone, STONE. (stone stone! stone"
    assert np.frombuffer(encoder.encode([text])[0], f"<u{encoder.width}").tolist() == model.encode(text).ids
    encoder.encode(["Stone stone, STONE. stone! stone"])
    assert set(encoder.numbers) == {"stone", "(stone", ",", ".", "!"}


def test_words_near_signs_encode_like_whole_texts(monkeypatch):
    model = Tokenizer.from_file(WORDS)
    encoder = WordEncoder(WORDS)
    r = random.Random(10)
    bits = [*"aZ9,.;:!?'-_ \n\t\x1e\x85\xa0ªµ²¼ß×÷ÅıſŸ", "'s", "'LL", "é", "e\u0301", "İ", "Σ", "…", "<|endoftext|>", "<|ENDOFTEXT|>", "H\u0331"]
    texts = ["".join(r.choices(bits[: r.choice([14, 30, len(bits)])], k=r.randint(0, 12))) for _ in range(4000)]
    monkeypatch.setattr("labspark.llm.token_files.WORDS_HELD", 500)
    wanted = [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    for low in range(0, 4000, 400):
        got = encoder.encode(texts[low : low + 400])
        assert [np.frombuffer(x, f"<u{encoder.width}").tolist() for x in got] == wanted[low : low + 400]
        assert len(encoder.numbers) <= 500
    assert encoder.encode([]) == []


def test_files_hold_every_document_in_order(spark, docs, texts):
    rows = [(3 * i - 20, t) for i, t in enumerate(texts)] + [(2**61, None), (2**61, "again"), (None, "nameless")]
    table = docs(rows, 5)
    got = sorted(token_files_of(table, WORDS, 1).collect(), key=lambda r: r.start)
    model = Tokenizer.from_file(WORDS)
    start = 0
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for r, (name, text) in zip(got, want, strict=True):
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (name, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files_of(table.where("false"), WORDS).count() == 0


def test_random_access(spark, docs):
    made = write_token_files(docs([(i, "word " * i) for i in range(50)], 2), WORDS, 1, new_folder(spark, "test"))
    sizes = []
    for row in sorted(made.collect(), key=lambda r: r.shard):
        file = TokenFile(row.path)
        sizes += [len(file.document(i)) for i in range(file.count)]
        file.close()
    assert sizes == list(range(1, 51))
