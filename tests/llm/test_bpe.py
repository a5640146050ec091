"""BPE by trie: ids and decoded texts equal the library's, odd inputs."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from sievespark.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id bigint, text string, ids string, id int, decoded string"


def texts():
    r = random.Random(6)
    parts = ["the", "Quick", "tokenization's", "don't", "I'LL", "naïve", "İstanbul", "ΣΊΣΥΦΟΣ", "ß", "𝒳", "中文字", "٣٤", "123456", "!!??", "<|endoftext|>", "a<|startoftext|>b", "<|END", "é", "é", "İ", "\x1c", "\x85", "　", "_-_", "x" * 60, "🙂👍🏽", "\x00", "'s", "''re", "﻿"]
    out = ["".join(r.choice(parts) + r.choice(["", " ", "\n", "  "]) for _ in range(r.randint(0, 25))) for _ in range(400)]
    out += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x500), r.randrange(0x2000, 0x3000), r.randrange(0x1F300, 0x1F700)])) for _ in range(40)) for _ in range(200)]
    return out + ["", "   ", "w" * 20_000, "ab " * 5000, "aeinrst" * 2000]


def test_equals_the_library(spark):
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    rows = [(i, t, "clash", 1, "clash") for i, t in enumerate(texts())] + [(9000, None, "", 0, ""), (None, "some words", "", 0, ""), (0, texts()[0], "", 0, "")]
    found = bpe.encode_decode(spark.createDataFrame(rows, DOCS), PATH).collect()
    assert len(found) == len(rows)
    by = {x.id: x for x in found}
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert by[i].ids == ids, text
        assert by[i].decoded == library.decode(ids, skip_special_tokens=False), text


def test_decode_column_and_empty_table(spark):
    table = spark.createDataFrame([(1, [320, 1929]), (2, []), (3, None)], "k int, ids array<int>")
    library = Tokenizer.from_file(PATH)
    assert [x.text for x in bpe.decode(table, PATH).orderBy("k").collect()] == [library.decode([320, 1929], skip_special_tokens=False), "", None]
    assert bpe.encode_decode(spark.createDataFrame([], DOCS), PATH).count() == 0


def test_prefixes_are_encoded_once():
    coder = bpe.TrieCoder(open(PATH, encoding="utf-8").read())
    alone = [list(coder.encode_words([w]))[0] for w in ("internist", "interning")]
    coder.states = 0
    assert list(coder.encode_words(["interning", "internist"])) == alone[::-1]
    assert coder.states == len("interning") + len("st")


def test_every_code_point():
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    coder = bpe.TrieCoder(open(PATH, encoding="utf-8").read())
    points = [x for x in range(0x110000) if not 0xD800 <= x < 0xE000]
    for at in range(0, len(points), 20_000):
        some = [f"x{chr(x)}1" for x in points[at : at + 20_000]]
        cut = coder.learn(some)
        got = [memoryview(b"".join(coder.ids[p] for p in pieces)).cast("i").tolist() for pieces in cut]
        assert got == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
