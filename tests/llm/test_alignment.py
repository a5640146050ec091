"""Alignment against the libraries and a plain two-pointer walk; counts against dictionaries; odd inputs."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from sievespark.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id bigint, text string, row string, a int, groups string"
ODD = ["", None, " ", "a", "  two  spaces ", "tab\tline\n\n\nend ", "▁ is a piece mark", "<s> </s> <unk> <|endoftext|>", "<0x41> A", "naïve Übermaß 日本語 😀👩‍👩‍👧", "x" * 5000, "a b " * 3000, "\x00\x01\x85 ﻿", "it's we'll DON'T", "1234567 12.5%", "é ẛ̣"]


def brute(texts):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = alignment._byte_of_letter()
    raw_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    out, counts = [], Counter()
    for t in texts:
        ia, ib = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        ra, rb = [bytes(letters[c] for c in a.id_to_token(i)) for i in ia], [raw_b(i) for i in ib]
        if not t or b"".join(ra) != (" " + t).encode() or b"".join(rb) != (" " + t).encode():
            ia, ib, ra, rb = [], [], [], []
        groups, links, i, j, x, y = [([], [])], [], 0, 0, 0, 0
        while i < len(ia) or j < len(ib):
            if x <= y and i < len(ia):
                x, i = x + len(ra[i]), i + 1
                groups[-1][0].append(ia[i - 1])
            else:
                y, j = y + len(rb[j]), j + 1
                groups[-1][1].append(ib[j - 1])
            if x == y:
                links.append((ia[i - 1], ib[j - 1]))
                groups.append(([], []))
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups[:-1])
        counts.update(links)
        out.append((len(ia), len(ib), len(groups) - 1, links, text))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(n, best.get(y, 0))
    return [(na, nb, ng, len(k), sum(counts[p] == best[p[1]] for p in k), sum(counts[p] for p in k), hashlib.sha256(s.encode()).hexdigest() if s else "") for na, nb, ng, k, s in out]


def test_the_query_equals_a_plain_walk(spark, tmp_path):
    r = random.Random(4)
    rows = [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150).collect()]
    texts = ODD + rows + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x3000), r.randrange(0x1F300, 0x1F700)])) for _ in range(r.randrange(60))) for _ in range(150)]
    rows = [(i, t, "clash", 1, "clash") for i, t in enumerate(texts)] + [(None, "a", "", 0, ""), (0, "a", "", 0, "")]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_token_alignment(spark, str(tmp_path))
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = Counter((r.doc_id, *(r[n] for n in names)) for r in found.collect())
    assert got == Counter((i, *x) for (i, *_), x in zip(rows, brute([t for _, t, *_ in rows])))
    assert all(t == "bigint" for c, t in found.dtypes if c != "groups_sha256")


def test_no_more_pairs_than_the_vocabularies_allow(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = alignment.pair_counts(alignment.align(docs, A, B)).collect()
    a, b = alignment.ByteTokens(A).bytes, alignment.PieceTokens(B).bytes
    assert counts and all(a[x.a].endswith(b[x.b]) or b[x.b].endswith(a[x.a]) for x in counts)
    assert len(counts) <= alignment.bound_of(A, B) <= alignment.MOST_PAIRS
    assert all(x.best_of_a >= x.links <= x.best_of_b for x in counts)


def test_pieces_do_not_change_the_result(monkeypatch):
    a, b = alignment._loaded(alignment.ByteTokens, A), alignment._loaded(alignment.PieceTokens, B)
    texts = ["one two three", "", "x", "four  five"]
    whole = alignment.align_texts(texts, a, b)
    each = [alignment.align_texts([t], a, b) for t in texts]
    assert whole["groups"] == [x["groups"][0] for x in each] and list(whole["n_groups"]) == [x["n_groups"][0] for x in each]
    assert [list(x) for x in whole["times"]] == [list(x["times"][0]) for x in each]


def test_another_vocabulary_file_is_encoded_by_its_own_library(tmp_path):
    path = tmp_path / "spaced.json"
    path.write_text(open(A).read().replace('"add_prefix_space":false', '"add_prefix_space":true', 1).replace('"add_prefix_space": false', '"add_prefix_space": true', 1))
    own, plain = alignment.ByteTokens(str(path)), alignment.ByteTokens(A)
    assert list(own.encode(["Hello"])[0]) == list(plain.encode([" Hello"])[0]) != list(plain.encode(["Hello"])[0])


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], DOCS), A, B).count() == 0
