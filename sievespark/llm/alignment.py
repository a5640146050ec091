"""Cross-tokenizer alignment: where the tokens of two vocabularies end at the same byte of a text.

The cumulative ends of both token sequences are merged; ends that both have cut the text into groups of tokens, and the
tokens that end there are linked. How often a pair of ids is linked in the whole corpus says how well it corresponds.
Two tokens that end together are suffixes of one another, so the pairs that can ever be linked are bounded by the two
vocabularies, whatever the corpus; ``pair_bound`` counts them, and only behind that bound are the counts broadcast.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text whose tokens are merged at a time; a longer text is one piece of its own.
PIECE = 1 << 21
#: Linked pairs that a broadcast may hold, about 100 bytes each on the executors.
MOST_PAIRS = 1 << 20
#: Fixed value: the pattern by which byte-level vocabularies of this kind cut words.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_TENS = 10 ** np.arange(1, 10)


def _byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokens:
    """A byte-level BPE vocabulary file (``tokenizers``' JSON), encoded by ``tiktoken`` where the merges allow it.

    Merges that make ids in their own order, and the plain byte-level cutting, mean the same for both libraries; any other
    file is encoded by ``tokenizers`` itself. Special tokens' strings in a text are plain text.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        held = json.loads(Path(path).read_text())
        model, cut, letters = held["model"], held["pre_tokenizer"], _byte_of_letter()
        vocab = {k: v for k, v in model["vocab"].items() if k not in {t["content"] for t in held["added_tokens"]}}
        self.bytes: list[bytes] = [b""] * (1 + max([*model["vocab"].values(), *(t["id"] for t in held["added_tokens"])]))
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[x] for x in token)
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        plain = held["normalizer"] is None and cut["type"] == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"] and not model.get("dropout") and not model.get("ignore_merges")
        if plain and [vocab.get(m) for m in made] == list(range(256, 256 + len(made))) and len(vocab) == 256 + len(made):
            own = tiktoken.Encoding("aligned", pat_str=_PATTERN, mergeable_ranks={b: i for i, b in enumerate(self.bytes) if b}, special_tokens={})
            self.encode = lambda texts: [own.encode_to_numpy(x, disallowed_special=()).astype(np.int64) for x in texts]
        else:
            whole = Tokenizer.from_file(path)
            whole.no_truncation(), whole.no_padding()
            whole.encode_special_tokens = True
            self.encode = lambda texts: [np.array(whole.encode(x, add_special_tokens=False).ids, np.int64) for x in texts]


class PieceTokens:
    """A ``sentencepiece`` model; U+2581 is a space and byte pieces are their byte."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(len(model))]
        self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.encode = lambda texts: [np.array(x, np.int64) for x in model.encode(texts, num_threads=1)]


@lru_cache(maxsize=4)
def _loaded(kind: type, path: str):
    tokens = kind(path)
    return tokens, np.array([len(b) for b in tokens.bytes], np.int64)


def pair_bound(a: ByteTokens, b: PieceTokens) -> int:
    """How many pairs of ids could end together: one's bytes are then the end of the other's."""
    mine, other = set(a.bytes) - {b""}, set(b.bytes) - {b""}
    ends = lambda tokens, into: sum(t[i:] in into for t in tokens for i in range(len(t)))
    return ends(mine, other) + ends(other, mine)


def merged_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two ascending sequences of ends hold equal ones: the places in ``a`` and the places in ``b``.

    The merge of both: for each end of ``a`` the pointer into ``b`` stands at the first end that is no smaller.
    """
    at = np.searchsorted(b, a)
    at[at == len(b)] = max(len(b) - 1, 0)
    hit = b[at] == a if len(b) else np.zeros(len(a), bool)
    return np.flatnonzero(hit), at[hit]


def _written(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The decimal ids, each followed by its byte of ``ends``, as one array of bytes; and where each begins."""
    width = np.ones(len(ids), np.int64)
    for d in _TENS[_TENS <= ids.max(initial=0)]:
        width += ids >= d
    stop = np.cumsum(width + 1)
    out = np.empty(int(stop[-1]) if len(stop) else 0, np.uint8)
    rest = ids.copy()
    for k in range(int(width.max(initial=0))):
        live = np.flatnonzero(width > k)
        out[stop[live] - 2 - k] = 48 + rest[live] % 10
        rest[live] //= 10
    out[stop - 1] = ends
    return out, stop


def align_texts(texts: list[str], a: tuple, b: tuple) -> dict[str, list]:
    """For each text its numbers of tokens and groups, the groups as ``a1,a2|b1;…``, and its linked pairs with counts."""
    (ta, la), (tb, lb) = a, b
    ia, ib = ta.encode([" " + x for x in texts]), tb.encode(texts)
    for i, x in enumerate(texts):
        raw = (" " + x).encode()
        if not x or b"".join([ta.bytes[k] for k in ia[i]]) != raw or b"".join([tb.bytes[k] for k in ib[i]]) != raw:
            ia[i] = ib[i] = np.empty(0, np.int64)
    na, nb = (np.array([len(x) for x in side], np.int64) for side in (ia, ib))
    allA, allB = np.concatenate(ia), np.concatenate(ib)
    pa_, pb = merged_ends(np.cumsum(la[allA]), np.cumsum(lb[allB]))
    # groups end at pa_ in A and pb in B; a text's end is an end in both, so no group spans two texts
    ends_a, ends_b = np.cumsum(na), np.cumsum(nb)
    first, last = np.searchsorted(pa_, ends_a - na), np.searchsorted(pa_, ends_a)
    behind_a, behind_b = pa_ + 1, pb + 1
    # each token's place when every group's A tokens come before its B tokens
    sizes_a, sizes_b = np.diff(behind_a, prepend=0), np.diff(behind_b, prepend=0)
    place_a = np.arange(len(allA)) + np.repeat(behind_b - sizes_b, sizes_a)
    place_b = np.arange(len(allB)) + np.repeat(behind_a, sizes_b)
    ids, marks = np.empty(len(allA) + len(allB), np.int64), np.full(len(allA) + len(allB), ord(","), np.uint8)
    ids[place_a], ids[place_b] = allA, allB
    marks[place_a[pa_]], marks[place_b[pb]] = ord("|"), ord(";")
    written, stop = _written(ids, marks)
    stop = np.concatenate([[0], stop])
    starts = stop[np.concatenate([[0], ends_a + ends_b])]
    groups = [written[s : max(s, e - 1)].tobytes().decode("ascii") for s, e in zip(starts[:-1], starts[1:])]
    keys = allA[pa_] * len(tb.bytes) + allB[pb]
    linked = [np.unique(keys[s:e], return_counts=True) for s, e in zip(first, last)]
    return {"n_a": na, "n_b": nb, "n_groups": last - first, "groups": groups, "a": [(k // len(tb.bytes)).astype(np.int32) for k, _ in linked], "b": [(k % len(tb.bytes)).astype(np.int32) for k, _ in linked], "times": [n.astype(np.int32) for _, n in linked]}


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, id, n_a, n_b, n_groups, groups, a, b, times)`` per row of ``docs``.

    ``groups`` lists the ids between common ends, ``a1,a2|b1;a3|b2,b3``; ``a``, ``b`` and ``times`` are the linked pairs of
    the text and how often each is linked in it. ``row`` tells rows apart, whatever their ids. A null or empty text, and one
    whose bytes either vocabulary does not give back, has no tokens: zeros, an empty string, no pairs. Long texts are
    aligned whole, one at a time.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = _loaded(ByteTokens, path_a), _loaded(PieceTokens, path_b)
        for frame in frames:
            texts = frame["text"].tolist()
            cuts, size = [0], 0
            for i, x in enumerate(texts):
                if size and size + len(x) > PIECE:
                    cuts, size = [*cuts, i], 0
                size += len(x)
            for s, e in zip(cuts, [*cuts[1:], len(texts)]):
                if s < e:
                    yield pd.DataFrame({"row": frame["row"].iloc[s:e].to_numpy(), "id": frame["id"].iloc[s:e].array, **align_texts(texts[s:e], a, b)})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"row bigint, id {kind}, n_a bigint, n_b bigint, n_groups bigint, groups string, a array<int>, b array<int>, times array<int>")


def _pairs(aligned: DataFrame, *keep: str) -> DataFrame:
    return aligned.select(*keep, F.explode(F.arrays_zip("a", "b", "times")).alias("p")).select(*keep, "p.a", "p.b", F.col("p.times").cast("bigint").alias("times"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(a, b, links, best_of_a, best_of_b)`` of every linked pair of ids: its links in the corpus and the highest count
    that either of its ids has with any partner. Counts are summed in tasks first; there are at most ``pair_bound`` rows."""
    counts = _pairs(aligned).groupBy("a", "b").agg(F.sum("times").alias("links"))
    best = lambda side: counts.groupBy(side).agg(F.max("links").alias(f"best_of_{side}"))
    return counts.join(best("a"), "a").join(best("b"), "b").select("a", "b", "links", "best_of_a", "best_of_b")


def link_sums(aligned: DataFrame, counts: DataFrame, bound: int) -> DataFrame:
    """``(row, n_links, n_best, count_sum)`` of every row with links: ``n_best`` counts those whose pair is linked most often
    among all of its B id, ``count_sum`` adds the pairs' counts. ``bound`` is the most rows that ``counts`` can have."""
    counts = counts.select(F.col("a").alias("ca"), F.col("b").alias("cb"), "links", "best_of_b")
    met = _pairs(aligned, "row").join(F.broadcast(counts) if bound <= MOST_PAIRS else counts, (F.col("a") == F.col("ca")) & (F.col("b") == F.col("cb")))
    best = F.when(F.col("links") == F.col("best_of_b"), F.col("times")).otherwise(0)
    return met.groupBy("row").agg(F.sum("times").alias("n_links"), F.sum(best).alias("n_best"), F.sum(F.col("times") * F.col("links")).alias("count_sum"))


def bound_of(path_a: str, path_b: str) -> int:
    return pair_bound(_loaded(ByteTokens, path_a)[0], _loaded(PieceTokens, path_b)[0])
