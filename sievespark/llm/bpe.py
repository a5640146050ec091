"""BPE encoding and decoding by a trie of last-token states.

The encoding of a string is the one token sequence whose neighbours are all stable, that is, whose
concatenation is encoded as just these two tokens. So the last token of a prefix is the suffix token that
is stable after the last token of what stands before it, and one state per trie node (its last token and
where that token starts) holds the encoding of every prefix. Distinct words are visited in sorted order, which is
a depth-first walk of their trie: the states of the path to a word stay until the walk leaves them, so shared
prefixes are encoded once and only one path is held.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_caches

END = "</w>"
#: Ranges of letters and digits younger than the files' library, which takes them for neither.
YOUNGER = """
0558-0558 058B-058C 088F-088F 0C5C-0C5C 0CDC-0CDC 208F-208F 209D-209F A7CE-A7CF A7D2-A7D2 A7D4-A7D4 A7DD-A7DD A7E2-A7E2
A7F1-A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A-11B0A 11DB0-11DDB 11DE0-11DE9 11DF1-11DF1
1246F-1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 16FF4-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20
18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168-1B168 1D6A6-1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF
1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E-2B81E 2CEA2-2CEAD 323B0-33479
3D000-3FC3F
"""
#: Capitals younger than Python's tables, which the files' library does lower, as ranges with their first small letter.
CAPITALS = """
1C89-1C89:1C8A A7CB-A7CB:0264 A7CC-A7CC:A7CD A7CE-A7CE:A7CF A7D2-A7D2:A7D3 A7D4-A7D4:A7D5 A7DA-A7DA:A7DB A7DC-A7DC:019B
10D50-10D65:10D70 16EA0-16EB8:16EBB
"""
_LOWER = {int(a, 16) + i: int(to, 16) + i for span, to in (x.split(":") for x in CAPITALS.split()) for a, b in [span.split("-")] for i in range(int(b, 16) - int(a, 16) + 1)}
_HAS_CAPITAL = regex.compile("[" + "".join(map(chr, _LOWER)) + "]")
_YOUNG = "[" + "".join("-".join(rf"\U{int(x, 16):08x}" for x in pair.split("-")) for pair in YOUNGER.split()) + "]"
_HAS_YOUNG = regex.compile(_YOUNG)
#: The pre-tokeniser's pattern inside text without white space, and Unicode's White_Space.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")
_PIECE_YOUNG = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--{_YOUNG}]+|[\p{{N}}--{_YOUNG}]|(?:[^\p{{L}}\p{{N}}]|{_YOUNG})+")
_SPACE = regex.compile("[\t-\r \x85\xa0  -     　]+")
_ODD_SPACE = regex.compile("[\x1c-\x1f]")
#: Known pieces in a generation of the memo, pairs of tokens whose stability is remembered, characters read at once.
MOST_PIECES, MOST_PAIRS, CHARS_AT_ONCE = 100_000, 300_000, 2_000_000
_TAIL = 4


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class TrieCoder:
    """Encoder of one vocabulary whose words carry an end mark; text is lower-cased, white space dropped."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        vocab: dict[str, int] = model["model"]["vocab"]
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.made = {a + b: ((a, b), i) for (a, b), i in self.rank.items()}
        self.edges: tuple[dict[str, list[tuple[str, int]]], ...] = ({}, {})
        self.names = {i: t for t, i in chain(vocab.items(), self.special.items())}
        #: Tokens by their symbols, inside a word and at its end, and the longest of those with a given tail.
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(END)}
        self.final = {t[: -len(END)]: i for t, i in vocab.items() if t.endswith(END)}
        self.inner_tails, self.final_tails = self._tails(self.inner), self._tails(self.final)
        self.alphabet = byte_alphabet()
        self.bytes_as = {i: c for i, c in enumerate(self.alphabet)}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.stable: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.ids: dict[str, bytes] = {}
        self.texts: dict[str, str] = {}
        self.older: tuple[dict[str, bytes], dict[str, str]] = ({}, {})
        self.states = 0

    @staticmethod
    def _tails(tokens: dict[str, int]) -> dict[str, int]:
        out: dict[str, int] = {}
        for t in tokens:
            if len(t) >= _TAIL:
                out[t[-_TAIL:]] = max(len(t), out.get(t[-_TAIL:], 0))
        return out

    def _symbols(self, token: str) -> list[str]:
        return [*token[: -len(END) - 1], token[-len(END) - 1 :]] if token.endswith(END) and len(token) > len(END) else list(token)

    def _merged(self, parts: list[str]) -> list[str]:
        """Plain merging of a few symbols, lowest rank first, leftmost of equals."""
        parts = list(parts)
        while len(parts) > 1:
            best, at = min((self.rank.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:])))
            if best == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge_of(self, token: str, side: int) -> list[tuple[str, int]]:
        """What stands at one end of the token while it is merged (0: its start, 1: its end), each with the rank that made it."""
        if (known := self.edges[side].get(token)) is None:
            made = self.made.get(token)
            known = [(token, -1)] if made is None else [*self._edge_of(made[0][side], side), (token, made[1])]
            self.edges[side][token] = known
        return known

    def _fits(self, left: int, right: int) -> bool:
        """The two tokens stay two when their strings are encoded together; left is -1 at the start.

        Both sides merge on their own until a pair across the border ranks before the next merge at
        either end; of equal ranks the leftmost goes first.
        """
        if left < 0:
            if (known := self.whole.get(right)) is None:
                b = self.names[right]
                known = self.whole[right] = self._merged(self._symbols(b)) == [b]
            return known
        if (known := self.stable.get(left << 20 | right)) is None:
            x, y = self._edge_of(self.names[left], 1), self._edge_of(self.names[right], 0)
            i, j, known, rank, never = 0, 0, self._fits(-1, right), self.rank.get, 1 << 30
            while known:
                grow_x = x[i + 1][1] if i + 1 < len(x) else never
                grow_y = y[j + 1][1] if j + 1 < len(y) else never
                across = rank((x[i][0], y[j][0]), never)
                if across < grow_x and across <= grow_y and across != never:
                    known = False
                elif grow_x == grow_y == never:
                    break
                elif grow_x <= grow_y:
                    i += 1
                else:
                    j += 1
            if len(self.stable) >= MOST_PAIRS:
                self.stable.clear()
            self.stable[left << 20 | right] = known
        return known

    def encode_words(self, words: list[str]) -> Iterator[list[int]]:
        """Token ids of each pre-token in the byte alphabet; sorted words share the states of their common prefixes."""
        stable, fits = self.stable.get, self._fits
        inner, final, inner_tails, final_tails = self.inner.get, self.final.get, self.inner_tails.get, self.final_tails.get
        token, start, before = [-1], [0], ""
        for word in words:
            n = len(word)
            at, same = 0, min(n, len(before)) - 1
            while at < same and word[at] == before[at]:
                at += 1
            del token[at + 1 :], start[at + 1 :]
            for end in range(at + 1, n):
                for a in range(max(0, end - inner_tails(word[end - _TAIL : end], _TAIL - 1)) if end >= _TAIL else 0, end):
                    if (t := inner(word[a:end])) is not None:
                        known = stable(token[a] << 20 | t) if a else None
                        if fits(token[a], t) if known is None else known:
                            break
                else:
                    raise ValueError("a symbol is missing in the vocabulary")
                token.append(t)
                start.append(a)
            for a in range(max(0, n - final_tails(word[n - _TAIL :], _TAIL - 1)) if n >= _TAIL else 0, n):
                if (t := final(word[a:])) is not None:
                    known = stable(token[a] << 20 | t) if a else None
                    if fits(token[a], t) if known is None else known:
                        break
            else:
                raise ValueError("a symbol is missing in the vocabulary")
            self.states += n - at
            before = word
            out = [t]
            while a:
                out.append(token[a])
                a = start[a]
            out.reverse()
            yield out

    def _normal(self, text: str) -> str:
        """NFC, then each character's own lower case, so a final capital sigma is lowered like any other."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return (text.translate(_LOWER) if _HAS_CAPITAL.search(text) else text).lower()

    def words_of(self, piece: str) -> list[str | int]:
        """Pre-tokens of text without white space in the byte alphabet; special tokens' strings are ids at once."""
        if piece.isascii():
            if piece[-1] in ",.;:!?" and piece[:-1].isalpha():
                return [piece[:-1].lower(), piece[-1]]
        out: list[str | int] = []
        for part in self.split.split(piece) if self.split and "<" in piece else [piece]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                text = self._normal(part)
                for word in (_PIECE_YOUNG if not text.isascii() and _HAS_YOUNG.search(text) else _PIECE).findall(text):
                    out.append(word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.bytes_as))
        return out

    def decode(self, ids) -> str:
        """Names of the tokens joined by one space, end marks and stand-ins kept, as for a file without a decoder."""
        return " ".join([self.names[i] for i in ids])

    def learn(self, texts: list[str]) -> list[list[str]]:
        """Pieces of each text; afterwards ``ids`` and ``texts`` hold all of them.

        Pieces not met before are cut into words, the distinct words encoded in one walk and the pieces put
        together from them.
        """
        cut = [[p for p in _SPACE.split(t) if p] if _ODD_SPACE.search(t) else t.split() for t in texts]
        if len(self.ids) > MOST_PIECES:
            self.older, self.ids, self.texts = (self.ids, self.texts), {}, {}
        ids, decoded, (old_ids, old_texts) = self.ids, self.texts, self.older
        plain: dict[str, str] = {}
        mixed: dict[str, list[str | int]] = {}
        for piece in {*chain.from_iterable(cut)}.difference(ids):
            if piece in old_ids:
                ids[piece], decoded[piece] = old_ids[piece], old_texts[piece]
            elif piece.isascii() and piece.isalpha():
                plain[piece] = piece.lower()
            else:
                mixed[piece] = self.words_of(piece)
        needed = {*plain.values()}
        needed.update([w for ws in mixed.values() for w in ws if type(w) is str])
        # A plain word's own entry is its encoding; a word in the byte alphabet may look like another piece.
        words = sorted([w for w in needed if not (w in ids and w.isascii() and w.isalpha())])
        names, found, found_texts = self.names, {}, {}
        for word, out in zip(words, self.encode_words(words)):
            found[word] = array("i", out).tobytes()
            found_texts[word] = " ".join([names[i] for i in out]) if len(out) > 1 else names[out[0]]
        for piece, word in plain.items():
            ids[piece], decoded[piece] = (found[word], found_texts[word]) if word in found else (ids[word], decoded[word])
        for piece, ws in mixed.items():
            parts = [(found[w], found_texts[w]) if w in found else (ids[w], decoded[w]) if type(w) is str else (array("i", [w]).tobytes(), names[w]) for w in ws]
            ids[piece], decoded[piece] = b"".join([a for a, _ in parts]), " ".join([b for _, b in parts])
        return cut


_CODERS: dict[str, TrieCoder] = {}


def _coder(spec: str) -> TrieCoder:
    """One coder per worker process and vocabulary, so that later tasks find its trie."""
    own_caches("bpe", _CODERS.clear)
    if spec not in _CODERS:
        _CODERS.clear()
        _CODERS[spec] = TrieCoder(spec)
    return _CODERS[spec]


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>, decoded string)`` of every whole text; a null text counts as empty.

    ``vocabulary`` is the path of a ``tokenizers`` file on the driver; its few MB, whatever the corpus,
    are broadcast. Texts are read in small blocks, nothing is shuffled, rows keep their partition. A blank
    text gives an empty array and an empty string; equal rows each keep a row.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(spec.value)
        for whole in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy())
            at = 0
            while at < whole.num_rows:
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHARS_AT_ONCE, "right")))
                batch = whole.slice(at, upto - at)
                at = upto
                cut = coder.learn(batch.column(1).to_pylist())
                get_ids, get_text = coder.ids.__getitem__, coder.texts.__getitem__
                raw = [b"".join(map(get_ids, pieces)) for pieces in cut]
                bounds = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int32)
                flat = np.frombuffer(b"".join(raw), np.int32)
                decoded = pa.array([" ".join(map(get_text, pieces)) for pieces in cut], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(bounds, flat), decoded], names=["id", "ids", "decoded"])
        coder.older = ({}, {})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, decoded string")


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Adds ``out_col``, the decoded text of an array of ids; a null array gives null."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = encoded.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def text_of(ids):
        coder = _coder(spec.value)
        return ids.map(lambda x: None if x is None else coder.decode(x))

    return encoded.withColumn(out_col, text_of(ids_col))
