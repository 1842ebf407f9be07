"""BPE encoding and decoding by tree concatenation.

Texts of up to WHOLE characters are encoded as they are. A longer text is cut, wherever that falls,
into 2**k halves of halves; Spark deals them out and they are encoded apart. Then neighbours are
joined pair by pair, up a tree: a window of text around each join is encoded again and grows until
its tokens agree with the left half's where it begins and with the right half's where it is left.

Why agreement is enough. A word's tokens are its BPE encoding exactly if each adjacent pair of them
is the encoding of its own two strings (each merge of the vocabulary uses only symbols of the
alphabet or of earlier merges, which is checked), and the word pattern never looks back. So the left
half's tokens before the window, the window's up to the agreement and the right half's after it are
the whole text's, if both ends lie between two words or between two tokens of one word that both
sides have, away from contractions and from strings of special tokens, and before a character that
no normalisation joins to the one before it. Where no such place is found the window ends up as the
whole of both halves, which is exact without any argument.

Defined cases: a null text counts as empty and has no ids; a null doc_id is kept; repeated rows are
each encoded; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import PLAIN, stretch_ids, token_bytes

#: Characters up to which a text is encoded whole, and to which a half is cut at least.
WHOLE, HALF = 32_768, 8_192
#: Characters that a window first takes on either side of a join.
WINDOW = 64
#: Rows whose texts and ids a worker holds at a time.
ROWS = 1_000
VOCABULARY = "word_bpe_49k.json"
_tokenizers: dict = {}
_lengths: dict = {}


def tokenizer(name: str):
    """(tokenizer, margin): loaded once a worker. margin: characters near a cut within which words are
    not certain: those of the longest special token, 3 at least for a contraction."""
    if name not in _tokenizers:
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        path = name if "/" in name else public_tokenizers.path(name)
        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"].get("merges", [])]
        made = {"".join(p): i for i, p in enumerate(pairs)}
        if any(made.get(part, -1) >= i for i, p in enumerate(pairs) for part in p):
            raise ValueError(f"{name}: a merge uses the result of a later one, so its encodings cannot be joined")
        _tokenizers[name] = found, max([3, *(len(t["content"]) for t in spec["added_tokens"])]) + 1
    return _tokenizers[name]


@dataclass
class Tokens:
    """Ids of a stretch of a text, with each token's place in the text and the number of its word."""

    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray
    word: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)

    def part(self, a: int, b: int | None = None) -> Tokens:
        return Tokens(self.ids[a:b], self.start[a:b], self.end[a:b], self.word[a:b])

    def opens(self) -> np.ndarray:
        """Each token's word's start."""
        first = np.concatenate(([True], self.word[1:] != self.word[:-1])) if len(self) else np.zeros(0, bool)
        return self.start[np.maximum.accumulate(np.where(first, np.arange(len(self)), 0))] if len(self) else self.start


def encoded(model, text: str, at: int) -> Tokens:
    """The library's encoding of a stretch of text that begins at `at`."""
    e = model.encode(text, add_special_tokens=False)
    place = np.array(e.offsets, np.int64).reshape(-1, 2) + at
    return Tokens(np.array(e.ids, np.uint32), place[:, 0], place[:, 1], np.array(e.word_ids, np.int64))


def halved(name: str, text: str) -> Tokens:
    """encoded(model, text, 0) by the stretches between blanks and line ends, at which no word goes on.

    The ids of a stretch that normalisation only lowers are remembered; its tokens stand one after
    another, so their places are sums of the characters that begin in each, and a token that begins
    within a character has that one too. Other stretches are the library's."""
    (model, _), known = tokenizer(name), stretch_ids(name)
    if known is None:
        return encoded(model, text, 0)
    if name not in _lengths:
        import regex

        strings = [model.id_to_token(i) for i in range(model.get_vocab_size())]
        inner = {chr(c) for c in (*range(161, 173), *range(174, 192), *range(290, 324))}  # the byte-level alphabet's 0x80 to 0xbf
        bare = [x.removesuffix("</w>") for x in strings]
        _lengths[name] = np.array([sum(c not in inner for c in x) for x in bare]), np.array([x[:1] in inner for x in bare], np.int64), np.array([x.endswith("</w>") for x in strings]), regex.compile(PLAIN)
    length, inside, closes, plain = _lengths[name]
    parts, rows, others = text.replace("\n", " ").split(" "), [], {}
    for k, p in enumerate(parts):
        if (p.isprintable() if p.isascii() else plain.fullmatch(p)) and "<|" not in p:
            rows.append(known[p])
        else:
            others[k] = encoded(model, p, 0)
            rows.append(others[k].ids.astype("<u4").tobytes())
    ids, n = np.frombuffer(b"".join(rows), "<u4"), np.array([len(r) // 4 for r in rows])
    first, at = np.cumsum(n) - n, np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
    of, size = np.repeat(np.arange(len(parts)), n), length[ids]
    ends = np.cumsum(size)
    end = ends - np.concatenate(([0], ends))[first][of] + at[of]
    start, new = end - size - inside[ids], np.concatenate(([True], closes[ids][:-1] | (np.diff(of) != 0)))[: len(ids)]
    for k, t in others.items():
        here = slice(first[k], first[k] + n[k])
        start[here], end[here], new[here] = t.start + at[k], t.end + at[k], np.diff(t.word, prepend=-1) != 0
    return Tokens(ids, start, end, np.cumsum(new))


def chained(parts: list[Tokens]) -> Tokens:
    """Parts one after another; only the changes of their words' numbers matter, so each goes on from the last."""
    words, top = [], 0
    for p in parts:
        words.append(p.word - (p.word[0] if len(p) else 0) + top)
        top = int(words[-1][-1]) + 1 if len(p) else top
    return Tokens(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("ids", "start", "end")), np.concatenate(words))


def settled(c: str) -> bool:
    """Whether normalisation leaves a character apart from the one before it: no mark, no inner or final jamo."""
    return unicodedata.category(c)[0] != "M" and not 0x1160 <= ord(c) <= 0x11FF


def _between(t: Tokens, i: int, opens: np.ndarray, text: str) -> str | None:
    """'word' if a word begins with token i, 'token' if a word goes on there, at a place where it may be parted."""
    if i == 0 or t.start[i] < t.end[i - 1] or not settled(text[t.start[i]]):
        return None
    if t.word[i] != t.word[i - 1]:
        return "word"
    return "token" if t.start[i] == t.end[i - 1] and t.start[i] - opens[i] >= 4 else None


def joined(model, margin: int, text: str, left: Tokens, right: Tokens, low: int, at: int, high: int) -> Tokens:
    """The encoding of text[low:high] from those of text[low:at] and text[at:high]."""
    reach, of_left, of_right = max(WINDOW, margin), left.opens(), right.opens()
    while True:
        i, begin = 0, low
        for k in range(int(np.searchsorted(left.start, at - reach, "right")) - 1, 0, -1):
            kind = _between(left, k, of_left, text)
            if kind == "word" or kind == "token" and text[left.start[k]] != "'":
                i, begin = k, int(left.start[k])
                break
        stop = min(high, at + 2 * reach)
        own = encoded(model, text[begin:stop], begin)
        same = i == 0 or len(own) > 0 and own.start[0] == begin and (_between(left, i, of_left, text) == "word" or own.ids[0] == left.ids[i] and own.end[0] == left.end[i])
        if same:
            places, of_own = {int(p): k for k, p in enumerate(right.start)} if len(right) < 4096 else None, own.opens()
            for j in range(1, len(own)):
                p = int(own.start[j])
                if p < at + margin or p > stop - margin and stop < high:
                    continue
                k = places.get(p, 0) if places is not None else int(np.searchsorted(right.start, p))
                if k == 0 or k >= len(right) or right.start[k] != p:
                    continue
                kind = _between(own, j, of_own, text)
                if kind is None or kind != _between(right, k, of_right, text):
                    continue
                if kind == "word" or own.ids[j - 1] == right.ids[k - 1] and own.start[j - 1] == right.start[k - 1]:
                    if kind == "word":
                        return chained([left.part(0, i), own.part(0, j), right.part(k)]) if i == 0 or left.word[i] != left.word[i - 1] else _within(left, i, own.part(0, j), right.part(k), False)
                    return _within(left, i, own.part(0, j), right.part(k), True)
            if stop == high:
                return chained([left.part(0, i), own]) if i == 0 or left.word[i] != left.word[i - 1] else _within(left, i, own, None, False)
        if begin == low and stop == high:
            return own
        reach *= 2


def _within(left: Tokens, i: int, own: Tokens, right: Tokens | None, inside: bool) -> Tokens:
    """Parts one after another, of which the second goes on within the first's word, or the third within the second's."""
    goes_on = i > 0 and left.word[i] == left.word[i - 1]
    a = left.part(0, i)
    words = [a.word, own.word - own.word[0] + (int(a.word[-1]) + (0 if goes_on else 1) if i else 0)]
    parts = [a, own]
    if right is not None and len(right):
        parts.append(right)
        words.append(right.word - right.word[0] + int(words[1][-1]) + (0 if inside else 1))
    return Tokens(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("ids", "start", "end")), np.concatenate(words))


def cuts(n: int, half: int) -> list[int]:
    """Where a text of n characters is cut: halves of halves, until none is longer than `half`."""
    k = max(0, -(-n // half) - 1).bit_length()
    return [(i * n) >> k for i in range((1 << k) + 1)]


def concatenated(model, margin: int, text: str, parts: list[Tokens], edges: list[int]) -> Tokens:
    """The whole text's encoding from its halves', joined pair by pair up the tree."""
    while len(parts) > 1:
        parts = [joined(model, margin, text, parts[i], parts[i + 1], edges[i], edges[i + 1], edges[i + 2]) for i in range(0, len(parts), 2)]
        edges = edges[::2]
    return parts[0]


_CUT = "doc_id long, digest binary, half int, n_halves int, piece string"


def decoder(name: str):
    """Array of ids -> text, special tokens included."""
    model, _ = tokenizer(name)
    if model.decoder is not None:
        return lambda ids: model.decode(ids.tolist(), skip_special_tokens=False)
    shown = [model.id_to_token(i) for i in range(model.get_vocab_size())]
    return lambda ids: " ".join([shown[i] for i in ids.tolist() if i < len(shown)])  # tokens between blanks, unknown ids left out


def encode(docs: DataFrame, name: str = VOCABULARY, whole: int = WHOLE, half: int = HALF, decoded: bool = False) -> DataFrame:
    """(doc_id, ids): every text's ids as little-endian unsigned 32-bit integers, one row a document; with
    decoded also the text that decode() makes of them, by the same workers.

    A long text's halves are counted by document and content before they are dealt out, so many
    repeated rows are encoded once; no more than one document is held at a time when they are joined.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    schema = "doc_id long, ids binary" + ", text string" * decoded

    def short(batches):
        back = decoder(name) if decoded else None
        for b in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            ids = token_bytes(b.column("text").to_pylist(), name)
            more = {"text": pa.array([back(np.frombuffer(x, "<u4")) for x in ids], pa.string())} if decoded else {}
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "ids": pa.array(ids, pa.binary())} | more)

    def cut(batches):
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                edges, digest = cuts(len(text), half), hashlib.sha256(text.encode()).digest()
                n = len(edges) - 1
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id] * n, pa.int64()), "digest": [digest] * n, "half": pa.array(range(n), pa.int32()), "n_halves": pa.array([n] * n, pa.int32()), "piece": [text[a:b] for a, b in zip(edges, edges[1:], strict=False)]})

    def apart(batches):
        for b in batches:
            found = [halved(name, p) for p in b.column("piece").to_pylist()]
            more = {"ids": [t.ids.astype("<u4").tobytes() for t in found], "places": [np.concatenate((t.start, t.end, t.word)).astype("<u2" if half < 1 << 16 else "<u4").tobytes() for t in found]}
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, more.values())], [*b.schema.names, *more])

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        model, margin = tokenizer(name)
        pdf = pdf.sort_values("half")
        text = "".join(pdf.piece)
        edges, parts = cuts(len(text), half), []
        for at, ids, places in zip(edges, pdf.ids, pdf.places, strict=False):
            start, end, word = np.frombuffer(places, "<u2" if half < 1 << 16 else "<u4").astype(np.int64).reshape(3, -1)
            parts.append(Tokens(np.frombuffer(ids, "<u4"), start + at, end + at, word))
        ids, n = concatenated(model, margin, text, parts, edges).ids.astype("<u4"), int(pdf.n.iloc[0])
        more = {"text": [decoder(name)(ids)] * n} if decoded else {}
        return pd.DataFrame({"doc_id": pd.array([None if pd.isna(pdf.doc_id.iloc[0]) else int(pdf.doc_id.iloc[0])] * n, "Int64"), "ids": [ids.tobytes()] * n} | more)

    few = own.where(F.char_length("text") <= whole).mapInArrow(short, schema)
    halves = own.where(F.char_length("text") > whole).mapInArrow(cut, _CUT).groupBy("doc_id", "digest", "half", "n_halves", "piece").agg(F.count("*").alias("n"))
    dealt = halves.mapInArrow(apart, f"{_CUT}, n long, ids binary, places binary")
    return few.unionByName(dealt.groupBy("doc_id", "digest").applyInPandas(together, schema))


def decode(ids: Column, name: str = VOCABULARY) -> Column:
    """The text of ids (little-endian unsigned 32-bit), special tokens included; null for null."""

    @F.pandas_udf("string")
    def run(c: pd.Series) -> pd.Series:
        back = decoder(name)
        return c.map(lambda b: None if b is None else back(np.frombuffer(b, "<u4")))

    return run(ids)
