"""BPE encoding and decoding by a contiguous rank array per word.

A word is an array of parts with the rank of each adjacent pair. The smallest
rank is looked up again and again; its boundary goes and the two neighbouring
ranks are refreshed. White space never lies in a word, so a text is the
concatenation of its white-space tokens, and each distinct token of a batch (of
up to CHARS characters, or one text) is encoded once. Its words are merged side
by side: up to SHORT parts they are rows of one matrix, and a step takes one
boundary from each row. Longer ones are merged one by one, those of more than
LONG parts with a heap, as the scan is quadratic.

Defined results: null and empty texts have no ids and decode to the empty
string; null keys pass through; repeated rows stay repeated; other columns of
the input are not read, so clashing names cannot matter.
"""
from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import attach, table
from .shared import borrowed, sized, slices, two

NONE = 1 << 60
SHORT, LONG, ROWS = 48, 200, 8192
CHARS = 4_000_000
STOPS = ",.;:!?%&$#*|"  # ASCII symbols that begin no contraction
# The definition in the tokenizer's file (split pattern, added tokens, white space).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{L}\p{N}]+"
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run of so many."""
    upto = np.cumsum(size)
    return np.repeat(start - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)


class Codec:
    """Encoder and decoder of one vocabulary file; one lives in each Python worker."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model = made["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in made["added_tokens"]}
        self.names = {**{i: s for s, i in vocab.items()}, **{i: s for s, i in self.special.items()}}
        letters = byte_letters()
        self.inner = [vocab[x] for x in letters]
        self.last = [vocab[x + end] for x in letters]
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.ranks[vocab[a] << 20 | vocab[b]] = len(self.made)
            self.made.append(vocab[a + b])
        self.split = regex.compile(SPLIT).findall
        self.odd = regex.compile("[\x1c-\x1f]").search
        self.spaces = regex.compile(f"[{SPACE}]+").split
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.made_ids = np.array(self.made, np.int64)
        self.pairs = np.array(sorted(self.ranks), np.int64)
        self.pair_ranks = np.array([self.ranks[p] for p in self.pairs.tolist()], np.int64)
        self.inner_ids, self.last_ids = np.array(self.inner, np.int64), np.array(self.last, np.int64)
        self.token_names = pa.array([self.names.get(i) for i in range(max(self.names) + 1)], pa.string())

    def looked_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it has none."""
        asked = left << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, asked), len(self.pairs) - 1)
        return np.where(self.pairs[at] == asked, self.pair_ranks[at], NONE)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has); short ones are grouped by length."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        found, count = [], size.copy()
        for i in np.flatnonzero(size > SHORT).tolist():
            made = self.word(raw[i])
            found.append((np.array([i]), np.array(made, np.int64)))
            count[i] = len(made)
        for top in range(4, SHORT + 4, 4):
            rows = np.flatnonzero((size > top - 4) & (size <= top))
            for at in range(0, len(rows), ROWS):
                part = rows[at : at + ROWS]
                ids, count[part] = self.merged_rows([raw[i] for i in part.tolist()], size[part], top)
                found.append((part, ids))
        start, flat = np.cumsum(count) - count, np.zeros(int(count.sum()), np.int64)
        for part, ids in found:
            flat[spread(start[part], count[part])] = ids
        return flat, count

    def merged_rows(self, raw: list[bytes], size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each word has) of words of at most width bytes: in each step every row loses the boundary of least rank."""
        joined = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in raw]), np.uint8).reshape(len(raw), width)
        parts, every = self.inner_ids[joined], np.arange(len(raw))
        parts[every, size - 1] = self.last_ids[joined[every, size - 1]]
        inside = np.arange(1, width) < size[:, None]
        ranks = np.full(inside.shape, NONE)
        ranks[inside] = self.looked_up(parts[:, :-1][inside], parts[:, 1:][inside])
        made, live, left = np.zeros((len(raw), width), np.int64), every, size.copy()
        while ranks.shape[1]:
            at = ranks.argmin(axis=1)
            least = ranks[every, at]
            if (least == NONE).any():
                open_ = least != NONE
                made[live[~open_], : parts.shape[1]] = parts[~open_]
                parts, ranks, at, least, live = parts[open_], ranks[open_], at[open_], least[open_], live[open_]
                every = np.arange(len(live))
                if not len(live):
                    break
            left[live] -= 1
            new = self.made_ids[least]
            parts[every, at] = new
            keep = np.ones(parts.shape, bool)
            keep[every, at + 1] = False
            parts = parts[keep].reshape(len(live), -1)
            keep = np.ones(ranks.shape, bool)
            keep[every, at] = False
            ranks = ranks[keep].reshape(len(live), -1)
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.looked_up(parts[before, at[before] - 1], new[before])
            after = np.flatnonzero(at + 1 < left[live])
            ranks[after, at[after]] = self.looked_up(new[after], parts[after, at[after] + 1])
        made[live, : parts.shape[1]] = parts
        return made[np.arange(width) < left[:, None]], left

    def word(self, raw: bytes) -> list[int]:
        parts = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        return self.merged(parts) if len(parts) <= LONG else self.merged_long(parts)

    def merged(self, parts: list[int]) -> list[int]:
        look, made = self.ranks.get, self.made
        ranks = [look(a << 20 | b, NONE) for a, b in zip(parts, parts[1:])]
        least = min(ranks)
        while least != NONE:
            i = ranks.index(least)
            parts[i] = new = made[least]
            del parts[i + 1], ranks[i]
            if not ranks:
                break
            if i:
                ranks[i - 1] = look(parts[i - 1] << 20 | new, NONE)
            if i < len(ranks):
                ranks[i] = look(new << 20 | parts[i + 1], NONE)
            least = min(ranks)
        return parts

    def merged_long(self, parts: list[int]) -> list[int]:
        """The same merges from a heap of (rank, place) over linked parts."""
        look, made, n = self.ranks.get, self.made, len(parts)
        before, after, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := look(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j] = made[r], False
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y >= 0 and (s := look(parts[x] << 20 | parts[y])) is not None:
                    heapq.heappush(heap, (s, x, parts[x], parts[y]))
        return [p for p, live in zip(parts, alive) if live]

    def spaced(self, text: str) -> list[str]:
        """The white-space tokens of a text; an added token is marked by a space before it."""
        if "<|" in text and len(parts := self.cut(text)) > 1:
            return [t for x in parts for t in ([" " + x] if x in self.special else self.spaced(x))]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # lower() alone would look at a sigma's neighbours
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return [w for w in self.spaces(text) if w] if self.odd(text) else text.split()

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text begins and the last ends)."""
        tokens: list[str] = []
        ends = [0]
        for text in texts:
            tokens += self.spaced(text)
            ends.append(len(tokens))
        coded = pa.array(tokens, pa.string()).dictionary_encode()
        del tokens
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        flat, size = self.distinct(coded.dictionary)
        each = size[index]
        upto = np.concatenate([[0], np.cumsum(each)])
        return flat[spread((np.cumsum(size) - size)[index], each)], upto[ends]

    def distinct(self, tokens: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all tokens, how many each has)."""
        place: dict[str, int] = {}
        own, many, special = [], [], {}
        # as object arrays: far cheaper than to_pylist
        named, stems = (x.to_numpy(zero_copy_only=False).tolist() for x in (tokens, pc.utf8_rtrim(tokens, STOPS)))
        for token, stem in zip(named, stems):
            if stem.isalpha():
                own.append(place.setdefault(stem, len(place)))
                if len(stem) == len(token):
                    many.append(1)
                else:
                    own.append(place.setdefault(token[len(stem) :], len(place)))
                    many.append(2)
            elif token[0] == " ":
                special[len(many)] = self.special[token[1:]]
                many.append(0)
            else:
                found = self.split(token)
                own += [place.setdefault(w, len(place)) for w in found]
                many.append(len(found))
        ids, size = self.words(list(place))
        words, count = np.array(own, np.int64), np.array(many, np.int64)
        start, each = (np.cumsum(size) - size)[words], size[words]
        flat = ids[spread(start, each)]
        sums = np.concatenate([[0], np.cumsum(each)])
        upto = np.cumsum(count)
        total = sums[upto] - sums[upto - count]
        if special:
            at = np.array(list(special))
            flat = np.insert(flat, (np.cumsum(total) - total)[at], list(special.values()))
            total[at] = 1
        return flat, total

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by spaces, word ends included."""
        return " ".join(map(self.names.__getitem__, ids))

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """The decoded text of each list; an id that isn't in the vocabulary is an error."""
        flat = ids.flatten()
        if len(flat) and (pc.min(flat).as_py() < 0 or pc.max(flat).as_py() >= len(self.token_names)):
            raise KeyError("an id outside of the vocabulary")
        named = self.token_names.take(flat)
        if named.null_count:
            raise KeyError("an id outside of the vocabulary")
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), named), " ")


@lru_cache(4)
def codec(path: str) -> Codec:
    return Codec(path)


def bpe_encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of each row's whole text."""
    path = path or default_path()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(path)
        with borrowed():
            for b in sized(batches, 1, CHARS):
                ids, ends = known.encode_all(b.column(1).to_pylist())
                made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), made], ["doc_id", "ids"])

    return two(df, key, text).mapInArrow(kernel, "doc_id long, ids array<int>")


def bpe_decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, ids, text): ids back to text; null ids decode to the empty text."""
    path = path or default_path()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(path)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), known.decode_all(b.column(1))], ["doc_id", "ids", "text"])

    some = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    return some.mapInArrow(kernel, "doc_id long, ids array<int>, text string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents encoded, decoded again, and both digested."""
    attach(spark)
    both = bpe_decode(bpe_encode(table(spark, sf_dir, "documents")))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


QUERIES = {"op1_bpe": op1_bpe}
ORACLE_SQL: dict[str, str] = {}
