"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct words of a chunk of texts lie in one array of symbols with links to the next and the previous symbol. The
index maps each pair that has a rank to all its positions. Ranks are taken in ascending order; one step merges every
position of a pair at once and enters the pairs that this makes. A pair is made after both its symbols, so its rank is
higher than theirs and this order gives each word the same merges as working on it alone.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from gridloom.llm.common import trim

# The pre-tokeniser's pattern of byte-level BPE vocabularies of this family.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
SPACE = r"\t-\r \x85\xa0  -     　"
LATIN_LETTER, LATIN_NUMBER, LATIN_SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"


def _pattern(letter: str, number: str, space: str) -> str:
    return f"{CONTRACTIONS}| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"


#: The same rule twice: texts within Latin-1 need no Unicode tables, which is much faster.
ANY = regex.compile(_pattern(r"\p{L}", r"\p{N}", SPACE))
LATIN = re.compile(_pattern(LATIN_LETTER, LATIN_NUMBER, LATIN_SPACE))
#: Characters of text encoded together, and distinct words kept from one chunk to the next.
CHUNK_CHARS, KEPT_WORDS = 4_000_000, 100_000
#: Up to so many positions of a pair are merged one by one, more with array operations.
FEW = 10


def words_of(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return ANY.findall(text)
    return LATIN.findall(text)


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: itself if visible in Latin-1, else one from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    names = {chr(b): b for b in visible}
    names |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
    return names


class Vocabulary:
    """Ids, merges by rank and added tokens of a tokenizer file (the text of its JSON)."""

    def __init__(self, text: str):
        data = json.loads(text)
        byte = printable_bytes()
        ids = data["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.token: list[bytes] = [b""] * (max([*ids.values(), *self.added.values()]) + 1)
        for name, i in ids.items():
            self.token[i] = bytes(byte[c] for c in name)
        for name, i in self.added.items():
            self.token[i] = name.encode()
        self.first = np.array([ids[c] for c, _ in sorted(byte.items(), key=lambda x: x[1])], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.left = [ids[a] for a, _ in merges]
        self.right = [ids[b] for _, b in merges]
        self.made = [ids[a + b] for a, b in merges]
        if len({*self.made}) < len(merges):
            raise ValueError("two merges make the same token")
        self.rank = {}
        for r, (a, b) in enumerate(zip(self.left, self.right)):
            self.rank.setdefault(a << 20 | b, r)
        keys = np.fromiter(self.rank, np.int64, len(self.rank))
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.fromiter(self.rank.values(), np.int64, len(keys))[order]
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; -1 for those that no merge joins."""
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


def merge_words(vocabulary: Vocabulary, words: list[bytes]) -> list[bytes]:
    """The ids of each word, as little-endian unsigned 32-bit integers."""
    if not words:
        return []
    size = np.fromiter(map(len, words), np.int64, len(words))
    symbol = vocabulary.first[np.frombuffer(b"".join(words), np.uint8)]
    n = len(symbol)
    ends = np.cumsum(size)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    after[ends[size > 0] - 1] = -1
    before[(ends - size)[size > 0]] = -1
    index: dict[int, list] = {}
    heap: list[int] = []

    def enter(at: np.ndarray) -> None:
        """Put the pairs that begin at these positions into the index."""
        ranks = vocabulary.lookup(symbol[at], symbol[after[at]])
        at, ranks = at[ranks >= 0], ranks[ranks >= 0]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for r, piece in zip(ranks[np.r_[0, cuts]].tolist(), np.split(at, cuts)):
            if r in index:
                index[r].append(piece)
            else:
                index[r] = [piece]
                heapq.heappush(heap, r)

    def enter_one(at: int, a: int, b: int) -> None:
        if (r := vocabulary.rank.get(a << 20 | b)) is not None:
            if r in index:
                index[r].append(at)
            else:
                index[r] = [at]
                heapq.heappush(heap, r)

    enter(np.flatnonzero(after >= 0).astype(np.int32))
    while heap:
        rank = heapq.heappop(heap)
        a, b, made = vocabulary.left[rank], vocabulary.right[rank], vocabulary.made[rank]
        pieces = index.pop(rank)
        single = [p for p in pieces if isinstance(p, int)]
        arrays = [p for p in pieces if not isinstance(p, int)]
        if len(single) + sum(map(len, arrays)) <= FEW:
            for at in sorted({*single, *(x for p in arrays for x in p.tolist())}):
                gone = int(after[at])
                if gone < 0 or symbol[at] != a or symbol[gone] != b:
                    continue
                to, back = int(after[gone]), int(before[at])
                symbol[at], symbol[gone], after[at] = made, -1, to
                if to >= 0:
                    before[to] = at
                    enter_one(at, made, int(symbol[to]))
                if back >= 0:
                    enter_one(back, int(symbol[back]), made)
            continue
        if single:
            arrays.append(np.array(single, np.int32))
        at = np.sort(np.concatenate(arrays))
        at = at[np.r_[True, at[1:] != at[:-1]] & (symbol[at] == a) & (after[at] >= 0)]
        at = at[symbol[after[at]] == b]
        if not len(at):
            continue
        if a == b:  # in a run of one symbol every second pair, from the left
            new_run = np.r_[True, at[1:] != after[at[:-1]]]
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(new_run, place, 0))) % 2 == 0]
        gone = after[at]
        to = after[gone]
        symbol[at], symbol[gone], after[at] = made, -1, to
        follows = to >= 0
        before[to[follows]] = at[follows]
        back = before[at]
        back = back[back >= 0]
        enter(np.concatenate([back[symbol[back] != made], at[follows]]))  # a pair of two of these is in `at` already
    alive = symbol >= 0
    counts = np.add.reduceat(alive, np.minimum(ends - size, n - 1)) * (size > 0) if n else np.zeros(len(words), np.int64)
    raw, out, start = symbol[alive].astype("<u4").tobytes(), [], 0
    for c in (4 * counts).tolist():
        out.append(raw[start : start + c])
        start += c
    return out


class _Words(dict):
    """Numbers words as they come; `new` has those that have no ids yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words, self.ids = _Words(), []

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.ids) > KEPT_WORDS:
            self.words, self.ids = _Words(), []
        v, number, numbered = self.vocabulary, self.words.__getitem__, []
        for text in texts:
            pieces = v.split.split(text) if v.split and any(t in text for t in v.added) else [text]
            numbered.append([v.added[p].to_bytes(4, "little") if k % 2 else np.array([*map(number, words_of(p))], np.int32) for k, p in enumerate(pieces)])
        self.ids += merge_words(v, [w.encode() for w in self.words.new])
        self.words.new = []
        ids = self.ids.__getitem__
        return [b"".join([p if isinstance(p, bytes) else b"".join(map(ids, p.tolist())) for p in pieces]) for pieces in numbered]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD. Added tokens are not skipped."""
        token = self.vocabulary.token
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encode_decode(docs: DataFrame, tokenizer_path: str, as_array: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, `ids` and `decoded` of every row of docs; other columns are ignored.

    ids is binary (little-endian unsigned 32-bit integers), or an array of int. Null and empty texts have no ids; repeated
    rows each have theirs; no documents: no rows. Ties between pairs of one rank go to the leftmost. Texts are encoded whole; memory follows CHUNK_CHARS and the longest text. The file at tokenizer_path is read by the driver
    and sent to the executors (a vocabulary's size does not follow the data).
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = docs.select(*keep).schema.add("ids", T.ArrayType(T.IntegerType()) if as_array else T.BinaryType()).add("decoded", T.StringType())

    of = keep.index("text") if "text" in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _ENCODERS:
            _ENCODERS[tokenizer_path] = Encoder(Vocabulary(sent.value))
        encoder = _ENCODERS[tokenizer_path]
        for batch in batches:
            text = batch.column(of)
            lengths = np.cumsum(pc.fill_null(pc.utf8_length(text), 0).to_numpy().astype(np.int64))
            start = 0
            while start < batch.num_rows:
                done = lengths[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(lengths, done + CHUNK_CHARS, "right")))
                part = batch.slice(start, stop - start)
                ids = encoder.encode([t or "" for t in part.column(of).to_pylist()])
                decoded = pa.array([encoder.decode(x) for x in ids], pa.string())
                if as_array:
                    ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                    coded = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
                else:
                    coded = pa.array(ids, pa.binary())
                del ids
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), coded, decoded], [*keep, "ids", "decoded"])
                del coded, decoded, part
                trim()
                start = stop

    return docs.select(*keep, *([] if "text" in keep else ["text"])).withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema)


def encode_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, from the operator's ids and texts."""
    return encode_decode(docs, tokenizer_path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
