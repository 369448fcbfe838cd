"""Byte-pair encoding and decoding with a lexicon of frequent words.

The most frequent words of the corpus, counted over all documents, are compiled
into a minimal acyclic transducer: states that accept the same endings are one,
each arc carries how many words come before it, and so a path ends in a word's
number and its token ids. Workers map the automaton's file into memory and look
up many words at once; a word that it doesn't hold is merged exactly, by rank.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import struct
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import Scratch, exact_id, in_worker, most_frequent, text_of, worker_caches

#: Words that the automaton holds; at most about 10 MB.
LEXICON_WORDS = 60_000
#: Longer words are merged one by one with a heap, shorter ones together.
_LONG = 192
_NONE = np.int64(1 << 40)


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(spare)) for b in range(256)}


class Merges:
    """Exact merging by rank, from a vocabulary file of the tokenizers library."""

    def __init__(self, name_or_path: str = tokens.DEFAULT_VOCABULARY):
        with open(tokens.vocabulary_path(name_or_path), encoding="utf-8") as f:
            said = json.load(f)
        vocab = said["model"]["vocab"]
        shown = byte_characters()
        self.byte_id = np.array([vocab[shown[b]] for b in range(256)], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in said["model"]["merges"]]
        self.width = 1 + max(vocab.values())
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made_of_rank = keys[order], order.astype(np.int64), made
        self.rank_of = {k: r for r, k in reversed(list(enumerate(keys.tolist())))}
        back = {c: b for b, c in shown.items()}
        self.bytes_of = {i: bytes(back[c] for c in token) if all(c in back for c in token) else token.encode() for token, i in vocab.items()}
        for t in said.get("added_tokens", []):
            self.bytes_of[t["id"]] = t["content"].encode()

    def one(self, word: bytes) -> list[int]:
        """Merge one word: the lowest rank first, leftmost among equals."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (r := self.rank_of.get(a * self.width + b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.made_of_rank[r]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.rank_of.get(ids[x] * self.width + ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def many(self, words: list[bytes]) -> list[bytes]:
        """Merge words together, a rank of each word at a time; ids as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        own = np.array([k for k, w in enumerate(words) if 0 < len(w) <= _LONG], dtype=np.int64)
        for k, w in enumerate(words):
            if len(w) > _LONG:
                out[k] = np.array(self.one(w), "<u4").tobytes()
        if not len(own):
            return out
        sizes = np.array([len(words[k]) for k in own], dtype=np.int64)
        ids = self.byte_id[np.frombuffer(b"".join([words[k] for k in own]), np.uint8)]
        while True:
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            rank = np.full(len(ids), _NONE)
            key = ids[:-1] * self.width + ids[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            rank[:-1][hit] = self.ranks[at[hit]]
            rank[starts + sizes - 1] = _NONE
            least = np.minimum.reduceat(rank, starts)
            done = least == _NONE
            for k in np.flatnonzero(done).tolist():
                out[own[k]] = ids[starts[k] : starts[k] + sizes[k]].astype("<u4").tobytes()
            if done.all():
                return out
            word = np.repeat(np.arange(len(own)), sizes)
            here = (rank == least[word]) & ~done[word]
            places = np.flatnonzero(here)
            # Of neighbouring candidates, as in "aaa", every second one from the left.
            run = np.concatenate(([True], np.diff(places) > 1))
            nth = np.arange(len(places)) - np.maximum.accumulate(np.where(run, np.arange(len(places)), 0))
            places = places[nth % 2 == 0]
            ids[places] = self.made_of_rank[rank[places]]
            keep = ~done[word]
            keep[places + 1] = False
            sizes = (sizes - np.bincount(word[places], minlength=len(own)))[~done]
            own, ids = own[~done], ids[keep]


_HEADER = struct.Struct("<8sQQQ")
_MAGIC = b"PLMAT001"


def compile_lexicon(words: dict[bytes, bytes]) -> bytes:
    """The file of a minimal acyclic transducer from words to id bytes.

    Built from sorted words: once the next word leaves a branch, the branch's
    states are final, and each is replaced by an equal one if that exists.
    """
    register: dict[tuple, int] = {}
    arcs: list[dict[int, int]] = []
    counts: list[int] = []

    def freeze(node: list) -> int:
        final, out = node
        key = (final, tuple(out.items()))
        if key not in register:
            register[key] = len(arcs)
            arcs.append(dict(out))
            counts.append(int(final) + sum(counts[t] for t in out.values()))
            finals.append(final)
        return register[key]

    finals: list[bool] = []
    path: list[list] = [[False, {}]]
    last = b""
    order = sorted(words)
    for w in order:
        common = os.path.commonprefix([last, w])
        for depth in range(len(last), len(common), -1):
            path[depth - 1][1][last[depth - 1]] = freeze(path.pop())
        path += [[False, {}] for _ in w[len(common) :]]
        path[-1][0] = True
        last = w
    for depth in range(len(last), 0, -1):
        path[depth - 1][1][last[depth - 1]] = freeze(path.pop())
    root = freeze(path[0])
    keys, targets, skips = [], [], []
    for s, out in enumerate(arcs):
        before = int(finals[s])
        for b in sorted(out):
            keys.append(s * 256 + b)
            targets.append(out[b])
            skips.append(before)
            before += counts[out[b]]
    ends = np.cumsum([0, *(len(words[w]) for w in order)]).astype("<u4")
    parts = [np.array(keys, "<i8"), np.array(targets, "<i4"), np.array(skips, "<i4"), np.array(finals, np.uint8), ends]
    return _HEADER.pack(_MAGIC, len(keys), len(arcs), root) + b"".join(x.tobytes() for x in parts) + b"".join(words[w] for w in order)


class Lexicon:
    """Reads the file of compile_lexicon, from bytes or a memory map."""

    def __init__(self, raw):
        magic, n, states, self.root = _HEADER.unpack_from(raw, 0)
        if magic != _MAGIC:
            raise ValueError("not a lexicon of this format")
        at = _HEADER.size
        self.keys = np.frombuffer(raw, "<i8", n, at)
        self.targets = np.frombuffer(raw, "<i4", n, at := at + 8 * n)
        self.skips = np.frombuffer(raw, "<i4", n, at := at + 4 * n)
        self.finals = np.frombuffer(raw, np.uint8, states, at := at + 4 * n)
        at += states
        total = int(self.skips_total())
        self.ends = np.frombuffer(raw, "<u4", total + 1, at)
        self.ids = memoryview(raw)[at + 4 * (total + 1) :]

    def skips_total(self) -> int:
        """How many words are accepted, counted along the last arcs of each state."""
        total, s = 0, self.root
        while True:
            last = int(np.searchsorted(self.keys, s * 256 + 256)) - 1
            if last < 0 or self.keys[last] >> 8 != s:
                return total + int(self.finals[s])
            total, s = total + int(self.skips[last]), int(self.targets[last])

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for those that are not accepted; all words advance together."""
        n = len(words)
        out = np.full(n, -1, dtype=np.int64)
        if not n or not len(self.keys):
            return out
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        text = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        live = np.arange(n)
        state, number = np.full(n, self.root, dtype=np.int64), np.zeros(n, dtype=np.int64)
        step = 0
        while len(live):
            ended = sizes[live] == step
            good = live[ended & (self.finals[state] == 1)]
            out[good] = number[ended & (self.finals[state] == 1)]
            live, state, number = live[~ended], state[~ended], number[~ended]
            if not len(live):
                break
            key = state * 256 + text[starts[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            live, at = live[hit], at[hit]
            state, number = self.targets[at].astype(np.int64), number[hit] + self.skips[at]
            step += 1
        return out

    def ids_of(self, number: int) -> bytes:
        return bytes(self.ids[self.ends[number] : self.ends[number + 1]])


class LexiconEncoder(tokens.PieceEncoder):
    """Encodes pieces by the automaton, and by merging where that has no answer."""

    def __init__(self, lexicon: Lexicon, name_or_path: str = tokens.DEFAULT_VOCABULARY):
        super().__init__(name_or_path)
        import public_tokenizers
        import regex

        self.lexicon, self.merges = lexicon, Merges(name_or_path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.special_ids = {t.content: int(i).to_bytes(4, "little") for i, t in self.library.get_added_tokens_decoder().items()}
        self.between = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.backward = {c: b for b, c in byte_characters().items()}
        size = 1 + max(self.merges.bytes_of)
        self.token_bytes = [self.merges.bytes_of.get(i, b"") for i in range(size)]
        self.decimal = [str(i) for i in range(size)]

    def _ids_of_words(self, keys: list[str]) -> list[bytes]:
        words = [k[1:] if k[0] == tokens.TEXT_START else k if k[0] == tokens.LINE_START else " " + k for k in keys]
        numbers = self.lexicon.numbers([w.encode() for w in words]).tolist()
        parts = [self.pattern.findall(w) if k < 0 else [] for w, k in zip(words, numbers, strict=True)]
        own = list({w for x in parts for w in x})
        merged = dict(zip(own, self.merges.many([w.encode() for w in own]), strict=True))
        return [self.lexicon.ids_of(k) if k >= 0 else b"".join([merged[w] for w in x]) for k, x in zip(numbers, parts, strict=True)]

    def _whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            got = []
            for part in self.between.split(text) if self.between else [text]:
                if part in self.special_ids:
                    got.append(self.special_ids[part])
                elif part:
                    words = [bytes(self.backward[c] for c in w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(part)]
                    own = list(set(words))
                    merged = dict(zip(own, self.merges.many(own), strict=True))
                    got.append(b"".join([merged[w] for w in words]))
            out.append(b"".join(got))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; what is no UTF-8 becomes U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@in_worker("lexicon")
def _count_pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces, those at a line's start with the line end before them, of texts that split into pieces."""
    seen: Counter = Counter()

    def out():
        frame = pd.DataFrame({"word": list(seen), "n": list(seen.values())})
        seen.clear()
        return frame

    for frame in frames:
        for text in frame["text"]:
            if tokens.splits(text):
                seen.update(tokens.pieces(text)[1:])
            if len(seen) > 1_000_000:
                yield out()
    if seen:
        yield out()


def build_lexicon(df: DataFrame, text_col: str = "text", vocabulary: str = tokens.DEFAULT_VOCABULARY, words: int = LEXICON_WORDS) -> bytes:
    """Count the words of all documents, and compile the most frequent ones; the driver gets no more than words of them."""
    seen = df.select(text_of(text_col).alias("text")).mapInPandas(_count_pieces, "word string, n long").where((F.length("word") > 0) & (F.length("word") <= 64) & (F.col("word") != "\n"))
    counts = Scratch(df.sparkSession, "lexicon").save(seen.groupBy("word").agg(F.sum("n").alias("n")), "counts")
    top = [w for w, _ in most_frequent(counts, words)]
    merged = LexiconEncoder(Lexicon(compile_lexicon({})), vocabulary)._ids_of_words(top)
    return compile_lexicon({(w if w[0] == tokens.LINE_START else " " + w).encode(): ids for w, ids in zip(top, merged, strict=True)})


_open: dict[str, LexiconEncoder] = {}
worker_caches.append(_open)


def mapped_encoder(raw: bytes, vocabulary: str) -> LexiconEncoder:
    """The encoder of this worker, over a memory map of the lexicon's file."""
    key = f"{hashlib.sha256(raw).hexdigest()}:{vocabulary}"
    if key not in _open:
        _open.clear()
        with tempfile.TemporaryFile() as f:
            f.write(raw)
            f.flush()
            _open[key] = LexiconEncoder(Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)), vocabulary)
    return _open[key]


@in_worker("lexicon")
def _encode(raw: bytes, vocabulary: str, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    own = mapped_encoder(raw, vocabulary)
    for frame in frames:
        texts, ids = frame["text"].tolist(), frame["id"].tolist()
        for lot in tokens.in_lots(texts):
            yield pd.DataFrame({"id": [ids[k] for k in lot], "ids": own.encode([texts[k] for k in lot])})


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = tokens.DEFAULT_VOCABULARY, lexicon: bytes | None = None) -> DataFrame:
    """id and ids (little-endian unsigned 32-bit) of each row, as the library encodes without special tokens added.

    A null text is empty and has no ids; a null id is kept. Rows are independent: repeated rows
    give repeated rows, an empty table none. Other columns are not read.
    """
    raw = df.sparkSession.sparkContext.broadcast(build_lexicon(df, text_col, vocabulary) if lexicon is None else lexicon)
    rows = df.select(exact_id(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInPandas(lambda frames: _encode(raw.value, vocabulary, frames), "id string, ids binary").withColumn("id", F.col("id").cast("long"))


@in_worker("lexicon")
def _digest(raw: bytes, vocabulary: str, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    own = mapped_encoder(raw, vocabulary)
    decimal, sha = own.decimal.__getitem__, hashlib.sha256
    for frame in frames:
        texts, doc_ids = frame["text"].tolist(), frame["id"].tolist()
        for lot in tokens.in_lots(texts):
            rows = []
            for k, got in zip(lot, own.encode([texts[k] for k in lot]), strict=True):
                ids = np.frombuffer(got, "<u4").tolist()
                rows.append((doc_ids[k], len(ids), sha(",".join(map(decimal, ids)).encode()).hexdigest(), sha(own.decode(ids).encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = tokens.DEFAULT_VOCABULARY) -> DataFrame:
    """Encode and decode each document: doc_id, n_tokens, ids_sha256, decoded_sha256; rows as in encode_documents."""
    raw = df.sparkSession.sparkContext.broadcast(build_lexicon(df, text_col, vocabulary))
    rows = df.select(exact_id(id_col).alias("id"), text_of(text_col).alias("text"))
    out = rows.mapInPandas(lambda frames: _digest(raw.value, vocabulary, frames), "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
