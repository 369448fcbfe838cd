"""Token ids of whole texts through the tokenizers library, with a cache of words.

A byte-level BPE vocabulary of this kind never merges across the start of a word.
In a text whose only white space is single spaces and single line ends, each
piece between them can be encoded on its own, so a worker asks the library once
for a piece and then looks it up. Any other text goes to the library whole.
"""

from __future__ import annotations

import gc
import os
import re
from collections import Counter

import numpy as np

from .common import worker_caches

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
#: Pieces that a worker keeps, about 170 bytes each; once so many are kept, others are encoded whenever they occur.
CACHED_PIECES = 900_000
#: Marks of pieces that have occurred before: only a piece that occurs again is kept.
_MARKS = 1 << 23
#: Outside these characters, Unicode versions may differ in what a letter is, or there is other white space.
_UNUSUAL = re.compile("[^\n -~\xa1-ӿ]")
_USUAL = bytes([10, *range(32, 127), *range(161, 256)])
_BATCH_PIECES = 4096
#: Marks at the end of a piece: a known word of letters and such an end are put together.
_ENDS, _KEPT_ENDS = ".,;:!?$%&*#|)", 4096

#: What the key of a piece starts with at a line's start and at the text's start; after a space, nothing is added.
LINE_START, TEXT_START = "\n", "\0"


def splits(text: str) -> bool:
    """Whether each piece between spaces and line ends can be encoded on its own."""
    try:
        unusual = bool(text.encode("latin-1").translate(None, _USUAL))
    except UnicodeEncodeError:
        unusual = _UNUSUAL.search(text) is not None
    return not (unusual or "  " in text or "\n\n" in text or " \n" in text or "\n " in text)


def pieces(text: str) -> list[str]:
    """The keys of a text that splits: each piece with what stands before it."""
    return (TEXT_START + text.replace("\n", " \n")).split(" ")


def vocabulary_path(name_or_path: str = DEFAULT_VOCABULARY) -> str:
    if os.path.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


class PieceEncoder:
    """Encodes texts as the library does with add_special_tokens=False."""

    def __init__(self, name_or_path: str = DEFAULT_VOCABULARY, kept: int | None = None):
        self.kept = CACHED_PIECES if kept is None else kept
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary_path(name_or_path))
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.newline, self.space = self.library.token_to_id("Ċ"), self.library.token_to_id("Ġ")
        self.starts = np.zeros(self.library.get_vocab_size(), dtype=bool)
        for token, i in self.library.get_vocab().items():
            self.starts[i] = token.startswith("Ġ")
        self.plain = self.newline is not None and self.space is not None
        as_bytes = lambda i: int(i or 0).to_bytes(4, "little")
        self.fixed = {"": as_bytes(self.space), LINE_START: as_bytes(self.newline), TEXT_START: b""}
        self.known = dict(self.fixed)
        self.seen = np.zeros(_MARKS, dtype=bool)
        self.ends: dict[str, bytes] = {}

    def _ids_of_words(self, keys: list[str]) -> list[bytes]:
        """The ids of each key, by the library: keys of one kind are joined to texts and told apart by their first ids."""
        out: list[bytes] = [b""] * len(keys)
        marks = [k[0] for k in keys]
        kinds = {LINE_START: [], TEXT_START: [], "": []}
        if LINE_START in marks or TEXT_START in marks:
            for i, m in enumerate(marks):
                kinds[m if m in kinds else ""].append(i)
        else:
            kinds[""] = range(len(keys))
        for kind, own in kinds.items():
            for first in range(0, len(own), _BATCH_PIECES):
                lot = own[first : first + _BATCH_PIECES]
                words = [keys[i] for i in lot]
                joined = "".join(words).replace(TEXT_START, LINE_START) if kind else " " + " ".join(words)
                ids = np.array(self.library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
                at = np.flatnonzero(ids == self.newline if kind else self.starts[ids])
                if len(at) != len(lot):
                    raise ValueError("the vocabulary joins words; it can't be encoded by pieces")
                raw, starts, ends = ids.tobytes(), ((at + (kind == TEXT_START)) * 4).tolist(), [*(at[1:] * 4).tolist(), len(ids) * 4]
                for i, a, b in zip(lot, starts, ends, strict=True):
                    out[i] = raw[a:b]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        collecting = gc.isenabled()
        gc.disable()  # the many short lists below hold no cycles
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        whole: list[int] = []
        waiting: list[tuple[int, list[bytes | None], list[int]]] = []
        unknown: list[str] = []
        get = self.known.get
        for k, text in enumerate(texts):
            if not self.plain or not splits(text) or any(s in text for s in self.special):
                whole.append(k)
                continue
            keys = pieces(text)
            values = list(map(get, keys))
            if None in values:
                gaps = [i for i, v in enumerate(values) if v is None]
                unknown += [keys[i] for i in gaps]
                waiting.append((k, values, gaps))
            else:
                out[k] = b"".join(values)
        if unknown:
            times = Counter(unknown)
            new = list(times)
            got = self._put_together(new)
            rest = [k for k in new if k not in got]
            got.update(zip(rest, self._ids_of_words(rest), strict=True))
            room = self.kept - len(self.known)
            if room > 0:
                marks = np.fromiter(map(hash, new), np.int64, len(new)) & (_MARKS - 1)
                again = self.seen[marks] | (np.fromiter(times.values(), np.int64, len(new)) > 1)
                self.seen[marks] = True
                self.known.update([(new[i], got[new[i]]) for i in np.flatnonzero(again)[:room].tolist()])
            found = map(got.__getitem__, unknown)
            for k, values, gaps in waiting:
                for i in gaps:
                    values[i] = next(found)
                out[k] = b"".join(values)
        if whole:
            for k, raw in zip(whole, self._whole([texts[k] for k in whole]), strict=True):
                out[k] = raw
        return out

    def _put_together(self, keys: list[str]) -> dict[str, bytes]:
        """The ids of keys that are a known word of letters with marks at its end; the two are never merged."""
        found, get = [], self.known.get
        for k in keys:
            word = k.rstrip(_ENDS)
            if len(word) < len(k):
                ids = get(word)
                if ids is not None and (word[1:] if word[:1] in (LINE_START, TEXT_START) else word).isalpha():
                    found.append((k, ids, k[len(word) :]))
        new = list({end for _, _, end in found if end not in self.ends})
        if len(self.ends) + len(new) > _KEPT_ENDS:
            self.ends.clear()
            new = list({end for _, _, end in found})
        self.ends.update(zip(new, self._ids_of_words([TEXT_START + e for e in new]), strict=True))
        return {k: ids + self.ends[end] for k, ids, end in found}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(got.ids, dtype="<u4").tobytes() for got in self.library.encode_batch_fast(texts, add_special_tokens=False)]


_loaded: dict[str, PieceEncoder] = {}
worker_caches.append(_loaded)


def encoder(name_or_path: str = DEFAULT_VOCABULARY, kept: int | None = None) -> PieceEncoder:
    """The encoder of this worker, loaded once; it keeps at most so many pieces."""
    if name_or_path not in _loaded or kept is not None and _loaded[name_or_path].kept != kept:
        _loaded.clear()
        _loaded[name_or_path] = PieceEncoder(name_or_path, kept)
    return _loaded[name_or_path]


def in_lots(texts: list[str], chars: int = 2_000_000) -> list[range]:
    """Ranges of texts with about so many characters, so that a lot's memory is bounded."""
    out, first, total = [], 0, 0
    for k, t in enumerate(texts):
        total += len(t)
        if total > chars:
            out.append(range(first, k + 1))
            first, total = k + 1, 0
    if first < len(texts):
        out.append(range(first, len(texts)))
    return out
