"""Tokenizing whole texts fast and exactly: each distinct piece is tokenized once per worker.

The vocabulary's pre-tokenizer drops white space, and no piece spans it, so a text is what its runs are, a run being
what stands between ASCII white space. Runs repeat, so a bounded cache takes most of the work. Runs of printable ASCII and
composed Latin letters are kept in lower case and cut into pieces by a regex, many at once; pieces go through the
tokenizers library (ids) or through our own heap-based merge (counts), as do other runs, whole. Long texts are worked on
in steps. A vocabulary with another normalizer or pre-tokenizer than the one assumed here is left to the library, text by text.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator

import numpy as np

from talkgrain.llm import workers

#: Entries of a generation of the cache, unless an encoder is given others; two are kept. Bounds memory, never changes results.
CACHE_ENTRIES = 500_000

#: Bytes of text that are looked at at a time.
STEP_BYTES = 1 << 20

# The specification that the fast path stands for.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}

#: Printable ASCII and composed Latin letters (to ſ) are composed already, and each letter has a lower case of its own. İ has not.
LETTERS = "!-~À-ÖØ-öø-įı-ſ"
SIMPLE = re.compile(f"[{LETTERS}]+")
SIMPLE_TEXT = re.compile(f"[{LETTERS}\\x20\\x09-\\x0D]*")

#: Pieces of such runs in lower case, as the vocabulary's pre-tokenizer splits them, and line feeds between runs.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|\n|[^a-z0-9ß-öø-ſ\n]+")
_GAP = re.compile(rb"[\x20\x09-\x0D]")

_loaded: dict[tuple, object] = {}
workers.keeps("tokens", _loaded.clear)


def _once(kind, path: str):
    workers.take_over("tokens")
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def _chunks(text: bytes) -> Iterator[bytes]:
    """A text in parts of about STEP_BYTES, cut at white space."""
    start = 0
    while len(text) - start > 2 * STEP_BYTES and (gap := _GAP.search(text, start + STEP_BYTES)):
        yield text[start : gap.start()]
        start = gap.start()
    yield text[start:] if start else text


class _Runs:
    """Cuts texts into runs: in lower case (str) if they are simple, else as they are (bytes)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) and not re.search(r"\s", t["content"]) for t in self.spec["added_tokens"])
        split = self.spec.get("pre_tokenizer")
        #: Whether texts may be taken apart here; else every text is the library's.
        self.known = plain and self.spec.get("normalizer") == NORMALIZER and split == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]} and self.spec["model"].get("end_of_word_suffix") is not None
        self.entries = CACHE_ENTRIES
        self.cache: dict = {}
        self.older: dict = {}

    def keys(self, text: bytes) -> list:
        s, special = text.decode("utf-8", "replace"), self._cut
        if not (special and special.search(s)) and SIMPLE_TEXT.fullmatch(s):
            return s.lower().split()
        out: list = []
        simple = SIMPLE.fullmatch
        for r in text.split():
            run = r.decode("utf-8", "replace")
            out.append(run.lower() if simple(run) and not (special and special.search(run)) else r)
        return out

    def pieces_known(self, pieces: list[str]) -> None:
        """Puts pieces into the cache."""
        raise NotImplementedError

    def runs_known(self, runs: list[bytes]) -> None:
        """Puts runs that are not simple into the cache."""
        raise NotImplementedError

    def learn(self, new: set) -> None:
        cache, older = self.cache, self.older
        if len(cache) + len(new) > self.entries:
            older = self.older = cache.copy()
            cache.clear()
            new = self.wanted
        if older:
            cache.update([(k, older[k]) for k in new if k in older])
        self.runs_known([k for k in new if isinstance(k, bytes) and k not in cache])
        runs = [k for k in new if isinstance(k, str) and k not in cache]
        pieces = PIECES.findall("\n".join(runs))
        distinct = set(pieces)
        distinct.discard("\n")
        if older:
            cache.update([(k, older[k]) for k in distinct if k in older])
        self.pieces_known(list(distinct.difference(cache)))
        if len(pieces) > 2 * len(runs) - 1:  # some runs are more than one piece
            start = 0
            for run in runs:
                if pieces[start] == run:
                    start += 2
                    continue
                end = pieces.index("\n", start) if start < len(pieces) and run is not runs[-1] else len(pieces)
                cache[run] = self.total(map(cache.__getitem__, pieces[start:end]))
                start = end + 1

    def looked_up(self, texts: list[bytes]) -> Iterator[tuple[int, Iterator]]:
        """For parts of texts, in order: the number of the text, and what each of the part's keys stands for."""
        cache, held, size = self.cache, [], 0
        parts = [(k, c) for k, t in enumerate(texts) for c in (_chunks(t) if len(t) > 2 * STEP_BYTES else (t,))]
        for at, (k, c) in enumerate(parts):
            held.append((k, self.keys(c)))
            size += len(c)
            if size < STEP_BYTES and at + 1 < len(parts):
                continue
            self.wanted = set().union(*(keys for _, keys in held))
            if new := self.wanted.difference(cache):
                self.learn(new)
            for n, keys in held:
                yield n, map(cache.__getitem__, keys)
            held, size = [], 0

    def specials(self, run: str) -> list[str]:
        return self._cut.split(run) if self._cut and any(s in run for s in self.special) else [run]

    def split(self, part: str) -> list[str]:
        """Byte-level pieces of a part without special tokens."""
        return [p for p, _ in self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(part))]


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, the rest follow from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    shifted = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


_LETTERS = _byte_letters()
_SHIFTED = {b: letter for b, letter in enumerate(_LETTERS) if chr(b) != letter}


def byte_level(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(_SHIFTED)


class HeapCounter(_Runs):
    """Counts tokens by byte-pair merging over a linked list with a heap of adjacent pairs; no ids come out."""

    def __init__(self, path: str):
        super().__init__(path)
        model = self.spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.symbols = {s: i for i, s in enumerate(model["vocab"])}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            ids = self.symbols
            self.pairs.setdefault((ids[left], ids[right]), (rank, ids[left + right]))

    def merged(self, word: str) -> int:
        """Initial symbols minus merges: pop the lowest-rank pair (leftmost on ties), join it, look at its new neighbours."""
        get, pairs = self.symbols.get, self.pairs
        ids = [i for i in map(get, word[:-1]) if i is not None]
        last = get(word[-1] + self.suffix)
        if last is not None:
            ids.append(last)
        n = count = len(ids)
        heap = []
        for k in range(n - 1):
            if p := pairs.get((ids[k], ids[k + 1])):
                heap.append((p[0], k, p[1], ids[k], ids[k + 1]))
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, k, joined, left, right = heapq.heappop(heap)
            r = after[k]
            if ids[k] != left or r >= n or ids[r] != right:
                continue  # a side was merged away since
            ids[k], ids[r] = joined, -1
            count -= 1
            after[k] = s = after[r]
            if s < n:
                before[s] = k
                if p := pairs.get((joined, ids[s])):
                    heapq.heappush(heap, (p[0], k, p[1], joined, ids[s]))
            if (q := before[k]) >= 0 and (p := pairs.get((ids[q], joined))):
                heapq.heappush(heap, (p[0], q, p[1], ids[q], joined))
        return count

    def run(self, run: bytes) -> int:
        parts = self.specials(run.decode("utf-8", "replace"))
        return sum(1 if p in self.special else sum(map(self.merged, self.split(p))) for p in parts if p)

    total = staticmethod(sum)

    def pieces_known(self, pieces: list[str]) -> None:
        for p in pieces:
            self.cache[p] = self.merged(p if p.isascii() else byte_level(p))

    def runs_known(self, runs: list[bytes]) -> None:
        for r in runs:
            self.cache[r] = self.run(r)

    def count_all(self, texts: list[bytes]) -> list[int]:
        if not self.known:
            return [len(self.lib.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids) for t in texts]
        out = [0] * len(texts)
        for k, counts in self.looked_up(texts):
            out[k] += sum(counts)
        return out

    def count(self, text: bytes) -> int:
        return self.count_all([text])[0]


class IdEncoder(_Runs):
    """Ids of whole texts, as little-endian bytes of the given width."""

    def __init__(self, path: str, width: str = "<u4"):
        super().__init__(path)
        self.width = width
        if not self.known:
            return
        model = self.spec["model"]
        suffix = model["end_of_word_suffix"]
        size = max(max(model["vocab"].values()), *self.special.values(), 0) + 1
        self.ends = np.zeros(size, bool)
        self.ends[[i for s, i in model["vocab"].items() if s.endswith(suffix)]] = True
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.plain = Tokenizer.from_str(json.dumps(self.spec | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}))
        self.plain.pre_tokenizer = WhitespaceSplit()  # for pieces that are normalized and byte-level already
        del self.spec

    total = staticmethod(b"".join)

    def pieces_known(self, pieces: list[str]) -> None:
        """Encodes pieces, many in one call, and cuts the ids where words end."""
        for k in range(0, len(pieces), 4096):
            some = pieces[k : k + 4096]
            text = " ".join([w if w.isascii() else byte_level(w) for w in some])
            ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some) or cuts[-1] != len(ids):
                raise ValueError("a piece did not end as a word")
            data, width, start = ids.astype(self.width).tobytes(), np.dtype(self.width).itemsize, 0
            for w, end in zip(some, (cuts * width).tolist()):
                self.cache[w] = data[start:end]
                start = end

    def runs_known(self, runs: list[bytes]) -> None:
        for k in range(0, len(runs), 4096):
            some = runs[k : k + 4096]
            for r, e in zip(some, self.lib.encode_batch_fast([r.decode("utf-8", "replace") for r in some], add_special_tokens=False)):
                self.cache[r] = np.array(e.ids, self.width).tobytes()

    def encode(self, text: bytes) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text."""
        if not self.known:
            return [np.array(self.lib.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, self.width).tobytes() for t in texts]
        out: list[list[bytes]] = [[] for _ in texts]
        for k, ids in self.looked_up(texts):
            out[k].append(b"".join(ids))
        return [parts[0] if len(parts) == 1 else b"".join(parts) for parts in out]


class IdEncoder16(IdEncoder):
    def __init__(self, path: str):
        super().__init__(path, "<u2")
        if self.lib.get_vocab_size() > 65_536:
            raise ValueError("ids do not fit 16 bits")


def counter(path: str) -> HeapCounter:
    return _once(HeapCounter, path)


def encoder(path: str, entries: int = CACHE_ENTRIES) -> IdEncoder:
    found = _once(IdEncoder, path)
    found.entries = entries
    return found


def encoder16(path: str) -> IdEncoder16:
    return _once(IdEncoder16, path)
