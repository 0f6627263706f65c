"""Token ids of many texts by the tokenizers library, with a bounded cache of what white-space-free chunks encode to."""

from __future__ import annotations

import json
import os
import re
from itertools import repeat

import numpy as np

#: Control and space characters that keep a text off the cached path; 0x01 is used as a mark below.
_ODD = bytes([0x01, 0x0B, 0x0C, *range(0x1C, 0x20), 0x85, 0xA0])
#: A space beside other white space: pre-tokens may then span chunks.
_RUNS = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")
_LONG = 100
_LETTERS = re.compile(r"[^\W\d_]+|[\W\d_]+")
_SPACE = re.compile(r"\s")
_TWO = re.compile(r"\s\s")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids of whole texts, equal to Tokenizer.encode(text, add_special_tokens=False).

    plain: special strings in texts are ordinary text; otherwise they get the ids that the file has for them, as the library does.
    Pre-tokens of the two public BPE files never cross the place before a lone space, so such a text is the concatenation of its
    chunks and each distinct chunk is encoded once while it stays in the cache. Texts outside Latin-1, with odd control characters or
    (byte-level file) with runs of mixed white space are encoded whole, as are those that may hold a special string and all texts of
    other tokenizer files.
    """

    def __init__(self, path: str, most: int = 800_000, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.most = most
        conf = json.load(open(path, encoding="utf-8"))
        # what all special strings begin with, if that has no letters; else texts are searched for each, whatever its case
        own = [x["content"] for x in conf.get("added_tokens") or []]
        begin = re.match(r"[^\w\s]*", os.path.commonprefix(own))[0]
        self.special = None if plain or not own else re.compile(re.escape(begin) if begin else "|".join(map(re.escape, own)), re.IGNORECASE)
        pre, norm = conf.get("pre_tokenizer") or {}, conf.get("normalizer")
        self.kind = "whole"
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.kind = "byte"
            self.opens = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
            self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
            self.opens[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("Ġ")]] = True
        elif [n.get("type") for n in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and conf["model"].get("end_of_word_suffix") and (pre.get("pretokenizers") or [{}])[0].get("behavior") == "Removed":
            mark = self.tokenizer.encode("\x01", add_special_tokens=False).ids
            if len(mark) == 1:
                self.kind, self.mark = "word", mark[0]
        self._reset()

    def _reset(self, keys: list[str] = (), flat: np.ndarray = (), sizes: np.ndarray = ()) -> None:
        self.known = {k: i for i, k in enumerate(keys)}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)
        self.hits = np.zeros(1 << 16, np.int64)
        self.n = self.used = 0
        self._put(np.asarray(flat, np.uint32), np.asarray(sizes, np.int64))

    def _put(self, flat: np.ndarray, sizes: np.ndarray) -> int:
        """Append runs of ids; returns the number of the first."""
        n, more = self.n, len(sizes)
        while n + more + 2 > len(self.ends):
            self.ends, self.hits = (np.concatenate([a, np.zeros_like(a)]) for a in (self.ends, self.hits))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.ends[n + 1 : n + 1 + more] = self.used + np.cumsum(sizes)
        self.used += len(flat)
        self.n += more
        return n

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of these numbers one after the other, and the bounds of the runs in them."""
        begin = self.ends[at]
        size = self.ends[at + 1] - begin
        total = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.repeat(begin - total[:-1], size) + np.arange(total[-1])], total

    def _name(self, keys: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        first = self._put(flat, sizes)
        self.known.update(zip(keys, range(first, first + len(keys)), strict=True))

    def _pieces(self, chunk: str) -> list[str] | None:
        """A chunk's runs of letters and of other characters, where pre-tokens are sure to end between them."""
        body = chunk.removeprefix("\x01") if self.kind == "byte" else chunk
        if "'" in body or _TWO.search(body):
            return None
        runs = _LETTERS.findall(body)
        if len(runs) < 2:
            return None
        if self.kind == "byte":
            runs[1:] = ["\x01" + r for r in runs[1:]]
            if body is not chunk:
                runs[0] = "\x01" + runs[0]
        return runs

    def _learn(self, new: list[str]) -> None:
        """Add chunks that the cache lacks, from the runs they consist of where that is safe."""
        compound, whole = [], {}
        for k in new:
            if runs := self._pieces(k):
                compound.append((k, runs))
                whole.update((r, 0) for r in runs if r not in self.known)
            else:
                whole[k] = 0
        self._encode_new(list(whole))
        if compound:
            at = np.array([self.known[r] for _, runs in compound for r in runs], np.int64)
            flat, total = self._gather(at)
            edge = np.concatenate([[0], np.cumsum([len(runs) for _, runs in compound])])
            self._name([k for k, _ in compound], flat, np.diff(total[edge]))

    def _encode_new(self, new: list[str]) -> None:
        """Encode chunks, many joined in one text, which is cut again where ids show a chunk's start or a separator."""
        encode = lambda texts: [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        groups = {"joined": [], "lines": [], "alone": []}
        for k in new:
            body = k.removeprefix("\x01") if self.kind == "byte" else k
            groups["joined" if body is k and k else "lines" if body and not _SPACE.search(body) else "alone"].append(k)
        for how, keys in groups.items():
            for at in range(0, len(keys), 25_600):
                some = keys[at : at + 25_600]
                plain = [k.removeprefix("\x01") if how != "joined" else k for k in some]
                if how == "alone":
                    plain = [" " + k if k == some[i] and self.kind == "byte" else k for i, k in enumerate(plain)]
                    runs = encode(plain)
                    self._name(some, np.concatenate(runs), np.array([len(r) for r in runs]))
                    continue
                lots = [plain[i : i + 100] for i in range(0, len(plain), 100)]
                if how == "lines":
                    texts, mark = ["\n".join(x) for x in lots], self.line
                elif self.kind == "byte":
                    texts, mark = [" " + " ".join(x) for x in lots], None
                else:
                    texts, mark = [" \x01 ".join(x) for x in lots], self.mark
                flats, sizes = [], []
                for lot, run in zip(lots, encode(texts), strict=True):
                    if mark is None:
                        cut = np.flatnonzero(self.opens[run])
                        size = np.diff(np.append(cut, len(run)))
                    else:
                        cut = np.flatnonzero(run == mark)
                        size = np.diff(np.concatenate([[-1], cut, [len(run)]])) - 1
                        run = run[run != mark]
                    if len(size) != len(lot):
                        raise AssertionError("chunks and ids don't match")
                    flats.append(run)
                    sizes.append(size)
                self._name(some, np.concatenate(flats), np.concatenate(sizes))

    def _trim(self) -> None:
        """Keep the chunks met most often, half of what fits."""
        keys = list(self.known)
        at = np.fromiter(self.known.values(), np.int64, len(keys))
        order = np.argsort(-self.hits[at], kind="stable")[: self.most // 2]
        order = order[self.hits[at[order]] > 1]
        flat, total = self._gather(at[order])
        self._reset([keys[i] for i in order], flat, np.diff(total))

    def _chunks(self, text: str) -> list[str] | None:
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        if len(raw.translate(None, _ODD)) != len(raw):
            return None
        if self.kind == "word":
            return text.lower().split()
        if any(run in text for run in _RUNS):
            return None
        parts = text.split(" ")
        parts[0] = "\x01" + parts[0]
        return parts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after the other, number of ids of each text); a null text has none."""
        chunks: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        whole: list[int] = []
        for i, text in enumerate(texts):
            if not text:
                continue
            parts = self._chunks(text) if self.kind != "whole" and not (self.special and self.special.search(text)) else None
            if parts is None:
                whole.append(i)
            else:
                counts[i] = len(parts)
                chunks += parts
        at = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = list(dict.fromkeys(chunks[i] for i in missing))
            self._learn(new)
            at[missing] = [self.known[chunks[i]] for i in missing]
            for k in new:
                if len(k) > _LONG:
                    del self.known[k]
        if self.n:
            self.hits[: self.n] += np.bincount(at, minlength=self.n)
        flat, total = self._gather(at)
        edge = np.concatenate([[0], np.cumsum(counts)])
        lengths = total[edge[1:]] - total[edge[:-1]]
        if whole:
            runs = np.split(flat, np.cumsum(lengths)[:-1])
            for lo in range(0, len(whole), 64):
                some = whole[lo : lo + 64]
                for i, e in zip(some, self.tokenizer.encode_batch([texts[i] for i in some], add_special_tokens=False), strict=True):
                    runs[i] = np.array(e.ids, np.uint32)
                    lengths[i] = len(runs[i])
            flat = np.concatenate(runs) if runs else flat
        if len(self.known) > self.most or self.used > 8 * self.most:
            self._trim()
        return flat, lengths


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, most: int = 800_000, plain: bool = False) -> Encoder:
    """One Encoder a Python worker, file and kind."""
    if (path, most, plain) not in _encoders:
        _encoders[path, most, plain] = Encoder(path, most, plain)
    return _encoders[path, most, plain]


def with_end(flat: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with end_id after each text, and the bounds of the texts in them."""
    bounds = np.concatenate([[0], np.cumsum(lengths + 1)])
    out = np.full(bounds[-1], end_id, np.uint32)
    inside = np.ones(bounds[-1], bool)
    inside[bounds[1:] - 1] = False
    out[inside] = flat
    return out, bounds
