"""Exact token ids of whole texts, encoding each distinct piece of text once per task.

A byte-level pre-tokenizer never lets a piece reach over the start of a run of white space, so a
text can be cut before every such run and the cuts encoded on their own. Cuts repeat (they are
words), so a bounded per-task cache holds their ids. Tokenizers of any other build, and texts that
hold one of the special strings, are encoded whole by the library.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Sequence

import numpy as np

from pairloom.llm.common import kept

#: White space as the pre-tokenizer's pattern knows it (fixed values).
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
_SPACES = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{SPACES}]", c))

CACHE_UNITS = 400_000  # about 80 MB a worker
KEEP_CHARS = 64
LINE_WORDS, LINES = 64, 64  # new words are encoded as lines of so many, so many lines a call: few objects at a time


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The file of a public tokenizer on this machine; an absolute path is taken as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(name: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    t.no_truncation()
    t.no_padding()
    return t


def set_up(tok) -> dict:
    """The parts of a tokenizer's file that say how it cuts; its vocabulary is not parsed again."""
    pre, kind = tok.pre_tokenizer, type(tok.model).__name__
    return {
        "normalizer": None if tok.normalizer is None else True,
        "pre_tokenizer": None if pre is None else json.loads(pre.__getstate__()),
        "model": {"type": kind, "dropout": getattr(tok.model, "dropout", None)},
    }


def cuts_are_exact(spec: dict) -> bool:
    """Whether the tokenizer's set-up allows cutting a text before runs of white space."""
    pre = spec.get("pre_tokenizer") or {}
    return (
        spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and not (spec.get("model") or {}).get("dropout")
    )


def units(text: str) -> list[str]:
    """``text`` cut before every run of white space; joined again they give ``text``."""
    return UNIT.findall(text)


def _bytes(ids: list[int]) -> bytes:
    a = array("I", ids)
    if a.itemsize != 4 or sys.byteorder != "little":
        return np.asarray(ids, dtype="<u4").tobytes()
    return a.tobytes()


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, name: str = "byte_bpe_50k.json", cache_units: int = CACHE_UNITS):
        self.tok = load_tokenizer(name)
        self.cut = cuts_are_exact(set_up(self.tok))
        self.special = [a.content for a in self.tok.get_added_tokens_decoder().values()]
        self.common = os.path.commonprefix(self.special)  # a text without it holds none of them
        vocabulary = self.tok.get_vocab() if self.cut else {}
        self.opens = np.zeros(max(vocabulary.values(), default=-1) + 1, dtype=bool)  # ids whose bytes begin with a space
        self.opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.cache: dict[str, bytes] = {}
        self.cache_units = cache_units

    def _ids(self, texts: Sequence[str]) -> list[bytes]:
        out = self.tok.encode_batch_fast(list(texts), add_special_tokens=False)
        return [_bytes(e.ids) for e in out]

    def _spaced(self, words: Sequence[str]) -> list[bytes]:
        """Ids of each word after one space. Words hold no space, are not empty and do not end in white space, so a
        line of them is cut before each of them and every word's ids begin with its space."""
        out: list[bytes] = []
        for k in range(0, len(words), LINE_WORDS * LINES):
            part = words[k : k + LINE_WORDS * LINES]
            lines = [" " + " ".join(part[j : j + LINE_WORDS]) for j in range(0, len(part), LINE_WORDS)]
            data = b"".join(self._ids(lines))
            first = np.flatnonzero(self.opens[np.frombuffer(data, "<u4")]) * 4
            if len(first) != len(part):
                out += self._ids([" " + p for p in part])
                continue
            first = [*first.tolist(), len(data)]
            out += [data[a:b] for a, b in zip(first, first[1:])]
        return out

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of whole texts, in order."""
        out: list[bytes | None] = [None] * len(texts)
        group: list[int] = []
        chars = 0
        for i, t in enumerate(texts):
            if not self.cut or (self.common in t and any(s in t for s in self.special)):
                out[i] = self._ids([t])[0]
                continue
            group.append(i)
            chars += len(t)
            if chars > 2_000_000:
                self._group(texts, group, out)
                group, chars = [], 0
        if group:
            self._group(texts, group, out)
        return out  # type: ignore[return-value]

    def _group(self, texts: Sequence[str], group: list[int], out: list) -> None:
        # a cached key is the part of a unit after its one leading space
        split = [texts[i].split(" ") for i in group]
        used = set().union(*split)
        if len(self.cache) > self.cache_units:
            # words of this group stay: the frequent ones are among them
            self.cache = {p: self.cache[p] for p in used if p in self.cache}
        new = used.difference(self.cache)
        short = [p for p in new if p.isalpha() and len(p) <= KEEP_CHARS]
        dirty, stops = set(), []
        for p in new.difference(short):
            if not p or p[-1] in _SPACES:
                dirty.add(p)
            elif len(p) <= KEEP_CHARS:
                # a stop after a letter is a piece of its own: such a word shares the ids of the bare one
                (stops if p[-1] in ".," and p[-2:-1].isalpha() else short).append(p)
        bare = {p[:-1] for p in stops}.difference(short)
        short += [p for p in bare if p not in self.cache]
        extra: dict[str, bytes] = {}
        self.cache.update(zip(short, self._spaced(short), strict=True))
        marks = dict(zip(".,", self._ids([".", ","]), strict=True)) if stops else {}
        self.cache.update((p, self.cache[p[:-1]] + marks[p[-1]]) for p in stops)
        long = [p for p in new if len(p) > KEEP_CHARS and p not in dirty]
        extra.update(zip(long, self._ids([" " + p for p in long]), strict=True))
        get = self.cache.__getitem__ if not extra else (lambda p: extra[p] if p in extra else self.cache[p])
        heads = self._ids([parts[0] for parts in split])
        for i, parts, head in zip(group, split, heads, strict=True):
            if not parts[1:]:
                out[i] = head
            elif dirty and not dirty.isdisjoint(parts):
                out[i] = self._dirty(texts[i])
            else:
                out[i] = head + b"".join(map(get, parts[1:]))

    def _dirty(self, text: str) -> bytes:
        """A text with longer runs of white space: cut by the pattern instead of at spaces."""
        found = units(text)
        fresh = list({u for u in found if u[0] != " " or u[1:] not in self.cache})
        ids = dict(zip(fresh, self._ids(fresh), strict=True))
        return b"".join(ids[u] if u in ids else self.cache[u[1:]] for u in found)


def shared_encoder(name: str) -> Encoder:
    """The encoder of this worker process: tasks that follow each other keep its cache."""
    return kept(f"encoder {name}", lambda: Encoder(name))
