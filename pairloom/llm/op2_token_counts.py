"""Token counts by prefix dynamic programming.

For every prefix of a text the table holds the exact number of tokens the tokenizer gives for that
prefix, so questions such as "how many tokens are the first n characters" and "how many characters
fit into a budget" are look-ups; nothing is encoded again.

The program runs over the bytes of a pre-token. The encoding of a prefix ends in the one token t
that is (a) a suffix of the prefix and (b) compatible with the last token of the shorter prefix
before it: merging the bytes of the two gives just these two tokens back. So count[i] =
count[i - len(t)] + 1, one step per byte, and compatibility of a token pair is worked out once per
task. Short pre-tokens of one length go together; a long one is walked along a trie of the
vocabulary, so its cost is linear. Every total is held against the library's own count; a piece that differs (never seen) gets
its prefixes from the library one by one.

Defined results: NULL text counts as the empty one (0 bytes, 0 tokens); NULL ids stay NULL;
repeated rows give repeated rows; an empty table gives an empty table; other columns are ignored.
Texts of any length are counted whole.
"""

from __future__ import annotations

import json
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import id_and_text, map_rows
from pairloom.llm.lattice import Lattice
from pairloom.llm.tokens import SPACES, UNIT, cuts_are_exact, load_tokenizer, tokenizer_path

#: The pre-tokenizer's pattern (fixed value), with its white space spelled out.
PIECES = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+"
    rf"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
LEAD = regex.compile(f"[{SPACES}]*")
CONTRACTIONS = ("'re", "'ve", "'ll")  # those that read differently when cut in their middle
CACHE_UNITS = 900_000
KEEP_CHARS = 60  # of a cached unit; its counts then fit into a byte each
CACHE_PIECES = 150_000
LONG_CHARS = 128  # of a pre-token that is walked on its own
BLOCK = 1 << 16


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, by its published rule."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Counts for all code-point prefixes of a text."""

    def __init__(self, name: str = "byte_bpe_50k.json", cache_units: int = CACHE_UNITS):
        self.tok = load_tokenizer(name)
        with open(tokenizer_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        self.exact_cuts = cuts_are_exact(spec)
        self.special = [a["content"] for a in spec.get("added_tokens", [])]
        self.cache: dict[str, bytes] = {}
        self.cache_units = cache_units
        if not self.exact_cuts:
            return
        letter = byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        self.ids = {
            raw(s): i for s, i in spec["model"]["vocab"].items() if all(c in letter for c in s) and s not in self.special
        }
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(merges)}
        self.names = sorted(self.ids)
        self.lattice = Lattice([t.decode("latin-1") for t in self.names], [])
        self.fits: dict[int, bool] = {}
        self.whole = np.full(len(self.names), -1, np.int8)
        self.trie: dict[bytes, int] = {}
        self.pieces: dict[str, list[int]] = {}

    def _merge(self, data: bytes) -> list[bytes]:
        """Byte-pair merges of a short string, lowest rank first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get((parts[i], parts[i + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Compatibility of many token pairs; each distinct pair is worked out once."""
        keys, back = np.unique(a.astype(np.int64) * len(self.names) + b, return_inverse=True)
        fits = self.fits
        got = [fits.get(k) for k in keys.tolist()]
        for i, ok in enumerate(got):
            if ok is None:
                x, y = divmod(int(keys[i]), len(self.names))
                x, y = self.names[x], self.names[y]
                got[i] = fits[int(keys[i])] = self._merge(x + y) == [x, y]
        return np.array(got, dtype=bool)[back]

    def _ones(self, t: np.ndarray) -> np.ndarray:
        for k in np.unique(t[self.whole[t] < 0]).tolist():
            self.whole[k] = self._merge(self.names[k]) == [self.names[k]]
        return self.whole[t] == 1

    def _program(self, chars: np.ndarray) -> np.ndarray:
        """Token counts of all byte prefixes of pre-tokens of one length (rows); 0 where no token fits."""
        arcs, (n, length) = self.lattice.arcs(chars), chars.shape
        count = np.zeros((length + 1, n), np.int32)
        last = np.zeros((length + 1, n), np.int32)
        for i in range(1, length + 1):
            left = np.ones(n, bool)
            for j in range(i - 1, -1, -1):
                k = arcs.get((j, i))
                if k is None:
                    continue
                at = np.flatnonzero(left & (k >= 0) & ((count[j] > 0) | (j == 0)))
                if not len(at):
                    continue
                at = at[self._pairs(last[j, at], k[at]) if j else self._ones(k[at])]
                last[i, at], count[i, at] = k[at], count[j, at] + 1
                left[at] = False
        return count[1:].T

    def _walk(self, data: bytes) -> list[int]:
        """Token counts of all byte prefixes of one pre-token; 0 where no token fits."""
        if not self.trie:  # beginnings of tokens, with the token's number or -1
            self.trie = {t[:k]: -1 for t in self.names for k in range(1, len(t))}
            self.trie.update((t, k) for k, t in enumerate(self.names))
        size, names, fits, step = len(data), self.names, self.fits, self.trie.get
        count, last = [0] * (size + 1), [0] * (size + 1)
        for j in range(size):
            if j and not count[j]:
                continue
            for i in range(j + 1, size + 1):
                k = step(data[j:i])
                if k is None:
                    break
                if k < 0 or count[i]:
                    continue
                if j:
                    key = last[j] * len(names) + k
                    ok = fits.get(key)
                    if ok is None:
                        x, y = names[last[j]], names[k]
                        ok = fits[key] = self._merge(x + y) == [x, y]
                else:
                    ok = self._merge(names[k]) == [names[k]]
                if ok:
                    last[i], count[i] = k, count[j] + 1
        return count[1:]

    def _at_letters(self, piece: str, counts: list[int]) -> list[int]:
        """Counts at the code points of a pre-token from those at its bytes."""
        if len(piece) == len(counts):
            return counts
        return [counts[e - 1] for e in accumulate(len(x.encode()) for x in piece)]

    def _count_pieces(self, pieces: list[str]) -> None:
        """Have the counts at the code points of new pre-tokens ready."""
        long = [p for p in pieces if len(p) > LONG_CHARS]
        self.pieces.update((p, self._at_letters(p, self._walk(p.encode()))) for p in long)
        pieces = [p for p in pieces if len(p) <= LONG_CHARS]
        raw = [p.encode().decode("latin-1") for p in pieces]
        for at, chars in self.lattice.groups(raw, 50_000, mark=False):
            counts = self._program(chars)
            for k, c in zip(at.tolist(), counts.tolist(), strict=True):
                self.pieces[pieces[k]] = self._at_letters(pieces[k], c)

    def _unit(self, unit: str, found: list[str], lead: int) -> list[int]:
        """Counts at the code points of a unit cut into pre-tokens."""
        if len(found) == 1:
            return self.pieces[found[0]]
        out = list(self.pieces[unit[:lead]]) if lead else []
        base = at = 0
        for p in found:
            counts = self.pieces[p]
            if p in CONTRACTIONS:
                counts = list(counts)
                counts[1] = self.pieces["'"][0] + self.pieces[p[1]][0]
            for k, c in enumerate(counts):
                if at + k >= lead:
                    out.append(base + c)
            at += len(p)
            base += counts[-1]
        return out

    def _library(self, text: str) -> list[int]:
        out: list[int] = []
        for k in range(0, len(text), 256):
            some = [text[: i + 1] for i in range(k, min(len(text), k + 256))]
            out += [len(e.ids) for e in self.tok.encode_batch_fast(some, add_special_tokens=False)]
        return out

    def _fill(self, new: list[str]) -> dict[str, list[int]]:
        totals = [len(e.ids) for e in self.tok.encode_batch_fast(new, add_special_tokens=False)]
        cut = [PIECES.findall(u) for u in new]
        leads = [LEAD.match(u).end() if len(f) > 1 else 0 for u, f in zip(new, cut, strict=True)]
        wanted = {p for f in cut for p in f} | {u[:n] for u, n in zip(new, leads, strict=True) if n}
        for c in CONTRACTIONS:
            if c in wanted:
                wanted |= {"'", c[1]}
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        self._count_pieces([p for p in wanted if p not in self.pieces])
        out = {}
        for u, f, n, total in zip(new, cut, leads, totals, strict=True):
            counts = self._unit(u, f, n)
            if len(counts) != len(u) or counts[-1] != total or 0 in counts:
                counts = self._library(u)
            out[u] = counts
        return out

    def _learn(self, texts: list[str]) -> list[list[str]]:
        """Have the units of a group of texts ready, so that new ones are counted together; the units."""
        if len(self.cache) > self.cache_units:
            self.cache.clear()
        found = [UNIT.findall(t) for t in texts]
        new = [u for u in set().union(*found) if len(u) <= KEEP_CHARS and u not in self.cache]
        if new:
            self.cache.update((u, bytes(c)) for u, c in self._fill(new).items())
        return found

    def _plain(self, text: str, found: list[str] | None = None) -> np.ndarray:
        found = UNIT.findall(text) if found is None else found
        if not found:
            return np.zeros(0, dtype=np.int64)
        try:
            own = np.frombuffer(b"".join(map(self.cache.__getitem__, found)), np.uint8)
        except KeyError:
            new = list({u for u in found if u not in self.cache})
            extra = {u: np.asarray(c, dtype=np.int64) for u, c in self._fill(new).items()}
            own = np.concatenate([extra[u] if u in extra else np.frombuffer(self.cache[u], np.uint8) for u in found])
        own = own.astype(np.int64)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        ends = np.cumsum(sizes)
        totals = own[ends - 1]
        return own + np.repeat(np.cumsum(totals) - totals, sizes)

    def group(self, texts: list[str]) -> list[np.ndarray]:
        """``prefixes`` of several texts."""
        if not self.exact_cuts:
            return [self.prefixes(t) for t in texts]
        plain = [t for t in texts if not any(s in t for s in self.special)]
        found = iter(self._learn(plain))
        return [self.prefixes(t) if any(s in t for s in self.special) else self._plain(t, next(found)) for t in texts]

    def batch(self, column: pa.Array, chars: int = 8_000_000):
        """Texts of a column with their counts, a group of about ``chars`` at a time."""
        texts, size = [], 0
        for k in range(0, len(column), 64):
            some = column.slice(k, 64).to_pylist()
            texts += some
            size += sum(map(len, some))
            if size >= chars:
                yield from zip(texts, self.group(texts), strict=True)
                texts, size = [], 0
        yield from zip(texts, self.group(texts), strict=True)

    def prefixes(self, text: str) -> np.ndarray:
        """counts[k]: tokens of the first k + 1 code points."""
        if not self.exact_cuts:
            return np.asarray(self._library(text), dtype=np.int64)
        held = [s for s in self.special if s in text]
        if not held:
            return self._plain(text)
        # a special string is one token; a prefix that ends inside it is ordinary text
        out, base = [], 0
        pieces = regex.split("(" + "|".join(regex.escape(s) for s in sorted(held, key=len, reverse=True)) + ")", text)
        for k in range(0, len(pieces), 2):
            mark = pieces[k + 1] if k + 1 < len(pieces) else ""
            own = len(pieces[k])
            plain = self._plain(pieces[k] + mark[:-1])
            out.append(plain + base)
            base += int(self._plain(pieces[k])[-1]) if own else 0
            if mark:
                base += 1
                out.append(np.array([base]))
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


_counters: dict[str, PrefixCounter] = {}


def shared_counter(name: str) -> PrefixCounter:
    """The counter of this worker process: tasks that follow each other keep what was worked out."""
    if name not in _counters:
        _counters[name] = PrefixCounter(name)
    return _counters[name]


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", budget: int = 1024
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and fit_chars: the longest prefix of at most ``budget`` tokens.

    One pass over the texts, no shuffle.
    """

    def make():
        counter = shared_counter(tokenizer)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_bytes, n_tokens, fit = [], [], []
            for text, counts in counter.batch(batch.column(1)):
                n_bytes.append(len(text.encode()))
                n_tokens.append(int(counts[-1]) if len(counts) else 0)
                within = np.flatnonzero(counts <= budget)
                fit.append(int(within[-1]) + 1 if len(within) else 0)
            over = [n > budget for n in n_tokens]
            return pa.record_batch(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(over, pa.bool_()), pa.array(fit, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

        return each

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"
    return map_rows(id_and_text(docs, id_col, text_col), schema, make)


def prefix_table(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json"
) -> DataFrame:
    """The stored program: per document blocks of 65,536 prefixes (doc_id, block, first, counts).

    ``counts`` holds the compressed differences of the counts after ``first``, so a block answers on its own.
    A document without characters has one block without prefixes.
    """

    def make():
        counter = shared_counter(tokenizer)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[tuple] = []
            for doc, (_, counts) in zip(batch.column(0).to_pylist(), counter.batch(batch.column(1)), strict=True):
                for k in range(0, max(1, len(counts)), BLOCK):
                    part = counts[k : k + BLOCK]
                    first = int(part[0]) if len(part) else 0
                    rows.append((doc, k // BLOCK, first, zlib.compress(np.diff(part).astype("<i4").tobytes(), 6), len(part)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32())
            return pa.record_batch(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "block", "first", "counts", "n"]
            )

        return each

    return map_rows(id_and_text(docs, id_col, text_col), "doc_id long, block int, first long, counts binary, n int", make)


def read_block(first: int, counts: bytes, n: int) -> np.ndarray:
    """The counts of a stored block."""
    if not n:
        return np.zeros(0, dtype=np.int64)
    steps = np.frombuffer(zlib.decompress(counts), dtype="<i4").astype(np.int64)
    return first + np.concatenate(([0], np.cumsum(steps)))


def fit_budgets(stored: DataFrame, budgets: list[int]) -> DataFrame:
    """Longest prefix (in code points) within each budget, from a stored table: doc_id, budget, chars."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for r in batch.to_pylist():
                counts = read_block(r["first"], r["counts"], r["n"])
                for b in budgets:
                    within = np.flatnonzero(counts <= b)
                    rows.append((r["doc_id"], b, r["block"] * BLOCK + int(within[-1]) + 1 if len(within) else 0))
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "budget", "chars"])

        return each

    found = map_rows(stored, "doc_id long, budget long, chars long", make)
    return found.groupBy("doc_id", "budget").agg(F.max("chars").alias("chars"))
