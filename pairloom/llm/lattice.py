"""Unigram lattice over subword pieces: marginal probabilities and expected counts for many words at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

MARK = "▁"
_BASE = np.uint64(1_000_003)
_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_BITS = 20


def vocabulary(path: str) -> tuple[list[str], list[int], np.ndarray]:
    """Pieces, the piece number of each byte, and starting weights from the vocabulary's own scores.

    A score of a merge vocabulary is a rank; a piece of rank r starts with weight 1 / (r + 10), a byte
    like the last rank.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    ids.sort(key=lambda i: -sp.get_score(i))
    pieces = [sp.id_to_piece(i) for i in ids]
    weights = [1.0 / (r + 10) for r in range(len(ids))] + [1.0 / (len(ids) + 10)] * 256
    return pieces, list(range(len(pieces), len(pieces) + 256)), np.array(weights)


class Lattice:
    """All ways to spell a word (with its leading mark) as pieces; single characters also as bytes."""

    def __init__(self, pieces: list[str], bytes_at: list[int]):
        self.pieces, self.bytes_at = pieces, np.array(bytes_at)
        self.size = len(pieces) + len(bytes_at)
        self.longest = max(map(len, pieces), default=1)
        self.hash = np.array([self._hash(p) for p in pieces], dtype=np.uint64)
        self.table = [np.full(1 << _BITS, -1, dtype=np.int32) for _ in _MULT]
        self.rest: dict[int, int] = {}
        for k, h in enumerate(self.hash):
            for t, m in zip(self.table, _MULT, strict=True):
                at = self._slot(np.array([h]), m)[0]
                if t[at] < 0:
                    t[at] = k
                    break
            else:
                self.rest[int(h)] = k

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * 1_000_003 + ord(c) + 1) % (1 << 64)
        return h

    @staticmethod
    def _slot(h: np.ndarray, m: np.uint64) -> np.ndarray:
        return ((h * m) >> np.uint64(64 - _BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes, -1 where there is none."""
        out = np.full(len(h), -1, dtype=np.int32)
        for t, m in zip(self.table, _MULT, strict=True):
            k = t[self._slot(h, m)]
            ok = (k >= 0) & (self.hash[k] == h)
            out[ok] = k[ok]
        for value, k in self.rest.items():
            out[h == np.uint64(value)] = k
        return out

    def groups(self, words: list[str], most: int = 4096, mark: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of equal length together: their places in the list, and their characters (after the mark)."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for part in np.split(order, cuts):
            n = int(lengths[part[0]]) if len(part) else 0
            step = max(1, min(most, 400_000 // (n + 1)))
            start = MARK if mark else ""
            for a in range(0, len(part), step):
                some = part[a : a + step]
                text = start.join(["", *[words[i] for i in some.tolist()]])
                yield some, np.frombuffer(text.encode("utf-32-le"), dtype="<u4").reshape(len(some), n + mark)

    def arcs(self, chars: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """(from, to) -> piece number of each word's stretch, -1 where it is none."""
        n, length = chars.shape
        h = np.zeros((length + 1, n), dtype=np.uint64)
        for i in range(length):
            h[i + 1] = h[i] * _BASE + chars[:, i].astype(np.uint64) + np.uint64(1)
        power = np.array([pow(int(_BASE), k, 1 << 64) for k in range(self.longest + 1)], dtype=np.uint64)
        out = {}
        for i in range(1, length + 1):
            for j in range(max(0, i - self.longest), i):
                k = self.find(h[i] - h[j] * power[i - j])
                if (k >= 0).any():
                    out[(j, i)] = k
        return out

    def spelled(self, chars: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """log weight of each character as bytes."""
        values, back = np.unique(chars, return_inverse=True)
        own = np.array([logp[self.bytes_at[list(chr(c).encode("utf-8", "surrogatepass"))]].sum() for c in values.tolist()])
        return own[back].reshape(chars.shape)

    def forward(self, arcs: dict, spelled: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """log of the summed weight of all spellings of each prefix."""
        n, length = spelled.shape
        a = np.full((length + 1, n), -np.inf)
        a[0] = 0
        padded = np.append(logp, -np.inf)
        for i in range(1, length + 1):
            a[i] = a[i - 1] + spelled[:, i - 1]
            for j in range(max(0, i - self.longest), i):
                k = arcs.get((j, i))
                if k is not None:
                    a[i] = np.logaddexp(a[i], a[j] + padded[k])
        return a

    def log_marginals(self, words: list[str], logp: np.ndarray) -> np.ndarray:
        """Natural log of the summed weight of all spellings of each word."""
        out = np.zeros(len(words))
        for at, chars in self.groups(words):
            out[at] = self.forward(self.arcs(chars), self.spelled(chars, logp), logp)[-1]
        return out

    def expected(self, words: list[str], counts: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Expected uses of each piece and byte over all spellings, words weighted by their counts."""
        total = np.zeros(self.size)
        padded = np.append(logp, -np.inf)
        for at, chars in self.groups(words):
            arcs, spelled, weight = self.arcs(chars), self.spelled(chars, logp), counts[at]
            a = self.forward(arcs, spelled, logp)
            length = chars.shape[1]
            b = np.full_like(a, -np.inf)
            b[length] = 0
            used, shares = [], []
            for i in range(length, 0, -1):
                b[i - 1] = np.logaddexp(b[i - 1], b[i] + spelled[:, i - 1])
                for j in range(max(0, i - self.longest), i):
                    k = arcs.get((j, i))
                    if k is not None:
                        b[j] = np.logaddexp(b[j], b[i] + padded[k])
                        share = np.exp(a[j] + padded[k] + b[i] - a[length]) * weight
                        ok = k >= 0
                        used.append(k[ok])
                        shares.append(share[ok])
            if used:
                total[: len(self.pieces)] += np.bincount(np.concatenate(used), np.concatenate(shares), minlength=len(self.pieces))
            by = np.exp(a[:-1] + spelled.T + b[1:] - a[length]) * weight
            values, back = np.unique(chars, return_inverse=True)
            per = np.bincount(back.reshape(-1), by.T.reshape(-1), minlength=len(values))
            for c, x in zip(values.tolist(), per.tolist(), strict=True):
                if x:
                    np.add.at(total, self.bytes_at[list(chr(c).encode("utf-8", "surrogatepass"))], x)
        return total
