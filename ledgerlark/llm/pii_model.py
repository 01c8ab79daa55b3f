"""A character-level bidirectional LSTM with CRF transitions, in numpy.

A text is cut into segments at safe places (sentence ends, blank lines, lines that begin with a label); a segment longer than WINDOW is covered
by overlapping windows. Each window gives label scores for its characters; where windows overlap, the scores are blended
with weights that fall towards a window's edge, and one Viterbi search over the whole segment reconciles them. Digits and
hexadecimal runs are read as classes, so segments that differ only there have the same scores and are computed once.
"""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np

from ledgerlark.llm import pii_cell

KINDS = ("email", "phone", "national_id", "street_address", "person_name")
#: 0 outside; 1+2k begins kind k, 2+2k continues it.
LABELS = 1 + 2 * len(KINDS)
WINDOW, STRIDE = 192, 112
#: Windows of similar length that run at once.
GROUP = 512
NEG = np.float32(-1e4)

_ASCII = " !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_SPECIAL = ["\n", "0", " ", "hex", "low", "up", "letter", "ordinal", "wide_at", "dash", "quote", "space", "other"]
PAD = 0
_ID = {c: i + 1 for i, c in enumerate([*_ASCII, *_SPECIAL])}
CLASSES = len(_ID) + 1


def _table() -> np.ndarray:
    t = np.full(0x11000, _ID["other"], np.uint8)
    for i in range(0x80, 0x11000):
        c = chr(i)
        if 0xD800 <= i < 0xE000:
            continue
        if c.isdigit() or c.isdecimal():
            t[i] = _ID["0"]
        elif c.isspace():
            t[i] = _ID["space"]
        elif c.islower():
            t[i] = _ID["low"]
        elif c.isupper():
            t[i] = _ID["up"]
        elif c.isalpha():
            t[i] = _ID["letter"]
    for i in range(0x30, 0x3A):
        t[i] = _ID["0"]
    for c in _ASCII:
        t[ord(c)] = _ID[c]
    for cs, name in (("\n\r  \x0b\x0c\x85", "\n"), ("\t", "space"), ("  ", " "), ("ºª°", "ordinal"), ("＠", "wide_at"), ("–—−‐‑", "dash"), ("“”„«»‘’", "quote")):
        for c in cs:
            t[ord(c)] = _ID[name]
    return t


_TABLE = _table()
_HEX = re.compile(r"[0-9a-f]{8,}")
_HEX_ID = _ID["hex"]


def _plain(text: str, i: int) -> bool:
    return 0 <= i < len(text) and text[i].isascii() and text[i].isalnum()


def encode(text: str) -> np.ndarray:
    """The class of each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ids = _TABLE[np.minimum(points, len(_TABLE) - 1)]
    for m in _HEX.finditer(text):  # whole runs that mix digits and letters
        a, b = m.span()
        run = m[0]
        if not (_plain(text, a - 1) or _plain(text, b) or run.isdigit() or run.isalpha()):
            ids[a:b] = _HEX_ID
    return ids


_END = re.compile(r"[.!?\"'](?:\s+[–—-])?\s+")
#: Blank lines, and lines that begin with a label, are cut in any case.
_LINE = re.compile(r"\n\s*\n\s*|\n(?=[A-Z][A-Za-z]*(?: [a-z]+){0,3}: )")
# Words of four letters and more that are shortened in addresses.
_SHORTENED = {"blvd", "pkwy", "terr", "bldg", "avda", "hlgs", "gdns", "strs", "plza"}


def _sentence_end(text: str, m: re.Match) -> bool:
    """Whether white space after a mark ends a sentence: after four letters, two digits or a closed bracket or quote, and
    before a letter, quote or one of @ | {, or a line break. So abbreviations, initials and streets written short don't."""
    s, e = m.start(), m.end()
    if e >= len(text) or not (text[e].isalpha() or text[e] in '"@|{' or "\n" in m[0]):
        return False
    if text[s] in "\"'":
        return s > 0 and text[s - 1] in ".!?"
    before = text[max(0, s - 4) : s]
    if len(before) == 4 and before.isalpha():
        return text[s] != "." or before.lower() not in _SHORTENED or (s > 4 and text[s - 5].isalpha())
    return len(before) >= 2 and (before[-2:].isdigit() or (before[-1] in "\"')>" and before[-2].isalnum()))


def segments(text: str) -> list[tuple[int, int]]:
    """Where the text is cut: spans [start, end). A personal detail doesn't cross a cut: abbreviations, initials and lines
    that run on stay together."""
    cuts = [(m.start() + 1, m.end()) for m in _END.finditer(text) if _sentence_end(text, m)]
    if "\n" in text:
        cuts = sorted(cuts + [m.span() for m in _LINE.finditer(text)], key=lambda c: (c[0], -c[1]))
    out, at = [], 0
    for a, b in cuts:
        if a < at:
            continue
        if a > at:
            out.append((at, a))
        at = b
    if at < len(text):
        out.append((at, len(text)))
    return out


class Model:
    """Parameters: w{f,b} class -> gates, u{f,b} state -> gates, bias, o output, ob, tr transitions, st starts."""

    NAMES = ("wf", "uf", "bf", "wb", "ub", "bb", "o", "ob", "tr", "st")

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = {k: np.ascontiguousarray(v, np.float32) for k, v in p.items()}
        self.cells: dict[str, object] = {}  # of the trained weights, made when first needed; None runs in numpy

    @classmethod
    def new(cls, hidden: int, seed: int) -> "Model":
        r = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p["w" + d] = r.normal(0, 0.2, (CLASSES, 4 * hidden))
            p["u" + d] = r.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            b = np.zeros(4 * hidden)
            b[hidden : 2 * hidden] = 1
            p["b" + d] = b
        p["o"] = r.normal(0, 0.1, (2 * hidden, LABELS))
        p["ob"] = np.zeros(LABELS)
        p["tr"] = np.zeros((LABELS, LABELS))
        p["st"] = np.zeros(LABELS)
        return cls(p)

    @classmethod
    def load(cls, path: str | Path) -> "Model":
        with np.load(path) as z:
            return cls({k: z[k] for k in cls.NAMES})

    def save(self, path: str | Path) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in self.p.items()})

    # Inference.

    def _lstm(self, ids: np.ndarray, d: str) -> np.ndarray:
        """States (T, B, H) of a batch of classes (T, B)."""
        h4 = self.p["u" + d].shape[1]
        n = h4 // 4
        if d not in self.cells:
            self.cells[d] = pii_cell.session(self.p["u" + d])
        if (cell := self.cells[d]) is not None:
            w, out = self.p["w" + d] + self.p["b" + d], np.empty((*ids.shape, n), np.float32)
            h = c = np.zeros((ids.shape[1], n), np.float32)
            for t in range(len(ids)):
                h, c = cell.run(None, {"x": np.take(w, ids[t], axis=0), "h": h, "c": c})
                out[t] = h
            return out
        # sigmoid(x) = tanh(x/2)/2 + 1/2: the first three gates are halved beforehand
        scale = np.ones(h4, np.float32)
        scale[: 3 * n] = 0.5
        w, u = (self.p["w" + d] + self.p["b" + d]) * scale, self.p["u" + d] * scale
        out = np.empty((*ids.shape, n), np.float32)
        h, c = np.zeros((ids.shape[1], n), np.float32), np.zeros((ids.shape[1], n), np.float32)
        for t in range(len(ids)):
            z = w[ids[t]]
            z += h @ u
            np.tanh(z, out=z)
            s = z[:, : 3 * n]
            s *= 0.5
            s += 0.5
            c = s[:, n : 2 * n] * c + s[:, :n] * z[:, 3 * n :]
            h = np.multiply(s[:, 2 * n : 3 * n], np.tanh(c), out=out[t])
        return out

    def emissions(self, windows: list[np.ndarray]) -> list[np.ndarray]:
        """Label scores (length, LABELS) of each window."""
        out: list[np.ndarray] = [None] * len(windows)  # type: ignore[list-item]
        order = sorted(range(len(windows)), key=lambda i: len(windows[i]))
        n = self.p["uf"].shape[0]
        for at in range(0, len(order), GROUP):
            group = order[at : at + GROUP]
            lengths = [len(windows[i]) for i in group]
            ahead = np.zeros((max(lengths), len(group)), np.int64)
            back = np.zeros_like(ahead)
            for j, i in enumerate(group):
                ahead[: lengths[j], j] = windows[i]
                back[: lengths[j], j] = windows[i][::-1]
            f, b = self._lstm(ahead, "f"), self._lstm(back, "b")
            ef, eb = f @ self.p["o"][:n] + self.p["ob"], b @ self.p["o"][n:]
            for j, i in enumerate(group):
                out[i] = ef[: lengths[j], j] + eb[: lengths[j], j][::-1]
        return out

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """The best label sequence of one segment."""
        tr, score = self.p["tr"], self.p["st"] + e[0]
        back = np.empty(e.shape, np.int8)
        for t in range(1, len(e)):
            m = score[:, None] + tr
            back[t] = m.argmax(0)
            score = m.max(0) + e[t]
        path = np.empty(len(e), np.int8)
        path[-1] = score.argmax()
        for t in range(len(e) - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path

    def viterbi_batch(self, es: list[np.ndarray]) -> list[np.ndarray]:
        """The same for segments of similar length at once."""
        if len(es) == 1:
            return [self.viterbi(es[0])]
        lengths = np.array([len(e) for e in es])
        t_max = int(lengths.max())
        alpha = np.zeros((t_max, LABELS, len(es)), np.float32)
        for j, x in enumerate(es):
            alpha[: len(x), :, j] = x
        tr = self.p["tr"]
        step = tr[:, :, None]
        alpha[0] += self.p["st"][:, None]
        for t in range(1, t_max):
            alpha[t] += (alpha[t - 1][:, None, :] + step).max(0)
        # The way back needs the best predecessor of one label only.
        paths = np.zeros((t_max, len(es)), np.int8)
        cols = np.arange(len(es))
        cur = alpha[lengths - 1, :, cols].argmax(1)
        for t in range(t_max - 1, -1, -1):
            live = t < lengths
            paths[t, live] = cur[live]
            if t:
                cur = np.where(live, (alpha[t - 1] + tr[:, cur]).argmax(0), cur)
        return [paths[:n, j] for j, n in enumerate(lengths)]

    def decode(self, segs: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
        """Spans (kind, start, end) of each segment of classes."""
        windows, owner = [], []
        for i, s in enumerate(segs):
            starts = [0] if len(s) <= WINDOW else [*range(0, len(s) - WINDOW, STRIDE), len(s) - WINDOW]
            for a in starts:
                windows.append(s[a : a + WINDOW])
                owner.append((i, a))
        scores: list[np.ndarray] = [None] * len(segs)  # type: ignore[list-item]
        weight: dict[int, np.ndarray] = {}
        for (i, a), e in zip(owner, self.emissions(windows)):
            if len(segs[i]) <= WINDOW:
                scores[i] = e
                continue
            if scores[i] is None:
                scores[i], weight[i] = np.zeros((len(segs[i]), LABELS), np.float32), np.zeros(len(segs[i]), np.float32)
            w = np.minimum(np.arange(1, len(e) + 1), np.arange(len(e), 0, -1)).astype(np.float32) ** 2
            if a == 0:
                w[: WINDOW // 2] = w.max()
            if a + len(e) == len(segs[i]):
                w[WINDOW // 2 :] = w.max()
            scores[i][a : a + len(e)] += e * w[:, None]
            weight[i][a : a + len(e)] += w
        for i, w in weight.items():
            scores[i] /= w[:, None]
        out: list[list[tuple[int, int, int]]] = [[] for _ in segs]
        order = sorted(range(len(segs)), key=lambda i: len(segs[i]))
        at = 0
        while at < len(order):
            n = 1
            while n < 256 and at + n < len(order) and (n + 1) * len(segs[order[at + n]]) <= 200_000:
                n += 1
            group = order[at : at + n]
            at += n
            for i, path in zip(group, self.viterbi_batch([scores[i] for i in group])):
                out[i] = spans_of(path)
        return out


def spans_of(path: np.ndarray) -> list[tuple[int, int, int]]:
    inside = np.flatnonzero(path)
    if not len(inside):
        return []
    out, start, kind, prev = [], -1, -1, -2
    for t in inside.tolist():
        label = int(path[t])
        k, begins = (label - 1) // 2, label % 2 == 1
        if begins or t != prev + 1 or k != kind:
            if start >= 0:
                out.append((kind, start, prev + 1))
            start, kind = t, k
        prev = t
    out.append((kind, start, prev + 1))
    return out


# Training.


def loss_and_grad(p: dict[str, np.ndarray], ids: np.ndarray, labels: np.ndarray, lengths: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log likelihood per character and its gradient. ids, labels (T, B); positions beyond a length are ignored."""
    T, B = ids.shape
    live = np.arange(T)[:, None] < lengths[None, :]
    total = float(live.sum())
    turn = np.where(live, lengths[None, :] - 1 - np.arange(T)[:, None], np.arange(T)[:, None])
    cols = np.arange(B)[None, :]
    n = p["uf"].shape[0]
    cache, states = {}, {}
    for d, x in (("f", ids), ("b", ids[turn, cols])):
        w, u = p["w" + d] + p["b" + d], p["u" + d]
        acts, cs, hs = np.empty((T, B, 4 * n), np.float32), np.empty((T, B, n), np.float32), np.empty((T, B, n), np.float32)
        h, c = np.zeros((B, n), np.float32), np.zeros((B, n), np.float32)
        for t in range(T):
            z = w[x[t]] + h @ u
            z[:, : 3 * n] = 0.5 * np.tanh(0.5 * z[:, : 3 * n]) + 0.5
            z[:, 3 * n :] = np.tanh(z[:, 3 * n :])
            c = z[:, n : 2 * n] * c + z[:, :n] * z[:, 3 * n :]
            h = z[:, 2 * n : 3 * n] * np.tanh(c)
            acts[t], cs[t], hs[t] = z, c, h
        cache[d], states[d] = (x, acts, cs, hs), hs
    hb = states["b"][turn, cols]
    both = np.concatenate([states["f"], hb], 2)
    e = both @ p["o"] + p["ob"]
    # CRF: forward and backward in log space.
    tr, st = p["tr"], p["st"]
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = st + e[0]
    for t in range(1, T):
        m = alpha[t - 1][:, :, None] + tr
        top = m.max(1)
        alpha[t] = np.where(live[t][:, None], top + np.log(np.exp(m - top[:, None, :]).sum(1)) + e[t], alpha[t - 1])
    for t in range(T - 2, -1, -1):
        m = tr[None] + (e[t + 1] + beta[t + 1])[:, None, :]
        top = m.max(2)
        beta[t] = np.where(live[t + 1][:, None], top + np.log(np.exp(m - top[:, :, None]).sum(2)), 0)
    top = alpha[-1].max(1)
    logz = top + np.log(np.exp(alpha[-1] - top[:, None]).sum(1))
    de = np.exp(alpha + beta - logz[None, :, None]) * live[:, :, None]
    dtr = np.zeros_like(tr)
    for t in range(1, T):
        pair = np.exp(alpha[t - 1][:, :, None] + tr + (e[t] + beta[t])[:, None, :] - logz[:, None, None])
        dtr += (pair * live[t][:, None, None]).sum(0)
    tt, bb = np.nonzero(live)
    gold = labels[tt, bb]
    score = st[labels[0]].sum() + e[tt, bb, gold].sum()
    np.subtract.at(de, (tt, bb, gold), 1)
    dst = np.exp(alpha[0] + beta[0] - logz[:, None]).sum(0)
    np.subtract.at(dst, labels[0], 1)
    step = live[1:]
    a, b = labels[:-1][step], labels[1:][step]
    score += tr[a, b].sum()
    np.subtract.at(dtr, (a, b), 1)
    g = {"tr": dtr, "st": dst, "ob": de.sum((0, 1)), "o": np.einsum("tbh,tbk->hk", both, de, optimize=True)}
    dh_all = de @ p["o"].T
    for d, dh in (("f", dh_all[:, :, :n]), ("b", dh_all[:, :, n:][turn, cols] * live[:, :, None])):
        x, acts, cs, hs = cache[d]
        u = p["u" + d]
        dz_all = np.empty_like(acts)
        dn, dc = np.zeros((B, n), np.float32), np.zeros((B, n), np.float32)
        for t in range(T - 1, -1, -1):
            i, f, o, gg = (acts[t][:, k * n : (k + 1) * n] for k in range(4))
            tc = np.tanh(cs[t])
            h = dh[t] + dn
            dc = dc + h * o * (1 - tc * tc)
            dz = dz_all[t]
            dz[:, :n] = dc * gg * i * (1 - i)
            dz[:, n : 2 * n] = dc * (cs[t - 1] if t else 0) * f * (1 - f)
            dz[:, 2 * n : 3 * n] = h * tc * o * (1 - o)
            dz[:, 3 * n :] = dc * i * (1 - gg * gg)
            dn, dc = dz @ u.T, dc * f
        flat = dz_all.reshape(-1, 4 * n)
        g["u" + d] = hs[:-1].reshape(-1, n).T @ dz_all[1:].reshape(-1, 4 * n)
        hot = np.zeros((CLASSES, flat.shape[0]), np.float32)
        hot[x.reshape(-1), np.arange(flat.shape[0])] = 1
        g["w" + d] = hot @ flat
        g["b" + d] = flat.sum(0)
    return float((logz.sum() - score) / total), {k: (v / total).astype(np.float32) for k, v in g.items()}
