"""Bidirectional LSTM in numpy that labels the blocks of a page as main text or not.

A block's input is the sum of the vectors of its path tokens and the mean of the vectors of its hashed words; both
tables of vectors are learned with the recurrent weights (back-propagation through time, Adam).  Pages are run in
batches, padded to the longest; the backward direction reads each page from its own end.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from typing import Any

PATHS, WORDS = 4096, 8192  # hash buckets of the two tables
PATH_DIM, WORD_DIM, HIDDEN = 24, 8, 20
CELLS = 200_000  # (pages x blocks) padded into one batch

_SPLIT = re.compile(r"\w+|[^\w\s]")
_SEEN: dict[str, int] = {}


def _bucket(token: str, buckets: int) -> int:
    return zlib.crc32(token.encode()) % buckets


def path_ids(path: tuple[str, ...]) -> list[int]:
    """Buckets of the path's tokens; the innermost element once more as such, and how deep the path is in sections."""
    inner = max((i for i, t in enumerate(path) if not t.startswith(".") and t != "a"), default=0)
    return [_bucket(t, PATHS) for t in path] + [_bucket(f"last:{t}", PATHS) for t in path[inner:]]


def word_ids(text: str) -> list[int]:
    """Buckets of the lower-cased words and signs of the whole text, and of its length."""
    out = []
    for word in text.lower().split():
        k = _SEEN.get(word)
        if k is None:
            if len(_SEEN) > 200_000:
                _SEEN.clear()
            k = _SEEN[word] = _bucket(word, WORDS)
        out.append(k)
    n = len(out).bit_length()
    # the length is worth as much as all words together
    return out + [_bucket(f"length:{n}", WORDS)] * max(1, len(out))


@dataclass
class Labeller:
    """Weights; ``w`` by name."""

    w: dict[str, Any]

    @classmethod
    def fresh(cls, seed: int) -> Labeller:
        import numpy as np

        rng = np.random.default_rng(seed)
        d = PATH_DIM + WORD_DIM
        w = {"path": np.zeros((PATHS, PATH_DIM)), "word": np.zeros((WORDS, WORD_DIM)), "out": rng.normal(0, 0.3, 2 * HIDDEN), "bias": np.zeros(1)}
        w["path"] += rng.normal(0, 0.05, w["path"].shape)
        w["word"] += rng.normal(0, 0.05, w["word"].shape)
        for side in "fb":
            w["x" + side] = rng.normal(0, d**-0.5, (d, 4 * HIDDEN))
            w["h" + side] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
            w["c" + side] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])  # remember at first
        return cls(w)

    # pages: lists of (path ids, word ids) per block

    def _inputs(self, pages: list):
        """(blocks of all pages x dimensions, flat ids and their blocks for both tables)."""
        import numpy as np

        flat = [b for page in pages for b in page]
        sizes_p = np.array([len(p) for p, _ in flat])
        sizes_w = np.array([len(w) for _, w in flat])
        ids_p = np.fromiter((i for p, _ in flat for i in p), np.int64, sizes_p.sum())
        ids_w = np.fromiter((i for _, w in flat for i in w), np.int64, sizes_w.sum())
        # every block has at least one id of each kind, so the segments aren't empty
        xp = np.add.reduceat(self.w["path"][ids_p], np.cumsum(sizes_p) - sizes_p)
        xw = np.add.reduceat(self.w["word"][ids_w], np.cumsum(sizes_w) - sizes_w) / sizes_w[:, None]
        return np.concatenate([xp, xw], 1), (ids_p, sizes_p, ids_w, sizes_w)

    def _places(self, pages: list):
        """Time-major places of the blocks, forwards and backwards, and the mask (time x pages)."""
        import numpy as np

        sizes = np.array([len(p) for p in pages])
        page = np.repeat(np.arange(len(pages)), sizes)
        t = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        mask = np.arange(sizes.max())[:, None] < sizes[None, :]
        return (t, page), (sizes[page] - 1 - t, page), mask

    def _run(self, x, mask, side: str, keep: bool):
        """Hidden states (time x pages x HIDDEN) and, for training, what each step computed."""
        import numpy as np

        steps, n = mask.shape
        h = c = np.zeros((n, HIDDEN))
        out, kept = np.empty((steps, n, HIDDEN)), []
        pre = x @ self.w["x" + side] + self.w["c" + side]
        for t in range(steps):
            z = pre[t] + h @ self.w["h" + side]
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c_new = np.where(m, f * c + i * g, c)
            tc = np.tanh(c_new)
            h_new = np.where(m, o * tc, h)
            if keep:
                kept.append((h, c, i, f, o, g, tc))
            h, c = h_new, c_new
            out[t] = h
        return out, kept

    def _forward(self, pages: list, keep: bool = False):
        import numpy as np

        flat, ids = self._inputs(pages)
        ahead, back, mask = self._places(pages)
        xs, hs, kept = {}, {}, {}
        for side, place in (("f", ahead), ("b", back)):
            xs[side] = np.zeros((*mask.shape, flat.shape[1]))
            xs[side][place] = flat
            hs[side], kept[side] = self._run(xs[side], mask, side, keep)
        h = np.concatenate([hs["f"][ahead], hs["b"][back]], 1)
        p = 1 / (1 + np.exp(-(h @ self.w["out"] + self.w["bias"][0])))
        return p, (flat, ids, ahead, back, mask, xs, hs, kept, h)

    def probabilities(self, pages: list) -> list:
        """Per page the probability of main text of each block."""
        import numpy as np

        out: list = [np.empty(0)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:
            longest = len(pages[order[-1]])
            take = max(1, min(len(order), CELLS // longest, 64))
            some, order = order[-take:], order[:-take]
            p, _ = self._forward([pages[i] for i in some])
            for i, part in zip(some, np.split(p, np.cumsum([len(pages[i]) for i in some])[:-1]), strict=True):
                out[i] = part
        return out

    def gradients(self, pages: list, labels, known) -> tuple[float, dict]:
        """Loss and gradients; ``labels`` and ``known`` run over the blocks of all pages."""
        import numpy as np

        p, (flat, ids, ahead, back, mask, xs, hs, kept, h) = self._forward(pages, keep=True)
        n = max(1, known.sum())
        loss = -np.log(np.where(labels, p, 1 - p) + 1e-9)[known].mean() if known.any() else 0.0
        dz = (p - labels) * known / n
        grad = {"out": h.T @ dz, "bias": np.array([dz.sum()])}
        dh = dz[:, None] * self.w["out"]
        dflat = np.zeros_like(flat)
        for side, place, part in (("f", ahead, dh[:, :HIDDEN]), ("b", back, dh[:, HIDDEN:])):
            above = np.zeros((*mask.shape, HIDDEN))
            above[place] = part
            dx, more = self._back(xs[side], mask, kept[side], above, side)
            dflat += dx[place]
            grad |= more
        ids_p, sizes_p, ids_w, sizes_w = ids
        grad["path"], grad["word"] = np.zeros_like(self.w["path"]), np.zeros_like(self.w["word"])
        np.add.at(grad["path"], ids_p, np.repeat(dflat[:, :PATH_DIM], sizes_p, axis=0))
        np.add.at(grad["word"], ids_w, np.repeat(dflat[:, PATH_DIM:] / sizes_w[:, None], sizes_w, axis=0))
        return float(loss), grad

    def _back(self, x, mask, kept, above, side: str):
        import numpy as np

        steps, n = mask.shape
        dh = dc = np.zeros((n, HIDDEN))
        dpre = np.zeros((steps, n, 4 * HIDDEN))
        dwh = np.zeros_like(self.w["h" + side])
        for t in range(steps - 1, -1, -1):
            h_before, c_before, i, f, o, g, tc = kept[t]
            m = mask[t][:, None]
            dh = dh + above[t]
            live = np.where(m, dh, 0)
            dct = np.where(m, dc, 0) + live * o * (1 - tc**2)
            d = np.concatenate([dct * g * i * (1 - i), dct * c_before * f * (1 - f), live * tc * o * (1 - o), dct * i * (1 - g**2)], 1)
            dpre[t] = d
            dwh += h_before.T @ d
            dh = np.where(m, d @ self.w["h" + side].T, dh)
            dc = np.where(m, dct * f, dc)
        flat = dpre.reshape(-1, 4 * HIDDEN)
        grad = {"x" + side: x.reshape(-1, x.shape[2]).T @ flat, "h" + side: dwh, "c" + side: flat.sum(0)}
        return dpre @ self.w["x" + side].T, grad


def train(pages: list, labels: list, seed: int = 7, epochs: int = 6, batch: int = 32, rate: float = 0.01) -> Labeller:
    """``labels``: per page one number per block: 1 main text, 0 not, -1 unknown (no loss)."""
    import numpy as np

    model, rng = Labeller.fresh(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.w.items()}
    v = {k: np.zeros_like(x) for k, x in model.w.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(pages))
        for at in range(0, len(order), batch):
            some = [i for i in order[at : at + batch] if pages[i]]
            if not some:
                continue
            truth = np.concatenate([np.array(labels[i]) for i in some])
            _, grad = model.gradients([pages[i] for i in some], truth == 1, truth >= 0)
            step += 1
            size = np.sqrt(sum((g**2).sum() for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1.0, 5 / (size + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g**2
                now = rate * (0.3 if epoch >= epochs - 2 else 1.0)
                model.w[k] = model.w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model
