"""A character-level bidirectional LSTM with CRF transitions, in numpy: training by Adam, batched Viterbi decoding."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

KINDS = ("email", "phone", "id", "address", "name")
#: Tags: 0 outside, then beginning and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
#: Window and the part of it that overlaps the next one (characters).
WINDOW, OVERLAP = 160, 48
N_CHARS = 135


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point: ASCII by itself (digits as one), others by category. 0 is padding."""
    by = {"Lu": 129, "Ll": 130, "Lo": 131, "Nd": 49, "Zs": 33, "Cc": 132}
    out = np.full(sys.maxunicode + 1, 133, np.uint8)
    for i in range(0x3000):
        out[i] = by.get(unicodedata.category(chr(i)), 133)
    out[0x3000:0xA4D0] = 131
    out[:128] = np.arange(1, 129)
    out[ord("0") : ord("9") + 1] = 49
    return out


def encode(text: str) -> np.ndarray:
    return _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


class Tagger:
    def __init__(self, hidden: int = 32, embedding: int = 20, seed: int = 42) -> None:
        rng = np.random.default_rng(seed)
        self.hidden = h = hidden
        init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {"emb": (0.3 * rng.normal(size=(N_CHARS, embedding))).astype(np.float32)}
        for d in "fb":
            self.p |= {f"wx{d}": init(embedding, 4 * h), f"wh{d}": init(h, 4 * h), f"b{d}": np.zeros(4 * h, np.float32)}
            self.p[f"b{d}"][h : 2 * h] = 1
        self.p |= {"wo": init(2 * h, TAGS), "bo": np.zeros(TAGS, np.float32), "tr": np.zeros((TAGS, TAGS), np.float32)}

    def _run(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple | None]:
        """x (T, B); hidden states (2, T, B, h) of both directions, each in its own order. Both go through one loop."""
        p, h, (t_max, n) = self.p, self.hidden, x.shape
        both = np.stack([x, x[::-1]], 1).astype(np.int32)
        both[:, 1] += N_CHARS
        table = np.concatenate([p["emb"] @ p[f"wx{d}"] + p[f"b{d}"] for d in "fb"])
        # The sigmoid is taken by tanh of half the argument: the halves are in the weights already.
        table[:, : 3 * h] *= 0.5
        wh = np.stack([p["whf"], p["whb"]])
        wh[:, :, : 3 * h] *= 0.5
        out = np.empty((t_max, 2, n, h), np.float32)
        gates = np.empty((t_max, 2, n, 4 * h), np.float32) if keep else None
        cells = np.empty((t_max, 2, n, h), np.float32) if keep else None
        hs, c = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        z, u = np.empty((2, n, 4 * h), np.float32), np.empty((2, n, h), np.float32)
        w = np.empty_like(z)
        for t in range(t_max):
            z = gates[t] if keep else z
            np.take(table, both[t], axis=0, out=z, mode="clip")
            if t:
                z += np.matmul(hs, wh, out=w)
            np.tanh(z, out=z)
            s = z[:, :, : 3 * h]
            s *= 0.5
            s += 0.5
            c = np.multiply(c, z[:, :, h : 2 * h], out=cells[t] if keep else c)
            c += np.multiply(z[:, :, :h], z[:, :, 3 * h :], out=u)
            hs = np.tanh(c, out=out[t])
            hs *= z[:, :, 2 * h : 3 * h]
        return out, (both, gates, cells, out)

    def _back(self, saved: tuple, grad: np.ndarray, g: dict[str, np.ndarray]) -> None:
        """grad (T, 2, B, h)."""
        p, h = self.p, self.hidden
        both, gates, cells, out = saved
        t_max, _, n = both.shape
        dz_all = np.empty((t_max, 2, n, 4 * h), np.float32)
        dh, dc = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        back = np.ascontiguousarray(np.stack([p["whf"].T, p["whb"].T]))
        i, f, o, u = (gates[..., k * h : (k + 1) * h] for k in range(4))
        tc = np.tanh(cells)
        before = np.concatenate([np.zeros((1, 2, n, h), np.float32), cells[:-1]])
        # What each gate's gradient is multiplied by doesn't depend on the loop.
        on_c = np.concatenate([u * i * (1 - i), before * f * (1 - f)], 3)
        on_o, on_u, through = tc * o * (1 - o), i * (1 - u * u), o * (1 - tc * tc)
        for t in range(t_max - 1, -1, -1):
            dh += grad[t]
            dc += dh * through[t]
            dz = dz_all[t]
            np.multiply(on_c[t, :, :, :h], dc, out=dz[:, :, :h])
            np.multiply(on_c[t, :, :, h:], dc, out=dz[:, :, h : 2 * h])
            np.multiply(on_o[t], dh, out=dz[:, :, 2 * h : 3 * h])
            np.multiply(on_u[t], dc, out=dz[:, :, 3 * h :])
            np.matmul(dz, back, out=dh)
            dc *= f[t]
        for k, d in enumerate("fb"):
            dz, x = np.ascontiguousarray(dz_all[:, k]), both[:, k].ravel() - k * N_CHARS
            flat = dz.reshape(-1, 4 * h)
            g[f"wh{d}"] = out[:-1, k].reshape(-1, h).T @ dz[1:].reshape(-1, 4 * h)
            table = np.zeros((N_CHARS, 4 * h), np.float32)
            order = np.argsort(x, kind="stable")
            chars = x[order]
            start = np.flatnonzero(np.r_[True, chars[1:] != chars[:-1]])
            table[chars[start]] = np.add.reduceat(flat[order], start, axis=0)
            g[f"b{d}"] = flat.sum(0)
            g[f"wx{d}"] = p["emb"].T @ table
            g["emb"] += table @ p[f"wx{d}"].T

    def emissions(self, x: np.ndarray) -> np.ndarray:
        out, _ = self._run(x)
        h = self.hidden
        return out[:, 0] @ self.p["wo"][:h] + (out[:, 1] @ self.p["wo"][h:])[::-1] + self.p["bo"]

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log-likelihood of the tags y (T, B) a window, and the gradient of its mean."""
        p, h, (t_max, n) = self.p, self.hidden, x.shape
        out, saved = self._run(x, True)
        both = np.concatenate([out[:, 0], out[::-1, 1]], 2)
        e = both @ p["wo"] + p["bo"]
        tr = np.exp(p["tr"])
        scale = np.exp(e - e.max(2, keepdims=True))
        alpha, beta, log_z = np.empty_like(e), np.empty_like(e), e.max(2).sum(0)
        a = scale[0]
        for t in range(t_max):
            a = a if not t else (a @ tr) * scale[t]
            s = a.sum(1, keepdims=True)
            a = a / s
            log_z = log_z + np.log(s[:, 0])
            alpha[t] = a
        v = np.ones((n, TAGS), np.float32)
        for t in range(t_max - 1, -1, -1):
            beta[t] = v
            v = (v * scale[t]) @ tr.T
            v /= v.sum(1, keepdims=True)
        post = alpha * beta
        post /= post.sum(2, keepdims=True)
        left, right = alpha[:-1].reshape(-1, TAGS), (beta[1:] * scale[1:]).reshape(-1, TAGS)
        total = np.einsum("nj,nj->n", left @ tr, right)
        pairs = (left / total[:, None]).T @ right * tr
        gold = np.take_along_axis(e, y[:, :, None], 2).sum() + p["tr"][y[:-1], y[1:]].sum()
        loss = float(log_z.sum() - gold) / n
        np.put_along_axis(post, y[:, :, None], np.take_along_axis(post, y[:, :, None], 2) - 1, 2)
        de = post / n
        g = {"tr": pairs / n, "emb": np.zeros_like(p["emb"])}
        np.add.at(g["tr"], (y[:-1].ravel(), y[1:].ravel()), -1.0 / n)
        g["wo"], g["bo"] = both.reshape(-1, 2 * h).T @ de.reshape(-1, TAGS), de.sum((0, 1))
        dh = de @ p["wo"].T
        self._back(saved, np.stack([dh[:, :, :h], dh[::-1, :, h:]], 1), g)
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 64, rate: float = 0.012, seed: int = 7) -> list[float]:
        """x, y (windows, T). Adam with a rate falling to a tenth; returns the losses."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        losses, queue = [], np.zeros(0, int)
        for step in range(1, steps + 1):
            if len(queue) < batch:
                queue = np.concatenate([queue, *(rng.permutation(len(x)) for _ in range(1 + batch // len(x)))])
            pick, queue = queue[:batch], queue[batch:]
            loss, g = self.loss_and_gradient(np.ascontiguousarray(x[pick].T), np.ascontiguousarray(y[pick].T))
            losses.append(loss)
            norm = np.sqrt(sum(float((w * w).sum()) for w in g.values()))
            lr, clip = rate * (1 - 0.9 * step / steps), np.float32(min(1.0, 25 / max(norm, 1e-9)))
            for k, w in g.items():
                w *= clip
                m[k] += 0.1 * (w - m[k])
                v[k] += 0.005 * (w * w - v[k])
                fix = np.sqrt(1 - 0.995**step) / (1 - 0.9**step)
                self.p[k] -= (lr * fix * m[k] / (np.sqrt(v[k]) + 1e-7)).astype(np.float32)
        return losses

    def viterbi(self, x: np.ndarray, favours: tuple[float, ...] = (0.0,)) -> list[np.ndarray]:
        """Best legal tags (windows, T) of x (windows, T) for each favour, which lowers the score of 'outside'.

        An inside tag follows only a tag of its kind. Windows that no path but the outside one can win are told by a bound and not
        decoded.
        """
        e = self.emissions(np.ascontiguousarray(x.T))
        out = []
        for k, favour in enumerate(favours):
            e[:, :, 0] -= favour - (favours[k - 1] if k else 0.0)
            out.append(self._best(e))
        return out

    def _best(self, e: np.ndarray) -> np.ndarray:
        t_max, n, _ = e.shape
        tr = self.p["tr"].copy()
        for k in range(2, TAGS, 2):
            legal = np.zeros(TAGS, bool)
            legal[k - 1 : k + 1] = True
            tr[~legal, k] = -1e4
        out = np.zeros((n, t_max), np.int8)
        # A step onto another tag wins at most this over a step from outside to outside; if none can win, the path stays outside.
        leaving = (e[:, :, 1:] + (tr.max(0)[1:] - tr[0, 0])).max(2) - e[:, :, 0]
        leaving[0] = (e[0, :, 1:]).max(1) - e[0, :, 0]
        home = max(0.0, float(tr[1:, 0].max() - tr[0, 0]))
        live = np.flatnonzero((leaving > -home).any(0))
        if not len(live):
            return out
        s = np.ascontiguousarray(e[:, live].transpose(0, 2, 1))
        back = np.empty((t_max, TAGS, len(live)), np.int8)
        starts = [0, *range(1, TAGS, 2)]
        v = s[0].copy()
        v[2::2] = -1e4
        for t in range(1, t_max):
            w = np.empty_like(v)
            for j in starts:
                c = v + tr[:, j, None]
                k = c.argmax(0)
                back[t, j] = k
                w[j] = np.take_along_axis(c, k[None], 0)[0]
            b, i = v[1::2] + np.diag(tr[1::2, 2::2])[:, None], v[2::2] + np.diag(tr[2::2, 2::2])[:, None]
            first = b > i
            w[2::2] = np.where(first, b, i)
            back[t, 2::2] = np.arange(2, TAGS, 2)[:, None] - first
            v = w + s[t]
        rows = np.arange(len(live))
        tag = v.argmax(0)
        got = np.empty((len(live), t_max), np.int8)
        got[:, -1] = tag
        for t in range(t_max - 1, 0, -1):
            tag = back[t, tag, rows]
            got[:, t - 1] = tag
        out[live] = got
        return out


def windows(codes: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """Overlapping windows over a stretch, the last one as long as what is left, and where each begins."""
    stride = WINDOW - OVERLAP
    starts = list(range(0, max(1, len(codes) - OVERLAP), stride))
    return [codes[s : s + WINDOW] for s in starts], starts


def reconcile(tags: list[np.ndarray], starts: list[int]) -> np.ndarray:
    """One tag for each character: where windows overlap, that of the window in whose middle the character lies deeper."""
    half = OVERLAP // 2
    out = np.zeros(starts[-1] + len(tags[-1]), np.int8)
    for k, s in enumerate(starts):
        lo = half if k else 0
        out[s + lo : s + len(tags[k])] = tags[k][lo:]
    return out


def spans(tags: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each tagged stretch; a beginning tag, or another kind, starts a new one."""
    kind = (tags.astype(np.int16) + 1) // 2
    on = kind > 0
    begin = on & ((tags % 2 == 1) | np.r_[True, kind[1:] != kind[:-1]])
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(on & np.r_[(kind[1:] != kind[:-1]) | begin[1:], True]) + 1
    return [(int(a), int(b), KINDS[kind[a] - 1]) for a, b in zip(starts, ends, strict=True)]
