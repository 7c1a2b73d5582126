"""Character-level bidirectional LSTM with CRF transitions, in numpy.

Parameters: for each direction an input table (character to the four gates), recurrent weights
and bias; output weights; CRF transitions with a start row. Label 0 is text outside any span.
"""

from __future__ import annotations

import io
from pathlib import Path

import numpy as np

LABELS = ["", "email", "phone", "id_number", "address", "name"]
CHARACTERS = " abcdefghijklmnopqrstuvwxyzáéíóúüñABCDEFGHIJKLMNOPQRSTUVWXYZÁÉÍÓÚÜÑ0123456789.,;:¿?¡!-_@#+()[]/'\"°º%&ªçãõâêôàèìòù\n\t"
CODES = {c: k + 2 for k, c in enumerate(CHARACTERS)}  # 0: beyond the end, 1: any other
WEIGHTS = Path(__file__).with_name("pii_weights.npz")
GATES = ("wx_f", "wh_f", "wx_b", "wh_b")


_TABLE = np.ones(max(map(ord, CODES)) + 2, np.uint8)  # the last place stands for all characters beyond
for _c, _k in CODES.items():
    _TABLE[ord(_c)] = _k


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(points, len(_TABLE) - 1)]


def fresh(hidden: int, seed: int) -> dict[str, np.ndarray]:
    """Weights to start training from."""
    r = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p[f"wx_{d}"] = r.normal(0, 0.3, (len(CODES) + 2, 4 * hidden)).astype(np.float32)
        p[f"wx_{d}"][:, hidden : 2 * hidden] += 1.0  # the forget gate starts open
        p[f"wh_{d}"] = (r.normal(0, 1, (hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
    p["wo"] = (r.normal(0, 1, (2 * hidden, len(LABELS))) / np.sqrt(2 * hidden)).astype(np.float32)
    p["bo"] = np.zeros(len(LABELS), np.float32)
    p["trans"] = np.zeros((len(LABELS) + 1, len(LABELS)), np.float32)
    return p


def save(p: dict[str, np.ndarray], path: Path = WEIGHTS) -> None:
    np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in p.items()})


def load(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k].astype(np.float32) for k in z.files}


def _reverse(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each row's first lengths columns in reverse order, the rest as it is."""
    at = np.arange(x.shape[1])[None, :]
    turned = np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)
    return np.take_along_axis(x, turned.reshape(turned.shape + (1,) * (x.ndim - 2)), 1)


class Tagger:
    """Scores and decodes texts with given weights."""

    #: Characters of a window and by how many two windows overlap.
    WINDOW, OVERLAP = 256, 96
    #: Windows scored at once.
    BATCH = 512

    def __init__(self, p: dict[str, np.ndarray]):
        self.hidden = h = p["wh_f"].shape[0]
        # sigmoid(x) = (tanh(x / 2) + 1) / 2: with the three gates halved one tanh does for all four
        scale = np.ones(4 * h, np.float32)
        scale[: 3 * h] = 0.5
        self.wx = [p["wx_f"] * scale, p["wx_b"] * scale]
        self.wh = [np.ascontiguousarray(p["wh_f"] * scale), np.ascontiguousarray(p["wh_b"] * scale)]
        self.wo = [np.ascontiguousarray(p["wo"][:h]), np.ascontiguousarray(p["wo"][h:])]
        self.bo, self.start, self.trans = p["bo"], p["trans"][0], p["trans"][1:]
        # a text whose label 0 leads everywhere by more than transitions could ever win back is all 0
        self.lead = max(0.0, float((np.maximum(self.trans.max(), self.start.max()) - min(self.trans[0, 0], self.start[0])) * 2))

    def _run(self, x: np.ndarray, lengths: np.ndarray, d: int) -> np.ndarray:
        """Emissions (time, batch, labels) of one direction; windows in falling order of length."""
        h, (n, size) = self.hidden, x.shape
        out = np.zeros((size, n, len(LABELS)), np.float32)
        hs, cs = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        live = np.searchsorted(-lengths, -np.arange(size), "left")  # windows longer than t
        wx, wh, wo = self.wx[d], self.wh[d], self.wo[d]
        z, tmp, columns = np.empty((n, 4 * h), np.float32), np.empty((n, 4 * h), np.float32), np.ascontiguousarray(x.T)
        for t in range(size):
            k = live[t]
            if not k:
                break
            g, u = z[:k], tmp[:k]
            np.take(wx, columns[t, :k], axis=0, out=g)
            np.matmul(hs[:k], wh, out=u)
            g += u
            np.tanh(g, out=g)
            s = g[:, : 3 * h]
            s += 1.0
            s *= 0.5
            c = cs[:k]
            c *= g[:, h : 2 * h]
            w = u[:, :h]
            np.multiply(g[:, :h], g[:, 3 * h :], out=w)
            c += w
            np.tanh(c, out=w)
            np.multiply(w, g[:, 2 * h : 3 * h], out=hs[:k])
            np.matmul(hs[:k], wo, out=out[t, :k])
        return out

    def emissions(self, windows: list[np.ndarray]) -> list[np.ndarray]:
        """For each window of codes its scores, (characters, labels)."""
        found: list = [None] * len(windows)
        order = sorted(range(len(windows)), key=lambda k: -len(windows[k]))
        for lo in range(0, len(order), self.BATCH):
            part = order[lo : lo + self.BATCH]
            lengths = np.array([len(windows[k]) for k in part])
            x = np.zeros((len(part), max(1, lengths[0])), np.uint8)
            for row, k in enumerate(part):
                x[row, : lengths[row]] = windows[k]
            ahead = self._run(x, lengths, 0)
            back = self._run(_reverse(x, lengths), lengths, 1)
            for row, k in enumerate(part):
                n = lengths[row]
                found[k] = ahead[:n, row] + back[:n, row][::-1] + self.bo
        return found

    def scores(self, texts: list[str]) -> list[np.ndarray]:
        """Scores of whole texts: those of overlapping windows, weighted by the distance to the window's edge, in one row of characters."""
        windows, of = [], []
        step = self.WINDOW - self.OVERLAP
        for k, t in enumerate(texts):
            x = codes(t)
            for a in range(0, max(1, len(x) - self.OVERLAP), step):
                windows.append(x[a : a + self.WINDOW])
                of.append((k, a))
        each = self.emissions(windows)
        found: list = [None] * len(texts)
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for (k, a), e in zip(of, each):
            size = len(texts[k])
            if len(e) == size:
                found[k] = e
                continue
            total, weight = sums.setdefault(k, (np.zeros((size, len(LABELS)), np.float32), np.zeros((size, 1), np.float32)))
            at = np.arange(len(e))
            w = np.minimum(at + 1 if a else len(e), len(e) - at if a + len(e) < size else len(e)).clip(1, self.OVERLAP)[:, None].astype(np.float32)
            total[a : a + len(e)] += w * e
            weight[a : a + len(e)] += w
        for k, (total, weight) in sums.items():
            found[k] = total / weight
        return found

    def decode(self, each: list[np.ndarray]) -> list[np.ndarray | None]:
        """The best labels of whole texts under the CRF; None where all are 0.

        Texts are decoded side by side, in falling order of length.
        """
        found: list = [None] * len(each)
        open_texts = [k for k, e in enumerate(each) if len(e) and not (e[:, 0] - e[:, 1:].max(1) > self.lead).all()]
        open_texts.sort(key=lambda k: -len(each[k]))
        for lo in range(0, len(open_texts), self.BATCH):
            part = open_texts[lo : lo + self.BATCH]
            lengths = np.array([len(each[k]) for k in part])
            size = lengths[0]
            e = np.zeros((size, len(part), len(LABELS)), np.float32)
            for row, k in enumerate(part):
                e[: lengths[row], row] = each[k]
            live = np.searchsorted(-lengths, -np.arange(size), "left")
            best = np.empty_like(e)
            best[0] = self.start + e[0]
            for t in range(1, size):
                n = live[t]
                before, now = best[t - 1, :n], best[t, :n]
                np.add(before[:, :1], self.trans[0], out=now)
                for i in range(1, len(LABELS)):
                    np.maximum(now, before[:, i : i + 1] + self.trans[i], out=now)
                now += e[t, :n]
            labels, last = np.zeros((size, len(part)), np.int8), np.zeros(len(part), np.int64)
            for t in range(size - 1, -1, -1):
                n = live[t]
                on = live[t + 1] if t + 1 < size else 0  # texts that go on: their label leads back
                if on:
                    last[:on] = (best[t, :on] + self.trans.T[last[:on]]).argmax(1)
                if n > on:
                    last[on:n] = best[t, on:n].argmax(1)
                labels[t, :n] = last[:n]
            hits = labels.any(0)
            for row, k in enumerate(part):
                if hits[row]:
                    found[k] = labels[: lengths[row], row].copy()
        return found

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of each text's decoded spans."""
        found = []
        for labels in self.decode(self.scores(texts)):
            if labels is None:
                found.append([])
                continue
            cuts = np.flatnonzero(np.diff(labels, prepend=0, append=0))
            found.append([(int(a), int(b), LABELS[labels[a]]) for a, b in zip(cuts[:-1], cuts[1:]) if labels[a]])
        return found


# Training


def _forward(x: np.ndarray, wx: np.ndarray, wh: np.ndarray):
    h, (n, size) = wh.shape[0], x.shape
    gates, cells, hs = np.empty((size, n, 4 * h), np.float32), np.zeros((size + 1, n, h), np.float32), np.zeros((size + 1, n, h), np.float32)
    for t in range(size):
        g = wx[x[:, t]] + hs[t] @ wh
        g[:, : 3 * h] = 0.5 * np.tanh(0.5 * g[:, : 3 * h]) + 0.5
        np.tanh(g[:, 3 * h :], out=g[:, 3 * h :])
        gates[t] = g
        cells[t + 1] = g[:, h : 2 * h] * cells[t] + g[:, :h] * g[:, 3 * h :]
        hs[t + 1] = g[:, 2 * h : 3 * h] * np.tanh(cells[t + 1])
    return gates, cells, hs


def _backward(x: np.ndarray, wh: np.ndarray, kept, dh_out: np.ndarray, vocabulary: int):
    gates, cells, hs = kept
    h, (n, size) = wh.shape[0], x.shape
    dz = np.empty((size, n, 4 * h), np.float32)
    dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
    for t in range(size - 1, -1, -1):
        g = gates[t]
        i, f, o, u = g[:, :h], g[:, h : 2 * h], g[:, 2 * h : 3 * h], g[:, 3 * h :]
        dh = dh + dh_out[t]
        tc = np.tanh(cells[t + 1])
        dc = dc + dh * o * (1 - tc * tc)
        d = dz[t]
        d[:, :h] = dc * u * i * (1 - i)
        d[:, h : 2 * h] = dc * cells[t] * f * (1 - f)
        d[:, 2 * h : 3 * h] = dh * tc * o * (1 - o)
        d[:, 3 * h :] = dc * i * (1 - u * u)
        dc = dc * f
        dh = d @ wh.T
    flat = dz.reshape(-1, 4 * h)
    dwh = hs[:-1].reshape(-1, h).T @ flat
    one = np.zeros((vocabulary, flat.shape[0]), np.float32)
    one[x.T.reshape(-1), np.arange(flat.shape[0])] = 1
    return one @ flat, dwh


def _crf(e: np.ndarray, y: np.ndarray, mask: np.ndarray, trans: np.ndarray):
    """Mean negative log-likelihood and its gradients; e (time, batch, labels), y and mask (time, batch)."""
    size, n, k = e.shape
    inner = trans[1:]
    alpha = np.empty_like(e)
    alpha[0] = trans[0] + e[0]
    for t in range(1, size):
        s = alpha[t - 1][:, :, None] + inner
        top = s.max(1)
        new = top + np.log(np.exp(s - top[:, None]).sum(1)) + e[t]
        alpha[t] = np.where(mask[t][:, None], new, alpha[t - 1])
    top = alpha[-1].max(1)
    z = top + np.log(np.exp(alpha[-1] - top[:, None]).sum(1))
    beta = np.zeros((n, k), np.float32)
    de, dtrans = np.zeros_like(e), np.zeros_like(trans)
    for t in range(size - 1, -1, -1):
        p = np.exp(alpha[t] + beta - z[:, None]) * mask[t][:, None]
        de[t] = p
        if t:
            s = inner + (e[t] + beta)[:, None, :]
            pair = np.exp(alpha[t - 1][:, :, None] + s - z[:, None, None]) * mask[t][:, None, None]
            dtrans[1:] += pair.sum(0)
            top = s.max(2)
            new = top + np.log(np.exp(s - top[:, :, None]).sum(2))
            beta = np.where(mask[t][:, None], new, beta)
    dtrans[0] = de[0].sum(0)
    rows = np.arange(n)
    gold = np.zeros(n, np.float32)
    for t in range(size):
        m = mask[t].astype(np.float32)
        de[t, rows, y[t]] -= m
        gold += m * e[t, rows, y[t]]
        if t:
            gold += m * inner[y[t - 1], y[t]]
            np.subtract.at(dtrans, (y[t - 1] + 1, y[t]), m)
        else:
            gold += trans[0][y[0]]
            np.subtract.at(dtrans[0], y[0], 1)
    return float((z - gold).mean()), de / n, dtrans / n


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, lengths: np.ndarray):
    """(loss, gradients) of a batch: codes, labels (both batch, time) and lengths."""
    v = p["wx_f"].shape[0]
    back_x = _reverse(x, lengths)
    f, b = _forward(x, p["wx_f"], p["wh_f"]), _forward(back_x, p["wx_b"], p["wh_b"])
    hf = f[2][1:]
    hb = np.ascontiguousarray(_reverse(np.ascontiguousarray(b[2][1:].transpose(1, 0, 2)), lengths).transpose(1, 0, 2))
    both = np.concatenate([hf, hb], 2)
    e = both @ p["wo"] + p["bo"]
    mask = np.arange(x.shape[1])[:, None] < lengths[None, :]
    loss, de, dtrans = _crf(e, np.ascontiguousarray(y.T), mask, p["trans"])
    h = hf.shape[2]
    g = {"trans": dtrans, "bo": de.sum((0, 1)), "wo": both.reshape(-1, 2 * h).T @ de.reshape(-1, de.shape[2])}
    dboth = de @ p["wo"].T
    g["wx_f"], g["wh_f"] = _backward(x, p["wh_f"], f, dboth[:, :, :h], v)
    db = np.ascontiguousarray(_reverse(np.ascontiguousarray(dboth[:, :, h:].transpose(1, 0, 2)), lengths).transpose(1, 0, 2))
    g["wx_b"], g["wh_b"] = _backward(back_x, p["wh_b"], b, db, v)
    return loss, g


class Adam:
    def __init__(self, p: dict[str, np.ndarray]):
        self.m, self.v, self.t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray], rate: float, clip: float = 5.0) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        shrink = min(1.0, clip / (norm + 1e-6))
        for k, x in g.items():
            x = x * shrink
            self.m[k] = 0.9 * self.m[k] + 0.1 * x
            self.v[k] = 0.999 * self.v[k] + 0.001 * x * x
            p[k] -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
