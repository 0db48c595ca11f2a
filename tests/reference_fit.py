"""Single-process NumPy version of the fit, the reference of the distributed one."""

import hashlib
import math
from dataclasses import dataclass, field

import numpy as np

from toposcope.operators.model import np_activation, np_activation_grad, np_encode, np_softmax

EPS_P = 1e-6


def np_normal(keys: list[str]) -> np.ndarray:
    """Box–Muller standard normals keyed by md5 (same draws as ``hashing.normal``)."""
    out = np.empty(len(keys))
    for n, k in enumerate(keys):
        hu = int(hashlib.md5((k + ":u").encode()).hexdigest()[:12], 16)
        hv = int(hashlib.md5((k + ":v").encode()).hexdigest()[:12], 16)
        u = (hu + 1.0) / (float(1 << 48) + 1.0)
        v = hv / float(1 << 48)
        out[n] = math.sqrt(-2.0 * math.log(u)) * math.cos(2.0 * math.pi * v)
    return out


def np_uniform(k: str) -> float:
    return int(hashlib.md5(k.encode()).hexdigest()[:12], 16) / float(1 << 48)


def batch_grad(tokens_list, counts_list, doc_ix, w: dict, beta: np.ndarray, act: str,
               seed: int, step: int, training: bool = True, bow_norm: bool = True, drop: float = 0.0):
    """Forward + backward for a list of sparse documents (not divided by the batch size).

    Returns (grads dict, d_beta dict word → K vector, rec sum, kl sum). ``beta`` is K × V.
    """
    n = len(tokens_list)
    k = beta.shape[0]
    mu, ls, a1, a2 = np_encode(tokens_list, counts_list, w, act, bow_norm)
    h1 = np_activation(act, a1)
    keep = np.ones_like(a2)
    if drop:
        keep = np.array([[np_uniform(f"{seed}:drop:{step}:{d}:{j}") >= drop for j in range(a2.shape[1])] for d in doc_ix]) / (1 - drop)
        h2 = np_activation(act, a2) * keep
        mu, ls = h2 @ w["Wmu"] + w["bmu"], h2 @ w["Ws"] + w["bs"]
    h2 = np_activation(act, a2) * keep
    if training:
        eps = np_normal([f"{seed}:{step}:{d}:{t}" for d in doc_ix for t in range(k)]).reshape(n, k)
    else:
        eps = np.zeros((n, k))
    sd = np.exp(0.5 * ls)
    z = mu + eps * sd
    theta = np_softmax(z)
    grads = {name: np.zeros_like(w[name]) for name in ("b1", "W2", "b2", "Wmu", "bmu", "Ws", "bs")}
    lens = np.array([len(t) for t in tokens_list], dtype=np.int64)
    tok = np.concatenate([np.asarray(t, dtype=np.int64) for t in tokens_list] + [np.zeros(0, np.int64)])
    cnt = np.concatenate([np.asarray(c, dtype=float) for c in counts_list] + [np.zeros(0)])
    doc = np.repeat(np.arange(n), lens)
    words, at = np.unique(tok, return_inverse=True)          # the words this batch touches
    cell_beta = beta[:, tok].T                               # cells × K
    p = np.einsum("ck,ck->c", theta[doc], cell_beta)
    rec_sum = float(-(cnt * np.log(p + EPS_P)).sum())
    g = -cnt / (p + EPS_P)
    d_theta = np.zeros((n, k))
    np.add.at(d_theta, doc, cell_beta * g[:, None])
    beta_rows = np.zeros((len(words), k))
    np.add.at(beta_rows, at, theta[doc] * g[:, None])
    kl = -0.5 * np.sum(1.0 + ls - mu * mu - np.exp(ls), axis=1)
    d_z = theta * (d_theta - np.sum(theta * d_theta, axis=1, keepdims=True))
    d_mu = d_z + mu
    d_ls = 0.5 * d_z * eps * sd + 0.5 * (np.exp(ls) - 1.0)
    grads["Wmu"] = h2.T @ d_mu
    grads["bmu"] = d_mu.sum(axis=0)
    grads["Ws"] = h2.T @ d_ls
    grads["bs"] = d_ls.sum(axis=0)
    d_h2 = d_mu @ w["Wmu"].T + d_ls @ w["Ws"].T
    d_a2 = d_h2 * keep * np_activation_grad(act, a2)
    grads["W2"] = h1.T @ d_a2
    grads["b2"] = d_a2.sum(axis=0)
    d_h1 = d_a2 @ w["W2"].T
    d_a1 = d_h1 * np_activation_grad(act, a1)
    grads["b1"] = d_a1.sum(axis=0)
    x = cnt / np.bincount(doc, weights=cnt, minlength=n)[doc] if bow_norm else cnt
    w1_rows = np.zeros((len(words), d_a1.shape[1]))
    np.add.at(w1_rows, at, d_a1[doc] * x[:, None])
    d_w1 = dict(zip(words.tolist(), w1_rows))
    d_beta = dict(zip(words.tolist(), beta_rows))
    return grads, d_w1, d_beta, rec_sum, float(kl.sum())


def beta_from(rho: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """K × V softmax over the vocabulary of alpha · rhoᵀ."""
    logit = alpha @ rho.T
    logit -= logit.max(axis=1, keepdims=True)
    e = np.exp(logit)
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class ModelState:
    """Dense parameters on the driver (model-sized): encoder weights, rho (V×E), alpha (K×E)."""
    w: dict
    rho: np.ndarray
    alpha: np.ndarray
    train_rho: bool = False      # word embeddings stay as given unless asked
    act: str = "relu"

    def beta(self) -> np.ndarray:
        return beta_from(self.rho, self.alpha)

    def names(self):
        return list(self.w) + ["alpha"] + (["rho"] if self.train_rho else [])

    def get(self, name):
        return self.alpha if name == "alpha" else self.rho if name == "rho" else self.w[name]

    def set(self, name, value):
        if name == "alpha":
            self.alpha = value
        elif name == "rho":
            self.rho = value
        else:
            self.w[name] = value


def assemble(grad_rows, state: ModelState):
    """Driver side of T5: dense gradients (mean over the batch) for every parameter, the
    softmax-over-vocabulary backward for alpha / rho, and the batch losses."""
    g = {name: np.zeros_like(state.get(name)) for name in state.names()}
    v, k = state.rho.shape[0], state.alpha.shape[0]
    d_beta = np.zeros((k, v))
    rec = kl = n = 0.0
    for r in grad_rows:
        name, i, vec = r["name"], int(r["i"]), np.asarray(r["vec"])
        if name == "_rec":
            rec = vec[0]
        elif name == "_kl":
            kl = vec[0]
        elif name == "_n":
            n = vec[0]
        elif name == "dbeta":
            d_beta[:, i] = vec
        elif name == "W1":
            g["W1"][i] = vec
        elif g[name].ndim == 1:
            g[name] = vec
        else:
            g[name][i] = vec
    beta = state.beta()
    d_logit = beta * (d_beta - np.sum(beta * d_beta, axis=1, keepdims=True))   # K × V
    g["alpha"] = d_logit @ state.rho
    if state.train_rho:
        g["rho"] = d_logit.T @ state.alpha
    n = max(n, 1.0)
    for name in g:
        g[name] = g[name] / n
    return g, rec / n, kl / n


@dataclass
class Adam:
    lr: float = 0.005
    wdecay: float = 1.2e-6
    b1: float = 0.9
    b2: float = 0.999
    eps: float = 1e-8
    t: int = 0
    m: dict = field(default_factory=dict)
    v: dict = field(default_factory=dict)

    def step(self, state: ModelState, grads: dict) -> None:
        self.t += 1
        for name, g in grads.items():
            p = state.get(name)
            g = g + self.wdecay * p
            m = self.b1 * self.m.get(name, 0.0) + (1 - self.b1) * g
            s = self.b2 * self.v.get(name, 0.0) + (1 - self.b2) * g * g
            self.m[name], self.v[name] = m, s
            mh = m / (1 - self.b1 ** self.t)
            vh = s / (1 - self.b2 ** self.t)
            state.set(name, p - self.lr * mh / (np.sqrt(vh) + self.eps))


@dataclass
class SGD:
    """Plain gradient steps (no weight decay)."""
    lr: float = 0.005

    def step(self, state: ModelState, grads: dict) -> None:
        for name, g in grads.items():
            state.set(name, state.get(name) - self.lr * g)


def clip_grads(grads: dict, max_norm: float) -> dict:
    """Global L2-norm clipping (``clip > 0``)."""
    if max_norm <= 0:
        return grads
    total = math.sqrt(sum(float(np.sum(g * g)) for g in grads.values()))
    if total > max_norm:
        scale = max_norm / (total + 1e-6)
        return {k: g * scale for k, g in grads.items()}
    return grads
