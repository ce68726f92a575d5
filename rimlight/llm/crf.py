"""A linear-chain conditional random field over the words of a text.

A word's features are the byte n-grams of the word between two boundary marks, n from 1 to 4 (those
that hold a mark are its affixes), and the word itself if it is in the lexicon. Features are hashed
into a fixed number of weights for each label; neighbouring labels have learned transition weights.

Inference is exact forward-backward. Texts are cut into chunks of ``CHUNK`` words; the transfer matrix
of each chunk, chained over a text, gives the messages at its borders, so that all chunks of many
texts run side by side and a long text takes no longer chain of steps than a short one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import regex

LETTERS = regex.compile(r"\p{L}+")
BITS = 17
CHUNK = 96
#: Words whose scores a worker keeps.
MAX_WORDS = 100_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def features(vocabulary: list[str], lexicon: set[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature numbers of all words in a row, and where each word's begin."""
    marked = [b"\x01" + w.encode("utf-8", "surrogatepass") + b"\x02" for w in vocabulary]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    raw = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(raw))  # bytes to the end of the word
    codes, owners, gram = [], [], np.zeros(len(raw), np.uint64)
    for n in range(1, 5):
        gram = gram[:len(raw) - n + 1] * np.uint64(257) + raw[n - 1:] if n > 1 else raw
        inside = left[:len(gram)] >= n
        codes.append(((gram[inside] + np.uint64(n << 40)) * _SPREAD) >> np.uint64(64 - BITS))
        owners.append(owner[:len(gram)][inside])
    known = [i for i, w in enumerate(vocabulary) if w in lexicon]
    if known:
        from xxhash import xxh3_64_intdigest

        whole = np.fromiter((xxh3_64_intdigest(marked[i]) for i in known), np.uint64, len(known))
        codes.append(whole >> np.uint64(64 - BITS))
        owners.append(np.array(known))
    codes, owners = np.concatenate(codes), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return codes[order].astype(np.int64), np.searchsorted(owners[order], np.arange(len(marked)))


@dataclass
class Field:
    labels: list[str]
    lexicon: set[str]
    weights: np.ndarray  # hashed feature x label
    moves: np.ndarray  # from label x to label
    start: np.ndarray
    known: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": {}, "scores": None}

    def emissions(self, vocabulary: list[str]) -> np.ndarray:
        codes, at = features(vocabulary, self.lexicon)
        counts = np.diff(np.append(at, len(codes)))[:, None]
        return np.add.reduceat(self.weights[codes], at, axis=0) / np.sqrt(counts)

    def _lookup(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.known) > MAX_WORDS:
            self.known, self.scores = {}, None
        new = [w for w in dict.fromkeys(w for t in texts for w in t) if w not in self.known]
        if new:
            for a in range(0, len(new), 20_000):
                part = new[a:a + 20_000]
                rows = self.emissions(part)
                base = len(self.known)
                self.known.update(zip(part, range(base, base + len(part))))
                held = 0 if self.scores is None else len(self.scores)
                if base + len(part) > held:
                    grown = np.zeros((max(2 * held, base + len(part)), len(self.labels)))
                    if held:
                        grown[:held] = self.scores
                    self.scores = grown
                self.scores[base:base + len(part)] = rows
        return [np.fromiter(map(self.known.__getitem__, t), np.int64, len(t)) for t in texts]

    def marginals(self, texts: list[list[str]]) -> np.ndarray:
        """For each text (not empty) the expected number of words of each label."""
        n_labels = len(self.labels)
        at = self._lookup(texts)
        chunks = [(d, i) for d, ids in enumerate(at) for i in range(0, len(ids), CHUNK)]
        of = np.array([d for d, _ in chunks])
        length = np.array([min(CHUNK, len(at[d]) - i) for d, i in chunks])
        ids = np.zeros((CHUNK, len(chunks)), np.int64)
        for c, (d, i) in enumerate(chunks):
            ids[:length[c], c] = at[d][i:i + CHUNK]
        local = self.scores[ids]
        local = np.exp(local - local.max(axis=2, keepdims=True))  # step x chunk x label
        moves = np.exp(self.moves - self.moves.max())
        first = np.concatenate(([True], of[1:] != of[:-1]))
        start = np.exp(self.start - self.start.max())

        # transfer matrix of each chunk: (state before the chunk) -> (state of its last word)
        transfer = np.broadcast_to(np.eye(n_labels), (len(chunks), n_labels, n_labels)).copy()
        for t in range(int(length.max())):
            on = length > t
            step = (transfer[on] @ moves) * local[t][on][:, None, :]
            transfer[on] = step / step.sum(axis=(1, 2), keepdims=True)
        # messages at the borders of chunks, along every text
        place = np.arange(len(chunks)) - np.maximum.accumulate(np.where(first, np.arange(len(chunks)), 0))
        into = np.full((len(chunks), n_labels), 1.0 / n_labels)  # before the first word: see alpha below
        behind = np.ones((len(chunks), n_labels))
        head = np.where(first)[0]
        # the first word of a text has no transition: its chunk's matrix is applied from word two on
        entry = start * local[0][head]
        deepest = int(place.max())
        by_place = [np.where(place == k)[0] for k in range(deepest + 1)]
        if deepest:
            out = np.zeros((len(chunks), n_labels))
            alpha = entry / entry.sum(axis=1, keepdims=True)
            for t in range(1, int(length[head].max())):
                on = length[head] > t
                step = (alpha[on] @ moves) * local[t][head[on]]
                alpha[on] = step / step.sum(axis=1, keepdims=True)
            out[head] = alpha
            for k in range(1, deepest + 1):
                c = by_place[k]
                into[c] = out[c - 1]
                step = np.einsum("ci,cij->cj", into[c], transfer[c])
                out[c] = step / step.sum(axis=1, keepdims=True)
            for k in range(deepest, 0, -1):
                c = by_place[k]
                step = np.einsum("cij,cj->ci", transfer[c], behind[c])
                behind[c - 1] = step / step.sum(axis=1, keepdims=True)
        # forward and backward inside all chunks
        alpha = np.zeros_like(local)
        now = (into @ moves) * local[0]
        now[head] = entry
        alpha[0] = now / now.sum(axis=1, keepdims=True)
        for t in range(1, int(length.max())):
            on = length > t
            step = (alpha[t - 1][on] @ moves) * local[t][on]
            alpha[t][on] = step / step.sum(axis=1, keepdims=True)
        total = np.zeros((len(chunks), n_labels))
        beta = behind.copy()
        for t in range(int(length.max()) - 1, -1, -1):
            on = length > t
            post = alpha[t][on] * beta[on]
            total[on] += post / post.sum(axis=1, keepdims=True)
            step = (beta[on] * local[t][on]) @ moves.T
            beta[on] = step / step.sum(axis=1, keepdims=True)
        out = np.zeros((len(texts), n_labels))
        np.add.at(out, of, total)
        return out


def train(sequences: list[tuple[list[str], list[int]]], labels: list[str], lexicon: set[str], rounds: int = 4,
          batch: int = 64, rate: float = 0.3, seed: int = 5) -> Field:
    """Maximum conditional likelihood by AdaGrad over label-marked word sequences."""
    n_labels, rng = len(labels), np.random.default_rng(seed)
    vocabulary = list(dict.fromkeys(w for ws, _ in sequences for w in ws))
    index = {w: i for i, w in enumerate(vocabulary)}
    codes, at = features(vocabulary, lexicon)
    ends = np.append(at[1:], len(codes))
    crf = Field(labels, lexicon, np.zeros((1 << BITS, n_labels), np.float32), np.zeros((n_labels, n_labels)), np.zeros(n_labels))
    seen_w, seen_m, seen_s = np.full_like(crf.weights, 1e-2), np.full_like(crf.moves, 1e-2), np.full_like(crf.start, 1e-2)
    for _ in range(rounds):
        order = rng.permutation(len(sequences))
        for a in range(0, len(order), batch):
            part = [sequences[i] for i in order[a:a + batch]]
            used, inverse = np.unique(np.concatenate([[index[w] for w in ws] for ws, _ in part]), return_inverse=True)
            span = np.concatenate([np.arange(at[u], ends[u]) for u in used])
            feats, sizes = codes[span], (ends - at)[used]
            first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            scale = 1 / np.sqrt(sizes)[:, None]
            emission = np.add.reduceat(crf.weights[feats], first, axis=0) * scale
            longest = max(len(ws) for ws, _ in part)
            where, k = np.full((longest, len(part)), -1), 0
            gold = np.zeros((longest, len(part)), np.int64)
            for c, (ws, ys) in enumerate(part):
                where[:len(ws), c], gold[:len(ws), c] = inverse[k:k + len(ws)], ys
                k += len(ws)
            grad_e, grad_m, grad_s = _gradient(emission, where, gold, crf.moves, crf.start)
            rows = np.repeat(grad_e * scale, sizes, axis=0)
            touched, inv = np.unique(feats, return_inverse=True)
            g = np.stack([np.bincount(inv, rows[:, j], len(touched)) for j in range(n_labels)], axis=1) / len(part)
            seen_w[touched] += g * g
            crf.weights[touched] += rate * g / np.sqrt(seen_w[touched])
            for value, seen, g in ((crf.moves, seen_m, grad_m / len(part)), (crf.start, seen_s, grad_s / len(part))):
                seen += g * g
                value += rate * g / np.sqrt(seen)
    return crf


def _gradient(emission: np.ndarray, where: np.ndarray, gold: np.ndarray, moves: np.ndarray, start: np.ndarray):
    """Of the log likelihood: by word of ``emission``, by transition, by first label."""
    steps, n = where.shape
    n_labels = len(start)
    on = where >= 0
    local = np.exp(emission[where] - emission[where].max(axis=2, keepdims=True))
    move = np.exp(moves)
    alpha = np.zeros((steps, n, n_labels))
    alpha[0] = np.exp(start) * local[0]
    alpha[0] /= alpha[0].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        step = (alpha[t - 1] @ move) * local[t]
        alpha[t] = np.where(on[t][:, None], step / step.sum(axis=1, keepdims=True), alpha[t - 1])
    beta = np.ones((n, n_labels))
    grad_e, grad_m = np.zeros_like(emission, dtype=float), np.zeros_like(moves)
    grad_s = np.zeros(n_labels)
    for t in range(steps - 1, -1, -1):
        live = on[t]
        post = alpha[t][live] * beta[live]
        post /= post.sum(axis=1, keepdims=True)
        delta = -post
        delta[np.arange(len(delta)), gold[t][live]] += 1
        np.add.at(grad_e, where[t][live], delta)
        if t == 0:
            grad_s += delta.sum(axis=0)
            break
        pair = alpha[t - 1][live][:, :, None] * move[None] * (local[t][live] * beta[live])[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        grad_m -= pair.sum(axis=0)
        np.add.at(grad_m, (gold[t - 1][live], gold[t][live]), 1)
        step = (beta[live] * local[t][live]) @ move.T
        beta[live] = step / step.sum(axis=1, keepdims=True)
    return grad_e, grad_m, grad_s
