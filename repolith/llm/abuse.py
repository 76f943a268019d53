"""Abusive, hateful or sexual content (problem 8).

A bidirectional gated recurrent network with attention pooling, written and
trained in numpy. Each token enters twice: as a word and as the mean of its
character trigrams, both hashed, after spellings have been folded (letters of
other scripts that look alike, zero-width characters, digits and signs for
letters, spaced-out letters, repeated letters). No word list enters; what a word
means is learned from the labelled texts.

The network reads a whole document, in blocks that overlap by ``MARGIN`` tokens on
either side, so that every token has a state that has seen its neighbours. The
attention then pools every window of ``WINDOW`` consecutive tokens (all of them,
one per token), and a document's score is that of its worst window: length does
not dilute it, and the recurrent part runs once per token, not once per window.

Training is multiple-instance: a labelled text answers for its worst window, so
the neutral sentences around an insult are not taken for insults. The labelled
texts say little about how code, logs and reports read, so that many texts are
drawn from the documents themselves (``MAX_BACKGROUND``, none above
``BACKGROUND_CHARS``, by a hash of doc_id) as presumably harmless; those that
networks trained without them find harmful are left out again, as are labels
that held-out networks contradict. A network can learn a wrong label by heart, from
a rare meeting of ordinary words; it would then flag harmless texts with the same
words. So a positive label whose words are all ordinary in the background takes no
part until networks trained without it agree with it. The labelled table is bounded (``MAX_LABELS``
rows, chosen by a hash of sample_id where there are more); the documents are all
scored, whole. Networks are trained side by side in tasks and kept under a digest
of what they were trained on.

Defined results: null, empty and wordless texts score 0; rows with a null label
or text are not trained on; without labels of both kinds every score is 0; of
several labels of one sample_id each counts.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.runtime import spread

WINDOW, BLOCK, MARGIN = 24, 96, 16
HIDDEN, WORD_DIMS, CHAR_DIMS, BUCKETS = 16, 16, 24, 8192
INPUT = WORD_DIMS + CHAR_DIMS
MAX_LABELS, MAX_BACKGROUND, BACKGROUND_CHARS = 20_000, 4_000, 3_000
STEPS, BATCH, CROP, RATE, FOLDS, MEMBERS = 260, 64, 88, 6e-3, 4, 2
THRESHOLD = 0.6
#: What held-out networks must say of a positive label, or those that know it, and from where on a background text counts as harmful.
HELD, LEARNED, HARMFUL = 0.25, 0.6, 0.12
#: A word in a smaller share of the background is odd; what held-out networks must say of a positive label without odd words.
ODD, AGREED = 0.004, 0.5

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
_LOOKALIKES = str.maketrans("аеорсухкмнтвіјѕԁɡһΑΒΕΖΗΙΚΜΝΟΡΤΥΧαεικνορτυχАВЕКМНОРСТУХ", "aeopcyxkmhtbijsdghabezhikmnoptyxaeiknoptuxabekmhopctyx")
_INVISIBLE = (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD, 0x034F, 0x180E)
_SIGNS = str.maketrans("013457@$", "oieastas")
_RUN = re.compile(r"([^\W\d])\1+")

_TOKEN = re.compile(r"(?<!\w)[^\W\d_](?:[ .\-*_|][^\W\d_]){3,}(?!\w)|[^\W_](?:[^\W_]|[@$*'’]{1,7}(?=[^\W_])|[@$](?![^\W_]))*|[@$][^\W\d_]+")
_HIDDEN = re.compile("[" + "".join(map(chr, _INVISIBLE)) + "]")
_HAN_GAP = re.compile(r"(?<=[㐀-鿿])[ ·.\-*_|•]{1,3}(?=[㐀-鿿])")
_HAN = re.compile(r"[㐀-鿿]+|[^㐀-鿿]+")
_SPACED = re.compile(r"[ .\-*_|]")


def fold(token: str) -> tuple[str, ...]:
    """The model's tokens of one written token."""
    if not token.isascii():
        token = unicodedata.normalize("NFKC", token)
        if re.search(r"[A-Za-z]", token):
            token = token.translate(_LOOKALIKES)
    if len(token) > 6 and _SPACED.match(token, 1) and all(_SPACED.match(token, i) for i in range(1, len(token), 2)):
        token = token[::2]
    low = token.lower()
    if re.search(r"[a-z]", low):
        if re.search(r"[0-9@$]", low) and not re.search(r"\d{2,}$|^[1-9]\d*[a-z]{1,2}$|^\d{2,}", low):
            low = low.translate(_SIGNS)
        if _RUN.search(low):
            low = _RUN.sub(r"\1", low)  # doubled letters count once, in every word alike
    if low.isdigit():
        return ("0",)
    if low.isascii():
        return (low,)
    out: list[str] = []
    for part in _HAN.findall(low):
        if "㐀" <= part[0] <= "鿿":
            out += [part[i : i + 2] for i in range(len(part) - 1)] or [part]
        else:
            out.append(part)
    return tuple(out)


class Tokens:
    """Splits texts; remembers how tokens fold, up to a bound."""

    LIMIT = 100_000

    def __init__(self) -> None:
        self.known: dict[str, tuple[str, ...]] = {}

    def __call__(self, text: str) -> list[str]:
        if not text.isascii():
            text = _HAN_GAP.sub("", _HIDDEN.sub("", text))
        known = self.known
        if len(known) > self.LIMIT:
            known.clear()
        out: list[str] = []
        for token in _TOKEN.findall(text):
            parts = known.get(token)
            if parts is None:
                parts = known[token] = fold(token)
            out += parts
        return out


def word_id(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def gram_ids(word: str) -> list[int]:
    marked = f"<{word}>"
    return [zlib.crc32(b"#" + marked[i : i + 3].encode()) % BUCKETS for i in range(max(1, len(marked) - 2))]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def window_logits(value: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled logits of all windows of each row, and the weights of the tokens in them.

    ``value`` and ``score`` are (B, T) with T >= WINDOW; a score of -1e9 marks padding.
    """
    v = np.lib.stride_tricks.sliding_window_view(value, WINDOW, axis=1)
    s = np.lib.stride_tricks.sliding_window_view(score, WINDOW, axis=1)
    w = np.exp(s - s.max(2, keepdims=True))
    w /= w.sum(2, keepdims=True)
    return (w * v).sum(2), w


class BiGRU:
    """Parameters and the two passes. Shapes: B texts, T steps, H hidden units per direction."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        d, h = INPUT, HIDDEN
        f = np.float32
        self.p = {
            "word": (r.normal(0, 0.1, (BUCKETS, WORD_DIMS))).astype(f),
            "char": (r.normal(0, 0.3, (BUCKETS, CHAR_DIMS))).astype(f),
            "attend": r.normal(0, 0.2, (2 * h, h)).astype(f), "attend_v": r.normal(0, 0.2, h).astype(f),
            "out": r.normal(0, 0.2, 2 * h).astype(f), "bias": np.zeros(1, f),
        }
        for way in "fb":
            self.p[f"W{way}"] = r.normal(0, (1 / d) ** 0.5, (d, 3 * h)).astype(f)
            self.p[f"U{way}"] = r.normal(0, (1 / h) ** 0.5, (h, 3 * h)).astype(f)
            self.p[f"b{way}"] = np.zeros(3 * h, f)

    def project(self, x: np.ndarray, way: str) -> np.ndarray:
        return x @ self.p[f"W{way}"] + self.p[f"b{way}"]

    def run(self, px: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (T, 2, B, H) of both directions side by side; projected inputs (T, 2, B, 3H), the second direction turned round, and mask (T, 2, B, 1).

        sigmoid(x) = (1 + tanh(x / 2)) / 2: the gates (2H of 3H) take half inputs, half weights and one tanh.
        """
        steps, _, batch, _ = px.shape
        h = HIDDEN
        u = np.stack([self.p["Uf"], self.p["Ub"]])
        gates, new = 0.5 * u[..., : 2 * h], u[..., 2 * h :]
        state = np.zeros((2, batch, h), px.dtype)
        out = np.empty((steps, 2, batch, h), px.dtype)
        whole = mask.all(axis=(1, 2, 3)).tolist()
        for t in range(steps):
            before = state
            zr = np.tanh(px[t, ..., : 2 * h] + before @ gates)
            zr *= 0.5
            zr += 0.5
            z, reset = zr[..., :h], zr[..., h:]
            candidate = np.tanh(px[t, ..., 2 * h :] + (reset * before) @ new)
            m = 1 if whole[t] and keep is None else mask[t]
            state = before + z * (candidate - before) * m
            out[t] = state
            if keep is not None:
                keep.append((t, before, z, reset, candidate, m))
        return out

    def states(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (B, T, 2H) of whole texts."""
        px = np.stack([self.project(x, "f"), self.project(x, "b")[:, ::-1]]) * np.r_[np.full(2 * HIDDEN, 0.5, x.dtype), np.ones(HIDDEN, x.dtype)]
        masks = np.stack([mask, mask[:, ::-1]]).astype(x.dtype)
        both = self.run(np.ascontiguousarray(np.moveaxis(px, 2, 0)), np.ascontiguousarray(np.moveaxis(masks, 2, 0))[..., None], keep)
        return np.moveaxis(np.concatenate([both[:, 0], both[::-1, 1]], axis=2), 0, 1)

    def heads(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What each token says (logit), how much it is attended to, and the hidden layer of the attention."""
        hidden = np.tanh(states @ self.p["attend"])
        score = np.where(mask > 0, hidden @ self.p["attend_v"], -1e9)
        return states @ self.p["out"] + self.p["bias"][0], score, hidden

    def gradients(self, x: np.ndarray, mask: np.ndarray, grad_of) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Gradients of the parameters and of the inputs x (B, T, D); ``grad_of(logits)`` is d loss / d window logits (B, T - WINDOW + 1)."""
        p, h = self.p, HIDDEN
        kept: list = []
        states = self.states(x, mask, kept)
        value, score, hidden = self.heads(states, mask)
        logits, weight = window_logits(value, score)
        d = grad_of(logits).astype(x.dtype)
        d_value, d_score = np.zeros_like(value), np.zeros_like(value)
        rows, starts = np.nonzero(d)
        for k in range(WINDOW):  # windows that take part are few
            w, at = weight[rows, starts, k] * d[rows, starts], (rows, starts + k)
            np.add.at(d_value, at, w)
            np.add.at(d_score, at, w * (value[at] - logits[rows, starts]))
        g = {"out": np.tensordot(states, d_value, axes=((0, 1), (0, 1))), "bias": np.array([d_value.sum()], x.dtype)}
        d_score = d_score * (mask > 0)
        g["attend_v"] = np.tensordot(hidden, d_score, axes=((0, 1), (0, 1)))
        d_hidden = d_score[..., None] * p["attend_v"] * (1 - hidden**2)
        g["attend"] = np.tensordot(states, d_hidden, axes=((0, 1), (0, 1)))
        d_states = d_value[..., None] * p["out"] + d_hidden @ p["attend"].T
        d_both = np.ascontiguousarray(np.moveaxis(np.stack([d_states[..., :h], d_states[:, ::-1, h:]]), 2, 0))
        u = np.stack([p["Uf"], p["Ub"]])
        gates, new = np.ascontiguousarray(np.swapaxes(u[..., : 2 * h], 1, 2)), np.ascontiguousarray(np.swapaxes(u[..., 2 * h :], 1, 2))
        d_steps = np.empty((x.shape[1], 2, len(x), 3 * h), x.dtype)
        carry = np.zeros((2, len(x), h), x.dtype)
        for t, before, z, reset, candidate, m in reversed(kept):
            ds = d_both[t] + carry
            dm = ds * m
            gain = dm * z
            d = d_steps[t]
            d[..., 2 * h :] = dc = gain * (1 - candidate * candidate)
            back = dc @ new
            d[..., :h] = (candidate - before) * gain * (1 - z)
            d[..., h : 2 * h] = back * before * reset * (1 - reset)
            carry = ds - gain + back * reset + d[..., : 2 * h] @ gates
        before = np.stack([k[1] for k in kept])
        gated = before * np.stack([k[3] for k in kept])
        d_px = np.moveaxis(d_steps, 0, 2)
        g_u = [np.concatenate([np.tensordot(before[:, k], d_steps[:, k, :, : 2 * h], axes=((0, 1), (0, 1))), np.tensordot(gated[:, k], d_steps[:, k, :, 2 * h :], axes=((0, 1), (0, 1)))], axis=1) for k in (0, 1)]
        d_x = np.zeros_like(x)
        for k, way in enumerate("fb"):
            d = d_px[k] if way == "f" else d_px[k][:, ::-1]
            g[f"U{way}"] = g_u[k]
            g[f"W{way}"] = np.tensordot(x, d, axes=((0, 1), (0, 1)))
            g[f"b{way}"] = d.sum((0, 1))
            d_x += d @ p[f"W{way}"].T
        return g, d_x, logits


def _groups(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that brings equal ids together, where each group starts, and its id."""
    order = np.argsort(ids, kind="stable")
    unique, starts = np.unique(ids[order], return_index=True)
    return order, starts, unique


class _Table:
    """Hashed words and trigrams of the distinct tokens of the training texts."""

    def __init__(self, texts: list[list[str]]) -> None:
        self.index = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        self.words = np.array([word_id(w) for w in self.index])
        grams = [gram_ids(w) for w in self.index]
        self.counts = np.array([len(g) for g in grams], np.float32)
        self.flat = np.concatenate([np.array(g) for g in grams])
        self.owner = np.repeat(np.arange(len(grams)), self.counts.astype(int))
        self.starts = np.concatenate([[0], np.cumsum(self.counts.astype(int))[:-1]])

    def inputs(self, p: dict[str, np.ndarray]) -> np.ndarray:
        chars = np.add.reduceat(p["char"][self.flat], self.starts, axis=0)
        return np.concatenate([p["word"][self.words], chars / self.counts[:, None]], axis=1)

    def spread(self, seen: np.ndarray, d: np.ndarray, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Gradients of the embeddings from those of the inputs of the tokens ``seen``."""
        out = {"word": np.zeros_like(p["word"]), "char": np.zeros_like(p["char"])}
        np.add.at(out["word"], self.words[seen], d[:, :WORD_DIMS])
        sizes = self.counts[seen].astype(int)
        which = np.repeat(np.arange(len(seen)), sizes)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        grams = self.flat[self.starts[seen][which] + inside]
        order, starts, ids = _groups(grams)
        out["char"][ids] = np.add.reduceat((d[:, WORD_DIMS:] / self.counts[seen][:, None])[which][order], starts, axis=0)
        return out


def _fit(labelled: list[tuple[np.ndarray, int]], background: list[np.ndarray], table: _Table, steps: int, seed: int) -> BiGRU:
    """One network, trained on batches of half labelled and half background texts."""
    rng = np.random.default_rng(seed)
    model = BiGRU(seed)
    by_kind = [[c for c, y in labelled if y == k] for k in (0, 1)]
    calm = by_kind[0] + background
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    for step in range(1, steps + 1):
        texts, target = [], []
        for k in range(BATCH):
            y = 1 if k % 8 < 3 else 0
            source = by_kind[y] if y or not background or k % 8 < 5 else background
            ids = source[rng.integers(len(source))]
            if y and rng.random() < 0.6:  # the same words within other, harmless text
                around = calm[rng.integers(len(calm))]
                cut = rng.integers(len(around) + 1)
                ids = np.concatenate([around[max(0, cut - 30) : cut], ids, around[cut : cut + 30]])
            if len(ids) > CROP and not y:  # another part of a long harmless text each time
                cut = rng.integers(len(ids) - CROP)
                ids = ids[cut : cut + CROP]
            texts.append(ids)
            target.append(y)
        width = max(WINDOW, *map(len, texts))
        ids, mask = np.zeros((BATCH, width), np.int64), np.zeros((BATCH, width), np.float32)
        for k, t in enumerate(texts):
            ids[k, : len(t)], mask[k, : len(t)] = t, 1
        # Words, and now and then whole tokens, go missing, so that spelling and neighbours must do.
        keep = np.ones((*ids.shape, INPUT), np.float32)
        keep[..., :WORD_DIMS] *= rng.random((*ids.shape, 1)) > 0.4
        keep *= rng.random((*ids.shape, 1)) > 0.12
        x = table.inputs(model.p)[ids] * keep
        target = np.array(target)

        def grad_of(logits: np.ndarray) -> np.ndarray:
            out = np.zeros_like(logits)
            rows = np.arange(len(logits))
            # Windows that end behind the text repeat what its last whole window has.
            real = np.arange(logits.shape[1])[None] <= np.maximum(0, mask.sum(1).astype(int) - WINDOW)[:, None]
            worst = np.where(real, logits, -np.inf).argmax(1)
            p = _sigmoid(logits[rows, worst])
            out[rows, worst] = np.where(target == 1, p - 0.95, p - 0.02)
            some = rng.integers(0, np.maximum(1, mask.sum(1).astype(int) - WINDOW + 1))
            far = (target == 1) & (np.abs(some - worst) > WINDOW)
            # What shares no token with the worst window of an abusive text is the harmless text around it.
            out[rows[far], some[far]] = 0.5 * (_sigmoid(logits[rows, some])[far] - 0.02)
            return out / len(target)

        g, d_x, _ = model.gradients(x, mask, grad_of)
        by_token, begins, seen = _groups(ids.reshape(-1))
        d_seen = np.add.reduceat((d_x * keep * mask[..., None]).reshape(-1, INPUT)[by_token], begins, axis=0)
        g |= table.spread(seen, d_seen, model.p)
        rate = RATE * (0.5 * (1 + np.cos(np.pi * step / steps)) + 0.03)
        for k, v in model.p.items():
            m1, m2 = moments[k]
            gradient = g[k] + 1e-3 * v * (g[k] != 0)
            m1 += 0.1 * (gradient - m1)
            m2 += 0.001 * (gradient**2 - m2)
            v -= (rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    for name, used in (("word", np.unique(table.words)), ("char", np.unique(table.flat))):
        blank = np.ones(BUCKETS, bool)
        blank[used] = False
        model.p[name][blank] = 0
    return model


def _odd(texts: list[list[str]], background: list[list[str]]) -> np.ndarray:
    """Which texts hold a word that is not ordinary in the background; all of them without a background."""
    held_by = Counter(w for t in background for w in set(t))
    ordinary = max(1, ODD * len(background))
    return np.array([any(held_by[w] < ordinary for w in t) for t in texts])


def _here(jobs: list) -> list:
    return [job() for job in jobs]


def train(labelled: list[tuple[str, int]], background: list[str] = (), *, steps: int = STEPS, folds: int = FOLDS, members: int = MEMBERS, seed: int = 7, run=_here) -> list[BiGRU] | None:
    """Fits the networks whose mean is the score; None without examples of both kinds. ``run`` runs independent fits."""
    split = Tokens()
    examples = [(t, y) for text, y in labelled if (t := split(text))]
    others = [t for text in background if (t := split(text))]
    if len({y for _, y in examples}) < 2:
        return None
    table = _Table([t for t, _ in examples] + others)

    def code(tokens: list[str]) -> np.ndarray:
        return np.array([table.index[w] for w in tokens])

    coded, plain = [(code(t), y) for t, y in examples], [code(t) for t in others]
    if folds > 1 and len(coded) >= 20 * folds:
        # Each fold's network judges labels it has not seen; two more that know all labels judge the half of the background they have not seen.
        rng = np.random.default_rng(seed)
        fold, half = rng.permutation(len(coded)) % folds, rng.permutation(len(plain)) % 2
        short = max(60, steps // 2)
        positive, odd = np.array([y == 1 for _, y in examples]), _odd([t for t, _ in examples], others)
        if (odd & positive).sum() < 2 * folds:  # too few to train on
            odd[:] = True
        sound = odd | ~positive

        def judge(f: int):
            seen = [c for c, k, s in zip(coded, fold, sound) if k != f and s]
            return Scorer([_fit(seen, plain, table, short, seed + f + 1)]).coded([examples[i][0] for i in np.flatnonzero(fold == f)])

        def look(f: int):
            score = Scorer([_fit([c for c, s in zip(coded, sound) if s], [c for c, k in zip(plain, half) if k != f], table, short, seed + 50 + f)])
            return score.coded([t for t, _ in examples]), score.coded([others[i] for i in np.flatnonzero(half == f)])

        *judged, (fit_a, harm_a), (fit_b, harm_b) = run([*(lambda f=f: judge(f) for f in range(folds)), lambda: look(0), lambda: look(1)])
        held, harm = np.zeros(len(coded)), np.zeros(len(plain))
        for f, found in enumerate(judged):
            held[fold == f] = found
        harm[half == 0], harm[half == 1] = harm_a, harm_b
        learned = np.maximum(fit_a, fit_b)
        # A harmful text unlike all others is doubted by networks that have not seen it, but learned by those that have; a wrong label is neither, or has no odd word.
        kept = [c for c, h, k, o in zip(coded, held, learned, odd) if (h >= AGREED or o and (h >= HELD or k >= LEARNED) if c[1] else h < 1 - HELD)]
        coded = kept if len({y for _, y in kept}) == 2 else coded
        plain = [c for c, h in zip(plain, harm) if h < HARMFUL]
    return run([lambda k=k: _fit(coded, plain, table, steps, seed + 100 * k) for k in range(members)])


class Scorer:
    """Scores texts with trained networks; projections of tokens are remembered up to a bound."""

    LIMIT, CHUNK = 60_000, 768

    def __init__(self, models: list[BiGRU]) -> None:
        self.models, self.split = models, Tokens()
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.size = 0
        self.px = [np.zeros((2, 1024, 3 * HIDDEN), np.float32) for _ in self.models]

    def _learn(self, words: list[str]) -> None:
        fresh = [w for w in words if w not in self.index]
        if self.size + len(fresh) > self.LIMIT:
            self._forget()
            fresh = words
        if not fresh:
            return
        for k, w in enumerate(fresh):
            self.index[w] = self.size + k
        grams = [gram_ids(w) for w in fresh]
        counts = np.array([len(g) for g in grams])
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        flat = np.concatenate([np.array(g) for g in grams])
        words_ = [word_id(w) for w in fresh]
        while self.px[0].shape[1] < self.size + len(fresh):
            self.px = [np.concatenate([x, np.zeros_like(x)], axis=1) for x in self.px]
        for px, model in zip(self.px, self.models):
            chars = np.add.reduceat(model.p["char"][flat], starts, axis=0) / counts[:, None]
            x = np.concatenate([model.p["word"][words_], chars], axis=1).astype(np.float32)
            px[:, self.size : self.size + len(fresh)] = np.stack([model.project(x, "f"), model.project(x, "b")])
            px[:, self.size : self.size + len(fresh), : 2 * HIDDEN] *= 0.5
        self.size += len(fresh)

    def __call__(self, texts: list[str | None]) -> list[float]:
        return self.coded(self.split(t) if t else [] for t in texts)

    def coded(self, texts) -> list[float]:
        """Scores of texts that are split already."""
        scores: list[float] = []
        pending: list[tuple[int, list[str]]] = []
        count = 0
        for i, tokens in enumerate(texts):
            scores.append(0.0)
            if tokens:
                pending.append((i, tokens))
                count += len(tokens)
            if count > 60_000:
                self._score(pending, scores)
                pending, count = [], 0
        if pending:
            self._score(pending, scores)
        return scores

    def _score(self, pending: list[tuple[int, list[str]]], scores: list[float]) -> None:
        self._learn(list(dict.fromkeys(w for _, t in pending for w in t)))
        lengths = [len(t) for _, t in pending]
        ids = np.fromiter((self.index[w] for _, t in pending for w in t), np.int64, sum(lengths))
        ends = np.cumsum(lengths)
        # Blocks of all texts: (start, end, start and end of the text), by length, so that little is padded.
        blocks = [(a, min(a + BLOCK, end), end - n, end) for n, end in zip(lengths, ends) for a in range(end - n, end, BLOCK)]
        blocks.sort(key=lambda b: (b[1] - b[0], b[0] - b[2], b[3] - b[1]))
        table = np.array(blocks)
        total = np.zeros(len(lengths), np.float64)
        for model, px in zip(self.models, self.px):
            value, score = np.empty(len(ids), np.float32), np.empty(len(ids), np.float32)
            for at in range(0, len(blocks), self.CHUNK):
                part = table[at : at + self.CHUNK]
                core = part[:, 1] - part[:, 0]
                width = int(core.max())
                margin = int(np.minimum(MARGIN, np.maximum(part[:, 0] - part[:, 2], part[:, 3] - part[:, 1])).max())
                steps = np.arange(-margin, width)[:, None]
                places = np.stack([part[:, 0] + steps, part[:, 0] + (width - 1 - steps)], axis=1)
                mask = (places >= part[:, 2]) & (places < part[:, 3])
                tokens = ids[np.where(mask, places, 0)]
                given = np.empty((*tokens.shape, 3 * HIDDEN), np.float32)
                for way in (0, 1):
                    np.take(px[way], tokens[:, way], axis=0, out=given[:, way])
                both = model.run(given, mask.astype(np.float32)[..., None])[margin:]
                v, s, _ = model.heads(np.concatenate([both[:, 0], both[::-1, 1]], axis=2), 1)
                inside = np.arange(width)[:, None] < core
                places = (part[:, 0] + np.arange(width)[:, None])[inside]
                value[places], score[places] = v[inside], s[inside]
            total += self._worst(value, score, lengths, ends)
        for (i, _), p in zip(pending, total / len(self.models)):
            scores[i] = float(p)

    @staticmethod
    def _worst(value: np.ndarray, score: np.ndarray, lengths: list[int], ends: np.ndarray) -> np.ndarray:
        """The highest probability over all windows of each text."""
        n = np.array(lengths)
        # Every text is followed by padding, so that a window never reaches into the next.
        pad = WINDOW - 1
        at = np.arange(len(value)) + np.repeat(np.arange(len(n)) * pad, n)
        weight, said = np.zeros(len(value) + pad * len(n) + 1), np.zeros(len(value) + pad * len(n) + 1)
        weight[at + 1] = np.exp(np.clip(score, -20, 20).astype(np.float64))
        said[at + 1] = weight[at + 1] * value
        np.cumsum(weight, out=weight)
        np.cumsum(said, out=said)
        begins = ends - n + np.arange(len(n)) * pad
        # Only windows that are whole, or that hold the whole text.
        count = np.maximum(1, n - WINDOW + 1)
        first = np.cumsum(count) - count
        starts = np.repeat(begins - first, count) + np.arange(count.sum())
        logits = (said[starts + WINDOW] - said[starts]) / (weight[starts + WINDOW] - weight[starts])
        return _sigmoid(np.maximum.reduceat(logits, first))


_KNOWN: dict[str, list[BiGRU] | None] = {}  # the last networks trained by this driver


def fit(labels: DataFrame, documents: DataFrame, *, max_labels: int = MAX_LABELS, max_background: int = MAX_BACKGROUND) -> list[BiGRU] | None:
    """Trains on at most ``max_labels`` labelled rows and ``max_background`` documents."""
    rows = labels.where("text is not null and abusive in (0, 1)").select("text", F.col("abusive").cast("int").alias("abusive"), "sample_id")
    bounded = rows.orderBy(F.xxhash64("sample_id"), "text").limit(max_labels).collect()
    labelled = [(r["text"], r["abusive"]) for r in bounded]
    drawn = documents.where(F.length("text") <= BACKGROUND_CHARS).select(F.xxhash64("doc_id").alias("h"), "text").orderBy("h", "text").limit(max_background).collect()
    background = list(dict.fromkeys(r["text"] for r in drawn))
    digest = hashlib.sha256(repr((labelled, background, STEPS, MEMBERS)).encode()).hexdigest()
    if digest not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[digest] = train(labelled, background, run=lambda jobs: _in_tasks(labels.sparkSession, jobs))
    return _KNOWN[digest]


def _in_tasks(spark: SparkSession, jobs: list) -> list:
    """Runs fits as Spark tasks side by side; their networks are small (3 MB each) and few."""
    from pyspark import cloudpickle

    packed = spark.sparkContext.broadcast([cloudpickle.dumps(job) for job in jobs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                result = pickle.dumps(pickle.loads(packed.value[k])())
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([result], pa.binary())], names=["id", "result"])

    rows = spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(run, "id bigint, result binary").collect()
    return [pickle.loads(r["result"]) for r in sorted(rows, key=lambda r: r["id"])]


def scores(documents: DataFrame, labels: DataFrame, *, max_labels: int = MAX_LABELS) -> DataFrame:
    """doc_id, source (trimmed, lower case), score of every document."""
    source = F.nullif(F.lower(F.trim(F.col("source").cast("string"))), F.lit("")).alias("source")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source, F.col("text").cast("string").alias("text"))
    model = fit(labels, rows, max_labels=max_labels)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # fixed size, about 3 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value) if shared.value is not None else lambda texts: [0.0] * len(texts)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(score(batch.column("text").to_pylist()), pa.float64())], names=["doc_id", "source", "score"])

    return spread(rows, "doc_id").mapInArrow(run, "doc_id bigint, source string, score double")


def flagged(scored: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    return scored.where(F.col("score") >= threshold).select("doc_id")


def rates(scored: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """source, documents, flagged, rate, mean_score."""
    grouped = scored.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("score") >= threshold).alias("flagged"), F.avg("score").alias("mean_score"))
    return grouped.withColumn("rate", F.col("flagged") / F.col("documents"))
