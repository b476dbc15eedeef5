"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters twice: as a word (an embedding, for words that enough training
documents have) and as characters (the mean embedding of its hashed character
trigrams). Two gated recurrent layers read a window of ``WINDOW`` words in
either direction, attention pools their states, and a logistic unit scores the
window. Windows start every ``STRIDE`` words and overlap; a document's score is
that of its highest window, and every word of every text is in some window.

Training takes at most ``SAMPLE`` labelled documents of each class of up to
``MAX_CHARS`` characters, those with the smallest hashes, and only documents
that are not held out. As a label tells of the document and not of the window,
each pass learns from the highest window of each document (and another one of
the clean ones). Word embeddings start from the smoothed log odds of the
training documents, which makes small samples enough.

Cases: null and empty texts are one window without words and get the score of
that; documents without labels are scored like others; several labels of one
document count as toxic if one does; without a toxic and a clean training
document every score is 0; repeated rows are scored each; an empty table gives
an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import texts_of

WINDOW, STRIDE, THRESHOLD = 64, 48, 0.7
SAMPLE, MAX_CHARS, MIN_DOCS, VOCABULARY = 1500, 20_000, 3, 20_000
WORD_DIM, CHAR_DIM, TRIGRAM_BITS, HIDDEN, ATTEND = 8, 6, 12, 6, 8
PASSES, STEPS, BATCH, RATE, PRIOR = 4, 120, 128, 0.01, 8.0
#: Embeddings learn slower and fade, so that small samples aren't learnt by heart.
SLOW, FADE = 0.3, 1e-3
EDGE = ".,;:!?\"'()[]{}|-_*#%&$<>"
#: Words that a worker remembers, windows that are scored together, characters of texts that are read together.
REMEMBERED, TOGETHER, CHARS_TOGETHER = 100_000, 1024, 1_000_000


def is_held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(3)) == 1


def tokens(text: str) -> list[str]:
    return text.lower().split()


def trigram_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of all the words with marked ends, one after the other, and how many each word has."""
    data = [f"<{w}>".encode() if w else b"<>>" for w in words]
    if not data:
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    sizes = np.array([len(d) for d in data], "i8")
    flat = np.frombuffer(b"".join(data), "u1").astype("u4")
    hashed = (flat[:-2] * np.uint32(0x9E3779B1) + flat[1:-1] * np.uint32(0x85EBCA77) + flat[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - TRIGRAM_BITS)
    inner = np.ones(len(flat), bool)
    ends = np.cumsum(sizes)
    inner[ends - 1] = inner[ends - 2] = False
    return hashed[inner[:-2]].astype("i8"), sizes - 2


def starts(n: int, window: int = WINDOW, stride: int = STRIDE) -> list[int]:
    """First words of the windows over n words; the last one ends with the text."""
    if n <= window:
        return [0]
    return [*range(0, n - window, stride), n - window]


class Network:
    """Parameters, and the passes forward and back over windows of word rows."""

    def __init__(self, vocabulary: dict[str, int], odds: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by=1.0: (rng.standard_normal(shape) * by / np.sqrt(shape[-2] if len(shape) > 1 else 1)).astype("f4")
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.vocabulary = vocabulary
        words = (rng.standard_normal((len(vocabulary) + 1, WORD_DIM)) * 0.05).astype("f4")
        words[:, 0] = odds
        self.p = {
            "words": words,
            "chars": (rng.standard_normal((1 << TRIGRAM_BITS, CHAR_DIM)) * 0.1).astype("f4"),
            "enter": draw(d, 6 * h),  # both directions: reset, update, new
            "bias": np.zeros(6 * h, "f4"),
            "gates": draw(2, h, 2 * h, by=0.7),
            "fresh": draw(2, h, h, by=0.7),
            "attend": draw(2 * h, ATTEND),
            "weigh": draw(ATTEND),
            "out": draw(2 * h),
            "out_bias": np.zeros(1, "f4"),
        }
        self.adam: dict[str, list] = {}
        self.steps = 0

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word rows of raw tokens, and the trigrams of all with each one's number."""
        bare = [w.strip(EDGE) for w in words]
        return np.array([self.vocabulary.get(w, 0) for w in bare], "i8"), *trigram_ids(bare)

    def embed(self, word_rows: np.ndarray, trigrams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        sums = np.add.reduceat(self.p["chars"][trigrams], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) if len(sizes) else np.zeros((0, CHAR_DIM), "f4")
        return np.concatenate([self.p["words"][word_rows], sums / sizes[:, None].astype("f4")], axis=1)

    def entered(self, x: np.ndarray) -> np.ndarray:
        """Embedded words as they enter both directions' gates; a last row of zeros stands for no word."""
        return np.concatenate([x @ self.p["enter"] + self.p["bias"], np.zeros((1, 6 * HIDDEN), "f4")]).astype("f4")

    def forward(self, entered: np.ndarray, at: np.ndarray, keep: bool = False):
        """Scores of windows: at[window, place] is the row of entered, its last row where there is no word."""
        n, length = at.shape
        h = HIDDEN
        table = entered.reshape(-1, 2, 3 * h).transpose(1, 0, 2).copy()
        there = (at != len(entered) - 1).astype("f4")
        state = np.zeros((2, n, h), "f4")
        all_states = np.zeros((length, n, 2 * h), "f4")
        trace = []
        gates_w, fresh_w = self.p["gates"], self.p["fresh"]
        for t in range(length):
            u = length - 1 - t
            xt = np.stack([table[0][at[:, t]], table[1][at[:, u]]])
            g = np.matmul(state, gates_w)
            g += xt[:, :, : 2 * h]
            g *= 0.5
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            reset, update = g[:, :, :h], g[:, :, h:]
            back = np.matmul(state, fresh_w)
            new = np.tanh(xt[:, :, 2 * h :] + reset * back)
            mask = np.stack([there[:, t], there[:, u]])[:, :, None]
            after = state + mask * (1 - update) * (new - state)
            if keep:
                trace.append((state, g, back, new, mask))
            state = after
            all_states[t, :, :h], all_states[u, :, h:] = state[0], state[1]
        m = np.tanh(all_states.reshape(-1, 2 * h) @ self.p["attend"]).reshape(length, n, ATTEND)
        e = m @ self.p["weigh"]
        e = np.exp(e - e.max(axis=0)) * np.maximum(there.T, 1e-9)
        a = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", a, all_states)
        logit = pooled @ self.p["out"] + self.p["out_bias"][0]
        score = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return (score, (table, trace, all_states, m, a, pooled)) if keep else score

    def infer(self, entered: np.ndarray, at: np.ndarray) -> np.ndarray:
        """forward()'s scores, with windows in the last axis and nothing kept."""
        (n, length), h, none = at.shape, HIDDEN, len(entered) - 1
        half = np.concatenate([np.full(2 * h, 0.5, "f4"), np.ones(h, "f4")])  # a sigmoid is half of a tanh of the half
        table = [np.ascontiguousarray(entered[:, k * 3 * h : (k + 1) * 3 * h] * half) for k in (0, 1)]
        gates = np.ascontiguousarray(self.p["gates"].transpose(0, 2, 1) * 0.5)
        fresh = np.ascontiguousarray(self.p["fresh"].transpose(0, 2, 1) * 0.5)
        order = np.ascontiguousarray(at.T)
        there = order != none
        full = bool(there.all())
        present = there.astype("f4")
        state, g, new = np.zeros((2, h, n), "f4"), np.empty((2, 2 * h, n), "f4"), np.empty((2, h, n), "f4")
        x = [np.empty((n, 3 * h), "f4") for _ in (0, 1)]
        states = np.empty((length, 2 * h, n), "f4")
        for t in range(length):
            u = length - 1 - t
            np.matmul(gates, state, out=g)
            np.matmul(fresh, state, out=new)
            for k, at_k in ((0, order[t]), (1, order[u])):
                np.take(table[k], at_k, axis=0, out=x[k], mode="clip")
                g[k] += x[k].T[: 2 * h]
            np.tanh(g, out=g)
            reset, update = g[:, :h], g[:, h:]
            reset += 1
            new *= reset
            new[0] += x[0].T[2 * h :]
            new[1] += x[1].T[2 * h :]
            np.tanh(new, out=new)
            new -= state
            np.subtract(0.5, np.multiply(update, 0.5, out=update), out=update)
            new *= update
            if not full:
                new[0] *= present[t]
                new[1] *= present[u]
            state += new
            states[t, :h], states[u, h:] = state[0], state[1]
        m = np.matmul(np.ascontiguousarray(self.p["attend"].T), states)
        np.tanh(m, out=m)
        e = np.matmul(self.p["weigh"], m)
        e = np.exp(e - e.max(axis=0)) * np.maximum(present, 1e-9)
        e /= e.sum(axis=0)
        states *= e[:, None, :]
        logit = self.p["out"] @ states.sum(axis=0) + self.p["out_bias"][0]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def backward(self, at: np.ndarray, n_rows: int, kept, d_logit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters above the embedding, and of entered."""
        _, trace, states, m, a, pooled = kept
        h, (length, n, _) = HIDDEN, states.shape
        grad = {"out": pooled.T @ d_logit, "out_bias": np.array([d_logit.sum()], "f4")}
        d_pooled = d_logit[:, None] * self.p["out"]
        d_a = np.einsum("nh,tnh->tn", d_pooled, states)
        d_states = a[:, :, None] * d_pooled
        d_e = a * (d_a - (a * d_a).sum(axis=0))
        grad["weigh"] = np.einsum("tn,tnk->k", d_e, m)
        d_m = (d_e[:, :, None] * self.p["weigh"] * (1 - m * m)).reshape(-1, ATTEND)
        grad["attend"] = states.reshape(-1, 2 * h).T @ d_m
        d_states = d_states + (d_m @ self.p["attend"].T).reshape(length, n, 2 * h)
        grad["gates"], grad["fresh"] = np.zeros_like(self.p["gates"]), np.zeros_like(self.p["fresh"])
        d_in = np.zeros((2, n_rows, 3 * h), "f4")
        carry = np.zeros((2, n, h), "f4")
        for t in range(length - 1, -1, -1):
            u = length - 1 - t
            state, g, back, new, mask = trace[t]
            reset, update = g[:, :, :h], g[:, :, h:]
            d = carry + np.stack([d_states[t, :, :h], d_states[u, :, h:]])
            d_new = d * mask * (1 - update) * (1 - new * new)
            d_update = d * mask * (state - new) * update * (1 - update)
            d_back = d_new * reset
            d_reset = d_new * back * reset * (1 - reset)
            d_g = np.concatenate([d_reset, d_update], axis=2)
            grad["gates"] += np.matmul(state.transpose(0, 2, 1), d_g)
            grad["fresh"] += np.matmul(state.transpose(0, 2, 1), d_back)
            carry = d * (1 - mask * (1 - update)) + np.matmul(d_g, self.p["gates"].transpose(0, 2, 1)) + np.matmul(d_back, self.p["fresh"].transpose(0, 2, 1))
            d_x = np.concatenate([d_g, d_new], axis=2)
            np.add.at(d_in[0], at[:, t], d_x[0])
            np.add.at(d_in[1], at[:, u], d_x[1])
        return grad, d_in.transpose(1, 0, 2).reshape(n_rows, 6 * h)

    def learn(self, grad: dict[str, np.ndarray]) -> None:
        """A step of Adam with weight decay."""
        self.steps += 1
        for k, g in grad.items():
            m, v = self.adam.setdefault(k, [np.zeros_like(self.p[k]), np.zeros_like(self.p[k])])
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            rate = RATE * (SLOW if k in ("words", "chars") else 1)
            self.p[k] -= (rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)).astype("f4")
            if k in ("words", "chars"):
                self.p[k][:, 1:] *= 1 - FADE


def windows_of(rows: np.ndarray, none: int) -> np.ndarray:
    """The windows of a text's word rows, filled up with none."""
    if len(rows) <= WINDOW:
        out = np.full((1, WINDOW), none, "i8")
        out[0, : len(rows)] = rows
        return out
    return rows[np.array(starts(len(rows)))[:, None] + np.arange(WINDOW)]


def train(texts: list[str], toxic: list[int], seed: int = 7) -> Network | None:
    """A network from labelled texts, or None without both classes."""
    y = np.array(toxic, "f4")
    if not len(y) or y.min() == y.max():
        return None
    split = [tokens(t) for t in texts]
    bare = [{w.strip(EDGE) for w in s} for s in split]
    having, toxic_having = Counter(w for s in bare for w in s), Counter(w for s, t in zip(bare, toxic, strict=True) if t for w in s)
    common = sorted((w for w, n in having.items() if n >= MIN_DOCS and w), key=lambda w: (-having[w], w))[:VOCABULARY]
    share = float(y.mean())
    odds = np.array([0.0] + [np.log((toxic_having[w] + PRIOR * share) / (having[w] + PRIOR) / share) for w in common], "f4")
    net = Network({w: i + 1 for i, w in enumerate(common)}, odds, seed)
    distinct = sorted({w for s in split for w in s})
    number = {w: i for i, w in enumerate(distinct)}
    word_rows, trigrams, sizes = net.features(distinct)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    none = len(distinct)
    own = [windows_of(np.array([number[w] for w in s], "i8"), none) for s in split]
    of = np.repeat(np.arange(len(own)), [len(w) for w in own])
    every = np.concatenate(own)
    first = np.concatenate([[0], np.cumsum([len(w) for w in own])[:-1]])
    rng = np.random.default_rng(seed)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype("f4")
    # before the network knows anything, a window's mean of its highest odds stands for its score
    reach = np.append(odds[word_rows], -1.0)
    scores = np.sort(reach[every], axis=1)[:, -3:].sum(axis=1)
    chosen_each = len(own) + int((y == 0).sum())
    for _ in range(max(PASSES, STEPS * BATCH // chosen_each)):  # small samples are passed more often
        top = np.array([f + int(scores[f : f + len(w)].argmax()) for f, w in zip(first, own, strict=True)])
        other = np.array([f + rng.integers(len(w)) for f, w in zip(first, own, strict=True)])[y == 0]
        chosen = rng.permutation(np.concatenate([top, other]))
        for i in range(0, len(chosen), BATCH):
            pick = chosen[i : i + BATCH]
            used, local = np.unique(every[pick], return_inverse=True)
            words = used[used < none]
            local = local.reshape(len(pick), WINDOW)
            n_tri = sizes[words]
            tri = trigrams[np.repeat(begin[words] - np.cumsum(n_tri) + n_tri, n_tri) + np.arange(n_tri.sum())]
            x = net.embed(word_rows[words], tri, n_tri)
            entered = net.entered(x)
            score, kept = net.forward(entered, local, keep=True)
            d_logit = ((score - y[of[pick]]) * weight[of[pick]] / len(pick)).astype("f4")
            grad, d_in = net.backward(local, len(entered), kept, d_logit)
            d_in = d_in[: len(words)]
            grad["enter"], grad["bias"] = x.T @ d_in, d_in.sum(axis=0)
            d_x = d_in @ net.p["enter"].T
            grad["words"], grad["chars"] = np.zeros_like(net.p["words"]), np.zeros_like(net.p["chars"])
            np.add.at(grad["words"], word_rows[words], d_x[:, :WORD_DIM])
            np.add.at(grad["chars"], tri, np.repeat(d_x[:, WORD_DIM:] / n_tri[:, None].astype("f4"), n_tri, axis=0))
            net.learn(grad)
        entered = net.entered(net.embed(word_rows, trigrams, sizes))
        scores = np.concatenate([net.infer(entered, every[i : i + TOGETHER]) for i in range(0, len(every), TOGETHER)])
    return net


class Scorer:
    """Scores texts; remembers words as they enter the network."""

    def __init__(self, net: Network):
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, 6 * HIDDEN), "f4")

    def remember(self, words: set[str]) -> None:
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            entered = self.net.entered(self.net.embed(*self.net.features(new)))[:-1]
            n = len(known)
            while n + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[n : n + len(new)] = entered
            known.update((w, n + i) for i, w in enumerate(new))

    def scores(self, texts: list[str]) -> list[float]:
        """The highest window's score of each text; windows of many texts are scored together."""
        best = np.zeros(len(texts))
        pending: list[tuple[int, np.ndarray]] = []
        held = 0

        def flush() -> None:
            nonlocal pending, held
            if pending:
                at = np.concatenate([w for _, w in pending])
                of = np.repeat([i for i, _ in pending], [len(w) for _, w in pending])
                none = len(self.known)
                used = np.concatenate([self.table[:none], np.zeros((1, 6 * HIDDEN), "f4")])
                at = np.where(at < 0, none, at)
                for i in range(0, len(at), TOGETHER):
                    np.maximum.at(best, of[i : i + TOGETHER], self.net.infer(used, at[i : i + TOGETHER]))
            pending, held = [], 0

        at = 0
        while at < len(texts):
            some, n = [], 0
            while at + len(some) < len(texts) and (not some or n < CHARS_TOGETHER):
                n += len(texts[at + len(some)])
                some.append(tokens(texts[at + len(some)]))
            self.remember({w for words in some for w in words})
            known = self.known
            for i, words in enumerate(some, at):
                w = windows_of(np.array([known[w] for w in words], "i8"), -1)
                pending.append((i, w))
                held += len(w)
                if held >= 8 * TOGETHER:
                    flush()
            at += len(some)
            if len(known) > REMEMBERED:
                flush()
                self.forget()
        flush()
        return best.tolist()


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, max_chars: int = MAX_CHARS) -> tuple[list[str], list[int]]:
    """The bounded sample that the network learns from, by hash and never from held-out documents."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    picked = known.where("toxic = 1").orderBy(order, "doc_id").limit(sample).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(sample))
    texts = docs.select("doc_id", "text").where(F.length("text") <= max_chars)
    one = F.min_by(F.struct("text", "toxic"), F.struct(F.xxhash64("text"), F.col("text"))).alias("one")
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(one).select("doc_id", "one.*").toArrow().to_pylist()  # at most 2 * sample rows, each of a bounded text
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in rows], [r["toxic"] for r in rows]


def sent_network(docs: DataFrame, labels: DataFrame):
    """The network that these documents and labels give, broadcast; its size is bounded by VOCABULARY."""
    net = train(*training_rows(docs, labels))
    return docs.sparkSession.sparkContext.broadcast(net and (net.vocabulary, net.p))


def scorer_of(sent) -> Scorer | None:
    if not sent.value:
        return None
    net = Network.__new__(Network)
    net.vocabulary, net.p = sent.value
    return Scorer(net)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    sent = sent_network(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(sent)
        for b in batches:
            found = scorer.scores(texts_of(b)) if scorer else [0.0] * b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(is_held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score less than the threshold, with all of their columns."""
    sent = sent_network(docs, labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(sent)
        for b in batches:
            yield b.filter(pa.array([x < threshold for x in scorer.scores([t or "" for t in b.column(at).to_pylist()])], pa.bool_())) if scorer else b

    return docs.mapInArrow(run, docs.schema)
