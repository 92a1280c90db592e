"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads words byte by byte in both directions and labels every
position with a distribution over languages; a document's distribution is the
mean over the positions of all its words. State starts anew at each word, so a
word's labels depend on the word alone and are computed once per task for
words that come back.

Training is numpy backpropagation through time on the driver, over a sample
bounded for each language by ``TRAIN_DOCS`` different texts and the first
``TRAIN_CHARS`` characters of each. Every document is scored over its whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartrail.functions.lookup import small_lookup
from cartrail.llm.common import in_groups, small_batches
from cartrail.llm.quality_qda import held_out

HELD_OUT = (4, 2)
TRAIN_DOCS = 150
TRAIN_CHARS = 16_384
PICK_PARTS = 64
TRAIN_WORDS = 40_000
# However many languages share TRAIN_WORDS, each gets as many.
LEAST_WORDS = 200
EMBED, HIDDEN = 12, 20
EPOCHS, BATCH, RATE = 4, 256, 0.01
# Longer runs of letters are read in pieces.
PIECE = 24
KNOWN_WORDS = 150_000
STRETCH = 1 << 22
LETTERS = r"[^\W\d_]+"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Direction:
    """One direction of the network: gates for update and reset, and the candidate."""

    def __init__(self, rng: np.random.Generator):
        k = 1 / np.sqrt(HIDDEN)
        self.w = rng.uniform(-k, k, (EMBED, 3 * HIDDEN)).astype(np.float32)
        self.u = rng.uniform(-k, k, (HIDDEN, 3 * HIDDEN)).astype(np.float32)
        self.b = np.zeros(3 * HIDDEN, dtype=np.float32)

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States for inputs (time, batch, EMBED); masked steps carry the state on."""
        steps, batch = mask.shape
        h = np.zeros((batch, HIDDEN), dtype=np.float32)
        out = np.empty((steps, batch, HIDDEN), dtype=np.float32)
        inputs = x @ self.w + self.b
        tape = []
        for t in range(steps):
            gates = _sigmoid(inputs[t, :, : 2 * HIDDEN] + h @ self.u[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(inputs[t, :, 2 * HIDDEN :] + (r * h) @ self.u[:, 2 * HIDDEN :])
            m = mask[t][:, None]
            if keep:
                tape.append((h, z, r, c, m))
            h = h + m * z * (c - h)
            out[t] = h
        return out, tape

    def backward(self, x: np.ndarray, tape: list, dout: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        dw, du, db = np.zeros_like(self.w), np.zeros_like(self.u), np.zeros_like(self.b)
        dx = np.empty_like(x)
        dh = np.zeros_like(dout[0])
        gates, cand = self.u[:, : 2 * HIDDEN], self.u[:, 2 * HIDDEN :]
        for t in range(len(tape) - 1, -1, -1):
            h, z, r, c, m = tape[t]
            dh = dh + dout[t]
            dz = dh * m * (c - h) * z * (1 - z)
            dc = dh * m * z * (1 - c * c)
            drh = dc @ cand.T
            dr = drh * h * r * (1 - r)
            da = np.concatenate([dz, dr, dc], axis=1)
            du[:, : 2 * HIDDEN] += h.T @ da[:, : 2 * HIDDEN]
            du[:, 2 * HIDDEN :] += (r * h).T @ dc
            dw += x[t].T @ da
            db += da.sum(axis=0)
            dx[t] = da @ self.w.T
            dh = dh * (1 - m * z) + drh * r + da[:, : 2 * HIDDEN] @ gates.T
        return dx, [dw, du, db]


class Network:
    """Byte embedding, two directions and a softmax at every position."""

    def __init__(self, langs: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.embed = (rng.standard_normal((256, EMBED)) * 0.3).astype(np.float32)
        self.ahead, self.back = Direction(rng), Direction(rng)
        self.out = (rng.standard_normal((2 * HIDDEN, len(langs))) * 0.1).astype(np.float32)
        self.bias = np.zeros(len(langs), dtype=np.float32)

    def parameters(self) -> list[np.ndarray]:
        a, b = self.ahead, self.back
        return [self.embed, a.w, a.u, a.b, b.w, b.u, b.b, self.out, self.bias]

    @staticmethod
    def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and mask, both (time, batch)."""
        steps = max(map(len, words))
        data = np.zeros((len(words), steps), dtype=np.uint8)
        size = np.array([len(w) for w in words])
        mask = np.arange(steps)[None, :] < size[:, None]
        data[mask] = np.frombuffer(b"".join(words), dtype=np.uint8)
        return data.T, np.ascontiguousarray(mask.T).astype(np.float32)

    def label(self, data: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Probabilities (time, batch, language) of every position."""
        x = self.embed[data]
        ahead, tape_a = self.ahead.forward(x, mask, keep)
        back, tape_b = self.back.forward(x[::-1], mask[::-1], keep)
        h = np.concatenate([ahead, back[::-1]], axis=2)
        logits = h @ self.out + self.bias
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        return p, (x, h, tape_a, tape_b)

    def gradients(self, data: np.ndarray, mask: np.ndarray, truth: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross entropy over all positions."""
        p, (x, h, tape_a, tape_b) = self.label(data, mask, keep=True)
        d = p.copy()
        d[:, np.arange(len(truth)), truth] -= 1
        d *= (mask / mask.sum())[:, :, None]
        d_out = h.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, d.shape[2])
        dh = d @ self.out.T
        dxa, ga = self.ahead.backward(x, tape_a, dh[:, :, :HIDDEN])
        dxb, gb = self.back.backward(x[::-1], tape_b, np.ascontiguousarray(dh[::-1, :, HIDDEN:]))
        d_embed = np.zeros_like(self.embed)
        np.add.at(d_embed, data.reshape(-1), (dxa + dxb[::-1]).reshape(-1, EMBED))
        return [d_embed, *ga, *gb, d_out, d.sum(axis=(0, 1))]

    def word_sums(self, words: list[bytes]) -> np.ndarray:
        """Probabilities summed over the positions of each word, by order of length."""
        sums = np.zeros((len(words), len(self.langs)))
        pieces = [(k, w[at : at + PIECE]) for k, w in enumerate(words) for at in range(0, len(w), PIECE)]
        pieces.sort(key=lambda piece: len(piece[1]))
        for at in range(0, len(pieces), 2048):
            some = pieces[at : at + 2048]
            data, mask = self.padded([w for _, w in some])
            p, _ = self.label(data, mask)
            np.add.at(sums, [k for k, _ in some], (p * mask[:, :, None]).sum(axis=0))
        return sums


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case; signs such as a raised two or a half are no letters."""
    runs = re.findall(LETTERS, (text or "").lower())
    if all(map(str.isalpha, runs)):
        return runs
    return [word for run in runs for word in ([run] if run.isalpha() else regex.findall(r"\p{L}+", run))]


def fit(rows: list[tuple[str, str]], seed: int = 5) -> Network | None:
    """Train on (text, language) rows; None if there are none with a letter."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for _, lang in rows})
    by_lang = {lang: Counter() for lang in langs}
    for text, lang in rows:
        by_lang[lang].update(words_of(text))
    langs = [lang for lang in langs if by_lang[lang]]
    if not langs:
        return None
    network = Network(langs, seed)
    each = max(LEAST_WORDS, TRAIN_WORDS // len(langs))
    sample: list[tuple[bytes, int]] = []
    for k, lang in enumerate(langs):
        words = sorted(by_lang[lang])
        weight = np.sqrt([by_lang[lang][w] for w in words])
        chosen = rng.choice(len(words), size=each, p=weight / weight.sum())
        sample += [(words[c].encode("utf-8", "surrogatepass")[:PIECE], k) for c in chosen]
    parameters = network.parameters()
    first = [np.zeros_like(p) for p in parameters]
    second = [np.zeros_like(p) for p in parameters]
    step = 0
    for epoch in range(EPOCHS):
        rng.shuffle(sample)
        blocks = []
        for at in range(0, len(sample), BATCH * 16):
            near = sorted(sample[at : at + BATCH * 16], key=lambda s: len(s[0]))
            blocks += [near[k : k + BATCH] for k in range(0, len(near), BATCH)]
        for k in rng.permutation(len(blocks)):
            data, mask = network.padded([w for w, _ in blocks[k]])
            truth = np.array([lang for _, lang in blocks[k]])
            step += 1
            rate = RATE * 0.4**epoch
            for p, g, m, v in zip(parameters, network.gradients(data, mask, truth), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return network


def train(docs: DataFrame) -> Network | None:
    """Fit on the bounded sample of texts that are not held out and have a language; copies of a text count once."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), HELD_OUT))
    known = known.select("lang", F.substring("text", 1, TRAIN_CHARS).alias("text")).withColumn("_order", F.xxhash64("text"))
    # A language may hold most rows: each of its parts picks first.
    part = F.pmod("_order", F.lit(PICK_PARTS)).alias("_part")
    picked = known.select("lang", "_order", part).distinct()
    for keys in (["lang", "_part"], ["lang"]):
        pick = Window.partitionBy(*keys).orderBy("_order")
        picked = picked.withColumn("_n", F.row_number().over(pick)).filter(F.col("_n") <= TRAIN_DOCS).drop("_n")
    chosen = known.join(small_lookup(picked.drop("_part")), ["lang", "_order"], "left_semi").dropDuplicates(["lang", "_order"])
    rows = sorted((r["text"], r["lang"]) for r in chosen.select("text", "lang").collect())
    return fit(rows)


class Reader:
    """Labels texts in one task and keeps the sums of the words it has read, within bounds."""

    def __init__(self, network: Network | None):
        self.network = network
        self.place: dict[str, int] = {}
        self.sums = np.zeros((0, 0))

    def label(self, raw: list[bytes]) -> Iterator[tuple[str, float]]:
        """Language and score of each text."""
        texts = [words_of(r.decode("utf-8")) for r in raw]
        if self.network is None:
            yield from [("und", 0.0)] * len(texts)
            return
        if len(self.place) > KNOWN_WORDS:
            self.place, self.sums = {}, self.sums[:0]
        new = list({w for words in texts for w in words if w not in self.place})
        if new:
            more = [w.encode("utf-8", "surrogatepass") for w in new]
            table = np.column_stack([self.network.word_sums(more), [len(w) for w in more]])
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self.sums = np.vstack([self.sums, table]) if len(self.sums) else table
        for words in texts:
            if not words:
                yield "und", 0.0
                continue
            total = self.sums[[self.place[w] for w in words]].sum(axis=0)
            mean = total[:-1] / total[-1]
            best = int(mean.argmax())
            yield self.network.langs[best], min(1.0, float(mean[best]))


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    A text that is null or has no letter is ``und`` with score 0, as is every
    text if nothing can be learned. Equal means go to the language that sorts
    first. Repeated rows are scored each.
    """
    network = train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(network)
        for batch in small_batches(batches):
            raw = [(t.as_py() or "").encode("utf-8") for t in batch.column("text")]
            answers = [one for group in in_groups(raw, STRETCH) for one in reader.label(group)]
            guess, score = zip(*answers) if answers else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(guess, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    schema = docs.select("doc_id").schema.add("lang_pred", "string").add("score", "double")
    rows = docs.select("doc_id", "text").mapInArrow(run, schema)
    return rows.select("doc_id", held_out(F.col("doc_id"), HELD_OUT).alias("held_out"), "lang_pred", "score")
