"""Main text of web pages by a linear-chain conditional random field.

A page is cut into leaf blocks: stretches of text between block-level tags. A
block is described by its ancestors (tags and words of class, id and role) and
by its text; neighbouring labels are tied by transition weights. The weights
are learned from labelled pages by gradient ascent on the conditional
likelihood, and pages are decoded by Viterbi.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Container, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cartrail.llm.common import small_batches
from cartrail.llm.labelled_pages import labelled_pages

STEPS = 250
RATE = 0.1
PENALTY = 1e-4

# Elements of the page language by their role.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr br".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Raw text: no markup counts inside, and if unclosed they run to the end of the page.
HIDDEN = "script|style|title|textarea|iframe"
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav "
    "ol p pre section table ul".split()
)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({HIDDEN})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-z][^>]*(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|([^<]+|<)",
    re.S | re.I,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


@dataclass
class Block:
    """A leaf block: its text, the characters of it in links, its tag and the features of its ancestors."""

    text: str
    linked: int
    leaf: str
    above: frozenset[str]


def leaf_blocks(page: str, known: Container[str] | None = None) -> list[Block]:
    """Blocks with text, in page order; broken and unclosed markup is read as far as it goes.

    Elements that add no feature to those above them share one set, and with
    ``known`` only the features in it are kept, so a page takes memory in
    proportion to its length, however deep it is.
    """
    blocks: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    opened: Counter[str] = Counter()
    none: frozenset[str] = frozenset()
    held: list[tuple[str, bool]] = []
    in_link = False

    def flush() -> None:
        nonlocal in_link
        if held:
            text = " ".join(entities.unescape("".join(t for t, _ in held)).split())
            if text:
                linked = sum(len(t) for t, link in held if link)
                leaf, above = stack[-1] if stack else ("none", none)
                blocks.append(Block(text, linked, leaf, above))
            held.clear()
        in_link = False

    def close(name: str, within: frozenset[str] = frozenset()) -> None:
        if not opened[name]:
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                opened.subtract(tag for tag, _ in stack[k:])
                del stack[k:]
                return
            if stack[k][0] in within:
                return

    for match in TOKEN.finditer(page):
        hidden, ending, tag, attributes, text = match.groups()
        if text is not None:
            held.append((text, in_link))
        elif tag is not None:
            name = tag.lower()
            if name in INLINE:
                if name == "a":
                    in_link = not ending
                elif name == "br":
                    held.append((" ", False))
                continue
            flush()
            if ending:
                close(name)
                continue
            if name in CLOSES_P:
                close("p", frozenset(("td", "th", "div", "section", "article")))
            elif name == "li":
                close("li", frozenset(("ul", "ol")))
            if name not in VOID and not attributes.endswith("/"):
                own = {"in " + name}
                if "=" in attributes:
                    found = " ".join("".join(m) for m in NAMED.findall(attributes))
                    own.update("named " + w for w in re.split(r"[^a-z]+", found.lower()) if w)
                if known is not None:
                    own = {feature for feature in own if feature in known}
                above = stack[-1][1] if stack else none
                stack.append((name, above if own <= above else above | own))
                opened[name] += 1
    flush()
    return blocks


def features(block: Block, at: int, count: int) -> list[str]:
    """Names of the features that hold for a block."""
    out = {"any", "leaf " + block.leaf, *block.above}
    size = len(block.text)
    out.add(f"size {min(9, size.bit_length())}")
    share = block.linked / max(1, size)
    out.add("links " + ("none" if share == 0 else "some" if share < 0.3 else "many" if share < 0.8 else "all"))
    if block.text[-1] in ".!?":
        out.add("ends")
    if block.text[0] == "©":
        out.add("copyright")
    if at < 2:
        out.add(f"first {at}")
    if count - at <= 2:
        out.add(f"last {count - at}")
    return sorted(out)


@dataclass
class Chain:
    """Weights: per feature and label, between labels, and at the start."""

    names: dict[str, int]
    weights: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def emissions(self, blocks: list[Block]) -> np.ndarray:
        out = np.zeros((len(blocks), 2))
        for k, block in enumerate(blocks):
            rows = [self.names[f] for f in features(block, k, len(blocks)) if f in self.names]
            out[k] = self.weights[rows].sum(axis=0)
        return out

    def viterbi(self, emissions: np.ndarray) -> list[int]:
        """The likeliest labels; equal scores go to label 0."""
        if not len(emissions):
            return []
        (s0, s1) = (self.start + emissions[0]).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        back = []
        for e0, e1 in emissions[1:].tolist():
            a, b, c, d = s0 + m00, s1 + m10, s0 + m01, s1 + m11
            back.append((int(b > a), int(d > c)))
            s0, s1 = max(a, b) + e0, max(c, d) + e1
        label = int(s1 > s0)
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]

    def main_text(self, page: str | None) -> str:
        blocks = leaf_blocks(page or "", self.names)
        return "\n".join(
            b.text for b, label in zip(blocks, self.viterbi(self.emissions(blocks))) if label
        )


def labelled_blocks(pieces: list[tuple[str, int]]) -> tuple[list[Block], list[int]]:
    """Blocks of a labelled page and their labels, told by where their text stands."""
    blocks = leaf_blocks("".join(piece for piece, _ in pieces))
    spans = [(" ".join(b.text for b in leaf_blocks(piece)), label) for piece, label in pieces if label >= 0]
    labels, k, left = [], 0, spans[0][0] if spans else ""
    for block in blocks:
        while not left.startswith(block.text):
            k += 1
            left = spans[k][0]
        labels.append(spans[k][1])
        left = left[len(block.text) :].lstrip() or "\0"
    return blocks, labels


def _log_add(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1)
    return top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))


def train(pages: list[list[tuple[str, int]]] | None = None) -> Chain:
    """Fit on labelled pages: full gradients by forward and backward sums, Adam steps."""
    known = [labelled_blocks(p) for p in (pages if pages is not None else labelled_pages())]
    known = [(b, y) for b, y in known if b]
    named = [[features(b, k, len(blocks)) for k, b in enumerate(blocks)] for blocks, _ in known]
    names = {f: k for k, f in enumerate(sorted({f for page in named for fs in page for f in fs}))}
    n, steps = len(known), max(len(b) for b, _ in known)
    x = np.zeros((n, steps, len(names)), dtype=np.float32)
    mask = np.zeros((n, steps))
    truth = np.zeros((n, steps), dtype=int)
    for i, (page, (_, labels)) in enumerate(zip(named, known)):
        for t, fs in enumerate(page):
            x[i, t, [names[f] for f in fs]] = 1
        mask[i, : len(labels)] = 1
        truth[i, : len(labels)] = labels
    parameters = [np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)]
    first = [np.zeros_like(p) for p in parameters]
    second = [np.zeros_like(p) for p in parameters]
    one_hot = np.eye(2)[truth] * mask[:, :, None]
    pairs = (one_hot[:, :-1, :, None] * one_hot[:, 1:, None, :]).sum(axis=(0, 1))
    for step in range(1, STEPS + 1):
        weights, move, start = parameters
        emit = x @ weights
        ahead, behind = np.zeros((n, steps, 2)), np.zeros((n, steps, 2))
        ahead[:, 0] = start + emit[:, 0]
        for t in range(1, steps):
            via = _log_add(ahead[:, t - 1, :, None] + move) + emit[:, t]
            ahead[:, t] = np.where(mask[:, t, None] > 0, via, ahead[:, t - 1])
        for t in range(steps - 2, -1, -1):
            via = _log_add(((behind[:, t + 1] + emit[:, t + 1])[:, None, :] + move).transpose(0, 2, 1))
            behind[:, t] = np.where(mask[:, t + 1, None] > 0, via, behind[:, t + 1])
        log_z = _log_add(ahead[:, -1, :, None])
        inside = np.exp(ahead + behind - log_z[:, None]) * mask[:, :, None]
        joint = np.exp(
            ahead[:, :-1, :, None] + move + (emit[:, 1:] + behind[:, 1:])[:, :, None, :] - log_z[:, None, :, None]
        ) * mask[:, 1:, None, None]
        rest = one_hot - inside
        gradients = [
            np.einsum("ntf,ntk->fk", x, rest, optimize=True) / n - PENALTY * weights,
            (pairs - joint.sum(axis=(0, 1))) / n - PENALTY * move,
            rest[:, 0].sum(axis=0) / n,
        ]
        for p, g, m, v in zip(parameters, gradients, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Chain(names, *parameters)


def main_texts(pages: DataFrame, model: Chain | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A null or empty page, or one without main text, has the empty text.
    Repeated rows are read each; an empty table gives no rows.
    """
    model = model or train()
    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = [model.main_text(p.as_py()) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
