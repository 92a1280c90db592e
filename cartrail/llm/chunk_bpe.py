"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts a text into chunks, at the first white space
after each place where the hash is low. Equal stretches of different documents
give equal chunks, wherever they stand; each is put together once in a task. What
the tokenizer encodes are the runs of a new chunk, each once in a task, and a
chunk is the join of its runs.

The default vocabulary never merges across white space or marks, so chunks that end there join
exactly. Where no white space is near, the cut falls inside a run; such a cut is
moved to the next white space before anything is encoded. This is exact for
vocabularies that split so, and not for those that keep spaces in their tokens.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cartrail.llm.common import in_groups, small_batches

VOCABULARY = "word_bpe_49k.json"
WINDOW = 8
CUT_BITS = 8
# Bytes to look ahead for white space before a cut falls inside a run.
LOOK_AHEAD = 128
KNOWN_CHUNKS = 10_000
KNOWN_RUNS = 250_000
SPACE = b" \t\n\r"
# Texts are cut in stretches of about this size to bound the hash arrays.
STRETCH = 1 << 22


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """Hash of the last WINDOW bytes at each place."""
    mixed = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(2654435761)
    total = mixed.copy()
    for back in range(1, WINDOW):
        total[back:] += mixed[:-back] << np.uint32(back)
    return total ^ (total >> np.uint32(15))


def chunks(raw: bytes) -> Iterator[tuple[bytes, bool]]:
    """The text in pieces, each with whether it ends inside a run of non-space bytes."""
    start = 0
    for at in range(0, len(raw), STRETCH):
        data = np.frombuffer(raw[max(0, at - WINDOW) : at + STRETCH], dtype=np.uint8)
        low = np.flatnonzero(rolling_hash(data) & np.uint32((1 << CUT_BITS) - 1) == 0) + max(0, at - WINDOW)
        for cut in low.tolist():
            if cut < start or cut < at:
                continue
            ahead = re.search(rb"[ \t\n\r]", raw[cut : cut + LOOK_AHEAD])
            end = cut + ahead.start() if ahead else cut + 1
            while end < len(raw) and raw[end] & 0xC0 == 0x80:
                end += 1
            if end <= start:
                continue
            inside = ahead is None and end < len(raw) and raw[end] not in SPACE
            yield raw[start:end], inside
            start = end
    if start < len(raw):
        yield raw[start:], False


class Encoder:
    """Encodes and decodes texts for one task; keeps what it has seen, within bounds."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.runs: dict[bytes, tuple[str, str]] = {}
        self.seen: dict[bytes, tuple[str, str]] = {}

    def _learn(self, runs: list[bytes]) -> None:
        """Encode and decode runs that are not known yet."""
        texts = [r.decode("utf-8") for r in runs]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        for run, own, text in zip(runs, ids, self.tokenizer.decode_batch(ids, skip_special_tokens=False)):
            self.runs[run] = (" ".join(map(str, own)), text)

    def encode(self, raws: list[bytes]) -> Iterator[tuple[int, str, str]]:
        """For each text the number of tokens, ids joined by a space, and the decoded text."""
        cut = [list(whole_chunks(raw)) for raw in raws]
        if len(self.seen) > KNOWN_CHUNKS:
            self.seen.clear()
        if len(self.runs) > KNOWN_RUNS:
            self.runs.clear()
        new = {chunk: units(chunk) for pieces in cut for chunk in pieces if chunk not in self.seen}
        missing = {run for runs in new.values() for run in runs if run not in self.runs}
        if missing:
            self._learn(list(missing))
        for chunk, runs in new.items():
            self.seen[chunk] = joined(map(self.runs.__getitem__, runs))
        for pieces in cut:
            ids, text = joined(map(self.seen.__getitem__, pieces))
            yield ids.count(" ") + 1 if ids else 0, ids, text


# Between an ASCII letter and one of these marks the tokenizer always splits.
MARK = re.compile(rb"(?<=[A-Za-z])(?=[.,;:!?|])")


def units(chunk: bytes) -> list[bytes]:
    """The parts of a chunk that the tokenizer treats apart, in lower case if that is safe.

    Outside ASCII, composition may depend on case; special tokens are told by theirs.
    """
    if b"<|" in chunk:
        return chunk.split()
    if chunk.isascii():
        chunk = chunk.lower()
    return MARK.sub(b" ", chunk).split()


def joined(parts: Iterator[tuple[str, str]]) -> tuple[str, str]:
    """Ids and texts one after the other; parts without tokens leave no trace."""
    ids, texts = tuple(zip(*parts)) or ((), ())
    if "" in ids:
        texts = [t for i, t in zip(ids, texts) if i]
        ids = [i for i in ids if i]
    return " ".join(ids), " ".join(texts)


def whole_chunks(raw: bytes) -> Iterator[bytes]:
    """Chunks after repair: a run that was cut is put together and moves to one side."""
    head = b""
    for chunk, inside in chunks(raw):
        chunk, head = head + chunk, b""
        if inside:
            end = max(chunk.rfind(s) for s in (b" ", b"\t", b"\n", b"\r")) + 1
            chunk, head = chunk[:end], chunk[end:]
        if chunk:
            yield chunk
    if head:
        yield head


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, columns: list[str], path: str | None = None) -> DataFrame:
    """The given columns with ``n_tokens``, ``token_ids`` (joined by a space) and ``decoded``.

    A null text counts as empty; an empty text has no tokens.
    """
    path = path or vocabulary_path()
    schema = docs.select(*columns).schema
    for name, kind in (("n_tokens", "long"), ("token_ids", "string"), ("decoded", "string")):
        schema = schema.add(name, kind)
    return _mapped(docs, columns, path, schema, lambda n, ids, text: (n, ids, text))


def encoding_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every document.

    A null text is an empty one; repeated rows and null ids stay, in a row each. An empty
    table gives no rows, and other columns are not read.
    """
    path = path or vocabulary_path()
    schema = docs.select("doc_id").schema.add("n_tokens", "long")
    schema = schema.add("ids_sha256", "string").add("decoded_sha256", "string")
    digest = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
    return _mapped(docs, ["doc_id"], path, schema, lambda n, ids, text: (n, digest(ids), digest(text)))


def _mapped(docs: DataFrame, columns: list[str], path: str, schema, answer) -> DataFrame:
    names = list(dict.fromkeys([*columns, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(path)
        # Nothing here makes reference cycles; walking the caches again and again is lost time.
        gc.disable()
        try:
            for batch in small_batches(batches):
                raws = [(t.as_py() or "").encode("utf-8") for t in batch.column("text")]
                rows = [answer(*one) for group in in_groups(raws, STRETCH) for one in encoder.encode(group)]
                counts, ids, texts = zip(*rows) if rows else ((), (), ())
                arrays = [batch.column(c) for c in columns]
                arrays += [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
        finally:
            gc.enable()

    return docs.select(*names).mapInArrow(run, schema)
