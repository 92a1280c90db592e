"""Reply trees, spelling variants and ranked search against brute force and on awkward input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartrail.llm import fp_tree_search, language_gru, maxscore, quality_qda, reply_trees, spelling_variants

MESSAGES = "tree_id bigint, message_id bigint, parent_id bigint, role string, text string, score double"
CHAT = "conv_id bigint, turn bigint, role string, text string, score string, head string"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# --- reply trees -------------------------------------------------------------


def brute_branches(rows, best):
    """Per tree the best branches as (total, [(role, text)]), walked from each leaf."""
    trees = {}
    for tree, message, parent, role, text, score in rows:
        trees.setdefault(tree, {})[message] = (parent, role, text or "", score or 0.0)
    out = []
    for tree, messages in trees.items():
        parents = {m[0] for m in messages.values()}
        found = []
        for leaf in set(messages) - parents:
            path, at = [], leaf
            while at in messages and len(path) <= len(messages):
                path.append(at)
                at = messages[at][0]
            if at not in messages:
                total = sum(messages[m][3] for m in path)
                found.append((-total, leaf, [messages[m][1:3] for m in reversed(path)]))
        for rank, (total, leaf, turns) in enumerate(sorted(found)[:best], 1):
            out.append((tree, rank, -total, leaf, tuple(turns)))
    return sorted(out)


def read_back(df):
    spans = reply_trees.read_loss(F.col("formatted"), F.col("loss_spans"))
    rows = df.select("*", reply_trees.read_turns(F.col("formatted")).alias("turns"), spans.alias("loss")).collect()
    for r in rows:
        assert r.n_turns == len(r.turns)
        assert [t.text for t in r.turns if t.role == "assistant"] == r.loss
    return sorted((r.tree_id, r["rank"], r.total, r.leaf, tuple((t.role, t.text) for t in r.turns)) for r in rows)


@pytest.mark.parametrize("best", [1, 3])
def test_best_branches_of_trees(spark, best):
    rows = []
    for tree in range(5):
        for m in range(1, 40):
            parent = None if m == 1 else max(1, m - 1 - (m * 7 + tree) % 9)
            rows.append((tree, m, parent, ("user", "assistant")[m % 2], f"<|t|>\\{m}<", float((m * 13 + tree) % 11)))
    # A flat tree, a chain, a circle with a tail, and an answer to a message that is not there.
    rows += [(10, m, None if m == 0 else 0, "user", "x", 0.5 * (m % 4)) for m in range(60)]
    rows += [(11, m, m - 1 if m else None, "assistant", "é|", None) for m in range(50)]
    rows += [(12, 1, 2, "a", "c", 1.0), (12, 2, 1, "a", "c", 1.0), (12, 3, 1, "a", "c", 1.0)]
    rows += [(13, 5, 99, "user", None, 1.0)]
    found = reply_trees.formatted_branches(spark.createDataFrame(rows, MESSAGES), best)
    assert read_back(found) == brute_branches(rows, best)


def test_heavy_parents_take_the_other_join(spark, monkeypatch):
    monkeypatch.setattr("cartrail.llm.common.HEAVY_KEYS", 3)
    rows = [(1, m, None if m == 0 else (m - 1) // 30, "user", str(m), float(m % 7)) for m in range(400)]
    found = reply_trees.formatted_branches(spark.createDataFrame(rows, MESSAGES), 2)
    assert read_back(found) == brute_branches(rows, 2)


def test_texts_cannot_break_turns(spark):
    """Many random texts of signs that the template uses, one tree each, in one run."""
    rng = random.Random(5)
    signs = ["<", "|", ">", "\\", "\n", "n", "im_end", "<|im_start|>", "<|im_end|>", "assistant", "é", " "]
    text = lambda: "".join(rng.choice(signs) for _ in range(rng.randint(0, 9)))
    trees = [[(text() if rng.random() < 0.5 else "assistant", text()) for _ in range(rng.randint(1, 4))] for _ in range(400)]
    rows = [(n, k, k - 1 if k else None, r, t, 0.0) for n, turns in enumerate(trees) for k, (r, t) in enumerate(turns)]
    found = read_back(reply_trees.formatted_branches(spark.createDataFrame(rows, MESSAGES)))
    assert [list(r[4]) for r in found] == trees


def test_odd_conversations(spark):
    rows = [
        (1, 0, "user", None, "s", "h"),
        (1, None, "system", "first", "s", "h"),
        (1, 2, None, "no role", None, None),
        (1, 1, "assistant", "twice", "s", "h"),
        (1, 1, "assistant", "twice", "s", "h"),
        (None, 0, "assistant", "no id", "s", "h"),
        (3, 0, "assistant", "word. " * 50_000, "s", "h"),
    ]
    got = {r.conv_id: r for r in reply_trees.chat_report(spark.createDataFrame(rows, CHAT)).collect()}
    assert set(got) == {1, None, 3, -1}
    turns = "system\nfirst\nuser\n\nassistant\ntwice\nassistant\ntwice\n\nno role\n"
    assert got[1].n_turns == 5 and got[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert (got[1].loss_chars, got[3].loss_chars, got[-1].loss_chars) == (10, 300_000, 34)
    empty = reply_trees.chat_report(spark.createDataFrame([], CHAT)).collect()
    assert [r.conv_id for r in empty] == [-1]


def test_chats_stay_native(spark):
    df = reply_trees.chat_report(spark.createDataFrame([(1, 0, "user", "x", "s", "h")], CHAT))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- spelling variants ---------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(counts):
    out = {}
    for w, n in counts.items():
        near = sorted((-counts[o], o) for o in counts if o != w and one_edit(w, o))
        form = near[0][1] if near and -near[0][0] >= 2 * n else None
        out[w] = (form, n, len(near), counts[form] if form else None)
    rows = set()
    for w, (form, n, near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, near, form_n))
    return rows


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text(alphabet="abé", max_size=7), max_size=25))
def test_scan_finds_exactly_the_pairs(words):
    words = sorted(words)
    want = {(i, j) for i, j in combinations(range(len(words)), 2) if one_edit(words[i], words[j])}
    found = list(spelling_variants.near_in_list(words))
    assert len(found) == len(set(found)) and set(found) == want


@pytest.mark.parametrize("group_words", [2, 96])
def test_variants_match_brute_force(spark, group_words):
    words = {}
    for k in range(400):
        letters = "abcdé"
        words["".join(letters[(k * p + k // p) % (2 + p % 4)] for p in range(3, 8 + k % 3))] = 3 + k * k % 50
    for c in "abcdefghijklmnopqrstuvwxyz":
        words[f"pre{c}fix"] = 5
        words[f"aaaaaaaa{c}"] = 4
    words["prefix"], words["a" * 8], words["x" * 3000], words["x" * 3001] = 90, 40, 3, 9
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = [tuple(r) for r in spelling_variants.variant_groups(frame, group_words).collect()]
    assert len(got) == len(words) and set(got) == brute_variants(words)


def test_words_of_documents(spark):
    texts = ["Straße naïve ÀÉÎÕÜ hello, HELLO-hello x1hello2", None, "", "hello naïve naïve ÀÉÎÕÜ " * 300, "hellos " * 7]
    rows = [(k if k else None, t, "w", 1, "k") for k, t in enumerate(texts)] + [(4, "hellos " * 7, "w", 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, word string, n int, key string")
    counts = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = fold(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    got = {tuple(r) for r in spelling_variants.variant_report(docs).collect()}
    assert got == brute_variants(counts) and len(got) >= 3
    assert spelling_variants.variant_report(docs.limit(0)).count() == 0


def test_a_letter_is_dropped_where_the_checksum_says(spark):
    docs = spark.createDataFrame([(k, "wonderful " * 3) for k in range(2000)], "doc_id bigint, text string")
    got = {r.word: r.n for r in spelling_variants.vocabulary(docs).collect()}
    want = Counter()
    for k in range(2000):
        h = zlib.crc32(f"{k}:wonderful".encode())
        want["wonderful"[: h % 9] + "wonderful"[h % 9 + 1 :] if h % 97 == 0 else "wonderful"] += 3
    assert got == want and len(got) > 3


# --- ranked search ---------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_ranking(docs, items, top=10):
    bags = [(d, Counter(TERM.findall(fold(t or "")))) for d, t in docs]
    number, length = sum(1 for _, b in bags if b), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(TERM.findall(fold(text or "")))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, bag in bags:
            if bag:
                m = 10 + (90 * bag.total() * number) // length
                score = sum(
                    math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
                    for t in terms & bag.keys()
                )
                if score > 0:
                    scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, k, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1)]
    return Counter(out)


def make_docs(count):
    texts = []
    for k in range(count):
        words = [f"w{(k * j * j + j) % (3 + j % 60)}" for j in range(5 + k % 40)]
        texts.append((k, " ".join(words) + (" Äß9-é" if k % 3 else "")))
    return texts


@pytest.mark.parametrize("leaf, trie, block", [(32, 8192, 8 << 20), (2, 64, 100)])
def test_ranking_matches_brute_force(spark, monkeypatch, leaf, trie, block):
    monkeypatch.setattr(fp_tree_search, "LEAF_DOCS", leaf)
    monkeypatch.setattr(fp_tree_search, "TRIE_DOCS", trie)
    docs = make_docs(700)
    # Copies: equal texts, and equal terms of the items in texts of another length.
    docs += [(5000 + k, "w1 w2 w3 copy") for k in range(200)] + [(6000 + k, "w1 w2 w3 copy " + "pad " * k) for k in range(50)]
    items = [(1, "W1 w2, w3 w1"), (2, "é ÄSS äß9 w7 w50"), (3, "copy"), (4, "not there"), (5, ""), (6, None), (1, "w9")]
    found = fp_tree_search.ranking(
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(items, "item_id bigint, text string"),
        block_bytes=block,
    )
    assert Counter(map(tuple, found.collect())) == brute_ranking(docs, items)


def test_odd_documents_and_items(spark):
    long_text = "alpha beta " * 150_000
    docs = [(1, "alpha"), (1, "alpha"), (None, "alpha"), (2, None), (3, ""), (4, "!?"), (5, long_text), (6, "gamma")]
    items = [(None, "alpha gamma"), (7, "beta"), (7, "beta"), (8, None)]
    doc_frame = spark.createDataFrame([(*d, 1, "t") for d in docs], "doc_id bigint, text string, score int, terms string")
    item_frame = spark.createDataFrame([(*i, 1, "t") for i in items], "item_id bigint, text string, rank int, term string")
    found = fp_tree_search.ranking(doc_frame, item_frame)
    assert Counter(map(tuple, found.collect())) == brute_ranking(docs, items)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert fp_tree_search.ranking(doc_frame.limit(0), item_frame).count() == 0
    assert fp_tree_search.ranking(doc_frame, item_frame.limit(0)).count() == 0


def test_a_long_text_is_read_in_stretches(monkeypatch):
    text = "Ab1 " * 1000 + "é" * 500 + " x"
    whole = [w for words in fp_tree_search.words_of(text) for w in words]
    monkeypatch.setattr(fp_tree_search, "STRETCH", 7)
    assert [w for words in fp_tree_search.words_of(text) for w in words] == whole == fold(text).encode().split()


# --- earlier operators: what they once got wrong ------------------------------------


def test_signs_that_are_no_letters_have_no_language(spark):
    rows = [(k, t, "en" if k % 2 else "de") for k, t in enumerate(["der hund lief", "the cat sat"] * 20)]
    docs = spark.createDataFrame(rows + [(99, "½ ² Ⅷ", None), (98, None, None), (97, "x²y", None)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_gru.language_report(docs).collect()}
    assert got[99] == got[98] == "und" and got[97] in ("en", "de")
    assert language_gru.words_of("ab½c Ünd x²") == ["ab", "c", "ünd", "x"]


def test_vectors_whose_products_do_not_fit_are_an_error(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1e30, 0.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="component is larger"):
        maxscore.scaled(rows).collect()
    assert [r.vector for r in maxscore.scaled(rows.filter("vec_id = 1")).collect()] == [[256, 512]]


def test_class_covariances_are_shrunk_as_written():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) + 2
    of = [rng.random(300) < 0.4]
    of.insert(0, ~of[0])
    model = quality_qda.fit(
        np.array([k.sum() for k in of], dtype=float), np.array([x[k].sum(axis=0) for k in of]), np.array([x[k].T @ x[k] for k in of])
    )
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    own = [np.cov(z[k].T, bias=True) for k in of]
    pooled = sum(c * k.mean() for c, k in zip(own, of))
    for covariance, whiten in zip(own, model.whiten):
        mixed = (1 - quality_qda.TO_POOLED) * covariance + quality_qda.TO_POOLED * pooled
        want = (1 - quality_qda.TO_IDENTITY) * mixed + quality_qda.TO_IDENTITY * np.trace(mixed) / 5 * np.eye(5)
        assert np.linalg.inv(whiten.T @ whiten) == pytest.approx(want)
    one_class = quality_qda.fit(np.array([3.0, 0.0]), np.zeros((2, 5)), np.zeros((2, 5, 5)))
    assert one_class is None
