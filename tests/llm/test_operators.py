"""The training-data operators against brute force and on awkward input."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from cartrail.llm import (
    chunk_bpe,
    common,
    kk_shards,
    labelled_pages,
    language_gru,
    line_dedup,
    maxscore,
    page_crf,
    quality_qda,
    simhash_decon,
    simhash_dedup,
    warc_fixity,
)

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _doc string"
LONG = "word and more. " * 30_000
ODD = [
    (1, None, "en", "a", 0, "x"),
    (2, "", None, None, None, None),
    (3, "  \n\t ", "de", "a", 5, "x"),
    (4, "Ωmega ### 123", None, "b", 13, None),
    (5, LONG, "en", "b", len(LONG), None),
    (5, LONG, "en", "b", len(LONG), None),
    (6, LONG, "en", "c", None, None),
    (None, "a text without a name stands here as the last of all.", "fr", None, 1, None),
    (None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def small(spark):
    return {t: spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels", "pages", "benchmark", "embeddings")}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and a column name used inside."""
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.limit(0)


# --- fixity ---------------------------------------------------------------


def test_fixity_finds_all_damage_and_nothing_else(spark):
    rows = [(f, o * 1000, 1000, 1, f"d{f}-{o}", o) for f in range(3) for o in range(300)]
    schema = "file bigint, offset bigint, length bigint, copies bigint, digest string, record int"
    a = spark.createDataFrame(rows, schema)
    changed = {(0, 7), (2, 299)}
    other = [(f, o, n, c, "bad" if (f, r) in changed else d, r) for f, o, n, c, d, r in rows if (f, r) != (1, 50)]
    b = spark.createDataFrame([*other, (2, 300_000, 1000, 1, "new", 300)], schema)
    got = {(r.file, r.record, r.state) for r in warc_fixity.audit(a, b).collect()}
    assert got == {(0, 7, "changed"), (2, 299, "changed"), (1, 50, "missing"), (2, 300, "extra")}
    assert warc_fixity.audit(a, a).count() == 0
    assert warc_fixity.audit(a, a.limit(0)).count() == len(rows)
    assert warc_fixity.audit(a.limit(0), a.limit(0)).count() == 0


def test_layout_has_no_gaps_and_counts_copies(spark):
    rows = [(i, "u", i % 7, "d") for i in range(50)] + [(1, "u", 1, "d")] * 9 + [(None, None, 0, "e")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, length bigint, digest string")
    placed = warc_fixity.lay_out(df, ["page_id", "url", "digest"], 10).collect()
    assert sum(r.copies for r in placed) == len(rows)
    files = defaultdict(list)
    for r in placed:
        files[r.file].append((r.offset, r.length * r.copies))
    for parts in files.values():
        end = 0
        for offset, size in sorted(parts):
            assert offset == end
            end += size


# --- shards ---------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 10**6), max_size=60), st.integers(1, 16))
def test_differencing_is_no_worse_than_greedy_alone(sizes, shards):
    shard = kk_shards.difference(sizes, shards)
    assert len(shard) == len(sizes) and all(0 <= s < shards for s in shard)
    load = Counter()
    for size, s in zip(sizes, shard):
        load[s] += size
    top = max(load.values(), default=0)
    assert top <= sum(sizes) / shards + max(sizes, default=0)


def test_two_way_differencing_leaves_the_known_difference():
    sizes = [8, 7, 6, 5, 4]
    shard = kk_shards.difference(sizes, 2)
    sums = [sum(s for s, k in zip(sizes, shard) if k == p) for p in (0, 1)]
    assert abs(sums[0] - sums[1]) == 2


def test_shards_keep_groups_and_number_gaplessly(spark, small, odd):
    copies = small["documents"].unionByName(
        small["documents"].limit(1).withColumn("doc_id", F.explode(F.sequence(F.lit(10_000), F.lit(10_200))))
    )
    for docs in (copies, odd.select(*small["documents"].columns)):
        rows = kk_shards.shard_documents(docs).collect()
        want = Counter(
            (d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs.collect()
        )
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
        slots, groups = defaultdict(list), defaultdict(set)
        for r in rows:
            slots[r.shard].append(r.slot)
            if r.size > 1:
                groups[r.size, r.text_crc32].add(r.shard)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert all(len(s) == 1 for s in groups.values())


# --- repeated passages ------------------------------------------------------


def brute_units(text):
    """(start, length, text) of units by index arithmetic over the list of pieces."""
    base, at = [], 0
    for line in text.split("\n"):
        for m in re.finditer(r"[^.!?]+[.!?]*|[.!?]+", line):
            words = [(w.start(), w.end(), w.group().lower()) for w in re.finditer(r"\S+", m.group())]
            cuts = [k + 1 for k, w in enumerate(words) if hashlib.md5(w[2].encode()).hexdigest()[0] in "01"]
            cuts = [0, *[c for c in cuts if c < len(words)], len(words)] if len(words) >= 32 else [0, len(words)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    low = words[a - 1][1] if a else 0
                    high = words[b - 1][1] if b < len(words) else len(m.group())
                    base.append((at + m.start() + low, at + m.start() + high, [w[2] for w in words[a:b]]))
        at += len(line) + 1
    sizes = [len(w) for _, _, w in base]
    spans = {(k, k) for k, n in enumerate(sizes) if n >= 8}
    for k, n in enumerate(sizes):
        if n < 8:
            spans |= {(k, j) for j in range(k, len(base)) if sum(sizes[k : j + 1]) >= 8 > sum(sizes[k:j])}
            spans |= {(j, k) for j in range(k + 1) if sum(sizes[j : k + 1]) >= 8 > sum(sizes[j + 1 : k + 1])}
    return sorted(
        (base[a][0], base[b][1] - base[a][0], " ".join(w for _, _, ws in base[a : b + 1] for w in ws)) for a, b in spans
    )


def brute_repeats(docs):
    seen, found = {}, set()
    for doc, text in sorted(set(docs), key=lambda d: d[0]):
        for start, size, unit in brute_units(text or ""):
            if unit not in seen:
                seen[unit] = (doc, start, size)
                continue
            kept, at, length = seen[unit]
            first = max(start, at + length) if kept == doc else start
            if start + size > first:
                found.add((doc, first, start + size - first, kept, at))
    return sorted(found)


@given(st.lists(st.sampled_from(["a", "bb ", "c. ", "dd! ", "\n", " e", " ff ", "gh ij kl mn. ", "x y z " * 14]), max_size=40))
@settings(max_examples=150, deadline=None)
def test_units_match_index_arithmetic(parts):
    text = "".join(parts)
    assert sorted(line_dedup.text_units(text)) == brute_units(text)


@pytest.mark.parametrize("end, words", [("\n", 4), (". ", 5), (" ", 4)], ids=["lines", "sentences", "no ends"])
def test_passages_of_short_units_go_but_for_one(spark, end, words):
    passage = end.join(" ".join(f"w{k}x{j}" for j in range(words)) for k in range(30))
    docs = spark.createDataFrame(
        [(1, f"Before one {passage} after one"), (2, f"Quite another start {passage} and end")],
        "doc_id long, text string",
    )
    kept = {r.doc_id: r.text for r in line_dedup.without_repeats(docs).collect()}
    assert kept[1] == f"Before one {passage} after one"
    # What stays stands with other words in one piece: the outermost units, or all outside the outermost cuts.
    said = re.findall(r"w\d+x\d+", passage)
    cuts = [k for k, w in enumerate(said) if hashlib.md5(w.encode()).hexdigest()[0] in "01"]
    head, tail = (words, len(said) - words) if end != " " else (cuts[0] + 1, cuts[-1] + 1)
    assert re.findall(r"w\d+x\d+", kept[2]) == said[:head] + said[tail:]
    assert "Quite another start" in kept[2] and "and end" in kept[2]


def test_a_run_that_repeats_itself_keeps_its_first_part(spark):
    docs = spark.createDataFrame([(1, "la la la.\n" * 20)], "doc_id long, text string")
    assert line_dedup.without_repeats(docs).first().text.split() == ["la", "la", "la."] * 3


def test_repeats_match_brute_force(small):
    docs = [(r.doc_id, r.text) for r in small["documents"].collect()]
    got = sorted(tuple(r) for r in line_dedup.repeated_units(small["documents"]).drop("_th").collect())
    assert got == brute_repeats(docs)


def test_a_passage_inside_a_line_is_cut_out_everywhere_but_once(spark):
    passage = "This sentence of the shared passage has more than eight words in it."
    rows = [(i, f"Own words number {i} come first. {passage} And {i} ends it.", "en", "s", 1) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id: r.text for r in line_dedup.without_repeats(docs).collect()}
    assert kept[0] == rows[0][1]
    assert all(passage not in kept[i] and f"number {i}" in kept[i] and f"{i} ends" in kept[i] for i in range(1, 5))


def test_spans_are_cut_with_their_line_ends():
    assert line_dedup.without_spans("ab\ncd\nef", [(3, 2)]) == "ab\nef"
    assert line_dedup.without_spans("abcdef", [(1, 2), (2, 2)]) == "aef"
    assert line_dedup.without_spans("", []) == ""


# --- quality ----------------------------------------------------------------


def test_statistics_do_not_depend_on_stretches(monkeypatch):
    texts = ["a!!b ## c\n" * 50, "", None, "x", "!" * 999, "Ende. " * 70]
    whole = quality_qda.statistics(texts)
    monkeypatch.setattr(quality_qda, "STRETCH", 37)
    assert np.array_equal(whole, quality_qda.statistics(texts))


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_qda.quality_report(docs, labels).join(labels, "doc_id").collect()
    tested = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == r.quality for r in tested]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_density_difference_matches_a_direct_formula():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) * [1, 2, 3]
    y = (rng.random(200) < 0.4).astype(int)
    parts = [x[y == k] for k in (0, 1)]
    model = quality_qda.fit(
        np.array([float(len(p)) for p in parts]), np.array([p.sum(0) for p in parts]), np.array([p.T @ p for p in parts])
    )
    z = (x - model.centre) / model.scale
    logs = []
    for p, mean, whiten in zip(parts, model.means, model.whiten):
        cov = np.linalg.inv(whiten.T @ whiten)
        d = z - mean
        logs.append(
            np.log(len(p) / 200) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
        )
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])))


# --- language ---------------------------------------------------------------


def test_gradients_match_differences():
    network = language_gru.Network(["a", "b", "c"])
    for p in network.parameters():
        p[...] = p.astype(np.float32)
    data, mask = network.padded([b"abc", b"de", b"xyzw"])
    truth = np.array([0, 2, 1])

    def loss():
        p, _ = network.label(data, mask)
        return -(np.log(p[:, np.arange(3), truth]) * mask).sum() / mask.sum()

    gradients = network.gradients(data, mask, truth)
    for p, g in zip(network.parameters(), gradients):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        step, old = np.float32(1e-2), p[at]
        p[at] = old + step
        up = loss()
        p[at] = old - step
        down = loss()
        p[at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 0.02 * abs(g[at]) + 1e-4


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_gru.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    tested = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in tested]) > 0.97


def test_every_language_is_learned(spark):
    """More than 64 languages, one of long texts only, and one of a text with many copies."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(10 * k + n, f"{letters[k % 26]}{letters[k // 26]} " * (20 + n), f"l{k:02d}") for k in range(70) for n in range(6)]
    rows += [(2000 + n, "xyx yxy " * (3000 + n), "long") for n in range(5)]
    rows += [(3000 + n, "qqq", "copied") for n in range(400)] + [(4000 + n, f"{'ww' * (n + 1)}", "copied") for n in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    taken = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(language_gru, "fit", lambda rows: taken.extend(rows))
        patch.setattr(language_gru, "TRAIN_DOCS", 10)
        language_gru.train(docs)
    assert {lang for _, lang in taken} == {r[2] for r in rows}
    assert all(len(text) <= 16_384 for text, _ in taken) and len(taken) == len(set(taken))
    assert sum(lang == "copied" for _, lang in taken) == 10


# --- tokens -----------------------------------------------------------------

PIECES = st.sampled_from(
    ["a", "The", " ", "\n", "\t", ", ", ".", "don't", "'s", "é", "é", " ", "\x1c", " ", "İ", "ß", "12", "###",
     "<|endoftext|>", "<|", "|>", "日本", "\U0001f600", "x" * 90, "J̌", "word word "]
)


@pytest.fixture(scope="module")
def encoder():
    return chunk_bpe.Encoder(chunk_bpe.vocabulary_path())


def by_library(encoder, text):
    ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), encoder.tokenizer.decode(ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECES, max_size=60).map("".join))
def test_tokens_match_the_library(encoder, text):
    assert list(encoder.encode([text.encode()])) == [by_library(encoder, text)]


def test_cuts_inside_runs_are_repaired(encoder):
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abcdeé日"), 20_000)) + " end"
    assert any(inside for _, inside in chunk_bpe.chunks(text.encode()))
    assert list(encoder.encode([text.encode()])) == [by_library(encoder, text)]


def test_chunks_are_the_text_and_shared_between_texts():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(4000)]
    shared = " ".join(words[500:])
    one, two = [list(chunk_bpe.whole_chunks(f"{head} {shared}".encode())) for head in ("some start", "another one entirely")]
    assert b"".join(two).decode().endswith(shared)
    assert len(set(one) & set(two)) > 0.9 * len(set(one))


def test_encoding_of_all_documents(small, encoder):
    rows = {r.doc_id: r for r in chunk_bpe.encoding_report(small["documents"]).collect()}
    for d in small["documents"].collect():
        n, ids, text = by_library(encoder, d.text or "")
        sha = [hashlib.sha256(s.encode()).hexdigest() for s in (ids, text)]
        assert [rows[d.doc_id].n_tokens, rows[d.doc_id].ids_sha256, rows[d.doc_id].decoded_sha256] == [n, *sha]


# --- search -----------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 6), st.integers(1, 5), st.integers(0, 10**6))
def test_maxscore_equals_all_products(n, width, k, seed):
    rng = np.random.default_rng(seed)
    rows = rng.integers(-4, 5, (n, width)) * (rng.random((n, width)) < 0.7)
    ids = rng.permutation(n) * 3
    postings = maxscore.Postings(ids, rows)
    query = rng.integers(-4, 5, width)
    own = int(ids[0])
    got_ids, got = postings.search(query, own, k)
    want = sorted(((-int(r @ query), int(i)) for r, i in zip(rows, ids) if i != own))[:k]
    assert [(-int(s), int(i)) for s, i in zip(got, got_ids)] == want


def test_search_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 40)
    monkeypatch.setattr(maxscore, "QUERY_ROWS", 2)
    rng = np.random.default_rng(2)
    vectors = [[float(x) for x in v] for v in rng.normal(size=(200, 8))]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(None, vectors[0]), (200, None), (201, [float("nan")] * 8), (202, [None] * 8), (203, vectors[3]), (203, vectors[3])]
    df = maxscore.scaled(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    table = {i: np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int) for i, v in enumerate(vectors)}
    items = [*table.items(), (203, table[3]), (203, table[3])]
    want = set()
    for q in range(0, 204, 50):
        if q in table:
            best = sorted((-int(v @ table[q]), i) for i, v in items if i != q)[:5]
            want |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in maxscore.top_k(df, df.filter("vec_id % 50 = 0"), 5).collect()} == want
    assert maxscore.top_k(df.limit(0), df.limit(0), 5).count() == 0


# --- pages ------------------------------------------------------------------


@pytest.fixture(scope="module")
def chain():
    return page_crf.train()


def test_blocks_of_unseen_labelled_pages(chain):
    right = total = 0
    for page in labelled_pages.labelled_pages(60, seed=77):
        blocks, labels = page_crf.labelled_blocks(page)
        got = chain.viterbi(chain.emissions(blocks))
        right += sum(a == b for a, b in zip(got, labels))
        total += len(labels)
    assert right / total > 0.99


def test_viterbi_is_the_best_path(chain):
    rng = np.random.default_rng(0)
    for n in range(1, 8):
        e = rng.normal(size=(n, 2))

        def score(path):
            return chain.start[path[0]] + sum(e[k, y] for k, y in enumerate(path)) + sum(chain.move[a, b] for a, b in zip(path, path[1:]))

        paths = [[(b >> k) & 1 for k in range(n)] for b in range(2**n)]
        assert np.isclose(score(chain.viterbi(e)), max(map(score, paths)))


def test_articles_of_the_pages(spark, small, chain):
    texts = {r.page_id: r for r in page_crf.main_texts(small["pages"], chain).collect()}
    import html

    for page in small["pages"].collect():
        article = re.search(r"<article>(.*?)(</article>|<footer|$)", page.html, re.S).group(1)
        article = re.sub(r"</?(?:b|i|a)[^>]*>", "", article.replace("<br>", " "))
        blocks = [" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert texts[page.page_id].text == "\n".join(b for b in blocks if b)
        assert texts[page.page_id].n_chars == len(texts[page.page_id].text)


@pytest.mark.parametrize("start", ["<div>x", "<div class='a{0}'>x", "<x-a>x</b-c>"])
def test_deep_pages_take_memory_in_proportion(chain, start):
    page = "".join(start.replace("{0}", "bcdefghij"[k % 9] * (k // 9 + 1) if k < 900 else "z") for k in range(40_000))
    tracemalloc.start()
    chain.main_text(page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!--", "<script>x", "a<b", "</div></p>", "&amp", "<p " + "a='" * 2000])
def test_broken_pages(chain, page):
    assert isinstance(chain.main_text(page), str)


@pytest.mark.parametrize(
    "start", ["<svg width='1'/>", "<math/>", "<button-group>", "<title-bar>", "<select-menu>", "<template-x>",
              "<button>", "<select>", "<object>", "<canvas>", "<noscript>"]
)
def test_the_rest_of_a_page_is_read(start):
    texts = [b.text for b in page_crf.leaf_blocks(f"<p>a</p>{start}<p>rest one</p><p>rest two</p>")]
    assert texts == ["a", "rest one", "rest two"]


@pytest.mark.parametrize("tag", ["script", "style", "title", "textarea", "iframe"])
def test_raw_text_is_left_out(tag):
    texts = [b.text for b in page_crf.leaf_blocks(f"<p>a</p><{tag} x='1'>var <b>x</b></{tag.upper()} ><p>b</p><{tag}>c<p>d")]
    assert texts == ["a", "b"]


# --- decontamination --------------------------------------------------------


def test_planted_items_are_found_and_clean_documents_stay(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    items = [(i, " ".join(word() for _ in range(20 + i))) for i in range(10)] + [(99, "too short"), (98, None), (97, "")]
    noise = lambda n: " ".join(word() for _ in range(n))
    docs = [(i, f"{noise(30)} {items[i % 10][1].upper()}, {noise(30)}") for i in range(20)]
    docs += [(100, noise(80)), (101, None), (102, ""), (103, items[0][1]), (104, "too short")]
    near = items[9][1].split()
    docs.append((105, noise(9) + " " + " ".join([*near[:28], "changed"]) + " " + noise(9)))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id): r.similarity for r in simhash_decon.contaminated(d, b).collect()}
    assert set(found) == {(i, i % 10) for i in range(20)} | {(103, 0), (105, 9)}
    assert 0.8 <= found[105, 9] < 1
    assert {r.doc_id for r in simhash_decon.clean_of(d, b).collect()} == {100, 101, 102, 104}
    assert simhash_decon.contaminated(d, b.limit(0)).count() == 0
    assert simhash_decon.contaminated(d.limit(0), b).count() == 0


def best_windows(docs, items):
    """{(doc_id, item_id): (similarity, start)} over every start of every document."""
    words = lambda text: [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    grams = lambda w: [" ".join(w[k : k + 5]) for k in range(len(w) - 4)]
    best = {}
    for d, text in docs:
        w, all_grams = words(text), grams(words(text))
        for i, passage in items:
            own = Counter(grams(words(passage)))
            size = own.total()
            for start in range(max(1, len(all_grams) - size + 1) if own and all_grams else 0):
                part = Counter(all_grams[start : start + size])
                shared = (own & part).total()
                similarity = shared / (size + part.total() - shared)
                if similarity >= 0.8 and (-similarity, start) < best.get((d, i), (0, 0)):
                    best[d, i] = (-similarity, start)
    return {k: (round(-s, 6), start) for k, (s, start) in best.items()}


def test_windows_start_at_every_place(spark):
    # Passages with words put in, left out and changed, at both ends of the text and twice in it;
    # items that repeat themselves, share a beginning, or have one shingle.
    rng = np.random.default_rng(41)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    noise = lambda n: [word() for _ in range(n)]
    shared = noise(12)
    passages = [noise(int(n)) for n in rng.integers(5, 90, 24)] + [shared + noise(n) for n in (30, 45)]
    passages += [noise(6) * 8, ["a", "b"] * 20, noise(5), noise(80)]
    items = [(i, " ".join(p)) for i, p in enumerate(passages)]
    docs = []
    for _ in range(400):
        p = list(passages[int(rng.integers(len(passages)))])
        for _ in range(int(rng.integers(0, 4))):
            at = int(rng.integers(len(p) + 1))
            p = p[:at] + [noise(int(rng.integers(1, 4))), [], noise(1)][int(rng.integers(3))] + p[at + int(rng.integers(0, 2)) :]
        again = p if rng.random() < 0.1 else []
        before, behind = (noise(int(n)) for n in rng.integers(0, 60, 2) * rng.integers(0, 2, 2))
        docs.append((len(docs), " ".join([*before, *p, *behind, *again])))
    # Two words before the rarest shingles move the passage from where these would place it.
    moved = passages[-1]
    docs.append((900, " ".join([*moved[:4], *noise(3), *moved[4:], *noise(40)])))
    expected = best_windows(docs, items)
    assert len(expected) > 150
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    found = simhash_decon.contaminated(d, b).collect()
    assert {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in found} == expected


def test_a_window_at_the_threshold_keeps_the_firm_bits(spark):
    rng = np.random.default_rng(6)
    shingles = [[f"s{k}" for k in rng.integers(0, 10**6, n)] for n in rng.integers(1, 60, 150)]
    rows = []
    for own in shingles:
        size = len(own)
        changed = int(size / 9)
        rows.append((own, [f"t{k}" for k in range(changed)] + own[changed:]))
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    unshared = F.floor(F.size("a") * 2 / 9 + 1e-9)
    for name, side, margin in [("least", "a", unshared), ("most", "a", -unshared), ("mark", "b", F.lit(0))]:
        df = simhash_decon.with_simhash(df, side, name, margin)
    got = df.select("least", "most", "mark").collect()
    assert all(r.least & ~r.mark == 0 and r.mark & ~r.most == 0 for r in got)
    assert any(r.least for r in got) and any(r.most != -1 for r in got)


def test_every_pair_within_the_radius_shares_a_block(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(200):
        a = int(rng.integers(-(2**63), 2**63 - 1))
        b = a
        for bit in rng.choice(64, simhash_decon.RADIUS, replace=False).tolist():
            b ^= -(1 << 63) if bit == 63 else 1 << bit
        rows.append((a, b))
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    shared = F.arrays_overlap(simhash_decon.blocks_of("a"), simhash_decon.blocks_of("b"))
    assert df.filter(~shared).count() == 0


# --- near copies ------------------------------------------------------------


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(docs):
    marks = [(d, slow_fingerprint(t)) for d, t in docs]
    distinct = sorted({m for _, m in marks})
    root = {m: m for m in distinct}

    def find(m):
        while root[m] != m:
            m = root[m]
        return m

    for a, b in combinations(distinct, 2):
        if bin(a ^ b).count("1") <= 3:
            root[find(a)] = find(b)
    smallest = {}
    for d, m in marks:
        smallest[find(m)] = min(d, smallest.get(find(m), d))
    return {d: (f"{m:016x}", smallest[find(m)]) for d, m in marks}


def test_near_copies_match_brute_force(small):
    docs = [(r.doc_id, r.text) for r in small["documents"].collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.near_copy_report(small["documents"]).collect()}
    assert got == brute_components(docs)


@pytest.mark.parametrize("part_rows, bucket_rows", [(2, 8), (1024, 1e-4), (3, 1e-9)])
def test_links_by_any_tables_and_cells(spark, monkeypatch, part_rows, bucket_rows):
    """Small cells and more tables give the same components."""
    monkeypatch.setattr(simhash_dedup, "PART_ROWS", part_rows)
    monkeypatch.setattr(simhash_dedup, "BUCKET_ROWS", bucket_rows)
    rng = np.random.default_rng(6)
    marks = {int(m) for m in rng.integers(-(2**63), 2**63 - 1, 40)}
    for m in list(marks)[:12]:
        for _ in range(6):
            for bit in rng.choice(63, rng.integers(1, 5), replace=False).tolist():
                m ^= 1 << bit
            marks.add(m)
    marks = sorted(marks)
    edges = [(a, b) for a, b in combinations(marks, 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= 3]
    label = {m: m for m in marks}
    for _ in marks:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame([(m,) for m in marks], "fp bigint")
    got = {r.node: r.label for r in simhash_dedup.components(simhash_dedup.links(df)).collect()}
    assert {m: got.get(m, m) for m in marks} == label


def test_bit_planes_find_exactly_the_close_pairs():
    rng = np.random.default_rng(7)
    values = rng.integers(0, 2**63, 300).astype(np.uint64)
    values[1::2] = values[::2] ^ (np.uint64(1) << rng.integers(0, 63, 150).astype(np.uint64))
    sizes = np.array([1, 70, 3, 130, 96])
    starts = np.cumsum(sizes) - sizes
    later, earlier = simhash_dedup.close_pairs(values, starts, sizes)
    want = {
        (j, i)
        for s, n in zip(starts, sizes)
        for i, j in combinations(range(s, s + n), 2)
        if bin(int(values[i] ^ values[j])).count("1") <= 3
    }
    assert set(zip(later.tolist(), earlier.tolist())) == want


def test_one_document_of_each_group_stays(spark, odd):
    kept = simhash_dedup.one_of_each(odd)
    assert kept.columns == odd.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(rows) == len(set(rows))
    assert {r[0] for r in rows} == {1, 4, 5, None}


def test_near_copies_with_null_ids_leave_one(spark):
    words = [f"w{k}" for k in range(2000)]
    texts = [" ".join([*words, *more]) for more in ([], ["end"], ["other"])]
    marks = [slow_fingerprint(t) for t in texts]
    assert len(set(marks)) > 1 and all(bin(marks[0] ^ m).count("1") <= 3 for m in marks)
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id bigint, text string")
    assert simhash_dedup.one_of_each(docs).count() == 1


def test_the_stage_keeps_the_smallest_id_of_each_component(spark, small):
    rows = [(r.doc_id, r.text) for r in small["documents"].collect()]
    words = [f"w{k}" for k in range(2000)]
    rows += [(1000 + k, " ".join([*words, f"end{k}"])) for k in range(4)]
    rows += [(2001, "Few  words"), (2000, "few words"), (2003, ""), (2002, None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], schema)
    groups = brute_components(rows)
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    kept = stage(spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d in groups if groups[d][1] == d}


# --- awkward input and the pipeline -----------------------------------------

BY_DOCUMENT = {
    "shards": kk_shards.shard_documents,
    "repeats": line_dedup.repeated_units,
    "language": language_gru.language_report,
    "tokens": chunk_bpe.encoding_report,
    "near copies": simhash_dedup.near_copy_report,
}


@pytest.mark.parametrize("name", sorted(BY_DOCUMENT))
def test_odd_and_empty_documents(name, odd, nothing):
    rows = BY_DOCUMENT[name](odd).collect()
    if name != "repeats":
        assert len(rows) == len(ODD)
    assert BY_DOCUMENT[name](nothing).count() == 0


def test_odd_documents_in_every_stage(spark, small, odd, nothing):
    for docs in (odd, nothing):
        for step, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SMALL)
            if step < 4:
                assert out.columns == docs.columns and out.dtypes == docs.dtypes
            rows = out.collect()
            assert len(rows) <= len(ODD)


def test_quality_without_labels(spark, small, odd):
    rows = quality_qda.quality_report(odd, small["labels"].limit(0)).collect()
    assert len(rows) == len(ODD) and {r.score for r in rows} == {0.5}


def test_pipeline_matches_its_stages_by_hand(spark, small):
    """Brute force for the stages with exact rules, on the rows the classifier keeps."""
    docs = quality_qda.accepted(small["documents"], small["labels"])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    groups = brute_components(rows)
    rows = [(d, t) for d, t in rows if groups[d][1] == d]
    cuts = defaultdict(list)
    for doc, start, size, *_ in brute_repeats(rows):
        cuts[doc].append((start, size))
    rows = [(d, line_dedup.without_spans(t, cuts[d])) for d, t in rows]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    leaks = {r.doc_id for r in simhash_decon.contaminated(frame, small["benchmark"]).collect()}
    words = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [words(r.text) for r in small["benchmark"].collect()]
    assert {d for d, t in rows if any(i in words(t) for i in items)} <= leaks
    encoder = chunk_bpe.Encoder(chunk_bpe.vocabulary_path())
    want = {(d, by_library(encoder, t)[0]) for d, t in rows if d not in leaks}
    assert {(r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, SMALL).collect()} == want
    assert common.table(spark, SMALL, "documents").count() > len(want) > 100
