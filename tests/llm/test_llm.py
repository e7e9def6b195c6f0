"""The training-data operators against brute force, round trips and held-out accuracy."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import chat, classlm, decontaminate, htmltext, jaccard, linededup, mixing, ordermin, quality, queries, simhash, tokencount
from lodestone.llm.common import batches_of, connected_components
from oracle import assert_same

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id int, size string, _twin int, fp int"
SPLIT = r"[^\x20\x09-\x0D]+"


def docs_of(spark, rows):
    """Rows (doc_id, text, source) with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, None, s, None, 1, "x", 2, 3) for i, t, s in rows], DOCS)


@pytest.fixture
def odd(spark):
    """Nulls, empty and long texts, ties and repeated rows."""
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    return docs_of(spark, [(1, None, None), (None, "a b c", "x"), (2, "", "x"), (3, long, "y"), (3, long, "y"), (4, long + " tail", "y"), (4, "other text here", None), (5, " \n\t", "é")])


@pytest.fixture
def none(spark):
    return docs_of(spark, []).limit(0)


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name])


# --- 1 ------------------------------------------------------------------------


def components_of(prints, ids, bits=4):
    parent = {i: i for i in range(len(prints))}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= bits:
                parent[root(i)] = root(j)
    low = defaultdict(list)
    for i in range(len(prints)):
        low[root(i)].append(ids[i])
    return [min((x for x in low[root(i)] if x is not None), default=None) for i in range(len(prints))]


def plain_simhash(text, width=4):
    words = re.findall(SPLIT, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@needs_data
def test_simhash_groups(spark):
    got = queries.QUERIES["op1_simhash_near_dedup"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{plain_simhash(t):016x}" for i, t in texts.items()}
    assert [r["component_id"] for r in got] == components_of([int(r["fingerprint"], 16) for r in got], [r["doc_id"] for r in got])


def test_crowded_lists_lose_no_link(spark):
    rng = random.Random(3)
    prints = []
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            x = base
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            prints.append(x - (1 << 64) if x >> 63 else x)
    prints = sorted(set(prints))
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    expected = {p: c for p, c in zip(prints, components_of(prints, prints), strict=True)}
    for block in (1, 5, 1024):
        roots = {r["node"]: r["root"] for r in connected_components(simhash.near_links(frame, 4, block)).collect()}
        assert {p: roots.get(p, p) for p in prints} == expected


@pytest.mark.parametrize(("matches", "width"), [(4, 4), (4, 3), (6, 4), (1, 1)])
def test_covering_serves_all(matches, width):
    from itertools import combinations

    sets = simhash.covering(matches, width)
    assert all(any(set(s) <= set(x) for s in sets) for x in combinations(range(8), matches))


@pytest.mark.parametrize("size", [2, 7, 8, 9, 17])
def test_lists_around_a_block(spark, size):
    """All fingerprints agree in four bytes, in lists just under, at and over the block's size."""
    rng = random.Random(size)
    prints = sorted({0x0102030400000000 | sum(1 << rng.randrange(32) for _ in range(rng.randint(0, 3))) for _ in range(4 * size)})[:size]
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    roots = {r["node"]: r["root"] for r in connected_components(simhash.near_links(frame, 4, 8)).collect()}
    assert {p: roots.get(p, p) for p in prints} == dict(zip(prints, components_of(prints, prints), strict=True))


def test_groups_without_ids(spark):
    """Near copies some or all of which have no id; ids at the ends of their range."""
    rows = docs_of(spark, [(None, "a b c", "x"), (None, "a b c", "x"), (2**63 - 1, "d e f", "x"), (None, "d e f", "x"), (-(2**63), "g h", "x")])
    got = sorted(((r["id"], r["component_id"]) for r in simhash.near_groups(rows).collect()), key=str)
    assert got == sorted([(None, None), (None, None), (2**63 - 1, 2**63 - 1), (None, 2**63 - 1), (-(2**63), -(2**63))], key=str)
    assert simhash.keep_first(rows).count() == 3


def test_components_of_a_chain_and_loops(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(99, 99), (None, 5)], "a long, b long")
    assert {r["node"]: r["root"] for r in connected_components(edges).collect()} == {i: 0 for i in range(41)} | {99: 99}
    assert connected_components(edges.limit(0)).count() == 0


def test_edges_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        made.add(1)
        return x

    counted = counted.asNondeterministic()  # or a filter has a call of its own
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long").select(counted("a").alias("a"), "b")
    assert connected_components(edges).where("root = 0").count() == 41
    assert made.value == 40


def test_plan_of_the_index_is_small(spark, monkeypatch):
    """The driver holds the plan: it must not grow with the number of sets of positions, of which there are 70."""
    plans, cut = [], simhash.cut_lineage
    monkeypatch.setattr(simhash, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution()) or cut(df))
    frame = spark.createDataFrame([(0,), (1,), (-1,), (1 << 40,)], "fp long")
    roots = {r["node"]: r["root"] for r in connected_components(simhash.near_links(frame)).collect()}
    assert roots == {0: 0, 1: 0, 1 << 40: 0}
    assert len(plans) == 1 and len(plans[0].analyzed().toString()) < 6000 and len(plans[0].optimizedPlan().toString()) < 6000


def test_posting_lists_are_not_broadcast(spark, monkeypatch):
    """Few fingerprints by size, but 70 rows each: the driver can't hold them."""
    plans, cut = [], simhash.cut_lineage
    monkeypatch.setattr(simhash, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution()) or cut(df))
    assert simhash.near_links(spark.range(300).select(F.col("id").alias("fp"))).count() > 0
    text = plans[0].executedPlan().toString()
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text


def test_simhash_odd(spark, odd, none):
    got = simhash.near_groups(odd).collect()
    assert len(got) == 8 and {r["fp"] for r in got if r["id"] in (1, 2, 5)} == {0}
    assert {r["component_id"] for r in got if r["id"] in (1, 2, 5)} == {1}
    kept = sorted((r["doc_id"], r["text"] and len(r["text"])) for r in simhash.keep_first(odd).where("doc_id is not null").collect())
    assert [k[0] for k in kept] == [1, 3, 4]
    assert simhash.near_groups(none).count() == 0 and simhash.keep_first(none).count() == 0


# --- 2 ------------------------------------------------------------------------


def test_token_counts_equal_the_library():
    tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), tokencount.merger(Path(path).read_bytes())
    rng = random.Random(1)
    alphabet = " ▁ \n\t aaabcdeétheing<s>0123\x00你好ﬁ☃🙂    ...,,,-----====____"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += ["".join(rng.choice(list(own.score)) for _ in range(12)) for _ in range(500)]
    texts += ["", " ", " " * 500, "a" * 5000, "<s>x</s> <unk>", None]
    assert own.count(texts) == [len(library.encode(t or "")) for t in texts]


@needs_data
def test_token_counts_of_documents(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in queries.QUERIES["op2_token_counts"](spark, SF).collect()}
    assert got == {i: (len(t.encode()), len(library.encode(t))) for i, t in texts.items()}


def test_token_count_odd(spark, odd, none):
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("piece_bpe_32k.model")
    got = {(r["doc_id"], r["n_bytes"]): r for r in tokencount.count_tokens(odd, path).collect()}
    assert got[1, 0]["n_tokens"] == 0 and got[2, 0]["over_limit"] is False
    assert any(r["over_limit"] for r in got.values()) and tokencount.count_tokens(none, path).count() == 0


# --- 3 ------------------------------------------------------------------------


class Forgetful(chat.MarkedTurns):
    """Drops what stands before </think> in all but the last turn, as some templates do."""

    def render(self, turns):
        cut = [(r, t.rpartition("</think>")[2] if k < len(turns) - 1 else t) for k, (r, t) in enumerate(turns)]
        return super().render(cut)


def test_spans_and_history():
    turns = [("user", "a <|im_end|> \\ b"), ("assistant", "<think>x</think>yes"), ("user", ""), ("assistant", "no")]
    plain = chat.MarkedTurns()
    text, places, rewrites = chat.render_incrementally(plain, turns)
    assert not rewrites and plain.parse(text) == turns and [plain.unescape(text[a:b]) for a, b in places] == [t for _, t in turns]
    assert text.count(chat.END) == 4
    text, places, rewrites = chat.render_incrementally(Forgetful(), turns)
    assert rewrites and text[slice(*places[3])] == "no" and text[slice(*places[0])] == plain.escape(turns[0][1])
    assert places[1] is None or text[slice(*places[1])] == "yes"


@pytest.mark.parametrize("text", ["", "\\", "\\n", "<|", "<\\|", "<|im_start|>assistant\n", "é🙂\n\\\\<|im_end|>"])
def test_escapes_round_trip(text):
    plain = chat.MarkedTurns()
    assert plain.parse(plain.render([(text, text), ("user", text)])) == [(text, text), ("user", text)]


def test_chat_odd(spark):
    rows = spark.createDataFrame([(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (2, None, None, None), (None, 0, "assistant", "z"), (3, 0, "assistant", None)], "conv_id long, turn long, role string, text string")
    template = chat.MarkedTurns()
    got = {r["conv_id"]: r for r in chat.digest(chat.format_conversations(rows, template), template).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[1]["loss_sha256"]) == (3, 2, sha("bb")) and got[1]["turns_sha256"] == sha("user\na\nassistant\nb\nassistant\nb\n")
    assert got[2]["turns_sha256"] == sha("\n\n") and got[3]["loss_sha256"] == sha("") and got[None]["loss_chars"] == 1
    assert chat.format_conversations(rows.limit(0), template).count() == 0


# --- 4 ------------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    weigh = {s: weights[k % len(weights)] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, free, out = share * sum(sizes.values()), set(sizes), {}
    while free:
        level = left / sum(weigh[s] for s in free)
        over = {s for s in free if most * sizes[s] < level * weigh[s]}
        if not over:
            return out | {s: level * weigh[s] for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


@needs_data
def test_mix_meets_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    got = queries.QUERIES["op4_mix_sources"](spark, SF).collect()
    assert {r["doc_id"]: r["size"] for r in got} == {r["doc_id"]: len(re.findall(SPLIT, r["text"] or "")) for r in docs.collect()}
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    targets = plain_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[source[r["doc_id"]]] and math.isclose(r["target"], targets[source[r["doc_id"]]])
    assert all(abs(taken[s] - t) <= 0.01 * t + 2 for s, t in targets.items())
    again = queries.QUERIES["op4_mix_sources"](spark, SF).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_mix_odd(spark, odd, none):
    got = mixing.taken_words(odd).collect()
    assert len(got) == 8 and all(r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(r["size"] for r in got) == [0, 0, 0, 3, 3, 30000, 30000, 30001]
    assert mixing.taken_words(none).count() == 0
    whole = mixing.mix_documents(odd)
    assert whole.count() == 8 and whole.agg(F.sum("taken")).first()[0] == sum(r["taken"] for r in got)


# --- 5 ------------------------------------------------------------------------


def one_edit(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_dedup(texts):
    seen, out = [], {}
    for doc in sorted(texts):
        kept = []
        for line in texts[doc].split("\n"):
            if not re.search(SPLIT, line):
                kept.append(line)
                continue
            near = any(abs(len(x) - len(line)) < 2 and one_edit(x, line) for x in seen)
            seen.append(line)
            if not near:
                kept.append(line)
        out[doc] = "\n".join(kept)
    return out


def test_lines_within_one_edit(spark):
    rng = random.Random(5)
    lines = []
    for _ in range(40):
        base = "".join(rng.choice("abcé ") for _ in range(rng.choice((0, 1, 2, 3, 5, 11, 18, 19, 20, 21, 63, 64, 65, 127, 128, 129, 200)))) + "z"
        lines.append(base)
        for _ in range(3):
            at, kind = rng.randrange(len(base)), rng.randrange(3)
            lines.append(base[:at] + ("" if kind == 0 else rng.choice("xy")) + base[at + (kind != 2) :])
        lines.append(base[:3] + "XXY" + base[5:])
    rng.shuffle(lines)
    texts = {k: "\n".join(lines[k * 4 : k * 4 + 4] + ["", " "]) for k in range(len(lines) // 4)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in linededup.dedup_lines(frame).collect()} == plain_dedup(texts)


@needs_data
def test_line_dedup_of_documents(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["doc_id"]: r["text"] for r in queries.QUERIES["op5_line_dedup"](spark, SF).collect()} == plain_dedup(rows)


def test_line_dedup_odd(spark, odd, none):
    got = linededup.dedup_lines(odd).collect()
    assert len(got) == 8 and next(r for r in got if r["doc_id"] == 1)["text"] is None
    assert {r["text"] for r in got if r["doc_id"] == 5} == {" \n\t"} and linededup.dedup_lines(none).count() == 0
    assert len({r["text"] for r in got if r["doc_id"] == 3}) == 1


# --- 6 ------------------------------------------------------------------------


@needs_data
def test_pages(spark):
    from html import unescape

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.QUERIES["op6_html_text"](spark, SF).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        expected = " ".join(unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?[ab]\b[^>]*>", "", inner))).split())
        assert (r["text"], r["n_chars"]) == (expected, len(expected))


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("<", "<"), ("plain &amp; text", "plain & text"), ("<p>Hello <b>wor</b>ld</p><p>x &lt; y</p>", "Hello world x < y"),
    ('<body class="has-sidebar"><div class="sidebar-layout"><article><header>h</header><h1>T</h1><p>One two three</p><div class="ad">buy</div><p>four</p><section class="comments"><article><p>nice one</p></article></section></article></div>', "T One two three four"),
    ('<div id="cookieNotice">We use</div><div class="content"><p>a b c d</p></div><div class="related-posts"><a>foo</a></div><form>send</form>', "a b c d"),
    ("<main><p>a <a href=x>b</a> c</p><aside>no</aside><script>var x='<p>'</script><p>d</p></main><p>tail words</p>", "a b c d"),
    ("<article><ul><li>x</li><li>y</li></ul></article><article><p>teaser</p></article>", "x y"), ("<nav><a>x</a></nav>", ""), ("<p style='display:none'>no</p><p>yes</p>", "yes"),
    ("<article><p>a b c d</p><section id='discussion'><p>so it holds</p></section><p class='legal-history'>law</p><div class='search-engine-history'>web</div></article>", "a b c d so it holds law web"),
    ("<article><p title=it's>one two</p><p>three don't <a href=x'y>four</a></p></article>", "one two three don't four"), ("<article><p>buy these</p><ul><li>eggs</li><li>milk</li></ul></article><ul><li>x</li></ul>", "buy these eggs milk"),
    ("<div class='ad-box'>buy</div><div class='sidebar-layout'><p>One two three four five.</p><p>Six.</p></div><p><a href=x>Next</a></p>", "One two three four five. Six."), ("a < b <3 <", "a < b <3 <"), ("<p>x<!-- <p>no", "x"), ("<p data-x='>'>a b c</p", "a b c"),
])
def test_main_text(html, text):
    assert htmltext.extract(html) == text


@needs_data
def test_pages_without_article(spark):
    """With the article's element renamed, nearly all pages still give the same text."""
    wrong = n = 0
    for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet").collect():
        expected = htmltext.extract(r["html"])
        for name in ("div", "section", "td"):
            n += 1
            wrong += htmltext.extract(r["html"].replace("<article>", f"<{name}>").replace("</article>", f"</{name}>")) != expected
    assert wrong <= 0.02 * n


@pytest.mark.parametrize(("html", "text"), [
    ("<div>" * 10_000 + "<article>hello world</article>", "hello world"), ("</b>" * 100_000 + "<p>some text here</p>", "some text here"), ("<p>" + "</div>" * 100_000 + "some text", "some text"),
    ("<!--" * 100_000, ""), ("<a " * 100_000, ""), ("<" * 1000, "<" * 1000), ("<a b='" * 50_000, ""), ("<article><b>" * 2000 + "x y", "x y"),
])
def test_broken_pages_take_seconds(html, text):
    from time import process_time

    began = process_time()
    assert htmltext.extract(html) == text and process_time() - began < 5


def test_pages_odd(spark):
    rows = spark.createDataFrame([(1, None, None, "clash"), (1, None, None, "clash"), (2, "u", "<p>" * 5000 + "deep", "x")], "page_id long, url string, html string, text string")
    assert sorted((r["page_id"], r["text"]) for r in htmltext.extract_pages(rows).collect()) == [(1, ""), (1, ""), (2, "deep")]
    assert htmltext.extract_pages(rows.limit(0)).count() == 0


# --- 7 ------------------------------------------------------------------------


@needs_data
def test_edited_texts_and_fingerprints(spark):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_fingerprints"](spark, SF).collect()}
    prints = defaultdict(set)
    for k, (i, text) in enumerate(docs):
        n = len(text)
        edited = text[: n - n // 3] + docs[(k + 1) % len(docs)][1][: n // 3]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        prints[text].add(got[i]["fingerprint"])
        assert 0 <= got[i]["near_edited"] <= 1
    assert all(len(x) == 1 for x in prints.values())
    near = np.mean([r["near_edited"] for r in got.values()])
    assert near > 0.2 and np.mean([r["near_next"] for r in got.values()]) < 0.05


def plain_signature(text):
    """The Order MinHash codes of a text, from their definition."""
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    def hash_longs(values, seed=42):
        for v in values:
            seed = xxhash.xxh64_intdigest(int(v % 2**64).to_bytes(8, "little"), seed)
        return wrap(seed)

    words = [wrap(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.findall(SPLIT, text)]
    mers = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    low = (1 << 24) - 1
    coded = sorted((hash_longs(m) & ~low) | i for i, m in enumerate(mers))
    seen, numbered = Counter(), []
    for v in coded:
        n = seen[v >> 24]
        seen[v >> 24] += 1
        numbered.append(v if n == 0 else (hash_spark(v >> 24, n) & ~low) | (v & low))
    ranges = defaultdict(list)
    for v in sorted(numbered):
        ranges[v >> 58].append(v)
    out = []
    for r in sorted(ranges):
        least = sorted((x & low, x >> 24) for x in ranges[r][:2])
        held = [(x >> 0) & ((1 << 40) - 1) for _, x in least]
        out.append(wrap(((hash_longs(held) % 2**64) >> 6) | ((r % 64) << 58)))
    return out


def hash_spark(a, n):
    """Spark's xxhash64 of a long and an int."""
    h = xxhash.xxh64_intdigest(int(a % 2**64).to_bytes(8, "little"), 42)
    h = xxhash.xxh64_intdigest(int(n).to_bytes(4, "little"), h)
    return (h + 2**63) % 2**64 - 2**63


def test_signature_equals_its_definition(spark):
    rng = random.Random(12)
    texts = ["", "one", "one two", " \n"] + [" ".join(f"w{rng.randrange(k)}" for _ in range(rng.randint(1, 400))) for k in (2, 3, 30, 4000) for _ in range(4)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string").select("k", ordermin.signature(F.col("text")).alias("s"), ordermin.likeness(ordermin.signature(F.col("text")), ordermin.signature(F.lit(texts[-1]))).alias("like")).collect()
    last = plain_signature(texts[-1])
    for r in rows:
        own = plain_signature(texts[r["k"]])
        assert r["s"] == own
        either = {x >> 58 for x in own} | {x >> 58 for x in last}
        assert math.isclose(r["like"], len(set(own) & set(last)) / len(either))


def test_order_and_repeats_matter(spark):
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(words), " ".join(words[150:] + words[:150]), " ".join(words) + " w0 w1 w2", " ".join(words * 3), "", "one", "  one ", "\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string").select("k", ordermin.signature(F.col("text")).alias("s")).collect()
    s = {r["k"]: r["s"] for r in rows}
    same = lambda a, b: len(set(s[a]) & set(s[b])) / max(1, len({x >> 58 for x in s[a] + s[b]}))
    assert same(0, 2) > 0.8 and 0.1 < same(0, 1) < same(0, 2) and s[3] != s[0] and s[4] == s[7] == [] and s[5] == s[6]


def test_fingerprints_odd(spark, odd, none):
    hashed = random.Random(3)
    ids = [None] * 9 + [7] * 12 + [hashed.randrange(-(2**63), 2**63) for _ in range(30)] + list(range(100, 110))
    words = [(i, " ".join(f"w{hashed.randrange(9)}" for _ in range(hashed.randrange(9)))) for i in ids]
    frame = spark.createDataFrame(words, "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    ordered = [(r["doc_id"], r["text"]) for r in frame.orderBy(F.col("doc_id").desc(), "h").collect()]
    expected = Counter()
    for k, (i, text) in enumerate(ordered):
        n = len(text)
        expected[i, hashlib.sha256((text[: n - n // 3] + ordered[(k + 1) % len(ordered)][1][: n // 3]).encode()).hexdigest()] += 1
    for stretch in (1, 4, 1024):
        assert Counter((r["id"], r["edited_sha256"]) for r in ordermin.fingerprints(frame, stretch=stretch).collect()) == expected
    nothing = frame.withColumn("doc_id", F.lit(None).cast("long"))
    assert len({(r["_b"], r["_s"]) for r in ordermin.in_stretches(nothing.select(F.col("doc_id").alias("id"), "text"), 4).collect()}) > 5
    got = ordermin.fingerprints(odd).collect()
    assert len(got) == 8 and {r["fingerprint"] for r in got if r["id"] in (1, 2, 5)} == {""}
    assert len({r["fingerprint"] for r in got if r["id"] == 3}) == 1 and ordermin.fingerprints(none).count() == 0
    sparse = spark.createDataFrame([(i * 10**7, f"text {i} a b c") for i in range(8)], "doc_id long, text string")
    for r in ordermin.fingerprints(sparse).collect():
        i, n = r["id"] // 10**7, len(f"text {r['id'] // 10**7} a b c")
        edited = f"text {i} a b c"[: n - n // 3] + f"text {(i - 1) % 8} a b c"[: n // 3]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


# --- 8 ------------------------------------------------------------------------


def plain_tiles(item, doc, least):
    marked_i, marked_d, tiles = set(), set(), []
    while True:
        best = None
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and i + n not in marked_i and d + n not in marked_d:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, d, n)
        if best is None:
            return tiles
        tiles.append(best)
        marked_i.update(range(best[0], best[0] + best[2]))
        marked_d.update(range(best[1], best[1] + best[2]))


def test_tiles_equal_brute_force():
    rng = random.Random(7)
    for k in range(150):
        item, doc = [rng.choice("abc"[: 1 + k % 3]) for _ in range(rng.randint(0, 25))], [rng.choice("abc"[: 1 + k % 3]) for _ in range(rng.randint(0, 40))]
        numbers = [np.array([ord(c) for c in x], np.int64) for x in (item, doc)]
        assert decontaminate.tile(*numbers, 3) == plain_tiles(item, doc, 3)


def test_repetitive_texts_take_seconds():
    from time import process_time

    began = process_time()
    assert decontaminate.tile(np.zeros(300, np.int64), np.zeros(1_000_000, np.int64), 5) == [(0, 0, 300)]
    two = np.arange(1_000_000) % 2
    assert decontaminate.tile(np.arange(301) % 2, two, 5) == [(0, 0, 301)]
    assert process_time() - began < 20


def test_short_items_mark_nothing(spark, odd, none):
    items = spark.createDataFrame([(1, "yes"), (2, "a b c"), (3, "w1 w2 w3 w4 w5 w6"), (3, "w1 w2 w3 w4 w5 w6"), (None, "other text here but longer than that")], "item_id long, text string")
    got = sorted((r["id"], r["item_id"], r["covered_tokens"]) for r in decontaminate.contamination(odd, items).collect())
    assert got == [(3, 3, 6)] * 4 + [(4, 3, 6)] * 2
    kept = decontaminate.drop_contaminated(odd, items)
    assert kept.columns == odd.columns and sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, "a b c"), (1, ""), (2, ""), (4, "other text here"), (5, " \n\t")]
    assert decontaminate.drop_contaminated(none, items).count() == 0 and decontaminate.drop_contaminated(odd, items.limit(0)).count() == 8


def test_reordered_passages(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(5000)}" for _ in range(60)]
    item = " ".join(words)
    texts = {1: f"start {item} end", 2: " ".join(words[30:] + ["x"] + words[:30]).upper(), 3: " ".join(words[:20]) + " nothing", 4: None, 5: " ".join(reversed(words)), 6: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = spark.createDataFrame([(9, item), (10, None), (11, ""), (12, "tiny one")], "item_id long, text string")
    for bits in (26, 7):
        got = decontaminate.contamination(docs, items, map_bits=bits)
        assert sorted((r["id"], r["item_id"], r["covered_tokens"], r["tiles"]) for r in got.collect()) == [(1, 9, 60, 1), (2, 9, 60, 2)]
    assert sorted(r[0] for r in decontaminate.drop_contaminated(docs, items).select("doc_id").collect()) == [3, 4, 5, 6]
    assert decontaminate.contamination(docs, items.limit(0)).count() == 0 and decontaminate.contamination(docs.limit(0), items).count() == 0


@needs_data
def test_leaks_equal_brute_force(spark):
    items = {r["item_id"]: decontaminate.tokens(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op8_decontaminate"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        said = decontaminate.tokens(r["text"])
        shingles = {tuple(said[i : i + 5]) for i in range(len(said) - 4)}
        for k, x in items.items():
            if any(tuple(x[i : i + 5]) in shingles for i in range(len(x) - 4)):
                assert (sum(t[2] for t in plain_tiles(x, said, 5)) >= 0.5 * len(x)) == ((r["doc_id"], k) in got)
            else:
                assert (r["doc_id"], k) not in got


# --- 9 ------------------------------------------------------------------------


@needs_data
def test_language_model(spark):
    texts = {r["doc_id"]: re.findall(SPLIT, "".join(c.lower() if c.isascii() else c for c in r["text"] or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i, ws in texts.items() if not out[i] for w in [*ws, ""])
    n, v = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_lm_scores"](spark, SF).collect()}
    held = [0.0, 0.0]
    for i, ws in texts.items():
        r, tokens = got[i], [*ws, ""]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)
        if out[i]:
            held[0] += r["base_score"]
            held[1] += r["score"]
    assert held[1] > held[0]


@pytest.mark.parametrize("head_words", [0, 6, 1000])
def test_class_model_equals_brute_force(spark, head_words):
    """Counts, transitions, classes of words outside the head and scores, from plain loops over the texts; probabilities sum to 1."""
    rng = random.Random(11)
    texts = [" ".join(f"{rng.choice('ab')}{min(rng.randrange(12), rng.randrange(12))}" for _ in range(rng.randint(0, 30))) for _ in range(40)]
    held = [k % 5 == 0 for k in range(40)]
    texts[0] += " never seen"
    rows = spark.createDataFrame(list(zip(range(40), held, texts, strict=True)), "id long, held_out boolean, text string")
    said = [t.split() for t in texts]
    counts = Counter(w for k, ws in enumerate(said) for w in ws if not held[k])
    sha = {w: int(np.array([xxhash.xxh64_intdigest(w.encode(), 42)], np.uint64).view(np.int64)[0]) for ws in said for w in ws}
    head = classlm.head_of(spark.createDataFrame([(sha[w], n) for w, n in counts.items()], "h long, n long"), head_words)
    encoded = classlm.encoded_rows(rows, head)
    m = classlm.fit(encoded, head, held.count(False), classes=5, seeds=4)
    rare = {r["h"]: (r["n"], r["cls"]) for r in m.rare.collect()}
    in_head = {w: k for w in counts for k in np.flatnonzero(head.hashes == sha[w]).tolist()}
    assert len(in_head) <= head_words and {w: rare[sha[w]][0] for w in counts if w not in in_head} == {w: n for w, n in counts.items() if w not in in_head}
    cls = lambda w: 4 if w == "" else int(m.of[in_head[w]]) if w in in_head else rare.get(sha[w], (0, 3))[1]
    ctx = lambda w: 4 if w == "" else int(m.of[in_head[w]]) if w in in_head else 3
    pairs, of_ctx = np.zeros((5, 5)), defaultdict(Counter)
    blind = np.zeros((5, 5))  # as the classes of words outside the head are chosen: they count as unknown
    for k, ws in enumerate(said):
        for a, b in zip(["", *ws], [*ws, ""], strict=True):
            if not held[k]:
                pairs[ctx(a), cls(b)] += 1
                blind[ctx(a), ctx(b)] += 1
                of_ctx[b][ctx(a)] += 1
    n = Counter({"": held.count(False)}) + counts
    room = [sum(n[w] + 1 for w in n if cls(w) == c) + (c == 3) for c in range(5)]
    sizes = [max(1, sum(counts[w] for w in in_head if cls(w) == c)) for c in range(5)]
    for w in counts:
        if w not in in_head:
            weigh = [sum(x * math.log10((blind[a, c] + 0.5) / (blind[a].sum() + 2.5) / sizes[c]) for a, x in of_ctx[w].items()) for c in range(3)]
            assert weigh[cls(w)] >= max(weigh) - 1e-9
    move = np.log10((pairs + 0.5) / (pairs.sum(1, keepdims=True) + 2.5))
    for r in classlm.scored(encoded, m).collect():
        ws = said[r["id"]]
        expected = sum(move[ctx(a), cls(b)] + math.log10((n[b] + 1) / room[cls(b)]) for a, b in zip(["", *ws], [*ws, ""], strict=True))
        assert math.isclose(r["score"], expected, rel_tol=1e-9) and r["held_out"] == held[r["id"]]
    every = sum(10 ** move[0, cls(w)] * (n[w] + 1) / room[cls(w)] for w in n) + 10 ** move[0, 3] / room[3]
    empty = sum(10 ** move[0, c] for c in range(5) if room[c] == 0)
    assert math.isclose(every + empty, 1)


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(1)
    pairs = np.zeros((22, 22))
    for _ in range(4000):
        a = rng.integers(20)
        pairs[a, rng.integers(10) + (10 if a < 10 else 0)] += 1
    of = classlm.exchange_clusters(pairs, 4)
    assert len(set(of[:10])) == len(set(of[10:20])) == 1 and of[0] != of[10] and of[20] == 2 and of[21] == 3


def test_scores_odd(spark, odd, none):
    for words in (2, classlm.HEAD_WORDS):
        got = classlm.score_texts(odd, F.col("doc_id") == 4, head_words=words).collect()
    assert len(got) == 8 and {r["n_tokens"] for r in got if r["id"] in (1, 2, 5)} == {1}
    assert classlm.score_texts(none, F.lit(False)).count() == 0
    assert {r["base_score"] for r in classlm.score_texts(odd.where("doc_id = 1"), F.lit(True)).collect()} == {0.0}


# --- 10 -----------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = queries.QUERIES["op10_quality"](spark, folder).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert len(held) > 30 and np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.95


def test_discriminant_equals_densities():
    rng = np.random.default_rng(4)
    x = [rng.normal(size=(50, 3)) @ np.diag([1, 2, 0.5]), rng.normal(size=(80, 3)) + 2]
    n = np.array([50.0, 80.0])
    m = quality.Discriminant.from_moments(n, np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x]), pooled=0.0, diagonal=0.0)
    at = rng.normal(size=(5, 3))
    log = []
    for k in (0, 1):
        cov = np.cov(x[k].T, bias=True) + 1e-6 * np.eye(3)
        d = at - x[k].mean(0)
        log.append(np.log(n[k] / n.sum()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (d @ np.linalg.inv(cov) * d).sum(1))
    assert np.allclose(m.score(at), 1 / (1 + np.exp(log[0] - log[1])))


def test_fit_equals_moments_of_its_rows(spark):
    """The model of a bounded sample has the means and shrunk covariances of just those rows."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["word", "Other", "x", "9", "--"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1)], "doc_id long, quality int")
    ids = [r[0] for r in labels.where("doc_id is not null").orderBy(F.xxhash64("doc_id")).limit(24).collect()]
    m = quality.fit(docs, labels, fit_rows=24)
    x = {i: np.array(quality.statistics(texts[i])) for i in ids}
    for k in (0, 1):
        own = np.array([x[i] for i in ids if i % 2 == k])
        assert np.allclose(m.mean[k], own.mean(0)) and math.isclose(m.log_prior[k], math.log(len(own) / 24))
        both = [np.cov(np.array([x[i] for i in ids if i % 2 == c]).T, bias=True) for c in (0, 1)]
        n = [sum(i % 2 == c for i in ids) for c in (0, 1)]
        common = (n[0] * both[0] + n[1] * both[1]) / 24
        shrunk = 0.6 * both[k] + 0.3 * common + 0.1 * np.diag(np.diag(common) + 1e-3) + 1e-6 * np.eye(15)
        assert np.allclose(m.factor[k] @ shrunk @ m.factor[k].T, np.eye(15), atol=1e-6)


def test_quality_odd(spark, odd, none):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score_quality(odd, empty).collect()} == {0.5}
    one = spark.createDataFrame([(3, 1, 0), (3, None, 0), (None, 1, 0)], empty.schema)
    assert len({r["score"] for r in quality.score_quality(odd, one).collect()}) == 1
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (1, 0, 0), (2, 1, 0)], empty.schema)
    assert all(0 <= r["score"] <= 1 for r in quality.score_quality(odd, labels).collect()) and quality.score_quality(none, labels).count() == 0


# --- pipeline -------------------------------------------------------------------


@needs_data
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    (_, classify), (_, lines), (_, near), (_, leaks), (_, mix) = corpus_pipeline.STAGES
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = classify(spark, docs, SF)
    kept = {r["doc_id"] for r in good.collect()}
    wrong = sum((i in kept) != (q == 1) for i, q in labels.items())
    assert good.columns == docs.columns and wrong <= 0.05 * len(labels)
    expected = {i: t for i, t in plain_dedup({r["doc_id"]: r["text"] for r in good.collect()}).items() if t.strip()}
    deduped = lines(spark, good, SF)
    assert {r["doc_id"]: r["text"] for r in deduped.collect()} == expected
    ids = sorted(expected)
    components = components_of([plain_simhash(expected[i]) for i in ids], ids)
    single = near(spark, deduped, SF)
    assert {r["doc_id"] for r in single.collect()} == set(components) and single.columns == docs.columns
    leaked = {r["id"] for r in decontaminate.contamination(single, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    clean = leaks(spark, single, SF)
    assert {r["doc_id"] for r in clean.collect()} == set(components) - leaked
    mixed = mix(spark, clean, SF)
    assert mixed.count() == clean.count() and abs(mixed.agg(F.sum("taken") / F.sum("size")).first()[0] - 1.5) < 0.02
    assert corpus_pipeline.run(spark, SF).count() == clean.count()


def test_pipeline_odd(spark, odd, none, tmp_path):
    spark.createDataFrame([(3, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "no such words in any text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (odd, none):
        docs = rows
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.count() <= rows.count()


def test_near_stage_equals_brute_force_jaccard(spark):
    rng = random.Random(8)
    texts = []
    for n in (6, 12, 40, 90, 300):
        for _ in range(4):
            base = [f"v{rng.randrange(5000)}" for _ in range(n)]
            for _ in range(9):
                words = list(base)
                for _ in range(rng.randint(0, 1 + n // 60)):
                    words[rng.randrange(n)] = f"x{rng.randrange(5000)}"
                texts.append(" ".join(words))
    passage = " ".join(f"common{k}" for k in range(12))  # a hot list of texts that aren't alike
    texts += [" ".join([passage, *(f"y{rng.randrange(5000)}" for _ in range(25))]) for _ in range(40)]
    rng.shuffle(texts)
    held = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    similar = [[5 * len(a & b) >= 4 * len(a | b) for b in held] for a in held]
    first = list(range(len(texts)))
    for _ in texts:
        now = [min(first[j] for j in range(len(texts)) if similar[i][j]) for i in range(len(texts))]
        if now == first:
            break
        first = now
    prints = [plain_simhash(t) for t in texts]
    assert any(similar[i][j] and (prints[i] ^ prints[j]).bit_count() > 4 for i in range(len(texts)) for j in range(i))
    docs = docs_of(spark, [(i, t, "x") for i, t in enumerate(texts)])
    assert {r["doc_id"] for r in corpus_pipeline.dedup_near(spark, docs, "").collect()} == set(first)
    assert {r["doc_id"] for r in jaccard.keep_first(docs, block=3).collect()} == set(first)


@pytest.mark.parametrize("word", ["probe", chat.PROBE, f"{chat.PROBE}0", f"{chat.PROBE} {chat.PROBE}0 {chat.PROBE}1 {chat.PROBE[:3]}"])
def test_texts_that_hold_the_probe_keep_their_places(word):
    turns = [("system", word), ("probe", f"x {word}"), ("assistant", f"<think>x</think>{word}"), ("assistant", f"yes {word}"), ("user", word), ("assistant", word)]
    for template in (chat.MarkedTurns(), Forgetful()):
        text, places, _ = chat.render_incrementally(template, turns)
        assert all(places) and all(text[slice(*p)] in (t, t.rpartition("</think>")[2]) for p, (_, t) in zip(places, turns, strict=True))


def test_batches_are_small_inside_and_as_before_outside(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    most = F.pandas_udf(lambda x: x * 0 + len(x), "long")
    with batches_of(spark, 7):
        rows = spark.range(0, 100, 1, 2).select(most("id").alias("n")).collect()
    assert len(rows) == 100 and max(r["n"] for r in rows) == 7
    assert spark.conf.get(key, None) == before
    with pytest.raises(ValueError), batches_of(spark, 7):
        raise ValueError
    assert spark.conf.get(key, None) == before


@pytest.mark.parametrize("n", [4, 5, 15, 16, 51, 63, 64, 400, 1023, 3300])
def test_similar_sets_share_an_indexed_position(n):
    """The first words of both meet on the larger set's shelf at least as often as the count filter asks, whatever words are frequent."""
    rng = np.random.default_rng(n)
    base = " ".join(f"w{x}" for x in range(n + 4))
    for more in (0, n // 8, n // 4):
        other = base + "".join(f" z{x}" for x in range(more))
        a, b = (jaccard.shingle_set(x) for x in (base, other))
        assert 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
        words = np.concatenate([jaccard.position_words(x, s, 0) for x in (a, b) for s in jaccard.shelves(len(x))])
        for frequent in (np.zeros(0, np.int64), np.unique(rng.choice(words, len(words) // 2))):
            (_, _, x), (_, _, y) = (jaccard.sketch(t, frequent) for t in (base, other))
            x, y = ({e["shelf"]: e for e in z} for z in (x, y))
            shelf = (len(b).bit_length() - 1) // 2
            shared = len(set(x[shelf]["keys"]) & set(y[shelf]["keys"]))
            assert shared >= len(a) // 4 + 1 - (len(a) + len(b)) // 9 >= 1


def test_unlike_texts_of_one_passage_leave_few_candidates(spark, monkeypatch):
    """Every pair of a long list came out of the comparison once a list before: here 45959 rows."""
    rng = random.Random(4)
    passage = " ".join(f"common{k}" for k in range(300))
    texts = [" ".join([passage, *(f"y{rng.randrange(10**6)}" for _ in range(1700))]) for _ in range(40)]
    rows, plain = [], jaccard.candidates
    monkeypatch.setattr(jaccard, "candidates", lambda *a: rows.append(plain(*a).count()) or plain(*a))
    assert jaccard.keep_first(docs_of(spark, [(i, t, "x") for i, t in enumerate(texts)])).count() == 40
    assert sum(rows) < 400


def test_class_model_takes_texts_in_small_batches(spark, odd, monkeypatch):
    """A worker held up to 10,000 texts with all their tokens."""
    key, seen, plain = "spark.sql.execution.arrow.maxRecordsPerBatch", [], {k: getattr(classlm, k) for k in ("encoded_rows", "exchange_pass", "rare_words", "scored")}
    for name, f in plain.items():
        monkeypatch.setattr(classlm, name, lambda *a, f=f, **b: seen.append(spark.conf.get(key)) or f(*a, **b))
    before = spark.conf.get(key, None)
    classlm.score_texts(odd, F.col("doc_id") == 4)
    assert len(seen) >= 4 and set(seen) == {str(classlm.BATCH)} and spark.conf.get(key, None) == before
