"""Fixtures by brute force: near duplicates, shared lines, passages, packing, top-k, chat, language, pages."""

import hashlib
import html
import random
import re
import zlib
from itertools import product

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from checks.compare import difference, duck_tables
from mailloom.llm import (
    chat,
    components,
    decontamination,
    html_text,
    language,
    line_dedup,
    packing,
    simhash,
    topk,
)
from mailloom.llm.html_blocks import blocks_of
from mailloom.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
ODD_TEXTS = [None, "", " \t\n", "one", "One two THREE", "one two three four", "a" * 200_000, "é ü " * 50_000]


@pytest.fixture(scope="module")
def con():
    return duck_tables(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF_DIR).toPandas(), con.sql(ORACLES[name]).df()) is None


@pytest.fixture(scope="module")
def odd(spark):
    """NULL ids and texts, repeats, ties, clashing column names."""
    rows = [(k, t, 1, "x", "y", 2.5) for k, t in enumerate(ODD_TEXTS)]
    rows += [(3, "one", 1, "x", "y", 2.5), (3, "other text", 1, "x", "y", 2.5), (None, "one two three four", 1, "x", "y", 2.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp int, contamination string, lang_pred string, score double")


def brute_components(rows, limit=4):
    """Least reachable id for each (doc_id, text)."""

    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0

    prints = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= limit and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    least = {}
    for (doc_id, _), g in zip(rows, group):
        if doc_id is not None:
            least[g] = min(doc_id, least.get(g, doc_id))
    return sorted((doc_id if doc_id is not None else -1, f"{p:016x}", least.get(g)) for (doc_id, _), p, g in zip(rows, prints, group))


def near_rows(df):
    return sorted((r[0] if r[0] is not None else -1, r[1], r[2]) for r in simhash.near_duplicates(df).collect())


def test_near_duplicates(spark, odd):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert near_rows(docs) == brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert near_rows(odd) == brute_components([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id is null").count() == 1


@pytest.mark.parametrize("agreed", [1, 2, 3, 4])
@pytest.mark.parametrize("shard", [simhash.SHARD, 40])
def test_links_are_all_found(spark, monkeypatch, agreed, shard):
    """Dense and scattered fingerprints, few and many blocks, whole and cut trees."""
    monkeypatch.setattr(simhash, "SHARD", shard)
    rng = random.Random(agreed)
    codes = {rng.getrandbits(64) for _ in range(150)}
    for centre in rng.sample(sorted(codes), 6):
        for _ in range(30):
            codes.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    codes = np.array(sorted(codes), np.uint64)
    prints = spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "fp long")
    edges = simhash.linked_fingerprints(prints, agreed=agreed)
    roots = {r["node"]: r["root"] for r in components.roots(edges).collect()}
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4
    label = np.arange(len(codes))
    for _ in range(len(codes)):
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    got = [roots.get(int(x), int(x)) for x in codes.view(np.int64)]
    groups = {}
    for a, b in zip(label.tolist(), got):
        groups.setdefault(a, set()).add(b)
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(200, 260)] + [(500, k) for k in range(501, 700)] + [(7, 7), (3, 9), (9, 3)]
    rng.shuffle(edges)
    roots = {r["node"]: r["root"] for r in components.roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {roots[k] for k in range(200, 261)} == {200} and {roots[k] for k in range(500, 700)} == {500} and roots[9] == 3
    assert 7 not in roots


def test_shared_lines_of_odd_texts(spark, odd):
    long_line = "A line that all of them hold"
    texts = [f"{long_line}\nfirst", f"  {long_line.upper()}\t\nsecond\n{long_line}", f"short\n{long_line}\n", "short", None, ""]
    docs = spark.createDataFrame([(k, t, 9) for k, t in enumerate(texts)] + [(None, long_line, 9)], "doc_id long, text string, n_lines int")
    got = {r["doc_id"]: r for r in line_dedup.drop_shared_lines(docs).collect()}
    assert [got[k]["text"] for k in range(6)] == [texts[0], "second", "short\n", "short", "", ""]
    assert [got[k]["n_lines"] for k in range(6)] == [2, 3, 3, 1, 1, 1] and got[None]["text"] == ""
    assert line_dedup.drop_shared_lines(docs, counts=False).columns == docs.columns
    assert line_dedup.drop_shared_lines(odd).count() == odd.count()
    assert line_dedup.drop_shared_lines(docs.limit(0)).count() == 0
    more = {r["doc_id"]: r["text"] for r in line_dedup.drop_shared_lines(docs, max_documents=4).collect()}
    assert more[1] == texts[1]


def test_passages(spark, odd, monkeypatch):
    monkeypatch.setattr(decontamination, "SHARD_BYTES", 500)
    rng = random.Random(2)
    words = [f"w{k}" for k in range(30)]
    items = [[rng.choice(words) for _ in range(n)] for n in (0, 1, 4, 9, 10, 11, 25, 60)]
    docs = []
    for _ in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        item = rng.choice(items)
        at, size = rng.randint(0, len(text)), rng.randint(0, len(item))
        docs.append(text[:at] + item[:size] + text[at:] + item * rng.randint(0, 2))
    frame = spark.createDataFrame([(k, ", ".join(d).upper()) for k, d in enumerate(docs)] + [(99, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " -- ".join(w)) for k, w in enumerate(items)] + [(50, None)], "item_id long, text string")
    for block in (1 << 20, 150):
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
        got = {r["doc_id"]: r["contamination"] for r in decontamination.mark_contamination(frame, bench).collect()}
        for k, doc in enumerate(docs):
            hit, names = set(), set()
            for name, item in enumerate(items):
                n = min(10, len(item))
                windows = {tuple(item[s : s + n]) for s in range(len(item) - n + 1)} if n else set()
                for s in range(len(doc) - n + 1):
                    if tuple(doc[s : s + n]) in windows:
                        hit.update(range(s, s + n))
                        names.add(str(name))
            assert (got[k]["n_words"], got[k]["n_hit"], got[k]["items"]) == (len(doc), len(hit), sorted(names))
            assert sum(s["end"] - s["start"] for s in got[k]["spans"]) == len(hit)
        assert got[99]["n_words"] == 0
    kept = decontamination.remove_contaminated(odd, bench)
    assert kept.columns == odd.columns
    assert decontamination.mark_contamination(odd, bench.limit(0)).filter("contamination.n_hit > 0").count() == 0
    assert decontamination.mark_contamination(odd.limit(0), bench).count() == 0


def test_longest_match():
    texts = [b"x a b c d e f g h i j k y", b"a b c d e f g h i j z"]
    items = decontamination.TestItems(["q"], ["a b c d e f g h i j k l"], 10)
    found = decontamination.scan_shard(texts, items, [None, None])
    assert found["longest"] == [11, 10] and found["n_hit"] == [11, 10]


def check_packing(rows, capacity):
    by_sequence, by_document = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_document.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return by_sequence, by_document


def test_packing(spark, odd):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    tricky = ["it's I'll ΑΣ <|endoftext|> x<|startoftext|>y don't", "\x00a\x01b \x85   é ﬁ ß ÷×ª", "日本語 123 4.5, wor.ld!?", "Naïve, Über; (x)"]
    docs = docs.union(spark.createDataFrame([(5000 + k, t) for k, t in enumerate(tricky)], docs.schema)).union(odd.filter("doc_id in (0, 1, 2, 6)").select(F.col("doc_id") + 6000, "text"))
    rows = packing.pack(docs, with_ids=True).collect()
    sequences, pieces = check_packing(rows, 4096)
    total = 0
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        ids.setdefault(r["doc_id"], []).extend(r["ids"])
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and r["length"] == len(r["ids"])
    for doc_id, text in texts.items():
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert ids[doc_id] == want, doc_id
        assert [p[2] for p in sorted(pieces[doc_id])] == [min(4096, len(want) - at) for at in range(0, len(want), 4096)]
        total += len(want)
    assert len(sequences) <= -(-total // 4096) + 1
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_bin_completion_is_optimal(seed):
    """Against all partitions of few pieces, where best fit alone often needs a bin more."""
    rng = random.Random(seed)
    sizes = [rng.randint(15, 60) for _ in range(9)]

    def fewest(left, room):
        if not left:
            return 0
        size, rest = left[0], left[1:]
        tried, best = set(), 1 + fewest(rest, [*room, 100 - size])
        for k, r in enumerate(room):
            if r >= size and r not in tried:
                tried.add(r)
                best = min(best, fewest(rest, [*room[:k], r - size, *room[k + 1 :]]))
        return best

    bins = packing.BinCompletion(sizes, 100).solve()
    assert sorted(sum(bins, [])) == sorted(sizes) and all(sum(b) <= 100 for b in bins)
    assert len(bins) == fewest(sorted(sizes, reverse=True), [])


def test_bin_completion_beats_best_fit():
    sizes = [44, 37, 33, 30, 26, 30] * 4
    assert len(packing.BinCompletion(sizes, 100).solve()) == 8 < len(packing.best_fit(sizes, 100))


@pytest.mark.parametrize("sizes", [[52, 43, 28, 22, 16, 16, 8, 8, 7], [62, 44, 35, 17, 12, 10, 7, 5, 4, 4]])
def test_search_reaches_fillings_of_many_pieces(sizes):
    assert len(packing.BinCompletion(sizes, 100).solve()) == 2 < len(packing.best_fit(sizes, 100))


def test_all_fillings_come_in_order_of_waste():
    sizes = [31, 29, 23, 23, 17, 11, 7, 5, 5, 2]
    group = packing.BinCompletion(sizes, 100)
    group.steps = 10**6
    found = list(group._all(60, 60))
    want = set()
    for chosen in product([False, True], repeat=len(sizes)):
        spare = 60 - sum(s for s, c in zip(sizes, chosen) if c)
        if spare >= 0 and all(c or s > spare for s, c in zip(sizes, chosen)):
            want.add(tuple(s for s, c in zip(sizes, chosen) if c))
    assert len(found) == len(want) and set(found) == want
    assert [sum(f) for f in found] == sorted(map(sum, found), reverse=True)


def test_search_improves_a_group_of_production_size():
    lengths = np.random.default_rng(0).lognormal(6.2, 0.9, 5000).astype(int) + 1
    group = packing.BinCompletion(np.clip(lengths, 1, 4095).tolist(), 4096)
    assert len(group.best) == group.bound + 1 == 883
    bins = group.solve()
    assert len(bins) == group.bound and sorted(sum(map(list, bins), [])) == sorted(np.clip(lengths, 1, 4095).tolist())
    assert max(map(sum, bins)) <= 4096


def test_top_k_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE", 7)
    monkeypatch.setattr(topk, "ROWS", 2)
    monkeypatch.setattr(topk, "BLOCK", 2)
    rng = random.Random(4)
    rows = [(k, [rng.choice([-0.5, 0.25, 1.0]) for _ in range(3)], "x") for k in range(60)]
    rows += [(60, None, "x"), (61, [1.0, None, 0.0], "x"), (62, [float("nan")] * 3, "x"), (63, [float("inf"), 0.0, 0.0], "x")]
    rows += [(None, [1.0, 1.0, 1.0], "x"), (40, [1.0, 1.0, 1.0], "x"), (64, [2.0], "x"), (65, [], "x"), (80, [1e9, -1e9, 1e9], "x"), (81, [1e7, 1e7, 0.0], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    queries = {}
    for i, v in whole:
        if i % 20 == 0:
            queries[i] = min(v, queries.get(i, v))
    for q, x in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in whole if i != q)[:20]
        want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored)]
    got = sorted(map(tuple, topk.top_k(frame, F.col("vec_id") % 20 == 0).collect()))
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in sorted(want)] and got == sorted(want)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_chat_round_trip(spark):
    turns = [
        (1, 0, "system", "a\\b <|start|>user\n</s> \\"), (1, 1, "user", None), (1, 2, "assistant", "<|end|>\n"),
        (1, 3, "user", "[INST] <<SYS>> \\<\\|"), (1, 4, "assistant", "done\n"), (1, 5, "user", "open end"),
        (2, 0, "user", "no reply"), (3, 0, None, "x"), (3, 0, "we ird\nrole %", "y"), (3, 0, "assistant", "é😀"),
        (None, 1, "assistant", "of nobody"), (4, None, "assistant", "b"), (4, 7, "assistant", "b"), (4, 7, "assistant", "b"),
    ]
    frame = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn int, role string, text string, example int")
    examples = chat.expand(frame)
    got = {r["conv_id"]: r for r in chat.digests(examples).collect()}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for conv in (1, 2, 3, 4, None):
        said = sorted(((t[1] if t[1] is not None else -1, t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        assert got[conv]["n_turns"] == len(said)
        assert got[conv]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for _, r, t in said))
        loss = "".join(t for _, r, t in said if r == "assistant")
        assert (got[conv]["loss_sha256"], got[conv]["loss_chars"]) == (sha(loss), len(loss))
    counts = {r["conv_id"]: r["n"] for r in examples.groupBy("conv_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {1: 3, 2: 1, 3: 2, 4: 3, None: 1}
    assert chat.expand(frame.limit(0)).count() == 0


def test_language(spark, odd):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = QUERIES["op5_language"](spark, SF_DIR).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    unseen = [r for r in found if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in unseen) >= 0.97 * len(unseen)
    assert all(0 <= r["score"] <= 1 for r in found)
    model = language.train_model(docs)
    got = [(r["text"], r["lang_pred"], r["rejected"]) for r in language.predict(odd, model).collect()]
    assert len(got) == odd.count()
    for text, name, rejected in got:
        assert (name == "und") == (not any(map(str.isalpha, text or ""))) and (rejected or name != "und")
    assert language.keep_identified(odd, model).columns == odd.columns
    unlabelled = language.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0


def article(page):
    """Main text of the pages' one layout."""
    found = re.search(r"<article>(.*?)</article>", page, re.DOTALL)
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", re.sub(r"</?b>", "", found[1] if found else "")))
    return "\n\n".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)


def test_pages(spark):
    got = {r["page_id"]: r for r in QUERIES["op3_html"](spark, SF_DIR).collect()}
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    wrong = [k for k, page in pages.items() if got[k]["text"] != article(page)]
    assert len(got) == len(pages) and len(wrong) <= 0.005 * len(pages)
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_other_layouts(spark):
    page = """<html><body><div class="navbar"><ul><li><a href=/>Home<li><a href=/n>News</ul></div>
 <div class=cookie-notice>We use cookies.<button>Accept</button></div>
 <div class="post-content"><h1>Fish &amp; chips</h1><p>The first paragraph of the text is long enough
 to be read.<p>The second one follows it, and it says more.<div class="advert"><p>Buy now! Free shipping.</p></div>
 <p>A third paragraph ends the story here.</p></div>
 <div class="sidebar"><h3>Related</h3><ul><li><a href=/a>Another story</a></li></ul></div>
 <div class="comments"><div class="comment"><p>Great thanks</p></div></div>
 <form><label>Your name</label><input></form><div class="footer"><p>Copyright. All rights reserved.</p></div>"""
    odd_pages = [None, "", "<", "<p", "just text", "<script>x</script>", "<p>" * 2000, page]
    frame = spark.createDataFrame([(k, "u", p, "t") for k, p in enumerate(odd_pages)], "page_id long, url string, html string, text string")
    model = html_text.train_labeller(spark.read.parquet(f"{SF_DIR}/pages.parquet"), made_pages=600)
    got = {r["page_id"]: r["text"] for r in html_text.extract(frame, model).collect()}
    assert got[7].split("\n\n") == [
        "Fish & chips", "The first paragraph of the text is long enough to be read.",
        "The second one follows it, and it says more.", "A third paragraph ends the story here.",
    ]
    assert all(got[k] == "" for k in (0, 1, 3, 5, 6))
    assert html_text.extract(frame.limit(0), model).count() == 0


def test_gradients_of_the_labeller():
    rng = np.random.default_rng(0)
    model = html_text.Labeller.new(1)
    pages = [rng.normal(size=(n, html_text.INPUTS)).astype(np.float32) for n in (3, 5)]
    labels = [np.array([1, 0, -1]), np.array([0, 1, 1, 0, 1])]

    def loss():
        total = n = 0
        for p, y in zip(model.chances(pages), labels):
            total -= np.log(np.where(y == 1, p, 1 - p)[y >= 0].astype(float)).sum()
            n += (y >= 0).sum()
        return total / n

    for w, g in zip(model.weights(), model.gradients(pages, labels)):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, step = w[at], 1e-2
        w[at] = old + step
        up = loss()
        w[at] = old - step
        down = loss()
        w[at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 2e-2 * max(1, abs(g[at]))


def test_blocks():
    got = [(b.text, b.path[-1]) for b in blocks_of('<div id="A-b"><p>x<b>y</b> &amp;amp; z<p>&lt;p&gt;<br>q</div><li>1<li>2<td a=">">t')]
    assert got == [("xy &amp; z", "p"), ("<p> q", "p"), ("1", "li"), ("2", "li"), ("t", "td")]


def test_token_ids_of_all_kinds_of_words(monkeypatch):
    """Long texts, many groups and a small memory, against the vocabulary's own library."""
    import pyarrow as pa

    from mailloom.llm import word_tokens

    monkeypatch.setattr(word_tokens, "REMEMBERED", 300)
    monkeypatch.setattr(word_tokens, "GROUP", 2000)
    monkeypatch.setattr(word_tokens, "LONG", 5000)
    rng = random.Random(4)
    letters = "abcXYZéÜß0123456789.,;:!?#$%&*+-/=@^_`{|}~\\\"()[]<>' ́Ωж日"
    texts = [None, "", " ", "<|ENDOFTEXT|> a<|endoftext|>b", "a " * 9000]
    texts += ["".join(rng.choice(letters + "    \n") for _ in range(rng.randint(0, 400))) for _ in range(200)]
    tokenizer = word_tokens.WordTokenizer(None)
    got = [np.concatenate([*stretches, np.zeros(0, np.uint32)]).tolist() for stretches in tokenizer.encode(pa.array(texts))]
    assert got == [tokenizer.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_long_text_of_many_lines(spark):
    """Time in proportion to the lines: a quadratic step would take minutes here."""
    import time

    def taken(n):
        text = "\n".join(f"line number {k} of it" for k in range(n))
        docs = spark.createDataFrame([(1, "line number 7 of it"), (2, text)], "doc_id long, text string")
        start = time.perf_counter()
        rows = {r[0]: tuple(r)[1:] for r in line_dedup.drop_shared_lines(docs).select("doc_id", "n_lines", "n_dropped", F.length("text")).collect()}
        assert rows == {1: (1, 0, 19), 2: (n, 1, len(text) - 20)}
        return time.perf_counter() - start

    taken(1000)
    assert taken(100_000) < 4 * taken(25_000) + 10


def test_texts_unlike_the_training_are_rejected(spark):
    """Languages that were not learned and random letters go; right answers and mixtures of learned languages stay."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").select("doc_id")
    rows = docs.join(good, "doc_id").orderBy("doc_id").collect()
    model = language.fit([r["text"] for r in rows], [r["lang"] for r in rows])
    rng = random.Random(2)
    strange = [
        "Het is een mooie dag en wij gaan naar het strand met de kinderen om daar te spelen en te zwemmen in de zee.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
        *("".join(rng.choices("abcdefghijklmnopqrstuvwxyz    ", k=200)) for _ in range(20)),
    ]
    assert all(model.predict(text)[2] for text in strange)
    rest = docs.join(good, "doc_id", "left_anti").join(spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 0"), "doc_id", "left_anti")
    judged = [(r["lang"], *model.predict(r["text"])) for r in rest.collect()]
    right = [j for j in judged if j[0] == j[1]]
    assert len(right) > 300 and sum(j[3] for j in right) <= 0.02 * len(right)
    parts = {r["lang"]: r["text"] for r in rows if r["text"] and len(r["text"]) > 400}
    for a in parts:
        for b in parts:
            assert not model.predict(parts[a][:400] + " " + parts[b][:400])[2]


def test_samples_stay_above_zero():
    from mailloom.llm.common import hash_limit

    for rows, total in [(400, 4 * 10**8), (1500, 10**13), (1, 2**62)]:
        assert 0 < hash_limit(rows, total) and abs(hash_limit(rows, total) * total / (rows << 63) - 1) < 1e-3
    assert hash_limit(10, 10) is None and hash_limit(10, 0) is None


def test_many_labels_and_hot_texts_are_bounded(spark):
    rows = [(k, f"l{k % 90}", "ab cd " * (k % 3 + 1)) for k in range(2000)] + [(k, "l1", "hot text") for k in range(2000, 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language.train_model(docs, most_languages=5, most_texts=100)
    assert len(model.languages) == 5 and "l1" in model.languages


MAIN = "This is the main text of the article, which is long enough to be read as prose, and then some more of it."


@pytest.mark.parametrize(
    "before, after",
    [
        ("<object data=x>", ""),
        ("<object data=x><object data=y>", "</object></object>"),
        ("<noscript>", "</noscript>"),
        ("<svg><g>", ""),
        ("<math>", "</math>"),
        ("<template>", ""),
        ("<iframe src=x>", ""),
        ("<textarea>", ""),
    ],
)
def test_nothing_is_dropped_before_the_labeller(before, after):
    page = f"<p>intro</p>{before}<article><p>{MAIN}</p></article>{after}<p>end</p>"
    texts = [b.text for b in blocks_of(page)]
    assert "intro" in texts and any(MAIN in t for t in texts) and any("end" in t for t in texts)
    inside = f"<article><p>See <math><mi>x</mi></math> and <object>y</object>.</p><script>var a = '<p>no</p>'</script></article>"
    assert [b.text for b in blocks_of(inside)] == ["See x and y."]


def test_training_batches_are_bounded():
    sizes = [1, 1, 2, 30, 400, 2000, 2000, 20_000] + [3] * 200
    parts = html_text._batches(sizes)
    assert [k for part in parts for k in part] == list(range(len(sizes)))
    assert all(len(p) <= 64 and (len(p) == 1 or len(p) * max(sizes[k] for k in p) <= 1 << 14) for p in parts)
