"""Quality scores, divergence of sources and whitening against brute force, and their edge cases."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailloom.functions import batches
from mailloom.llm import boosted_trees, divergence, quality, text_statistics, whitening
from mailloom.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"


# ---------------------------------------------------------------- quality


def test_flat_trees_follow_the_tree_by_rows():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 9, (900, 5)).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 3] > 2)).astype(float)
    model = boosted_trees.fit(x, y, trees=30)

    def walk(row):
        total = model.start
        for node in model.roots:
            while model.left[node] != node:
                node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
            total += model.value[node]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(model.scores(x), [walk(row) for row in x])
    assert ((model.scores(x) >= 0.5) == y).mean() > 0.99


def test_a_cut_is_the_best_of_all():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(200, 3)).round(1), rng.integers(0, 2, 200).astype(float)
    model = boosted_trees.fit(x, y, trees=1, leaves=2, bins=1000, least_rows=1)
    chance = (y.sum() + 0.5) / 201
    slope, curve = chance - y, np.full(200, chance * (1 - chance))
    worth = lambda m: slope[m].sum() ** 2 / (curve[m].sum() + 1)
    gains = {(f, t): worth(x[:, f] <= t) + worth(x[:, f] > t) for f in range(3) for t in np.unique(x[:, f])[:-1]}
    feature, threshold = model.feature[0], model.threshold[0]
    got = worth(x[:, feature] <= threshold) + worth(x[:, feature] > threshold)
    assert got == pytest.approx(max(gains.values()))


@pytest.mark.parametrize("y", [[], [1.0] * 5, [0.0]])
def test_one_label_gives_one_score(y):
    model = boosted_trees.fit(np.zeros((len(y), 2)), np.array(y))
    assert len(set(model.scores(np.random.default_rng(0).normal(size=(4, 2))))) == 1


def test_statistics_by_hand():
    text = "One two TWO\n\nOne two TWO\nend. x### 12"
    got = dict(zip(text_statistics.NAMES, text_statistics.statistics(text)))
    words, raw = text.split(), text.encode()
    assert got["log_words"] == pytest.approx(math.log1p(len(words)))
    assert got["words_distinct"] == pytest.approx(len(set(words)) / len(words))
    assert got["word_commonest"] == pytest.approx(2 / 9)
    assert got["words_all_upper"] == pytest.approx(2 / 9)
    assert got["words_odd_end"] == pytest.approx(1 / 9)
    assert got["words_without_letter"] == pytest.approx(1 / 9)
    assert got["share_symbol"] == pytest.approx(3 / len(raw))
    assert got["lines_repeated"] == pytest.approx(1 / 3)
    assert got["pairs_distinct"] == pytest.approx(len(set(zip(words, words[1:]))) / 8)
    for odd in (None, "", " \n\t", "é" * 100_000, "a b " * 100_000, "\n" * 50_000):
        assert np.isfinite(text_statistics.statistics(odd)).all()


def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    found = QUERIES["op11_quality"](spark, SF_DIR)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    assert found.count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    judged = found.filter("held_out").join(labels.select("doc_id", "quality"), "doc_id").toPandas()
    assert len(judged) > 30 and (judged["predicted"] == judged["quality"]).mean() >= 0.95
    assert found.filter("score < 0 or score > 1 or (predicted = 1) <> (score >= 0.3)").count() == 0


def test_odd_labels_and_texts(spark):
    docs = spark.createDataFrame(
        [(k, "good words here. " * (k % 7 + 1) if k % 2 else "### $$$ " * (k % 5 + 1), 9.0) for k in range(200)]
        + [(None, None, 1.0), (3, "", 1.0), (3, "", 1.0), (7, "x" * 300_000, 1.0)],
        "doc_id long, text string, Score double",
    )
    labels = spark.createDataFrame(
        [(k, k % 2) for k in range(150)] + [(1, 1), (2, 1), (5, None), (None, 1), (4, 7), (9999, 1)], "doc_id long, quality int"
    )
    usable = {r["id"]: r["label"] for r in quality.usable_labels(labels, 1000).collect()}
    assert 2 not in usable and 1 in usable and None not in usable and set(usable.values()) == {0, 1}
    assert quality.usable_labels(labels, 10).count() == 10
    assert not {r["doc_id"] for r in docs.filter(quality.held_out(F.col("doc_id"))).collect()} & set(usable)
    model = quality.train_model(docs, labels)
    found = quality.score(docs, model)
    assert found.columns == ["doc_id", "text", "score", "predicted"] and found.count() == docs.count()
    assert found.filter("doc_id >= 150 and predicted <> doc_id % 2").count() == 0
    assert quality.score(docs.limit(0), quality.train_model(docs.limit(0), labels.limit(0))).count() == 0
    assert quality.score(docs, quality.train_model(docs, labels.limit(0))).select("score").distinct().count() == 1


# ---------------------------------------------------------------- divergence


def brute_audit(rows, least, top):
    docs = [tuple(v or "" for v in row) for row in rows]
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) for _, _, text in docs]
    out = set()
    for lang in {d[0] for d in docs}:
        held, used = Counter(), {}
        for (own, source, _), said in zip(docs, words):
            if own == lang:
                held.update(set(said))
                used.setdefault(source, Counter()).update(said)
        kept = [t for t, n in held.items() if n >= least]
        whole = sum(used.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        q, shares = share(whole), {s: share(c) for s, c in used.items()}
        for source, p in shares.items():
            pairs = [(o, sum(abs(p[t] - shares[o][t]) for t in kept)) for o in used if o != source]
            terms = [(t, p[t] - q[t]) for t in kept if used[source][t] and p[t] > q[t]]
            for part, items, last in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda i: (-i[1], i[0].encode()))[:last]
                out |= {(lang, source, part, item, value, rank) for rank, (item, value) in enumerate(ranked, 1)}
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_audit(spark, monkeypatch, seed):
    """Ties, empty groups, a language without kept terms, many tiles and blocks, dictionaries that overflow."""
    rng = np.random.default_rng(seed)
    letters = [chr(c) for c in range(97, 117)] + ["é", "ß", "Zz", "y-y", "𝒳"]
    rows = []
    for _ in range(300):
        lang, source = rng.choice(["a", "b", ""]), f"s{int(rng.integers(0, 12) ** 2 / 12)}"
        size = int(rng.integers(0, 12))
        rows.append((str(lang), source, " ".join(rng.choice(letters, size, p=None))))
    rows += [("c", "only", "x"), ("a", "empty", None), (None, None, "a b c"), ("a", None, "")] + [("b", "s1", "t t t u")] * 40
    if seed == 2:
        monkeypatch.setattr(divergence, "TILE", 3)
        monkeypatch.setattr(divergence, "TERMS", 4)
    if seed == 3:
        monkeypatch.setattr(divergence, "HELD", 5)
        monkeypatch.setattr(divergence, "BROADCAST_BYTES", -1)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, source string, text string, term int, n int")
    got = [tuple(r) for r in divergence.audit(docs.repartition(5), min_documents=10, top=4).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_audit(rows, 10, 4)


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([("a", "s", "x"), ("a", "r", None)], "lang string, source string, text string")
    assert divergence.audit(docs.limit(0)).count() == 0
    got = {tuple(r) for r in divergence.audit(docs).collect()}
    assert got == {("a", "s", "pair", "r", 0, 1), ("a", "r", "pair", "s", 0, 1)}


def test_long_text_in_pieces():
    text = ("Ab1éx " * 400_000).encode()
    assert sum((Counter(p) for p in divergence.terms_in_pieces(text)), Counter()) == {b"ab": 400_000, "éx".encode(): 400_000}


def test_terms_are_numbers_once_they_are_counted(spark, monkeypatch):
    """No text takes part in what is summed, joined and ranked for each source, and numbers rise as terms do."""
    seen, each = [], divergence._skybands
    monkeypatch.setattr(divergence, "_skybands", lambda rows, k: seen.append(rows) or each(rows, k))
    docs = spark.createDataFrame([("a", "s", "é b Z"), ("a", "r", "b y")] * 3, "lang string, source string, text string")
    found = divergence.audit(docs, min_documents=3)
    assert all(f.dataType.typeName() == "long" for rows in seen for f in rows.schema.fields)
    numbers = sorted({(r["number"], r["of_lang"]) for r in seen[0].collect()})
    assert [n for _, n in numbers] == [6, 3, 3, 3] and found.filter("part = 'term'").count() > 0


@pytest.mark.parametrize("portion", [1, 7, 1 << 22])
def test_counts_of_texts_side_by_side(spark, monkeypatch, portion):
    """Words end where their text ends; texts beyond a portion, empty ones and odd characters count as well."""
    monkeypatch.setattr(divergence, "portions", lambda texts: batches.portions(texts, portion))
    monkeypatch.setattr(divergence, "PORTION", portion)
    texts = ["ab", "cd AB", "", " ", "ab1éx", "é", "-", "Ab ab\nab", "日本 x", "x" * 40, "\x00a\x7f"]
    rows = [("a" if k % 3 else "b", t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.lower())
    for once in (False, True):
        want = Counter((lang, w) for lang, t in rows for w in (set(words(t)) if once else words(t)))
        found = divergence._counted(docs, ["lang"], once=once).groupBy("lang", "term").agg(F.sum("n")).collect()
        assert {(r[0], r[1]): r[2] for r in found} == want


@pytest.mark.parametrize("block", [3, 512])
def test_skyband(monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    rng = np.random.default_rng(block)
    for k in (1, 2, 5):
        count, other, name = rng.integers(0, 12, 150), rng.integers(0, 12, 150), rng.permutation(150)
        better = (count[:, None] >= count) & (other[:, None] <= other) & (name[:, None] < name)
        want = set(np.flatnonzero(better.sum(axis=0) < k))
        assert set(divergence.skyband(count, other, name, k)) == want


def test_share_is_exact(spark):
    cases = [(0, 1, 1), (7, 10, 3), (10**15 - 3, 10**15, 10**6), (8 * 10**15, 8 * 10**15 + 1, 5), (0, 0, 9)]
    df = spark.createDataFrame(cases, "c long, n long, v long")
    got = [r[0] for r in df.select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (c + 5) // (n + 5 * v) for c, n, v in cases]


# ---------------------------------------------------------------- whitening


@pytest.mark.parametrize("kind", range(6))
def test_solver(kind):
    rng = np.random.default_rng(kind)
    for n in (1, 2, 3, 17, 60):
        a, b = rng.standard_normal(n), rng.standard_normal(n - 1)
        if kind == 1:
            a *= 10.0 ** rng.uniform(-8, 8, n)
        if kind == 2:
            b[rng.random(n - 1) < 0.4] = 0
        if kind == 3:
            a[rng.random(n) < 0.3] = 0
        if kind == 4:
            a, b = np.ones(n), np.zeros(n - 1)
        if kind == 5:
            a, b = np.ones(n), np.full(n - 1, 1e-9)
        whole = np.diag(a) + np.diag(b, 1)
        values = whitening.squared_singular_values(a, b)
        want = np.linalg.svd(whole, compute_uv=False)
        assert np.abs(np.sqrt(values) - want).max() <= 1e-13 * max(want.max(), 1e-300)
        k = min(4, n)
        z = whitening.directions(a, b, values[:k])
        assert np.abs(whole.T @ (whole @ z) - z * values[:k]).max() <= 1e-12 * max(want.max() ** 2, 1e-300)
        assert np.abs(z.T @ z - np.eye(k)).max() < 1e-12


def test_small_singular_values_keep_their_digits():
    """Of a bidiagonal matrix without a zero, also the least are right in all digits."""
    a, b = 10.0 ** -np.arange(0, 40, 4.0), np.full(9, 1e-3) * 10.0 ** -np.arange(0, 36, 4.0)
    got = np.sqrt(whitening.squared_singular_values(a, b))
    assert np.prod(got) == pytest.approx(np.prod(a), rel=1e-12)


def test_bidiagonal():
    rng = np.random.default_rng(4)
    for n in (1, 2, 9):
        r = np.triu(rng.standard_normal((n, n)))
        a, b, right = whitening.bidiagonal(r)
        whole = np.diag(a) + np.diag(b, 1)
        assert np.allclose(right.T @ right, np.eye(n)) and np.allclose(right @ whole.T @ whole @ right.T, r.T @ r)


def brute_whitening(vectors):
    x = np.floor(256 * np.array(vectors, float))
    distinct = np.unique(x, axis=0)
    n, mean = len(distinct), distinct.mean(axis=0)
    covariance = (distinct - mean).T @ (distinct - mean) / n
    e, v = np.linalg.eigh(covariance)
    e, v = e[::-1][:4], v[:, ::-1][:, :4]
    return n, ((n * x - distinct.sum(axis=0)) ** 2).sum(axis=1), (x - mean) @ v / np.sqrt(e), e / np.trace(covariance)


def test_whitening(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    rows = rows.unionByName(rows.filter("vec_id < 30")).repartition(23).withColumn("n", F.lit("other"))
    want = rows.toPandas().sort_values("vec_id", kind="stable")
    n, deviation, white, explained = brute_whitening(want["embedding"].tolist())
    got = whitening.whiten(rows).toPandas()
    assert len(got) == 4 * len(want) and set(got["n"]) == {n} and got["identity_error"].max() < 1e-12
    for c in range(4):
        one = got[got["component"] == c + 1].sort_values("vec_id", kind="stable")
        assert one["vec_id"].tolist() == want["vec_id"].tolist()
        assert [int(d) for d in one["deviation"]] == deviation.astype(np.int64).tolist()
        values = one["whitened"].to_numpy()
        values *= np.sign(values @ white[:, c])
        assert np.abs(values - white[:, c]).max() < 1e-9 and abs(one["explained"].iloc[0] - explained[c]) < 1e-12


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.0, None, 3.0]), (3, None), (4, [nan, 1.0, 1.0]), (None, [4.0, 5.0]), (1, [1.0, 2.0, 3.0]), (6, []), (7, [inf])]
    odd = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(odd).toPandas()
    n, deviation, white, explained = brute_whitening([[1, 2, 3], [4, 5, 0], [0, 0, 0]])
    assert sorted(got["vec_id"].fillna(-1)) == sorted([1, 1, 1, 1, 1, 1, -1, -1, -1, 6, 6, 6]) and set(got["n"]) == {3}
    one = got[(got["vec_id"] == 6) & (got["component"] <= 2)].sort_values("component")
    assert {int(d) for d in one["deviation"]} == {int(deviation[2])}
    assert np.allclose(np.abs(one["whitened"].astype(float)), np.abs(white[2, :2])) and np.allclose(one["explained"], explained[:2])
    assert got[got["component"] == 3]["whitened"].isna().all()
    assert whitening.whiten(odd.limit(0)).count() == 0 and whitening.whiten(odd.filter("vec_id = 6")).count() == 0
    same = whitening.whiten(odd.filter("vec_id = 1")).collect()
    assert len(same) == 6 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in same)
    huge = spark.createDataFrame([(k, [float(2**40 * k), 1.0]) for k in range(5)], "vec_id long, embedding array<double>")
    exact = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(huge).filter("component = 1").collect()}
    assert exact == {k: (5 * 2**48 * k - 2**48 * 10) ** 2 for k in range(5)}
