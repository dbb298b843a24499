"""The classifier, the language model and the neighbour search."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import classifier, neighbours, perplexity
from tidemark.llm.queries import op6_quality_classifier, op9_quality_rules, op10_nearest_neighbours


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    ones = labels == 1
    return (ranks[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in op6_quality_classifier(spark, sf_dir).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())
    held = [i for i in labels if rows[i]["held_out"]]
    scores, truth = np.array([rows[i]["score"] for i in held]), np.array([labels[i] for i in held])
    assert auc(scores, truth) > 0.97 and ((scores >= 0.5) == truth).mean() > 0.93


def test_held_out_labels_are_not_looked_at(spark, sf_dir):
    documents, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    first, second = (dict(map(tuple, classifier.score_documents(documents, x).select("doc_id", "score").collect())) for x in (labels, flipped))
    assert first == second


def test_classifier_on_odd_rows(spark, odd, none):
    some = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 1), (None, 1), (5, None), (99, 1)], "doc_id long, quality int")
    for labels in (some, some.where("quality = 1"), some.where("false")):
        rows = classifier.score_documents(odd, labels).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert classifier.score_documents(none, some).count() == 0


def test_isotonic_steps_rise():
    x, y = np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1])
    centres, values = classifier.isotonic(x, y)
    assert (np.diff(values) > 0).all() and (np.diff(centres) > 0).all()
    assert values.tolist() == [0, 0.5, 1] and centres.tolist() == [1, 2.5, 4.5]


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def plain_verdicts(rows):
    """Scores and verdicts of (id, language, text) rows, one word after the other. The spelling table is held against its definition below."""
    found, bands = {}, {}
    for lang in {r[1] for r in rows}:
        mine = [(i, (t or "").encode()) for i, one, t in rows if one == lang]
        codes, n = np.unique(np.concatenate([perplexity._codes(perplexity.PAD + t) for _, t in mine if t] or [np.zeros(0, int)]), return_counts=True)
        if not len(codes):
            continue
        table = perplexity.dense_log_probabilities(perplexity.kneser_ney(codes, n)).astype(float)
        counts = Counter(w for _, t in mine for w in t.split())
        total, types = sum(counts.values()), Counter(min(n, 3) for n in counts.values())
        d = perplexity.discounts(np.array(list(counts.values()), dtype=float))
        freed = sum(d[k] * types[k] for k in (1, 2, 3)) / total
        sound = []
        for i, t in mine:
            words, own = t.split(), Counter(t.split())
            if not words:
                continue
            logs = np.append(0, np.cumsum(table[perplexity._codes(perplexity.PAD + t)]))
            at, score = 0, 0.0
            for w in words:
                begin = t.index(w, at)
                at = begin + len(w)
                left = counts[w] - own[w]
                p = max(left - d[min(left, 3)], 0) / total + freed * np.exp(logs[at] - logs[max(begin - 1, 0)])
                score -= np.log(p) / (len(w) + 1) / len(words)
            found[i] = (score, -logs[-1] / len(t))
            if not plain_statistics(t.decode())[5]:
                sound.append(i)
        for k in (0, 1):
            quartiles = [sorted(found[i][k] for i in sound)[max(-(-len(sound) * q // 4) - 1, 0)] for q in (1, 2, 3)] if sound else [0, 0, 0]
            bands[lang, k] = quartiles[1], max((quartiles[2] - quartiles[0]) / 1.349, perplexity.LEAST_DEVIATION)
        for i in sound:
            (middle, width), (plain, plain_width) = bands[lang, 0], bands[lang, 1]
            low, high = middle - perplexity.LOWER_WIDTH * width, middle + perplexity.UPPER_WIDTH * width
            found[i] += (low <= found[i][0] <= high and found[i][1] >= plain - perplexity.SPELLING_WIDTH * plain_width,)
    return found


def test_rules_of_the_whole_table(spark, sf_dir, documents, texts):
    rows = op9_quality_rules(spark, sf_dir).collect()
    assert {r["doc_id"]: tuple(r)[1:7] for r in rows} == {i: plain_statistics(t) for i, t in texts.items()}
    expected = plain_verdicts([(r["doc_id"], r["lang"], r["text"]) for r in documents.collect()])
    for r in rows:
        one = expected.get(r["doc_id"], (None,))
        assert r["log_perplexity"] == (pytest.approx(one[0], rel=1e-4) if one[0] is not None else None)
        assert r["kept"] == (not r["base_failed"] and one[2])


def test_bands_part_labelled_junk_from_clean_documents(spark):
    """Labels take no part in the rules. Of documents that pass the plain rules, those marked sound stay and most others go."""
    sf_dir = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in op9_quality_rules(spark, sf_dir).collect() if not r["base_failed"] and r["doc_id"] in labels]
    kept = {q: [r["kept"] for r in rows if labels[r["doc_id"]] == q] for q in (0, 1)}
    assert np.mean(kept[1]) >= 0.98 and np.mean(kept[0]) <= 0.3


@pytest.mark.parametrize("text", ["", "a", "a b a b a b a b", "x y z\nx y z\n \nx y z", "é\x0b\x1c \x85#", "a b c d a b c"])
def test_statistics(text):
    assert perplexity.text_statistics(text.encode()) == plain_statistics(text)[:5]


def slow_probability(counts, order, context, symbol, cache):
    """Interpolated modified Kneser-Ney straight from its definition."""
    if order == 0:
        return 1 / perplexity.SYMBOLS
    if order not in cache:
        grams = counts
        for n in range(perplexity.ORDER, order, -1):
            grams = Counter(g[1:] for g in grams)
        cache[order] = grams, perplexity.discounts(np.array(list(grams.values()), dtype=float))
    grams, d = cache[order]
    same = {g: n for g, n in grams.items() if g[:-1] == context}
    lower = slow_probability(counts, order - 1, context[1:], symbol, cache)
    if not same:
        return lower
    total = sum(same.values())
    left = sum(d[min(int(n), 3)] for n in same.values()) / total
    n = same.get((*context, symbol), 0)
    return (n - d[min(int(n), 3)] if n else 0) / total + left * lower


def test_model_is_kneser_ney():
    data = perplexity.PAD + b"the cat sat on the mat. the dog sat on the log, 12 times!\nThe cat ran. " * 3
    codes, counts = np.unique(perplexity._codes(data), return_counts=True)
    table = np.exp(perplexity.dense_log_probabilities(perplexity.kneser_ney(codes, counts)).astype(float))
    assert table.reshape(-1, perplexity.SYMBOLS).sum(axis=1) == pytest.approx(1, abs=1e-4)
    split = lambda code: tuple(code // perplexity.SYMBOLS**k % perplexity.SYMBOLS for k in (3, 2, 1, 0))
    grams, cache = {split(int(c)): int(n) for c, n in zip(codes, counts, strict=True)}, {}
    for code in [*codes[::7].tolist(), 0, 12345, 48**4 - 1]:
        gram = split(code)
        assert table[code] == pytest.approx(slow_probability(grams, 4, gram[:-1], gram[-1], cache), rel=1e-4)


def test_counts_cover_every_text(spark, documents, texts):
    passed = perplexity.materialise(perplexity.counted(documents, 8), "counted")
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0]
    assert perplexity.ngram_counts(passed).agg(F.sum("n")).first()[0] == size
    answers = perplexity.answered(passed, 8)
    words = Counter((r["lang"], w) for r in documents.collect() for w in (r["text"] or "").encode().split())
    sums = answers.where("total is not null").groupBy("lang").agg(F.sum("total"), *(F.sum(F.col("types")[k]) for k in range(5))).collect()
    for lang, total, *types in sums:
        counts = [n for (one, _), n in words.items() if f"={one}" == lang]
        assert total == sum(counts) and types == [sum(min(n, 5) == k for n in counts) for k in range(1, 6)]


def test_model_grows_with_the_corpus(spark, documents):
    """Different words that the ranges hold; the spelling model alone would stop growing."""
    def held(frame):
        answers = perplexity.answered(perplexity.materialise(perplexity.counted(frame, 8), "counted"), 8)
        return answers.where("types is not null").select(F.sum(F.aggregate("types", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0]

    assert held(documents) > 1.5 * held(documents.where("doc_id % 4 = 0"))


def sentence(k, words):
    draw = np.random.default_rng(k)
    return " ".join(words[i] for i in draw.integers(0, len(words), 70))


def test_documents_above_and_below_the_bands(spark):
    english = "the quick brown fox jumps over lazy dogs and runs along river banks until sun sets behind green hills near old town".split()
    german = "der schnelle braune fuchs springt über faule hunde und läuft am ufer entlang bis die sonne hinter grünen hügeln steht".split()
    rows = [(k, sentence(k, english), "en") for k in range(60)] + [(100 + k, sentence(k, german), "de") for k in range(60)]
    noise = " ".join("".join(chr(97 + (k * j * 7 + j) % 26) for j in range(9)) for k in range(1, 80))
    for k, lang, words in ((900, "en", english), (950, "de", german)):
        rows += [(k, noise, lang), (k + 1, sentence(7, words).upper(), lang), (k + 2, sentence(8, words).replace(" ", "### "), lang)]
    rules = perplexity.fit_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    found = {r["doc_id"]: r for r in perplexity.verdicts(rules).collect()}
    for k in (900, 950):
        band = rules.bands["=en" if k == 900 else "=de"]
        assert all(not found[k + j]["kept"] and found[k + j]["log_perplexity"] > band[1] for j in (0, 1, 2))
    assert sum(found[k]["kept"] for k in found if k < 900) >= 116
    low = perplexity.Rules(rules.documents, rules.path, rules.words, {lang: (b[0] + 1, b[1] + 1, b[2]) for lang, b in rules.bands.items()})
    assert not any(r["kept"] for r in perplexity.verdicts(low).collect() if r["doc_id"] < 900)


def test_null_and_empty_languages_are_apart(spark):
    rows = [(k, sentence(k, "one two three four five six seven".split()), None) for k in range(8)] + [(10 + k, sentence(k, "uno dos tres cuatro cinco seis".split()), "") for k in range(8)]
    rules = perplexity.fit_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert rules.bands.keys() == rules.words.keys() == {"-", "="}


def test_other_documents_are_refused(spark):
    words = "one two three four five six seven".split()
    frame = spark.createDataFrame([(k, sentence(k, words), "en") for k in range(8)], "doc_id long, text string, lang string")
    rules = perplexity.fit_rules(frame)
    rules.documents = frame.withColumn("text", F.concat("text", F.lit(" unheard")))
    with pytest.raises(Exception, match="not counted"):
        perplexity.verdicts(rules).collect()


def test_rules_on_odd_rows(odd, none):
    rules = perplexity.fit_rules(odd)
    rows = perplexity.verdicts(rules).collect()
    assert len(rows) == odd.count()
    of = {r["doc_id"]: r for r in rows}
    assert of[4]["n_words"] == of[3]["n_words"] == of[8]["n_words"] == 0 and of[4]["base_failed"]
    assert of[5]["n_words"] == 30_000 and of[5]["base_failed"]
    kept = perplexity.keep_documents(rules)
    assert kept.schema == odd.schema and kept.exceptAll(odd).count() == 0
    assert perplexity.verdicts(perplexity.fit_rules(none)).count() == 0


def exact(rows, k=20):
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids], dtype=float)
    out = {}
    for row, i in enumerate(ids):
        if i % 20 == 0:
            s = x @ x[row]
            order = [j for j in np.lexsort((ids, -s)) if j != row][:k]
            out[i] = [(ids[j], s[j]) for j in order]
    return out


def answers(frame):
    found = {}
    for r in frame.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return found


def recall(found, expected):
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in expected[q]}) for q in expected)
    return hits / sum(map(len, expected.values()))


def test_neighbours_of_the_whole_table(spark, sf_dir):
    table = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    found, expected = answers(op10_nearest_neighbours(spark, sf_dir)), exact(table)
    assert found.keys() == expected.keys() and recall(found, expected) >= 0.95
    for query, pairs in found.items():
        assert len(pairs) == 20 and query not in {i for i, _ in pairs}
        assert all(s == pytest.approx(np.dot(np.array(table[query], float), np.array(table[i], float)), abs=1e-12) for i, s in pairs)


def test_graph_search_with_small_leaves(spark):
    x = np.random.default_rng(0).standard_normal((1500, 16))
    rows = {k: v.tolist() for k, v in enumerate(x)}
    frame = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    nodes = neighbours._as_nodes(neighbours.valid_vectors(frame))
    path = neighbours.scratch_path(spark, "test-graph")
    blocks = neighbours.build_graph(nodes, path, trees=4, leaf=100, degree=16, rounds=2)
    queries = nodes.where("node % 20 = 0").withColumnRenamed("node", "query")
    found = neighbours.search(neighbours.start_pools(queries), path, blocks, neighbours.POOL).collect()
    pools = {r["query"]: [(i, 0.0) for i in r["ids"] if i != r["query"]][:20] for r in found}
    assert recall(pools, exact(rows)) >= 0.9


def test_search_goes_on_until_the_pool_is_expanded(spark):
    """With two nodes a hop, any small fixed number of hops stops long before the pool of 40 is expanded."""
    x = np.random.default_rng(0).standard_normal((1500, 16))
    rows = {k: v.tolist() for k, v in enumerate(x)}
    nodes = neighbours._as_nodes(neighbours.valid_vectors(spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")))
    path = neighbours.scratch_path(spark, "test-graph")
    blocks = neighbours.build_graph(nodes, path, trees=4, leaf=100, degree=16)
    queries = nodes.where("node % 100 = 0").withColumnRenamed("node", "query")
    found = neighbours.search(neighbours.start_pools(queries), path, blocks, pool=40, beam=2).collect()
    pools = {r["query"]: [(i, 0.0) for i in r["ids"] if i != r["query"]][:20] for r in found}
    assert recall(pools, {q: near for q, near in exact(rows).items() if q in pools}) >= 0.9


def test_pools_grow_until_the_sample_is_found(spark):
    x = np.random.default_rng(3).standard_normal((3000, 24))
    rows = {k: v.tolist() for k, v in enumerate(x)}
    nodes = neighbours.materialise(neighbours._as_nodes(neighbours.valid_vectors(spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>"))), "nodes")
    path = neighbours.scratch_path(spark, "test-graph")
    blocks = neighbours.build_graph(nodes, path, trees=2, leaf=60, degree=8, rounds=1)
    queries = nodes.where("node % 60 = 0").withColumnRenamed("node", "query")
    recalls = []
    for target in (0.0, 0.99):
        found = neighbours.search_to_recall(nodes, queries, path, blocks, pool=30, target=target).collect()
        pools = {r["query"]: [(i, 0.0) for i in r["ids"] if i != r["query"]][:20] for r in found}
        recalls.append(recall(pools, {q: near for q, near in exact(rows).items() if q in pools}))
    assert recalls[0] < recalls[1] and recalls[1] >= 0.98


def test_more_vectors_than_a_leaf_holds(spark):
    """Queries of the whole function over a table of many leaves, a third of it dense, against brute force."""
    x = np.random.default_rng(4).standard_normal((6000, 32))
    x[:2000] = 0.2 * x[:2000] + np.random.default_rng(5).standard_normal(32)
    rows = {k: (v / np.linalg.norm(v)).tolist() for k, v in enumerate(x)}
    frame = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    found = answers(neighbours.nearest(frame, F.pmod("vec_id", F.lit(20)) == 0))
    expected = exact(rows)
    assert len(rows) > 10 * neighbours.LEAF and found.keys() == expected.keys() and recall(found, expected) >= 0.9


def test_crowded_leaves_are_cut_by_place(spark):
    """One dense leaf: the first edges must find more of the nearest than parts dealt at random could."""
    x = np.random.default_rng(1).standard_normal((4000, 8)) * 0.05 + 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    nodes = neighbours._as_nodes(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"))
    leaves = neighbours._leaves(nodes.select("node", "v"), 4000, np.zeros(8, np.float32), 1, 200)
    found = neighbours._edges_in_leaves(leaves, 200, 1).select("a", "b").collect()
    best = x @ x.T
    np.fill_diagonal(best, -np.inf)
    assert len(found) >= 3900 and sum(best[r["a"]].argmax() == r["b"] for r in found) >= 3 * 4000 / 20


def test_odd_vectors_and_copies(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, None]), (6, [inf, 0.0]), (7, [1.0]), (None, [1.0, 1.0]), (20, [0.5, 0.5]), (20, [0.5, 0.5]), (40, []), (60, [1.0, 0.0])]
    rows += [(100 + k, [1.0, 0.0]) for k in range(50)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    found = answers(neighbours.nearest(frame, F.pmod("vec_id", F.lit(20)) == 0))
    assert found.keys() == {0, 20, 60, 100, 120, 140}
    assert [i for i, _ in found[0]] == [1, 60, *range(100, 118)] and {s for _, s in found[0]} == {1.0}
    assert [i for i, _ in found[60]] == [0, 1, *range(100, 118)]
    assert neighbours.nearest(frame.where("false"), F.lit(True)).count() == 0
    assert answers(neighbours.nearest(frame.where("vec_id in (0, 20)"), F.pmod("vec_id", F.lit(20)) == 0)) == {0: [(20, 0.5)], 20: [(0, 0.5)]}
