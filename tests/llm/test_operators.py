"""Each operator against brute force on small fixtures with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import math
import random
import re
import string
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from tarnfold.llm import blocks, decontaminate, hmm_lm, language_id, mixing, ngram_join, pii, sharding, suffix_dedup, topk_search, url_filter

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, label string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def english(rng, n):
    return " ".join(rng.choice(["the", "of", "house", "river", "green", "walks", "under", "Stone", "light", "table", "window"]) + rng.choice(["", "", "s", "ing", "er"]) for _ in range(n))


def german(rng, n):
    return " ".join(rng.choice(["der", "die", "über", "Straße", "schön", "zwischen", "Häuser", "nicht", "größe", "wald"]) + rng.choice(["", "en", "ung", "keit"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(60):
        text = english(rng, 80) if i % 2 else german(rng, 80)
        out.append((i, text, "en" if i % 2 else "de"))
    near = out[3][1].split()
    near[40] = "changed"
    out += [(60, " ".join(near), "en"), (61, out[5][1], "en"), (62, out[5][1].upper(), "en"), (63, None, None), (64, "", "en"), (65, "...", None)]
    out += [(66, "one two", "en"), (67, "One\tTwo", None), (61, out[5][1], "en"), (None, english(rng, 30), "en"), (68, english(rng, 4000), "en")]
    return [(i, t, lang, "s", len(t or ""), 99, "x") for i, t, lang in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_language(docs, empty):
    got = {(r["doc_id"], r["held_out"]): r for r in language_id.predict(docs).collect()}
    assert len(got) == docs.select("doc_id").distinct().count()
    for i in range(60):
        r = got[i, zlib.crc32(str(i).encode()) % 5 == 0]
        assert r["lang_pred"] == ("en" if i % 2 else "de")
    assert all(got[i, zlib.crc32(str(i).encode()) % 5 == 0]["lang_pred"] == "und" for i in (63, 64, 65))
    assert language_id.predict(empty).count() == 0
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id in (63, 64, 65)").count() == 0 and kept.filter("doc_id < 60").count() == 60


def test_mixed_text_has_spans(docs):
    rng = random.Random(1)
    model = language_id.train(docs, language_id.in_training(docs["doc_id"]))
    a, b = english(rng, 40), german(rng, 40)
    r = language_id.label_texts(model, [a + " " + b]).iloc[0]
    assert r["span_lang"] == ["en", "de"] and abs(r["span_end"][0] - len(a)) < 40


def test_viterbi_is_exact():
    rng = np.random.default_rng(0)
    sizes = rng.integers(0, 200, 12)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    score = -rng.exponential(6, (bounds[-1], 3))
    label = language_id.viterbi(score, bounds, 9.0)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if a < b:
            best = score[a].copy()
            for t in range(a + 1, b):
                best = np.maximum(best, best.max() - 9) + score[t]
            own = score[np.arange(a, b), label[a:b]].sum() - 9 * (np.diff(label[a:b]) != 0).sum()
            assert abs(own - best.max()) < 1e-6


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("cell", "most", "hot"), [(512, 4 << 20, 1024), (2, 900, 1)])
def test_ngram_join(docs, rows, cell, most, hot, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL_DOCS", cell)
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", most)
    sets = [(10**9 if r[0] is None else r[0], shingles(r[1])) for r in rows]
    component = {i: i for i, _ in sets}
    for _ in range(4):
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    component[i] = component[j] = min(component[i], component[j])
    want = sorted((i, len(s), component[i]) for i, s in sets)
    got = sorted((10**9 if r[0] is None else r[0], r[1], 10**9 if r[2] is None else r[2]) for r in ngram_join.classes(docs).collect())
    assert got == want
    if cell == 512:
        kept = ngram_join.keep_first(docs)
        assert kept.columns == docs.columns and kept.count() == len(set(component.values()))


def test_components_of_long_chains(spark, tmp_path):
    rng = random.Random(9)
    order = list(range(300))
    rng.shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(299) if i % 100 != 99] + [(1000 + i, 1000) for i in range(50)] + [(7, 7)]
    ws = ngram_join.Workspace(spark, "chains")
    got = {r["node"]: r["label"] for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long"), ws, "c").collect()}
    want = {n: min(order[a : a + 100]) for a in (0, 100, 200) for n in order[a : a + 100]} | {1000 + i: 1000 for i in range(50)}
    assert got == want


def test_ngram_join_of_nothing(empty):
    assert ngram_join.classes(empty).count() == 0


def test_keep_first_tells_rows_of_one_id_apart(spark):
    rng = random.Random(15)
    a, b, *other = [english(rng, 60) for _ in range(8)]
    near = lambda t: t + " end"
    rows = [(1, near(b)), (5, a), (5, b)]  # an id that is first of one class and a near copy of a smaller id in another
    rows += [(7, t) for t in other[:3]] + [(None, t) for t in other[3:]] + [(None, near(other[3])), (9, None), (9, "")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, row string").repartition(3)
    got = ngram_join.keep_first(frame)
    assert got.columns == frame.columns
    got = [(r["doc_id"], r["text"]) for r in got.collect()]
    want = [r for r in rows if r not in ((5, b), (None, other[3]), (None, near(other[3])))]
    one = [r for r in got if r[1] in (other[3], near(other[3]))]
    assert len(one) == 1 and sorted(map(repr, got)) == sorted(map(repr, [*want, *one]))


@pytest.mark.parametrize("most", [4 << 20, 900])
def test_suffix_dedup(spark, docs, rows, empty, most, monkeypatch):
    """With blocks of 900 bytes a task holds many blocks, and the text of 4,000 words is larger than one."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", most)
    seen, want = {}, []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for i, t, *_ in order:
        b, i = (t or "").encode(), 10**9 if i is None else i
        for s in range(len(b) - 49):
            seen.setdefault(b[s : s + 50], i)
    for i, t, *_ in rows:
        b, k = (t or "").encode(), 10**9 if i is None else i
        gone = [False] * len(b)
        for s in range(len(b) - 49):
            if seen[b[s : s + 50]] < k:
                gone[s : s + 50] = [True] * 50
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        want.append((k, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    got = sorted((10**9 if r[0] is None else r[0], *r[1:]) for r in suffix_dedup.deduplicated(docs).collect())
    assert got == sorted(want)
    assert suffix_dedup.deduplicated(empty).count() == 0


def test_loser_tree_order_and_prefixes():
    rng = random.Random(2)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(50)) if rng.random() < 0.7 else b"a" * 50 for _ in range(rng.randrange(1, 40))) for _ in range(7)]
    coded = []
    for run in runs:
        shared, rest = suffix_dedup.front_code(np.array([list(x) for x in run], np.uint8))
        assert suffix_dedup.front_decode(shared, rest) == run
        coded.append((run, shared.tolist()))
    order, common = suffix_dedup.merge_runs(coded)
    every = [x for run in runs for x in run]
    out = [every[i] for i in order]
    assert out == sorted(every) and sorted(order) == list(range(len(every)))
    for k in range(1, len(out)):
        n = next((i for i in range(50) if out[k][i] != out[k - 1][i]), 50)
        assert common[k] == n


def test_language_model(docs, empty):
    scored = hmm_lm.fit_and_score(docs, hmm_lm.is_fold(docs["doc_id"], 5, 1), ~hmm_lm.is_fold(docs["doc_id"], 5, 1) & docs["doc_id"].isNotNull())
    got = scored.collect()
    rows = docs.select("doc_id", "text").collect()
    count = Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            count.update([*words(t), None])
    n, v = sum(count.values()), len(count)
    base = sorted((-1 if i is None else i, len(words(t)) + 1, sum(count[w] > 0 for w in [*words(t), None]), round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t), None]), 6)) for i, t in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == base
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 and r["train_tokens"] == n for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    none = empty.select("doc_id", "text")
    assert hmm_lm.fit_and_score(none, hmm_lm.is_fold(none["doc_id"], 5, 1), none["doc_id"].isNotNull()).count() == 0


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(3)
    s = hmm_lm.STATES
    model = {"emit": rng.dirichlet(np.ones(5), s).T, "move": rng.dirichlet(np.ones(s), s), "start": rng.dirichlet(np.ones(s))}
    seqs = [np.array([0, 3, 4]), np.array([2, 2, 1, 4]), np.array([4])]
    for seq, got in zip(seqs, hmm_lm.forward_log10(model, seqs)):
        total = np.zeros(1)
        paths = {(k,): model["start"][k] * model["emit"][seq[0], k] for k in range(s)}
        for x in seq[1:]:
            paths = {(*p, k): w * model["move"][p[-1], k] * model["emit"][x, k] for p, w in paths.items() for k in range(s)}
        total = sum(paths.values())
        assert abs(math.log10(total) - got) < 1e-5


@pytest.mark.parametrize(("window", "narrow"), [(2, 1), (2, 3), (2, 9), (128, 48)])
def test_expected_counts_are_those_of_all_paths(window, narrow, monkeypatch):
    monkeypatch.setattr(hmm_lm, "WINDOW", window)
    monkeypatch.setattr(hmm_lm, "NARROW", narrow)
    monkeypatch.setattr(hmm_lm, "TOGETHER", 3 * window)
    monkeypatch.setattr(hmm_lm, "STATES", 3)
    rng = np.random.default_rng(4)
    s, symbols = 3, hmm_lm.SYMBOLS
    model = {"emit": np.zeros((symbols, s)), "move": rng.dirichlet(np.ones(s), s), "start": rng.dirichlet(np.ones(s))}
    model["emit"][:5] = rng.dirichlet(np.ones(5), s).T
    seqs = [np.array(x, np.uint16) for x in ([0, 3, 4, 1, 1, 2, 0], [2, 2, 1, 4], [4], [1, 0, 3, 3, 2])]
    got = {"emit": np.zeros((symbols, s)), "move": np.zeros((s, s)), "start": np.zeros(s), "log": 0.0, "n": 0}
    hmm_lm.expected_counts(model, seqs, got)
    emit, move, start, log = np.zeros((symbols, s)), np.zeros((s, s)), np.zeros(s), 0.0
    for seq in seqs:
        paths = {(k,): model["start"][k] * model["emit"][seq[0], k] for k in range(s)}
        for x in seq[1:]:
            paths = {(*p, k): w * model["move"][p[-1], k] * model["emit"][x, k] for p, w in paths.items() for k in range(s)}
        whole = sum(paths.values())
        log += math.log(whole)
        for p, w in paths.items():
            start[p[0]] += w / whole
            for t, k in enumerate(p):
                emit[seq[t], k] += w / whole
                if t:
                    move[p[t - 1], k] += w / whole
    assert np.allclose(got["emit"], emit, atol=1e-4) and np.allclose(got["move"] * model["move"], move, atol=1e-4) and np.allclose(got["start"], start, atol=1e-4)
    assert abs(got["log"] - log) < 1e-4 and got["n"] == 17


def luhn(d):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - (9 if int(c) > 4 else 0) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out, t = [], t or ""
    out += [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        out += [(2, *m.span())] if 16 <= len(d) <= 19 and luhn(d) else []
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(out))


def test_pii(spark, empty):
    texts = [
        "a@b.c_d@e.f x@y.z.w", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004", "4952 9359 0025 3052 and 4952-9359-0025-3053", "+1 (017) 555-7713 +1.",
        "é" * 50 + "\U0001f600 mail@x.org", "9" * 30000, "a" * 3000 + "@", None, "", "x@y.z," * 300, "tel +1 (826) 555-4081 190.137.2.1",
    ]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in pii.find_spans(frame).select("doc_id", pii.spelled(pii.F.col("base")).alias("base"), pii.spelled(pii.F.concat("base", "added")).alias("every")).collect()}
    for i, t in enumerate(texts):
        assert got[i]["base"] == base_spans(t)
        assert set(base_spans(t).split(",")) <= set(got[i]["every"].split(",")) | {""}
    assert pii.find_spans(empty).count() == 0


def test_pii_counts_of_kinds(spark, tmp_path):
    texts = ["10.0.0.1 and 0.00.000.255", "a@b.c d@e.f 0000 0000 0000 0000", "+1 (826) 555-4081 a@b.c 1.2.3.4 1.2.3.4", "+1 (826) 555-4081", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in pii.op6_pii(spark, str(tmp_path)).collect():
        want = base_spans(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [want.count(f"{k}:") for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_em_learns_reliabilities():
    patterns = [("phone", "+++", 0)]
    patterns = [("phone", "++++", 80), ("phone", "0+0+", 30), ("phone", "----", 60), ("phone", "0-0-", 40)]
    post = pii.estimate(patterns)
    assert post["phone", "++++"] > 0.9 > 0.1 > post["phone", "----"]


@pytest.mark.parametrize("bucket", [4096, 24])
def test_topk(spark, bucket, monkeypatch):
    monkeypatch.setattr(topk_search, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(topk_search, "QUERY_ROWS", 2)
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(0, 1 + (i % 7), 6)], "x") for i in range(400)]
    rows += [(400, None, ""), (401, [1.0, None, 0.0], ""), (402, [float("nan")] * 6, ""), (403, [float("inf")] * 6, ""), (404, rows[3][1], ""), (500, rows[3][1], ""), (3, rows[3][1], "y"), (600, [], "")]
    rows += [(None, rows[200][1], ""), (500, rows[9][1], ""), (600, rows[9][1], "")]  # rows of one id are queries and candidates of their own, rows without one candidates
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = sorted(map(repr, map(tuple, topk_search.top_k(frame, topk_search.F.col("vec_id") % 100 == 0, 10).collect())))
    vec = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for n, (q, v) in enumerate(vec):
        if q is not None and q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), c is None, c or 0) for m, (c, w) in enumerate(vec) if m != n)[:10]
            want += [repr((q, k + 1, None if none else c, -s)) for k, (s, none, c) in enumerate(best)]
    assert got == sorted(want)
    assert topk_search.top_k(frame.limit(0), topk_search.F.col("vec_id") % 100 == 0).count() == 0


def test_topk_skips_short_vectors(spark, monkeypatch):
    """Lengths over many buckets: queries don't reach the groups of short vectors, and huge products are clamped."""
    monkeypatch.setattr(topk_search, "BUCKET_ROWS", 16)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 5) * 1.05 ** (400 - i)]) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk_search.top_k(frame, topk_search.F.col("vec_id") % 100 == 0, 3).collect())
    vec = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    want = []
    for q in (0, 100, 200, 300):
        best = sorted((-min(2**63 - 1, max(-(2**63), sum(a * b for a, b in zip(vec[q], vec[c])))), c) for c in vec if c != q)[:3]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == sorted(want)
    big = spark.createDataFrame([(0, [1e12, 1e12]), (1, [1e12, 1e12]), (2, [-1e12, -1e12])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk_search.top_k(big, topk_search.F.col("vec_id") == 0, 2).orderBy("rank").collect()] == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]


def test_urls(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [(i, f"https://h{i % 7}.org/x" if i % 3 else f"http://b{i % 4}.net/es/1", f"<a href=\"https://h{(i * 5 + 1) % 7}.org/q\"> <A class=x HREF='//b{i % 4}.net/z'>", 1) for i in range(60)]
    rows += [(100, None, None, 1), (101, "nourl", "", 1), (102, "http://X.COM/a?b", "<a href=/rel>", 1), (102, "http://X.COM/a?b", "<a href=/rel>", 1), (None, "x://www.Example.com/en/?q", None, 1)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    key = lambda rs: sorted(repr(tuple(r)) for r in rs)
    con = duckdb.connect()
    con.register("pages", frame.toPandas().astype({"page_id": "Int64"}))
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({url_filter.ORACLE_SQL})").fetchall()
    assert key(url_filter.judge(frame, url_filter.RULES).select("page_id", "host", "path", "rule", "verdict").collect()) == key(want)
    assert url_filter.judge(frame.limit(0), url_filter.RULES).count() == 0


def test_distrust_goes_along_long_chains(spark):
    """Hosts that lead to blocked ones over up to 30 links, one link each, with 90 blocked pages at the end."""
    rows = [(n, f"https://h{n}.org/", f'<a href="https://h{n + 1}.org/">') for n in range(30)] + [(30, "https://h30.org/", '<a href="https://bad.net/es/">')] + [(100 + n, "https://bad.net/es/x", "") for n in range(90)]
    got = {r["host"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), url_filter.RULES).collect()}
    for n in range(31):  # a host's distrust is what the seeds send back over its links
        assert got[f"h{n}.org"] == ("block" if 90 * 0.85 ** (31 - n) >= 0.5 else "allow"), n
    assert sum(v == "block" for h, v in got.items() if h != "bad.net") == 31 and 90 * 0.85**31 > 0.5


def descended(n, p, shares, rounds=4000):
    """Plain projected gradient with a small step, in NumPy: what the operator's steps must reach too."""
    r, goal = np.ones(len(n)), np.array(shares) * n.sum()
    for _ in range(rounds):
        gap = (n * r) @ p - goal
        r = np.maximum(0.0, r - 0.5 * p @ (gap / (n @ p)))
    return r, np.abs((n * r) @ p - goal).max() / n.sum()


def test_mixing(spark, docs, empty):
    rng = random.Random(4)
    rows = [(i, english(rng, 50) + (" vile vile" if i % 5 == 0 else " kind"), i % 5 == 0) for i in range(200)] + [(200, None, False), (201, "", False), (7, english(rng, 50) + " kind", False)]
    frame = spark.createDataFrame([(i, t, "en", 1, 2.0, "f", "w") for i, t, _ in rows], "doc_id long, text string, lang string, rate int, p double, features string, words string")
    labels = spark.createDataFrame([(i, 1, int(bad)) for i, _, bad in rows if i % 2], "doc_id long, quality int, toxic int").union(spark.createDataFrame([(i, 1, 1) for i in range(0, 100, 10)], "doc_id long, quality int, toxic int"))
    labels = labels.union(spark.createDataFrame([(3, 1, 1), (999, 0, 0), (None, 0, 1), (5, None, 0)], labels.schema))  # a tie of labels, no document, no id, no domain
    got = mixing.mix_documents(frame, labels)
    kept = {r["doc_id"] for r in got.select("doc_id").collect()}
    assert got.columns == frame.columns and got.filter("doc_id = 7").count() == 2
    assert not kept & {i for i, _, bad in rows if bad} and {i for i, _, bad in rows if not bad and i < 200} <= kept
    members, rate, gap = mixing.rates(frame, mixing.domain_labels(labels), {"good": 0.7, "low": 0.0, "toxic": 0.3}, mixing.Workspace(spark, "test"))
    got = members.select("n", "p", rate.alias("rate")).collect()
    total = sum(r["n"] for r in got)
    assert all(r["rate"] >= 0 for r in got) and gap < 1e-3
    assert abs(sum(r["n"] * r["rate"] * r["p"][2] for r in got) / total - 0.3) < 1e-3
    assert mixing.mix_documents(empty, labels).count() == 0
    assert mixing.mix_documents(docs, labels.limit(0)).columns == docs.columns


def test_a_round_of_the_fit_has_two_stages(spark):
    rng = random.Random(9)
    rows = [(i, english(rng, 30) + (" vile" if i % 3 == 0 else " kind"), "toxic" if i % 3 == 0 else "good") for i in range(360)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(36)
    labelled = spark.createDataFrame([(i, d) for i, _, d in rows], "doc_id long, domain string")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")  # a task for each file
    spark.sparkContext.setJobGroup("fit", "fit")
    model = mixing.train(docs, labelled, ["good", "toxic"], mixing.Workspace(spark, "fit"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    seen = spark.sparkContext.statusTracker()
    stages = [len(seen.getJobInfo(j).stageIds) for j in seen.getJobIdsForGroup("fit")]
    assert len(stages) > 20 and sum(n > 2 for n in stages) < 5
    got = model.with_posterior(docs.withColumn("words", mixing.tokens_of(mixing.F.col("text")))).select("doc_id", "p").collect()
    assert len(got) == 360 and all((r["p"][1] > 0.5) == (r["doc_id"] % 3 == 0) for r in got)


@pytest.mark.parametrize("shares", [[0.88, 0.11, 0.01], [0.1, 0.2, 0.7], [1.0, 0.0, 0.0]])
def test_rates_of_three_overlapping_domains(spark, shares):
    rng = np.random.default_rng(2)
    n, p = rng.integers(1, 900, 3000).astype(float), rng.dirichlet([2.0, 0.5, 0.3], 3000)
    members = spark.createDataFrame([(float(a), [float(x) for x in b]) for a, b in zip(n, p)], "n double, p array<double>").cache()
    steps, gap = mixing.fit_rates(members, 3, shares, mixing.Workspace(spark, "rates"))
    got = np.array([r[0] for r in members.select(mixing.rate_of(mixing.F.col("p"), steps)).collect()])
    left = np.abs((n * got) @ p - np.array(shares) * n.sum()).max() / n.sum()
    assert abs(left - gap) < 1e-9 and (got >= 0).all()
    assert gap <= descended(n, p, shares)[1] * 1.02 + 1e-3 if min(shares) > 0 else gap < 0.02
    for d in range(3):
        if min(shares) > 0:
            assert abs((n * got) @ p[:, d] / n.sum() - shares[d]) <= min(1e-3, 0.02 * shares[d])


def test_decontamination(spark, docs, empty):
    rng = random.Random(6)
    alphabet = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(alphabet) for _ in range(n))
    items = [(i, text(30)) for i in range(20)] + [(20, None), (21, "too short"), (None, text(30))]
    reworded = items[1][1].split()
    for k in (3, 9, 14):
        reworded[k] = "other"
    plain = [(i, text(300)) for i in range(40)]
    leaky = [(100, text(77) + " " + items[0][1].upper() + ". " + text(90)), (101, text(10) + " " + " ".join(reworded) + " " + text(50)), (102, items[2][1]), (103, text(3000) + " " + items[3][1])]
    frame = spark.createDataFrame([*plain, *leaky, (104, None), (105, ""), (102, items[2][1]), (None, items[4][1])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r["doc_id"], r["contaminated"], r["item_id"]) for r in decontaminate.contamination(frame, bench).collect()]
    assert sorted((-1 if i is None else i, k) for i, bad, k in got if bad) == [(-1, 4), (100, 0), (101, 1), (102, 2), (102, 2), (103, 3)]
    assert decontaminate.drop_contaminated(frame, bench).count() == 42
    assert decontaminate.contamination(frame, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0


def test_driver_holds_few_matrices(spark):
    rng = random.Random(16)
    alphabet = ["".join(rng.choice(string.ascii_lowercase) for _ in range(5)) for _ in range(900)]
    frame = spark.createDataFrame([(i, " ".join(rng.choice(alphabet) for _ in range(60))) for i in range(60)], "item_id long, text string")
    tracemalloc.start()
    basis = decontaminate.fit(frame, frame.limit(20), decontaminate.Workspace(spark, "fit"))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert basis.shape == (decontaminate.TERMS, decontaminate.RANK + 1) and np.isfinite(basis).all() and basis[:, 0].any()
    assert most < 3 * 4 * decontaminate.TERMS * (decontaminate.RANK + decontaminate.EXTRA)


def test_decontamination_of_many_items(spark):
    rng = random.Random(16)
    alphabet = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(4000)]
    text = lambda n: " ".join(rng.choice(alphabet) for _ in range(n))
    items = [(i, text(rng.randrange(20, 70))) for i in range(12 * decontaminate.RANK)]
    leaks = rng.sample(range(len(items)), 120)

    def reworded(k):
        w = items[k][1].split()
        for at in rng.sample(range(len(w)), len(w) // 6):
            w[at] = rng.choice(alphabet)
        return " ".join(w)

    leaky = [(1000 + n, text(rng.randrange(60)) + " " + (reworded(k) if n % 2 else items[k][1]) + " " + text(rng.randrange(60))) for n, k in enumerate(leaks)]
    frame = spark.createDataFrame([(i, text(200)) for i in range(100)] + leaky, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["item_id"] for r in decontaminate.contamination(frame, bench).collect() if r["contaminated"]}
    assert sum(got.get(1000 + n) == k for n, k in enumerate(leaks)) >= 0.9 * len(leaks)
    assert not any(i < 1000 for i in got)


def test_blocks_of_items_give_the_same_verdicts(spark, monkeypatch):
    rng = random.Random(19)
    alphabet = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(alphabet) for _ in range(n))
    items = [(i, text(rng.randrange(12, 40))) for i in range(40)]
    frame = spark.createDataFrame([(i, text(60), "x") for i in range(50)] + [(100 + i, text(20) + " " + items[i][1] + " " + text(9), "y") for i in range(20)] + [(100, items[39][1], "z")], "doc_id long, text string, v string")
    bench = spark.createDataFrame([*items, items[3]], "item_id long, text string")
    one = sorted(tuple(r)[:3] for r in decontaminate.contamination(frame, bench).collect())
    assert [(r[0], r[2]) for r in one if r[1]] == sorted([(100 + i, i) for i in range(20)] + [(100, 39)])
    monkeypatch.setattr(decontaminate, "BLOCK", 9)
    assert sorted(tuple(r)[:3] for r in decontaminate.contamination(frame, bench).collect()) == one
    kept = decontaminate.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(50))


def test_retrieval_loses_no_paraphrase(spark):
    """Against the verifier on every stretch of every text: what it finds, retrieval finds too."""
    rng = random.Random(20)
    alphabet = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(1500)]
    text = lambda n: " ".join(rng.choice(alphabet) for _ in range(n))
    items = [(i, text(rng.randrange(15, 60))) for i in range(60)]

    def reworded(share):
        w = rng.choice(items)[1].split()
        for at in rng.sample(range(len(w)), int(len(w) * share)):
            w[at] = rng.choice(alphabet)
        return " ".join(w)

    texts = [text(rng.randrange(50)) + " " + reworded(share) + " " + text(rng.randrange(50)) for share in (0, 0.1, 0.19, 0.3) for _ in range(60)] + [text(120) for _ in range(60)]
    want = set()
    known = [decontaminate.hashed_words(t).tolist() for _, t in items]
    for n, t in enumerate(texts):
        w = decontaminate.hashed_words(t).tolist()
        if any(decontaminate.verified(i, w[a : a + 2 * len(i)])[1] for i in known for a in range(0, len(w), 8)):
            want.add(n)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in decontaminate.contamination(frame, spark.createDataFrame(items, "item_id long, text string")).collect() if r["contaminated"]}
    assert len(want) > 180 and len(got & want) >= 0.95 * len(want) and all(n < 240 for n in got)


def test_words_are_hashed_alike_in_pieces(monkeypatch):
    rng = random.Random(21)
    texts = ["", "One  two", "über-Straße x" * 9, "...", " ".join("w" * rng.randrange(1, 40) for _ in range(300)), "z" * 700]
    whole, sizes = decontaminate.hashed_texts(texts)
    assert sizes.tolist() == [len(re.findall(r"[a-z0-9\u0080-\uffff]+", t.lower())) for t in texts]
    monkeypatch.setattr(decontaminate, "PIECE_BYTES", 50)
    again, same = decontaminate.hashed_texts(texts)
    assert (whole == again).all() and (sizes == same).all()
    assert (np.concatenate([decontaminate.hashed_words(t) for t in texts]) == whole).all()


def test_rare_words_in_slices(monkeypatch):
    rng = random.Random(22)
    alphabet = [f"w{k}" for k in range(3000)]
    items = [decontaminate.hashed_words(" ".join(rng.choice(alphabet) for _ in range(rng.randrange(10, 50)))) for _ in range(30)]
    rare = decontaminate.rare_words(items, np.arange(30), np.ones(decontaminate.TERMS))
    texts = [np.concatenate([np.array([1] * rng.randrange(0, 200), np.uint64), items[k], np.array([2] * rng.randrange(90), np.uint64)]) for k in range(30)]
    sizes = np.array([len(t) for t in texts])
    words = np.concatenate(texts)
    for size in (decontaminate.SLICE, 64):
        monkeypatch.setattr(decontaminate, "SLICE", size)
        begin = np.cumsum(sizes) - sizes
        found = {(t, i) for t, i, a, b in decontaminate.rare_candidates(words, (words & np.uint64(decontaminate.TERMS - 1)).astype(np.int64), sizes, rare) if decontaminate.lcs(items[i].tolist(), words[begin[t] + a : begin[t] + min(b, sizes[t])].tolist()) == len(items[i])}
        assert {(k, k) for k in range(30)} <= found


def test_lcs():
    rng = random.Random(8)
    for _ in range(50):
        a, b = [rng.randrange(6) for _ in range(rng.randrange(1, 30))], [rng.randrange(6) for _ in range(rng.randrange(0, 40))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(a, b) == t[-1][-1]


def test_sharding(spark, docs, rows, empty, tmp_path):
    path = f"file://{tmp_path}/map"
    got = sharding.shard_records(docs, 8, path).collect()
    assert len(got) == len(rows)
    load, slots, home = Counter(), {}, {}
    for r in got:
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert home.setdefault(r["vslot"], r["shard"]) == r["shard"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) < 30_000  # one text of 4,000 words
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.stored_versions(spark, path) == [0, 1]
    first, second = sharding.load_map(spark, path, 0), sharding.load_map(spark, path)
    assert (first.version, second.version) == (0, 1) and first.shards == sharding.initial_map(8).shards
    with pytest.raises(ValueError, match="no version 7"):
        sharding.load_map(spark, path, 7)
    sharding.shard_records(docs.filter("doc_id < 30"), 8, path).collect()  # edits the newest map
    third = sharding.load_map(spark, path)
    assert third.version == 2 and sum(a != b for a, b in zip(second.shards, third.shards)) < 60
    assert sharding.shard_records(empty, 8, f"file://{tmp_path}/none").count() == 0
    assert sharding.load_map(spark, f"file://{tmp_path}/none").shards == sharding.initial_map(8).shards


def test_a_hot_id_is_spread_over_shards(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(sharding, "RANKED", 3)
    rows = [(7 if i % 3 else None, f"text {i}") for i in range(600)] + [(i, "other text") for i in range(100, 400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sharding.shard_records(frame, 8, f"file://{tmp_path}/map").collect()
    load, slots = Counter(), {}
    for r in got:
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sum(len(s) for s in slots.values()) == 900 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) <= 64


def test_maps_move_few_slots():
    weight = {s: 100 + (s * 37) % 50 for s in range(4096)}
    first = sharding.initial_map(8)
    second = sharding.rebalance(first, weight)
    load = second.loads(weight)
    assert max(load) - min(load) <= 0.001 * sum(load) / 8 and len(second.moved) < 400
    third = sharding.grow(second, weight)
    assert all(third.shards[s] == 8 for s in third.moved) and abs(third.loads(weight)[8] / (sum(weight.values()) / 9) - 1) < 0.05


def test_a_map_shrinks_and_unfinished_versions_stand_in_nobodys_way(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(2000)], "doc_id long, text string")
    path = f"file://{tmp_path}/map"
    sharding.shard_records(docs, 8, path).count()
    before = sharding.load_map(spark, path)
    (tmp_path / "map" / "version=2").mkdir()  # a write that was cut short
    got = {r["shard"]: r["n"] for r in sharding.shard_records(docs, 4, path).groupBy("shard").agg(sharding.F.sum("size").alias("n")).collect()}
    assert set(got) == {0, 1, 2, 3} and max(got.values()) - min(got.values()) < 60
    assert sharding.stored_versions(spark, path)[:3] == [0, 1, 3] and sharding.load_map(spark, path).n_shards == 4
    gone = sharding.shrink(before, {s: 1 for s in range(4096)})
    assert all((a == b) == (b != 7) for a, b in zip(gone.shards, before.shards, strict=True)) and max(gone.shards) == 6
    sharding.shard_records(docs, 5, path).count()
    assert {sharding.load_map(spark, path, v).n_shards for v in sharding.stored_versions(spark, path)} == {4, 5, 6, 7, 8}


def test_the_sample_is_bounded_whatever_the_ids(spark):
    ids = sharding.F.when(sharding.F.col("id") % 3 > 0, sharding.F.col("id"))
    docs = spark.range(60_000).select(ids.alias("doc_id"), sharding.F.when(sharding.F.col("id") % 3 > 0, sharding.F.col("id").cast("string")).otherwise("copy").alias("text"))
    n = decontaminate.sampled(docs.select("text")).count()
    assert 0.8 * decontaminate.SAMPLE < n <= 2 * decontaminate.SAMPLE
    assert decontaminate.sampled(docs.select("text").limit(5)).count() == 5 and decontaminate.sampled(docs.select("text").limit(0)).count() == 0
