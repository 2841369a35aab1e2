"""The corpus pipeline, stage by stage, on a small folder of tables against plain Python."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from tarnfold.llm import decontaminate, language_id, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, p double, words string, doc string, row long"


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(31)
    make = lambda letters: ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 8))) for _ in range(500)]
    english, other = make("etaoinshr"), make("äöüßdbkzw")
    items = [(i, sentence(rng, english, 30)) for i in range(15)]
    rows = []
    for i in range(160):
        bad = i % 4 == 0
        rows.append((i, sentence(rng, english if i % 2 else other, rng.randrange(60, 90)) + (" vile vile vile" if bad else " kind"), "en" if i % 2 else "xx"))
    rows += [(200 + k, rows[k][1] + " end", rows[k][2]) for k in (1, 2, 3)]  # near copies of smaller ids
    rows += [(210, rows[5][1], "en"), (211, sentence(rng, english, 40) + " " + items[3][1] + " " + sentence(rng, english, 40), "en"), (212, items[4][1].upper(), "en")]
    rows += [(220, None, None), (221, "", None), (222, "12 34 !!", None), (None, sentence(rng, english, 70) + " kind", "en")]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(0, 130)] + [(999, 0, 1)]
    base = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, lang, "s", len(t or ""), 5, 0.5, "w", "d", 7) for i, t, lang in rows], SCHEMA).repartition(3).write.parquet(f"file://{base}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{base}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{base}/labels.parquet")
    return f"file://{base}", rows, items, spark


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_stages(folder):
    path, rows, items, spark = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = rows
    key = lambda i: -1 if i is None else i
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        got = out.collect()
        if name == "language_id":
            found = {key(r["doc_id"]): r for r in language_id.predict(docs).collect()}
            kept = [r for r in kept if found[key(r[0])]["lang_pred"] != "und" and found[key(r[0])]["score"] >= 0.5]
            assert not {220, 221, 222} & {r[0] for r in kept} and len(kept) > 160
        elif name == "ngram_jaccard_join":
            sets = [(r, shingles(r[1])) for r in kept]
            first = [r for r, a in sets if not any(a and b and 100 * len(a & b) >= 80 * len(a | b) and (key(o[0]) if o[0] is not None else 10**9) < (key(r[0]) if r[0] is not None else 10**9) for o, b in sets)]
            assert len(kept) - len(first) == 4
            kept = first
        elif name == "decontamination":
            known = [decontaminate.hashed_words(t).tolist() for _, t in items]
            words = {r[0]: decontaminate.hashed_words(r[1]).tolist() for r in kept}
            clean = [r for r in kept if not any(decontaminate.verified(i, words[r[0]][a : a + 60])[1] for i in known for a in range(0, len(words[r[0]]), 8))]
            assert {r[0] for r in kept} - {r[0] for r in clean} == {211, 212}
            kept = clean
        elif name == "mixing":
            assert {key(r["doc_id"]) for r in got} == {key(i) for i, t, _ in kept if "vile" not in t}
            kept = [r for r in kept if "vile" not in r[1]]
        assert sorted(key(r["doc_id"]) for r in got) == sorted(key(r[0]) for r in kept), name
        assert out.columns[: len(columns)] == columns if name != "sharding" else set(columns) <= set(out.columns)
        docs = spark.createDataFrame(got, out.schema).repartition(3) if name != "sharding" else out
    load = Counter()
    for r in got:
        load[r["shard"]] += len((r["text"] or "").encode()) + 1
    assert max(load.values()) - min(load.values()) <= max(len((r["text"] or "").encode()) + 1 for r in got)
    assert len({(r["vslot"], r["shard"]) for r in got}) == len({r["vslot"] for r in got})


def test_run_gives_the_rows_of_its_stages(folder):
    path, rows, _, spark = folder
    got = corpus_pipeline.run(spark, path)
    ids = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in got.collect())
    assert 211 not in ids and 220 not in ids and 210 not in ids and -1 in ids and 80 < len(ids) < 150 and {"vslot", "shard"} <= set(got.columns)
    assert sharding.N_SLOTS == 4096


def test_empty_tables(folder, spark, tmp_path):
    path = folder[0]
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{path}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
