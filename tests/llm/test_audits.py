"""Line frequency, filter overlap and Merkle trees against plain versions, with nulls, repeats, ties, empty and long texts, hot keys and clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tarnfold.llm import filter_audit, merkle, quality_rules
from tarnfold.llm.workspace import Workspace

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, row int, kept string, part string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
H = lambda s: sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice("alpha Beta gamma delta épsilon Zeta 12 7 eta* theta".split()) for _ in range(n))
    out = []
    for i in range(90):
        lines = [say(rng.randint(0, 40)) for _ in range(rng.randint(1, 4))]
        lines += ["  Read MORE\tnow 1", "© 2024 All  rights"] if i % 3 else ["read more now 22 "] * 2
        out.append((i, rng.choice(["a", "a", "b", None, ""]), rng.choice(["en", "en", "de", "é", "", None]), "\n".join(lines)))
    out += [(200 + i, "a", "en", "read more now 3\nall copies say this and that and no more of it") for i in range(40)]
    out += [(300, "a", "de", out[3][3]), (3, "b", "en", out[3][3]), (3, "b", "en", out[3][3]), (None, "a", None, out[3][3]), (None, "a", None, None), (400, None, "fr", ""), (401, "a", "de", "a b c d e a b c d e a b c d e f"), (402, "a", "en", say(30_000))]
    return [(i, s, lang, None if i == 7 else len(t or ""), t, 5, "no", "p") for i, s, lang, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_quality(rows, least=quality_rules.LEAST_DOCS, share=quality_rules.SHARE):
    normal = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]+", "0", x.lower())).strip(" ")
    held, hosts = defaultdict(set), defaultdict(set)
    for r in rows:
        t, host = r[4] or "", r[1] or ""
        hosts[host].add(t)
        for x in t.split("\n"):
            if normal(x):
                held[host, normal(x)].add(t)
    often = {k for k, v in held.items() if len(v) > least and len(v) > share * len(hosts[k[0]])}
    out = []
    for r in rows:
        t, host = r[4] or "", r[1] or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        count = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for k in range(5)}
        gone = sum(len(WORD.findall(x)) for x in lines if (host, normal(x)) in often)
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        left = "\n".join(x for x in t.split("\n") if (host, normal(x)) not in often)
        kept = not failed and not (gone and (len(w) - gone < 0.5 * len(w) or len(w) - gone < 10))
        out.append((r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed, kept, gone, left))
    return out


def test_quality(spark, docs, rows, empty, monkeypatch):
    monkeypatch.setattr(quality_rules, "GROUP", 300)
    got = quality_rules.judged(Workspace(spark, "quality"), docs).select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed").collect()
    want = plain_quality(rows)
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(w[:-1]) for w in want)
    assert any(w[8] for w in want) and any(not w[6] and not w[7] for w in want)
    cleaned = quality_rules.clean(Workspace(spark, "clean"), docs)
    assert cleaned.columns == docs.columns
    assert sorted(repr((r["doc_id"], r["text"] or "", r["row"], r["kept"])) for r in cleaned.collect()) == sorted(repr((w[0], w[-1], 5, "no")) for w in want if w[7])
    assert quality_rules.judged(Workspace(spark, "none"), empty).count() == 0 and quality_rules.clean(Workspace(spark, "none"), empty).count() == 0


def test_copies_are_one_document_and_hosts_have_their_own_limits(spark):
    long = " ".join(f"w{i}" for i in range(30))
    copies = [(i, "big", "en", 1, f"Shared line of a copy\n{long}", 0, "", "") for i in range(50)]
    other = [(100 + i, "small" if i < 11 else "big", "en", 1, f"Menu {i}\n{long} {str(i).translate(str.maketrans('0123456789', 'abcdefghij'))}", 0, "", "") for i in range(11 + 200)]
    got = {r["doc_id"]: r["removed"] for r in quality_rules.judged(Workspace(spark, "copies"), spark.createDataFrame(copies + other, SCHEMA)).select("doc.doc_id", "removed").collect()}
    assert all(got[i] == 0 for i in range(50)) and all(got[100 + i] == 2 for i in range(211))


def test_repeated_words_of_very_long_texts():
    words = [b"%d" % (i % 7001) for i in range(40_000)]
    assert quality_rules.repeats([words, [b"a"] * 4, [], [b"x"] * 6]) == [40_000, 0, 0, 6]
    assert quality_rules.repeats([[], []]) == [0, 0] and quality_rules.repeats([[b"1", b"2"], [b"3", b"4", b"5"]]) == [0, 0]


def plain_audit(rows, labels):
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[4] or ""] = min(r[0], least.get(r[4] or "", r[0]))
    masks = defaultdict(Counter)
    for r in rows:
        t = r[4] or ""
        w = WORD.findall(t)
        mask = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": r[0] is not None and r[0] > least[t]}
        masks[r[2] or ""][tuple(k for k in "ABCDE" if mask[k]), r[0] in good, r[0] in toxic] += 1
    out = []
    for part, cells in masks.items():
        lines, sums = [], Counter()
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order):
                row = Counter()
                for (fails, g, x), n in cells.items():
                    before = any(e in fails for e in order[:step])
                    row["redundant" if before and f in fails else "removed" if f in fails else "kept" if not before else "gone"] += n
                    row["unique"] += n * (fails == (f,))
                    row["good"] += n * (f in fails and not before and g)
                    row["toxic"] += n * (f in fails and not before and x)
                sums[f] += row["removed"]
                lines.append((order, step + 1, f, row))
        out += [(part, o, s, r["kept"], r["removed"], r["redundant"], r["unique"], r["good"], r["toxic"], sums[f]) for o, s, f, r in lines]
    return out


def test_filter_overlap(spark, docs, rows, empty):
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 80, 2)] + [(3, 1, None), (3, None, 1), (None, 1, 1), (300, 0, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, table)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == sorted(plain_audit(rows, labels))
    assert filter_audit.audit(empty, table).count() == 0
    assert sorted(map(tuple, filter_audit.audit(docs, table.limit(0)).collect())) == sorted(plain_audit(rows, []))


def test_filter_sums_are_those_of_shapley(spark, docs):
    """Over all orders, each document's removal is shared by the filters that it fails."""
    got = filter_audit.audit(docs, docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic"))
    per = got.groupBy("part", "filter_order").agg(F.sum("removed").alias("gone"), F.min("kept").alias("left")).groupBy("part").agg(F.min("gone").alias("a"), F.max("gone").alias("b"), F.max("left").alias("left")).collect()
    total = {r["part"]: r["s"] for r in got.select("part", F.substring("filter_order", F.col("step"), F.lit(1)).alias("f"), "shapley").distinct().groupBy("part").agg(F.sum("shapley").alias("s")).collect()}
    assert all(r["a"] == r["b"] and total[r["part"]] == 120 * r["a"] for r in per)


def plain_tree(leaves):
    """Root and each leaf's siblings, level by level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, a in enumerate(at):
            first = a - a % merkle.BASE
            paths[i] += [level[s] for s in range(first, min(first + merkle.BASE, len(level))) if s != a]
            at[i] = a // merkle.BASE
        level = [H("".join(level[a : a + merkle.BASE])) for a in range(0, len(level), merkle.BASE)]
    return level[0], paths


def plain_manifest(rows):
    f = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: H("".join(map(f, (r[0], r[1], r[2], None if r[3] is None else r[3] + more, r[4]))))
    trees = defaultdict(list)
    for r in rows:
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), leaf(r, 1) if bad else None))
    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    done = {k: plain_tree([x[2] for x in sorted(trees[k], key=lambda x: x[:3])]) for k in names}
    root, up = plain_tree([done[k][0] for k in names])
    out = []
    for n, k in enumerate(names):
        for x, path in zip(sorted(trees[k], key=lambda x: x[:3]), done[k][1]):
            fine = x[3] is None or x[3] == x[2]
            out.append((x[1] if x[0] else None, x[2], done[k][0], root, H("".join(path + up[n])), fine))
    return out


@pytest.mark.parametrize(("base", "span"), [(2, 12), (2, 2), (3, 1), (16, 1)])
def test_manifest(spark, docs, rows, empty, base, span, monkeypatch):
    monkeypatch.setattr(merkle, "BASE", base)
    monkeypatch.setattr(merkle, "SPAN", span)

    def manifest(rows):
        chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
        trees, top = merkle.manifest(Workspace(spark, "manifest"), rows, tampered=F.when(chosen, merkle.leaf(n_chars=F.col("n_chars") + 1)))
        out = merkle.proven(trees, top)
        text = lambda c: F.lower(F.hex(c)).alias(c)
        return trees, top, out.select("doc_id", text("digest"), text("subroot"), text("root"), text("path"), "tampered", "at", "n", "top_at", "top_n").collect()

    trees, top, got = manifest(docs)
    want = plain_manifest(rows)
    assert sorted(repr((r["doc_id"], r["digest"], r["subroot"], r["root"], H(r["path"]))) for r in got) == sorted(repr(w[:5]) for w in want)
    for r in got:
        for digest, same in ((r["digest"], True), *([] if r["tampered"] is None else [(r["tampered"].hex(), r["doc_id"] == 7)])):
            subroot, rest = merkle.fold(digest, r["at"], r["n"], r["path"], base)
            folded, rest = merkle.fold(subroot, r["top_at"], r["top_n"], rest, base)
            assert rest == "" and (folded == r["root"]) == same
    sizes = Counter(r[2] for r in rows)
    nodes = Counter()
    for n in sizes.values():
        level = 0
        nodes[level] += n
        while n > 1:
            n, level = -(-n // base), level + 1
            nodes[level] += n
    assert {r["level"]: r["count"] for r in trees.records().groupBy("level").count().collect()} == dict(nodes)
    if span == 12:
        assert manifest(empty)[2] == []


def test_stacks_over_any_cut_of_the_leaves_give_the_same_root():
    rng = random.Random(1)
    for n in (*range(1, 20), 33, 64, 100):
        leaves = [H(str(i)) for i in range(n)]
        nodes = [(0, i, d) for i, d in enumerate(leaves)]
        while len(nodes) > 1:
            cut = sorted(rng.sample(range(1, len(nodes)), min(len(nodes) - 1, rng.randint(0, 3))))
            met = []
            for a, b in zip([0, *cut], [*cut, len(nodes)], strict=True):
                known, _ = merkle.climb(nodes[a:b], n, 2)
                met += [(*peak, known[peak]) for peak in dict.fromkeys(merkle.passed((k, j), known, n, 2)[0] for k, j, _ in nodes[a:b])]
            nodes = met
        assert nodes[0][2] == plain_tree(leaves)[0]
