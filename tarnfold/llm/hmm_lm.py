"""Hidden Markov language model over words.

The alphabet is the `VOCAB` most frequent training words (exact counts over all
training texts), eight classes of rarer words by length and script, and the end of a
text. Baum-Welch starts from the word frequencies, perturbed for each state. Every round
is a Spark job over whole texts: tasks add up expected counts, which are summed by
symbol. The first rounds tell the states apart on a 16th and then a quarter of the
training texts, taken by a hash and so growing with them; the others take all. On each,
rounds go on until the likelihood of a token gains less than `SETTLED` nats. The scaled forward recursion then
gives the exact likelihood of every whole text. A rare word also pays its smoothed
probability within its class, so the score is the probability of the text's words
themselves.

Texts are worked through side by side, word by word, longest first. Where few are left,
they are cut into windows of `WINDOW` words, side by side again: what a window does to
any state before it is one small matrix, and their products along a text give the states
at its windows' edges, from both ends. So likelihoods and counts are those of whole
texts, and a very long text takes no more steps than others.

Frequent words are looked up in a table of fixed size that every task holds; only
rarer ones are shuffled, so no word's rows gather in one task.

Defined cases: a null text is an empty one and scores its end alone; a null id is
scored but neither held out nor learnt from; repeated rows are scored one by one;
with no training texts all counts are 0; very long words count like others and are
never in the table of frequent words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.llm.workspace import Workspace, is_fold

STATES, VOCAB, WORD_BYTES = 8, 32_000, 64
RARE, END = VOCAB, VOCAB + 8
SYMBOLS = END + 1
WINDOW, TOGETHER, NARROW = 128, 1 << 19, 48  # words of a window, words side by side, texts below which windows are
SHARES, ROUNDS, SETTLED = (16, 4, 1), 50, 0.01
FLUSH = 400_000
LN10 = np.log(10.0)


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8 bytes: bytes.lower touches A-Z alone, bytes.split cuts at the six blanks of the contract."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def rare_class(word: bytes) -> int:
    return (min(len(word), 15) >> 2) * 2 + (not word.isascii())


def _rare_class(word: Column) -> Column:
    n = F.octet_length(word)
    return (F.shiftright(F.least(n, F.lit(15)), 2) * 2 + (n != F.length(word)).cast("int")).cast("int")


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter[bytes] = Counter()

    def out() -> pd.DataFrame:
        return pd.DataFrame({"token": pd.Series([w.decode("utf-8", "replace") for w in seen], dtype=object), "n": pd.Series(list(seen.values()), dtype="int64")})

    for pdf in batches:
        for text in pdf["text"]:
            seen.update(words_of(text))
            if len(seen) >= FLUSH:
                yield out()
                seen.clear()
    yield out()


def _encode(hot: dict[bytes, int]):
    """Rows to symbol sequences, and the rare words in them; each row gets a key of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = TaskContext.get().partitionId() << 40
        for pdf in batches:
            seqs, rares = [], []
            for text in pdf["text"]:
                words = words_of(text)
                ids = [hot.get(w, -1) for w in words]
                rare = [w for w, i in zip(words, ids, strict=True) if i < 0]
                seq = np.array([*ids, END], np.int32)
                if rare:
                    seq[seq < 0] = [RARE + rare_class(w) for w in rare]
                seqs.append(seq.astype(np.uint16).tobytes())
                rares.append([w.decode("utf-8", "replace") for w in rare])
            yield pd.DataFrame({"key": np.arange(key, key + len(pdf)), "doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "learn": pdf["learn"], "seq": seqs, "rare": rares})
            key += len(pdf)

    return run


def initial_model(unigram: np.ndarray, seed: int = 7) -> dict:
    """Sticky states whose emissions are the word frequencies, perturbed so that Baum-Welch can tell them apart."""
    rng = np.random.default_rng(seed)
    emit = (unigram + 1e-9)[:, None] * np.exp(rng.normal(0, 0.7, (len(unigram), STATES)))
    move = np.full((STATES, STATES), 0.2 / (STATES - 1)) + np.eye(STATES) * (0.8 - 0.2 / (STATES - 1))
    return {"emit": emit / emit.sum(axis=0), "move": move, "start": np.full(STATES, 1 / STATES)}


def batches_of(seqs: Iterable[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Neighbouring sequences of about TOGETHER words."""
    held: list[np.ndarray] = []
    size = 0
    for s in seqs:
        held.append(s)
        size += len(s)
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def no_counts() -> dict:
    """Expected emissions, moves and starts, and the log likelihood and number of what was read."""
    return {"emit": np.zeros((SYMBOLS, STATES)), "move": np.zeros((STATES, STATES)), "start": np.zeros(STATES), "log": 0.0, "n": 0}


class Windows:
    """The windows of long sequences under a model: the states at their edges, and the sequences' log likelihoods.

    A sequence goes on from the state `before` it, one row each. Windows lie longest first
    and are worked through in slices of about TOGETHER places, so that of a very long
    sequence only the edges are held whole.
    """

    def __init__(self, scaled: tuple, seqs: list[np.ndarray], before: np.ndarray) -> None:
        self.emit, self.most, self.move, _ = scaled
        states = len(self.move)
        self.flat = np.concatenate(seqs)
        sizes = np.array([len(s) for s in seqs])
        count = -(-sizes // WINDOW)
        head, owner = np.cumsum(count) - count, np.repeat(np.arange(len(seqs)), count)
        nth = np.arange(len(owner)) - head[owner]
        size = np.minimum(sizes[owner] - nth * WINDOW, WINDOW)
        order = np.argsort(-size, kind="stable")
        self.size, self.begin = size[order], ((np.cumsum(sizes) - sizes)[owner] + nth * WINDOW)[order]
        matrix, log = np.empty((len(order), states, states), np.float32), np.empty(len(order))
        for part in self.slices():
            matrix[part], log[part] = self._matrices(part, states)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.first = place[head]  # each sequence's first window
        self.enter, self.leave = np.empty((len(order), states), np.float32), np.ones((len(order), states), np.float32)
        falling = np.argsort(-count, kind="stable")
        running = np.searchsorted(-count[falling], -np.arange(int(count.max())), side="left").tolist()
        self.log, a = np.zeros(len(seqs)), before[falling]
        for w, m in enumerate(running):
            k = place[head[falling[:m]] + w]
            self.enter[k] = a[:m]
            a = np.matmul(a[:m, None, :], matrix[k])[:, 0]
            c = np.maximum(a.sum(axis=1), 1e-30)
            a = a / c[:, None]
            self.log[falling[:m]] += np.log(c) + log[k]
        for w in range(len(running) - 1, 0, -1):
            k = place[head[falling[: running[w]]] + w]
            x = np.matmul(matrix[k], self.leave[k][:, :, None])[:, :, 0]
            self.leave[place[head[falling[: running[w]]] + w - 1]] = x / np.maximum(x.max(axis=1, keepdims=True), 1e-30)

    def slices(self) -> Iterator[slice]:
        for a in range(0, len(self.size), TOGETHER // WINDOW):
            yield slice(a, a + TOGETHER // WINDOW)

    def opened(self, part: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """Symbols, which places are filled, emissions, and how many windows still run at each step."""
        size = self.size[part]
        step = np.arange(int(size[0]))
        symbols = self.flat[self.begin[part] + np.minimum(step[:, None], size - 1)]
        return symbols, step[:, None] < size, self.emit[symbols], np.searchsorted(-size, -step, side="left").tolist()

    def _matrices(self, part: slice, states: int) -> tuple[np.ndarray, np.ndarray]:
        """What each window does to the state before it, and the logarithm of what was divided out."""
        symbols, inside, b, alive = self.opened(part)
        matrix = self.move * b[0][:, None, :]
        log = np.where(inside, self.most[symbols], 0).sum(axis=0)
        for t in range(1, len(alive)):
            m = alive[t]
            matrix[:m] = (matrix[:m].reshape(-1, states) @ self.move).reshape(m, states, states) * b[t, :m, None, :]
            if t % 8 == 7 or t == len(alive) - 1:
                c = np.maximum(matrix.max(axis=(1, 2)), 1e-30)
                matrix /= c[:, None, None]
                log += np.log(c)
        return matrix, log

    def counted(self, total: dict) -> np.ndarray:
        """Add the windows' expected counts to `total`; gives what each sequence says of the state before it."""
        back, before = np.ascontiguousarray(self.move.T), np.empty_like(self.enter)
        for part in self.slices():
            symbols, inside, b, alive = self.opened(part)
            enter, leave, size = self.enter[part], self.leave[part], self.size[part]
            alpha, scale = np.zeros_like(b), np.ones(b.shape[:2], np.float32)
            a = enter
            for t, m in enumerate(alive):
                x = (a[:m] @ self.move) * b[t, :m]
                scale[t, :m] = np.maximum(x.sum(axis=1), 1e-30)
                a = alpha[t, :m] = x / scale[t, :m, None]
            last = alpha[size - 1, np.arange(len(size))]
            beta = leave / np.maximum((last * leave).sum(axis=1, keepdims=True), 1e-30)
            gamma = np.zeros_like(alpha)
            for t in range(len(alive) - 1, -1, -1):
                m = alive[t]
                gamma[t, :m] = alpha[t, :m] * beta[:m]
                x = b[t, :m] * beta[:m] / scale[t, :m, None]
                total["move"] += (alpha[t - 1, :m] if t else enter).T @ x
                beta[:m] = x @ back
            before[part] = beta
            add_emissions(total, symbols[inside], gamma[inside])
        return before[self.first]


def add_emissions(total: dict, symbols: np.ndarray, mass: np.ndarray) -> None:
    for s in range(mass.shape[1]):
        total["emit"][:, s] += np.bincount(symbols, weights=mass[:, s], minlength=len(total["emit"]))


def scaled_model(model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Emissions held against the greatest of their symbol, so that products stay far from 0; the logarithms of those; moves and starts."""
    most = np.maximum(model["emit"].max(axis=1), 1e-300)
    return (model["emit"] / most[:, None]).astype(np.float32), np.log(most), model["move"].astype(np.float32), model["start"].astype(np.float32)


class SideBySide:
    """Whole sequences under a model, longest first: step by step while NARROW or more of them still run, then by windows."""

    def __init__(self, model: dict, seqs: list[np.ndarray]) -> None:
        self.order = np.argsort([-len(s) for s in seqs], kind="stable")
        seqs = [seqs[i] for i in self.order]
        sizes = np.array([len(s) for s in seqs])
        self.scaled = scaled_model(model)
        emit, most, move, start = self.scaled
        narrow = int(sizes[min(NARROW, len(sizes)) - 1]) if len(sizes) >= NARROW else 0
        # The head ends where fewer than NARROW run on; a little beyond, if all end soon.
        steps = int(sizes[0]) if int(sizes[0]) - narrow <= WINDOW else max(1, narrow)
        self.alive = np.searchsorted(-sizes, -np.arange(steps + 1), side="left").tolist()
        head = np.minimum(sizes, steps)
        base = np.cumsum([0, *self.alive[:-1]])
        self.base = base.tolist()
        owner = np.repeat(np.arange(len(seqs)), head)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(head) - head, head)
        self.symbols = np.empty(len(owner), np.uint16)
        self.symbols[base[at] + owner] = np.concatenate([s[:steps] for s in seqs])
        self.b = emit[self.symbols]
        self.alpha, self.scale = np.empty_like(self.b), np.empty(len(self.b), np.float32)
        self.log, a = np.zeros(len(seqs)), None
        for t in range(steps):
            m, i, j = self.alive[t], self.base[t], self.base[t + 1]
            x = (start if a is None else a[:m] @ move) * self.b[i:j]
            c = np.maximum(x.sum(axis=1), 1e-30)
            a = self.alpha[i:j] = x / c[:, None]
            self.scale[i:j] = c
            self.log[:m] += np.log(c)
        self.log += np.bincount(owner, weights=most[self.symbols][base[at] + owner], minlength=len(seqs))
        left = self.alive[steps]
        self.tail = Windows(self.scaled, [s[steps:] for s in seqs[:left]], a[:left]) if left else None
        if left:
            self.log[:left] += self.tail.log

    def counted(self, total: dict) -> None:
        back = np.ascontiguousarray(self.scaled[2].T)
        beta = np.ones((self.alive[0], len(back)), np.float32)
        if self.tail is not None:
            beta[: self.alive[-1]] = self.tail.counted(total)
        gamma = np.empty_like(self.alpha)
        for t in range(len(self.alive) - 2, -1, -1):
            m, i, j = self.alive[t], self.base[t], self.base[t + 1]
            gamma[i:j] = self.alpha[i:j] * beta[:m]
            if t:
                x = self.b[i:j] * beta[:m] / self.scale[i:j, None]
                before = self.base[t - 1]
                total["move"] += self.alpha[before : before + m].T @ x
                beta[:m] = x @ back
        add_emissions(total, self.symbols, gamma)
        total["start"] += gamma[: self.alive[0]].sum(axis=0)


def expected_counts(model: dict, seqs: list[np.ndarray], total: dict) -> None:
    """Add the expected counts of whole sequences to `total`, by the scaled forward-backward recursion."""
    w = SideBySide(model, seqs)
    w.counted(total)
    total["log"] += float(w.log.sum())
    total["n"] += sum(map(len, seqs))


def maximised(total: dict, model: dict, unigram: np.ndarray) -> dict:
    """The M-step; every symbol keeps a share of its frequency in every state, so no text gets probability 0."""
    emit = total["emit"] + (0.5 + 2.0 * len(unigram) * unigram / max(unigram.sum(), 1e-300))[:, None] * 0.01
    move, start = total["move"] * model["move"] + 0.1, total["start"] + 0.1
    return {"emit": emit / emit.sum(axis=0), "move": move / move.sum(axis=1, keepdims=True), "start": start / start.sum()}


def _expect(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = no_counts()
        for part in batches_of(np.frombuffer(blob, np.uint16) for pdf in batches for blob in pdf["seq"]):
            expected_counts(shared.value, part, total)
        last = np.zeros((1, STATES))
        last[0, :2] = total["log"], total["n"]
        rows = np.concatenate([total["emit"], total["move"], total["start"][None], last])
        at = np.nonzero(rows.any(axis=1))[0]
        yield pd.DataFrame({"row": at, **{f"s{s}": rows[at, s] for s in range(STATES)}})

    return run


def baum_welch_round(seqs: DataFrame, model: dict, unigram: np.ndarray) -> tuple[dict, float | None]:
    """The next model, and the mean log likelihood of a token under the one before (None without any); what reaches the driver has a row per symbol and state at most."""
    shared = seqs.sparkSession.sparkContext.broadcast(model)
    cols = [f"s{s}" for s in range(STATES)]
    got = seqs.select("seq").mapInPandas(_expect(shared), "row long, " + ", ".join(f"{c} double" for c in cols)).groupBy("row").agg(*[F.sum(c).alias(c) for c in cols]).toPandas()
    shared.destroy()
    rows = np.zeros((SYMBOLS + STATES + 2, STATES))
    rows[got["row"].to_numpy(int)] = got[cols].to_numpy(float)
    log, n = rows[-1, :2]
    if not n:
        return model, None
    return maximised({"emit": rows[:SYMBOLS], "move": rows[SYMBOLS : SYMBOLS + STATES], "start": rows[SYMBOLS + STATES]}, model, unigram), float(log / n)


def baum_welch(seqs: DataFrame, unigram: np.ndarray, ws: Workspace) -> dict:
    """Rounds over growing shares until the likelihood settles on each. seqs has key and seq."""
    model = initial_model(unigram)
    for share in SHARES:
        part = seqs if share == 1 else ws.save(seqs.filter(F.pmod(F.xxhash64("key"), F.lit(share)) == 0), f"share{share}")
        before = None
        for _ in range(ROUNDS):
            model, now = baum_welch_round(part, model, unigram)
            if now is None or (before is not None and now - before < SETTLED):
                break
            before = now
        if share != 1:
            ws.drop(f"share{share}")
    return model


def forward_log10(model: dict, seqs: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each whole sequence by the scaled forward recursion."""
    out = []
    for part in batches_of(seqs):
        w = SideBySide(model, part)
        log = np.empty(len(part))
        log[w.order] = w.log
        out.append(log)
    return np.concatenate(out) / LN10 if out else np.zeros(0)


def _score(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, base, known = shared.value
        for pdf in batches:
            seqs = [np.frombuffer(b, np.uint16) for b in pdf["seq"]]
            flat = np.concatenate(seqs).astype(np.int64)
            at = np.concatenate(([0], np.cumsum([len(s) for s in seqs])[:-1]))
            yield pd.DataFrame({
                "key": pdf["key"], "doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "n_tokens": [len(s) for s in seqs],
                "hot_known": np.add.reduceat(known[flat], at), "hot_base": np.add.reduceat(base[flat], at), "path": forward_log10(model, seqs),
            })

    return run


def _most_frequent(counts: DataFrame) -> pd.DataFrame:
    """The VOCAB most frequent words. A histogram of counts first gives a floor, so that few rows are sorted."""
    level = F.floor(F.log2("n") * 16).cast("int")
    floor, above = 0, 0
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # at most 16 rows a doubling
        floor, above = r["level"], above + r["count"]
        if above >= VOCAB:
            break
    return counts.filter(level >= floor).orderBy(F.desc("n"), "token").limit(VOCAB).toPandas()


def fit_and_score(docs: DataFrame, held_out: Column, learn: Column, name: str = "lm") -> DataFrame:
    """Scores of every row of docs by a model of the rows for which `learn` holds."""
    spark = docs.sparkSession
    ws = Workspace(spark, name)
    rows = docs.select("doc_id", "text", held_out.alias("held_out"), F.coalesce(learn, F.lit(False)).alias("learn"))
    counts = ws.save(rows.filter("learn").select("text").mapInPandas(_count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")), "counts")
    hot = _most_frequent(counts.filter(F.octet_length("token") <= WORD_BYTES))
    by_class = {r["c"]: (r["n"], r["v"]) for r in counts.groupBy(_rare_class(F.col("token")).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    ends = rows.filter("learn").count()
    n_all, v_all = sum(n for n, _ in by_class.values()) + ends, sum(v for _, v in by_class.values()) + (ends > 0)
    rest = {c: list(by_class.get(c, (0, 0))) for c in range(8)}
    hot_bytes = [w.encode() for w in hot["token"]]
    for w, n in zip(hot_bytes, hot["n"], strict=True):
        rest[rare_class(w)][0] -= n
        rest[rare_class(w)][1] -= 1
    table = spark.sparkContext.broadcast({w: i for i, w in enumerate(hot_bytes)})
    encoded = ws.save(rows.mapInPandas(lambda it: _encode(table.value)(it), "key long, doc_id long, held_out boolean, learn boolean, seq binary, rare array<string>"), "encoded")

    unigram = np.zeros(SYMBOLS)
    unigram[: len(hot)] = hot["n"]
    unigram[RARE:END] = [rest[c][0] for c in range(8)]
    unigram[END] = ends
    model = baum_welch(encoded.filter("learn").select("key", "seq"), unigram / max(1, unigram.sum()), ws)

    denominator = n_all + 0.5 * (v_all + 1)
    base, known = np.zeros(SYMBOLS), np.zeros(SYMBOLS, np.int64)
    base[: len(hot)] = np.log10((hot["n"].to_numpy(float) + 0.5) / denominator) if len(hot) else 0
    known[: len(hot)] = 1
    base[END], known[END] = np.log10((ends + 0.5) / denominator), int(ends > 0)
    shared = spark.sparkContext.broadcast((model, base, known))
    table.destroy()
    scored = encoded.select("key", "doc_id", "held_out", "seq").mapInPandas(_score(shared), "key long, doc_id long, held_out boolean, n_tokens long, hot_known long, hot_base double, path double")

    class_mass = F.element_at(F.lit([float(rest[c][0] + 0.5 * (rest[c][1] + 1)) for c in range(8)]), _rare_class(F.col("token")) + 1)
    c = F.coalesce(F.col("n"), F.lit(0)) + 0.5
    each = encoded.select("key", F.explode("rare").alias("token")).join(counts.hint("shuffle_hash"), "token", "left")
    each = each.select("key", F.col("n").isNotNull().cast("long").alias("known"), F.log10(c / denominator).alias("base"), F.log10(c / class_mass).alias("inside"))
    rare = each.groupBy("key").agg(F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("inside").alias("inside"))
    zero = lambda col, kind: F.coalesce(F.col(col), F.lit(0).cast(kind))
    return scored.join(rare, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("hot_known") + zero("known", "long")).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("hot_base") + zero("base", "double")).alias("base_score"), (F.col("path") + zero("inside", "double")).alias("score"),
    )


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = is_fold(F.col("doc_id"), 5, 1)
    return fit_and_score(docs, held, ~held & F.col("doc_id").isNotNull(), "op4")
