"""Sharding over fixed virtual slots.

Records hash into a fixed, large number of virtual slots. Bytes are aggregated per
slot (a table of at most `n_slots` rows, whatever the corpus), and a versioned
slot-to-shard map is stored and edited: rebalancing starts from the newest stored map,
moves few slots between shards and never rehashes a record.

A record's slot is a hash of its id. Records of one id are spread over `COPIES` slots by
a row number if the id is null or occurs more than `HOT` times, so that a hot id is neither one slot nor one task; which ids are hot follows from
counts over all records and changes no other record's slot.

Defined cases: a null text counts as no bytes; null ids are spread like a hot id;
repeated rows are separate records; an empty table gives an empty result and the
initial map; columns of the input named like an output column are replaced.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfold.llm.workspace import Workspace

N_SLOTS = 4096
HOT, COPIES = 64, 1024  # copies of an id from which it is spread, and over how many slots
RANKED = 1 << 14  # records of a slot that are ranked together, on average


@dataclass(frozen=True)
class SlotMap:
    """One version of the map; shards[i] is the shard of virtual slot i."""

    version: int
    n_shards: int
    shards: tuple[int, ...]
    moved: tuple[int, ...] = field(default=())

    def loads(self, weight: dict[int, int]) -> list[int]:
        out = [0] * self.n_shards
        for slot, w in weight.items():
            out[self.shards[slot]] += w
        return out


def initial_map(n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
    """Version 0: equal runs of slots."""
    return SlotMap(0, n_shards, tuple(slot * n_shards // n_slots for slot in range(n_slots)))


def _nearest(ordered: list[tuple[int, int]], wanted: float) -> tuple[int, int] | None:
    """The (weight, slot) of a sorted list whose weight is nearest to the one wanted."""
    i = bisect_left(ordered, (wanted, -1))
    return min(ordered[max(0, i - 1) : i + 1], key=lambda x: (abs(x[0] - wanted), x), default=None)


def _best_swap(heavy: list[tuple[int, int]], light: list[tuple[int, int]], gap: int) -> tuple[tuple[int, int], tuple[int, int]] | None:
    """Slots of two shards, sorted by weight, whose exchange brings the shards closest."""
    best = None
    for a in heavy:
        b = _nearest(light, a[0] - gap / 2)
        if b and 0 < a[0] - b[0] < gap and (best is None or abs(a[0] - b[0] - gap / 2) < abs(best[0][0] - best[1][0] - gap / 2)):
            best = a, b
    return best


def rebalance(current: SlotMap, weight: dict[int, int], tolerance: float = 0.0005) -> SlotMap:
    """Move slots from the heaviest to the lightest shard until they differ by at most the tolerance of a mean shard.

    Each move takes the slot whose weight is nearest to half of the gap, so it always
    narrows it; when no single slot can, the best swap of two slots is made; without
    one it stops.
    """
    shards = list(current.shards)
    members: list[list[tuple[int, int]]] = [[] for _ in range(current.n_shards)]
    for slot, w in sorted(weight.items()):
        if w > 0:
            insort(members[shards[slot]], (w, slot))
    load = [sum(w for w, _ in m) for m in members]
    allowed = max(1.0, tolerance * sum(load) / max(1, len(load)))

    def give(item: tuple[int, int], src: int, dst: int) -> None:
        members[src].remove(item)
        insort(members[dst], item)
        load[src] -= item[0]
        load[dst] += item[0]
        shards[item[1]] = dst

    for _ in range(20 * len(shards)):
        order = sorted(range(len(load)), key=lambda k: (load[k], k))
        heavy, gave = order[-1], False
        if load[heavy] - load[order[0]] <= allowed:
            break
        for light in order[:-1]:
            gap = load[heavy] - load[light]
            one = _nearest(members[heavy], gap / 2)
            if one and one[0] < gap:
                give(one, heavy, light)
                gave = True
            elif two := _best_swap(members[heavy], members[light], gap):
                give(two[0], heavy, light)
                give(two[1], light, heavy)
                gave = True
            if gave:
                break
        if not gave:
            break
    moved = tuple(s for s in range(len(shards)) if shards[s] != current.shards[s])
    return SlotMap(current.version + 1, current.n_shards, tuple(shards), moved)


def grow(current: SlotMap, weight: dict[int, int]) -> SlotMap:
    """Add one shard, which takes slots from the others until it holds its share; no slot moves elsewhere."""
    shards, new = list(current.shards), current.n_shards
    load = {k: w for k, w in enumerate(current.loads(weight))} | {new: 0}
    share = sum(load.values()) / (new + 1)
    for slot in sorted(weight, key=lambda s: (-weight[s], s)):
        src = shards[slot]
        if load[src] - weight[slot] >= share * 0.98 and load[new] + weight[slot] <= share * 1.02:
            shards[slot] = new
            load[src] -= weight[slot]
            load[new] += weight[slot]
    moved = tuple(s for s in range(len(shards)) if shards[s] != current.shards[s])
    return SlotMap(current.version + 1, new + 1, tuple(shards), moved)


def shrink(current: SlotMap, weight: dict[int, int]) -> SlotMap:
    """Take the last shard away: its slots, heaviest first, go to the shard that holds least by then; no other slot moves."""
    shards, last = list(current.shards), current.n_shards - 1
    load = current.loads(weight)[:last]
    for slot in sorted((s for s, k in enumerate(shards) if k == last), key=lambda s: (-weight.get(s, 0), s)):
        to = min(range(last), key=lambda k: (load[k], k))
        shards[slot] = to
        load[to] += weight.get(slot, 0)
    moved = tuple(s for s in range(len(shards)) if shards[s] != current.shards[s])
    return SlotMap(current.version + 1, last, tuple(shards), moved)


_MAP = "n_shards int, vslot int, shard int"


def store_map(spark: SparkSession, m: SlotMap, path: str) -> None:
    """Each version is a folder of its own and is never changed after."""
    rows = [(m.n_shards, slot, shard) for slot, shard in enumerate(m.shards)]
    spark.createDataFrame(rows, _MAP).coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={m.version}")


def _versions(spark: SparkSession, path: str) -> dict[int, bool]:
    """The versions in the folder at path, and whether each was written to its end; none if there is no such folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in store.listStatus(folder)] if store.exists(folder) else []
    return {int(p.getName().removeprefix("version=")): store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")) for p in found}


def stored_versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that can be read, in order; a write that was cut short is none."""
    return sorted(v for v, whole in _versions(spark, path).items() if whole)


def next_version(spark: SparkSession, path: str) -> int:
    """A number beyond all that were begun, so that a write that was cut short stands in nobody's way."""
    return max(_versions(spark, path), default=-1) + 1


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """The version asked for, or the newest."""
    known = stored_versions(spark, path)
    version = known[-1] if version is None and known else version
    if version not in known:
        raise ValueError(f"no version {version} of the slot map at {path}; stored are {known}")
    rows = sorted((r["vslot"], r["shard"], r["n_shards"]) for r in spark.read.schema(_MAP).parquet(f"{path}/version={version}").collect())
    return SlotMap(version, rows[0][2], tuple(r[1] for r in rows))


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def virtual_slot(key: Column, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_slots)).cast("int")


def with_slot(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """docs with vslot. Hot ids are a table of at most a HOT-th of the rows, and joined only if there are any."""
    home = virtual_slot(F.col("doc_id"), n_slots)
    spread = F.pmod(home + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(COPIES)), F.lit(n_slots)).cast("int")
    hot = docs.filter("doc_id is not null").groupBy("doc_id").count().filter(F.col("count") > HOT).select("doc_id", F.lit(True).alias("_hot"))
    docs = docs.drop("vslot")
    if hot.isEmpty():
        return docs.withColumn("vslot", F.when(F.col("doc_id").isNull(), spread).otherwise(home))
    return docs.join(hot, "doc_id", "left").withColumn("vslot", F.when(F.col("doc_id").isNull() | F.col("_hot"), spread).otherwise(home)).select(*docs.columns, "vslot")


def slot_loads(slotted: DataFrame) -> list:
    """(vslot, bytes, records) of each slot that has any: at most n_slots rows. slotted has vslot and size."""
    return slotted.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("records")).collect()


def updated_map(spark: SparkSession, loads: list, n_shards: int, path: str | None, n_slots: int = N_SLOTS) -> SlotMap:
    """The newest stored map, or the initial one, grown or shrunk to the number of shards and rebalanced for the loads. With a path, each of these steps that changes the map is stored as the next version."""
    weight = {r["vslot"]: r["bytes"] for r in loads}
    known = stored_versions(spark, path) if path else []

    def stored(m: SlotMap) -> SlotMap:
        if path:
            m = replace(m, version=next_version(spark, path))
            store_map(spark, m, path)
        return m

    now = load_map(spark, path) if known else stored(initial_map(n_shards, n_slots))
    while now.n_shards != n_shards:
        now = stored((grow if now.n_shards < n_shards else shrink)(now, weight))
    return stored(rebalance(now, weight)) if loads else now


def shard_of(m: SlotMap) -> Column:
    """The shard of vslot; the map is n_slots literals."""
    return F.element_at(F.lit(list(m.shards)).cast("array<int>"), F.col("vslot") + 1)


def assign_shards(docs: DataFrame, n_shards: int, map_path: str, ws: Workspace) -> DataFrame:
    """docs with vslot and shard. Slots are written once, since a hot id's row numbers may differ in a second evaluation."""
    kept = docs.drop("vslot", "shard")
    slotted = ws.save(with_slot(kept), "slotted")
    m = updated_map(docs.sparkSession, slot_loads(slotted.select("vslot", record_size(F.col("text")).alias("size"))), n_shards, map_path)
    return slotted.withColumn("shard", shard_of(m))


def shard_records(docs: DataFrame, n_shards: int = 8, map_path: str | None = None, name: str = "shards") -> DataFrame:
    """Every record with its shard and its place in the shard, gapless from 0.

    Records are ranked in groups of about RANKED: a slot's records are dealt into
    as many groups as its count asks for, so no task orders a whole shard or slot. A place
    is the records of the shard's groups before plus the rank in the group.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, name)
    rows = docs.select("doc_id", "text")
    rows = with_slot(rows).select("doc_id", record_size(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), "vslot", F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    rows = ws.save(rows, "slotted")
    loads = slot_loads(rows)
    m = updated_map(spark, loads, n_shards, map_path)
    groups = [1] * len(m.shards)
    for r in loads:
        groups[r["vslot"]] = -(-r["records"] // RANKED)
    part = F.pmod("salt", F.element_at(F.lit(groups).cast("array<int>"), F.col("vslot") + 1)).cast("int")
    rows = rows.withColumns({"shard": shard_of(m), "part": part})
    held = rows.groupBy("shard", "vslot", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("vslot", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size"))
    ranked = rows.withColumn("rank", rank)
    return ranked.join(starts, ["vslot", "part"]).select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("start") + F.col("rank") - 1).alias("slot"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ws = Workspace(spark, "op10_map")
    return shard_records(docs, 8, f"{ws.path}/slot_map", "op10").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot"
    )
