"""SimHash near-duplicates by the general pigeonhole principle.

The 64 bits of a fingerprint are dealt to parts so that correlated bits share
one. With thresholds t_1..t_m whose sum is ``distance - m + 1``, two
fingerprints within the distance differ in at most t_i bits of some part i
(-1 leaves a part out). A dynamic program picks the thresholds, not
necessarily equal, with the least estimated work from the counts of values
in each part; then parts are probed and candidates verified bit by bit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Texts, map_texts, written
from .graph import components

BITS = 64
SEED = 42

# Numbers of parts that are tried.
PARTS = (1, 2, 3)

# A probed value that more rows share is not joined pair by pair: its
# fingerprints meet at their neighbours instead. Both ways find every link.
CROWD = 32


def _fingerprint_run(width: int):
    xxh = xxhash.xxh64_intdigest

    def run(texts: Texts) -> dict[str, pa.Array]:
        hashes, sizes = [], []
        for t in texts.each():
            words = t.lower().split()  # on bytes: Latin capitals and ASCII white space only
            text = b" ".join(words)
            if len(words) <= width:
                row = [xxh(text, SEED)] if words else []
            else:
                stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                start = np.concatenate([[0], stop[:-width]])
                row = [xxh(text[a:b], SEED) for a, b in zip(start.tolist(), (stop[width - 1:] - 1).tolist())]
            hashes.append(np.array(row, np.uint64))
            sizes.append(len(row))
        return {"fingerprint": pa.array(majority(hashes, np.array(sizes)).view(np.int64))}
    return run


def majority(hashes: list[np.ndarray], sizes: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """Per text the bits that are set in over half of its hashes."""
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    votes = np.zeros((len(sizes), BITS), np.int64)
    owner = np.arange(len(sizes)).repeat(sizes)
    for i in range(0, len(flat), block):
        bits = np.unpackbits(flat[i:i + block].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        who, first = np.unique(owner[i:i + block], return_index=True)
        votes[who] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * votes > sizes[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(df: DataFrame, width: int = 3, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``fingerprint`` (bigint, the 64 bits) of the text's ``width``-word shingles, repeats included.

    Fewer words are one shingle; a null text or one without words has fingerprint 0.
    """
    return map_texts(df, text, lambda: _fingerprint_run(width), "fingerprint bigint", keep)


# --- the plan: parts, thresholds -------------------------------------------------------------

def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """(number of fingerprints, 64 x 64 counts of bits set together), summed by Spark from one matrix a task."""

    def run(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8)
            for i in range(0, len(raw), 1 << 16):
                x = np.unpackbits(raw[i:i + (1 << 16)], axis=1, bitorder="little").astype(np.float32)
                total += x.T @ x
            n += len(raw)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(total.reshape(-1), float(n)))], ["cell", "n"])

    cells = dict(map(tuple, fps.select("fingerprint").mapInArrow(run, "cell bigint, n double").groupBy("cell").agg(F.sum("n")).collect()))
    flat = np.array([cells.get(i, 0.0) for i in range(BITS * BITS + 1)])
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt to parts of like size: each part grows by the bit that correlates most with those in it."""
    p = together.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    like = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(like, 0)
    free, out = list(range(BITS)), []
    for k in range(parts):
        size = (BITS - sum(map(len, out))) // (parts - k)
        part = [max(free, key=lambda b: like[b, free].sum())]
        free.remove(part[0])
        while len(part) < size:
            best = max(free, key=lambda b: like[b, part].sum())
            free.remove(best)
            part.append(best)
        out.append(sorted(part))
    return out


def part_value(fp: Column, bits: list[int]) -> Column:
    """The fingerprint with the bits of other parts cleared."""
    mask = sum(1 << b for b in bits)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds with the given sum and least cost; ``costs[i][t + 1]`` is part i's cost at threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for k, more in enumerate(row):
                t = k - 1
                if s + t not in step or c + more < step[s + t][0]:
                    step[s + t] = (c + more, [*ts, t])
        best = step
    return best[total]


def plan(fps: DataFrame, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts to probe, for the least estimated rows and candidates."""
    n, together = bit_statistics(fps)
    p = together.diagonal() / max(n, 1)
    agree = p * p + (1 - p) ** 2
    tries = [group_bits(n, together, m) for m in PARTS]
    flat = [bits for parts in tries for bits in parts]
    values = F.array(*(F.struct(F.lit(i).alias("part"), part_value(F.col("fingerprint"), bits).alias("value")) for i, bits in enumerate(flat)))
    counts = fps.select(F.explode(values).alias("x")).groupBy("x.part", "x.value").count()
    # pairs with equal values, less where a crowd meets at its neighbours
    pairs = F.least(F.col("count") * (F.col("count") - 1) / 2, F.col("count") * (BITS + 1))
    same = dict(map(tuple, counts.groupBy("part").agg(F.sum(pairs)).collect()))
    options, at = [], 0
    for parts in tries:
        costs = []
        for bits in parts:
            base, at = float(same.get(at, 0.0)), at + 1
            # pairs that differ in one more bit are as many times more as bits disagree against agree
            more = float(((1 - agree[bits]) / agree[bits]).sum())
            row = [0.0, n + base]
            if distance >= 1:
                row.append(n * (2 + len(bits)) + base * (1 + more))
            if distance >= 2:
                row.append(n * (1 + len(bits)) * (1 if len(bits) == BITS else 2) + (0 if len(bits) == BITS else base * (1 + more + more * more / 2)))
            costs.append(row)
        cost, ts = allocate(costs, distance - len(parts) + 1)
        options.append((cost, [(bits, t) for bits, t in zip(parts, ts) if t >= 0]))
    return min(options, key=lambda o: o[0])[1]


# --- probing ---------------------------------------------------------------------------------

def near(fp: Column, bits: list[int]) -> list[Column]:
    """The value itself and with each one of the bits flipped."""
    return [fp, *(fp.bitwiseXOR(F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b)) for b in bits)]


def probes(fps: DataFrame, chosen: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, fp, own): the values each fingerprint is found under; ``own``: its value is the key itself."""
    rows = []
    for i, (bits, t) in enumerate(chosen):
        for j, key in enumerate(near(part_value(F.col("fingerprint"), bits), bits if t else [])):
            rows.append(F.struct(F.lit(i).alias("part"), key.alias("key"), F.col("fingerprint").alias("fp"), F.lit(j == 0 or t > 1).alias("own")))
    return fps.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def meet(fps: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) of fingerprints within the distance, as stars, without pairs.

    Distance 2: fingerprints that share a neighbour (or are one) are within 2
    of each other, so all linked to the least of them keep their component.
    Distance 1: each is linked to those neighbours that exist. At most 65
    fingerprints meet at one key.
    """
    keys = fps.select("fp", F.posexplode(F.array(*near(F.col("fp"), list(range(BITS)) if distance else []))).alias("j", "key"))
    hub = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("least"), F.max(F.when(F.col("j") == 0, F.col("fp"))).alias("own")).where("n > 1")
    hub = hub.select("key", (F.col("least") if distance == 2 else F.col("own")).alias("hub")).where("hub is not null")
    return keys.join(hub, "key").select(F.col("fp").alias("a"), F.col("hub").alias("b")).where("a <> b")


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Links (a, b) that connect exactly what the pairs of distinct fingerprints within ``distance`` (0, 1 or 2) connect."""
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")
    found = probes(fps, plan(fps, distance))
    shared = found.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    found = written(found.join(shared, ["part", "key"]), "probes")
    few = found.where(F.col("n") <= CROWD)
    left, right = few.alias("l"), few.alias("r")
    pairs = (left.join(right, (F.col("l.part") == F.col("r.part")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.fp") < F.col("r.fp")))
             .where(F.col("l.own") | F.col("r.own")).where(F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= distance)
             .select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b")))
    crowd = found.where(F.col("n") > CROWD).select("fp").distinct()
    return pairs.unionByName(meet(crowd, distance))


def label(rows: DataFrame, distance: int = 2) -> DataFrame:
    """Add ``first``: the first row (least ``place``) of each row's component; ``rows`` has fingerprint and place (any ordered type).

    Copies are one fingerprint before any link is sought, so a group of
    copies costs one row a task. The last join is by fingerprint; Spark
    splits the partition of a hot one.
    """
    fps = written(rows.groupBy("fingerprint").agg(F.min("place").alias("first")), "fingerprints")
    roots = components(links(fps, distance))
    owned = fps.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    best = owned.groupBy("root").agg(F.min("first").alias("best"))
    owned = owned.join(best, "root").select(F.col("fingerprint").alias("fp"), F.col("best").alias("first"))
    return rows.join(owned, F.col("fingerprint") == F.col("fp")).drop("fp")


def report(docs: DataFrame, width: int = 3, distance: int = 2) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (the least doc_id that links reach).

    A null doc_id is never an id of a component that has another one.
    """
    rows = written(fingerprints(docs.select("doc_id", "text"), width, keep=["doc_id"]), "simhash")
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"))
    done = label(rows.withColumn("place", place), distance)
    return done.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id"))


def keep_first(docs: DataFrame, width: int = 3, distance: int = 2) -> DataFrame:
    """One document of each component, in the documents' own columns: the one with the least doc_id.

    Rows with the same doc_id are told apart, and one of them stays.
    """
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), "text")
    rows = fingerprints(packed, width, keep=["row", "id"]).withColumn("number", F.monotonically_increasing_id())
    rows = written(rows, "simhash")
    place = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("number").alias("number"))
    fps = rows.select("fingerprint", place.alias("place"))
    first = label(fps, distance).where("place = first").select(F.col("place.number").alias("kept"))
    return rows.join(first, F.col("number") == F.col("kept"), "left_semi").select("row.*")
